"""Queries over pages: JSON trees of unknown depth (structured data, payloads to redact, widget states of a store) and the forms of search pages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import titles as ti
from ..registry import query
from ..sources import cards, extract, search_pages, trees
from ..sources import relations as r
from ..sources.relations import with_views

KIND, OFFER = """CASE WHEN p_partkey % 3 = 0 THEN '["Thing","Product"]' ELSE '"Product"' END""", """CASE WHEN p_partkey % 2 = 0 THEN '{"price":' || p_size || '}' ELSE '[{"lowPrice":"1 ' || (100 + p_size) || ',5"}]' END"""
#: Forms in which a page holds its product: plain, in a graph, in arrays of a graph's object, where no one looks, after a broken script.
FORMS = (
    """product""", """'{"@context":"x","@graph":[{"@type":"WebPage","name":"w"},' || product || ']}'""", """'[[{"@graph":' || product || '}],' || product || ']'""", """'{"mainEntity":' || product || '}'""",
    """'{broken</script><script type="application/ld+json">' || product""",
)
@query("s27_structured_products", """SELECT p_partkey AS page_id, n AS place, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE ELSE 1100.5::DOUBLE + p_size END AS price
FROM part, range(2) t(n) WHERE p_partkey % 5 <> 3 AND (n = 0 OR p_partkey % 5 = 2)""")  # fmt: skip
def s27(spark, d):
    """Products in the structured data of a page for every part, in several forms of nesting."""
    product = F.concat(F.lit('{"@type":'), F.expr(KIND), F.lit(',"name":"'), "p_name", F.lit('","offers":'), F.expr(OFFER), F.lit("}"))
    form = F.coalesce(*[F.when(F.col("p_partkey") % len(FORMS) == k, F.expr(f)) for k, f in enumerate(FORMS)])
    pages = r.table(spark, d, "part").withColumn("product", product).select(F.col("p_partkey").alias("page_id"), F.concat(F.lit('<script type="application/ld+json">'), form, F.lit("</script>")).alias("html"))
    return trees.structured_products(pages, F.regexp_extract_all("html", F.lit(extract.SCRIPTS), F.lit(1))).select("page_id", "place", "name", "price")


GIVEN = """'{"page_url":"https://x/p/' || event_id || '?token=1#a","search_query":" ' || name || '","authToken":"s","n":' || event_id || ',"deep":{"Email":"a@b","title":"' || repeat('y', 90) || '","on":true,"none":null,"deeper":{"note":"' || repeat('x', 400) || '","prompt":{"a":1},"list":["' || repeat('z', 130) || '",2,{"password":1}],"last":{"password":"p"}}}}'"""


@query("f20_redacted_trees", with_views("""SELECT event_id, '{"deep":{"deeper":{"last":{},"list":["' || repeat('z', 120) || '",2,{"password":1}],"note":"' || repeat('x', 299) || '…"},"none":null,"on":true,"title":"' || repeat('y', 79) || '…"},"n":' || event_id || ',"page_url":"https://x/p/' || event_id || '","search_query":"' || name || '"}' AS redacted FROM telemetry_events"""))
def f20(spark, d):
    """Nested payloads of all events without private fields at any depth, long values cut."""
    given = r.telemetry_events(spark, d).select("event_id", F.expr(GIVEN).alias("payload"))
    return trees.redacted(given, "event_id", "payload")


#: Widget states of a page, by the product's number: a heading and a rating, nested prices, a price found in depth, two headings, a search item, nothing to read.
STATES = (
    """'{"webProductHeading":' || q('{"title":"' || p_name || '","price":"' || a || ' ₽","originalPrice":"' || (a + 500) || ' ₽"}') || ',"webReviewScore":' || q('{"totalScore":4.66,"count":"12 reviews"}') || '}'""",
    """'{"webPrice-1":' || q('{"priceV2":{"price":[{"text":"' || a || ' ₽"},{"text":"' || (a * 2) || ' ₽"}]},"atom":{"text":"' || p_name || '"}}') || '}'""",
    """'{"pdpMain":' || q('{"x":[{"y":1}],"nested":{"webSale":{"title":"' || p_name || '","cardPrice":"' || a || '"}}}') || '}'""",
    """'{"product1":' || q('{"title":"first","price":' || (a + 1) || ',"rating":5}') || ',"bad":"{","product2":' || q('{"title":"' || p_name || '","price":' || a || ',"reviewsCount":7}') || '}'""",
    """'{"searchResults":' || q('{"items":[{"noise":1},{"title":"' || p_name || '","price":"' || a || '"}]}') || '}'""",
    """'{"note":"plain","empty":' || q('{"x":1}') || '}'""",
)


@query("n47_widget_offers", """WITH p AS (SELECT p_partkey AS page_id, p_name, p_partkey % 6 AS f, (1000 + p_partkey % 7000)::DOUBLE AS a FROM part)
SELECT page_id, CASE WHEN f < 5 THEN p_name END AS title, CASE WHEN f < 5 THEN a END AS price, CASE f WHEN 0 THEN a + 500 WHEN 1 THEN a * 2 END AS old,
CASE f WHEN 0 THEN 4.7::DOUBLE END AS rating, CASE f WHEN 0 THEN 12 WHEN 3 THEN 7 END AS reviews FROM p""")  # fmt: skip
def n47(spark, d):
    """The offer in a page's widget states, for every part, in several forms."""
    quoted = lambda sql: re.sub(r"\bq\((.*?\}'|'[^()]*?')\)(?= \|\|)", lambda m: f"substring(to_json(array({m[1]})), 2, length(to_json(array({m[1]}))) - 2)", sql)
    form = F.coalesce(*[F.when(F.col("p_partkey") % len(STATES) == k, F.expr(quoted(f))) for k, f in enumerate(STATES)])
    pages = ti.spread(r.table(spark, d, "part")).withColumn("a", F.expr("1000 + p_partkey % 7000")).select(F.col("p_partkey").alias("page_id"), form.alias("states"))
    return extract.widget_offers(pages)


#: Pieces of search pages, by store: a tile or a link with a price, a link with its title before it, an id with a title around it; each id also comes again later.
PIECES = {
    "megamarket": ("""'<div data-product-id="' || a || '"><h3>' || p_name || ' tile</h3><b>1 500 ₽</b></div>'""", """'<i title="' || p_name || ' titled"></i>' || repeat('.', 150) || '<a href="/catalog/details/x-' || b || '/?q=1"><b>x</b></a>'""", """'<a href="/catalog/details/y-' || a || '/">again</a><a href="/catalog/details/z-' || c || '/">' || p_name || ' <i>linked</i></a>'"""),
    "aliexpress": ("""'<a href="/item/' || a || '.html?x=1"> ' || p_name || ' <b>tile</b></a>'""", """repeat('-', 300) || '<img alt="' || p_name || ' titled"> 2 300 руб <a href="https://aliexpress.ru/item/' || b || '.html">x</a>'""", """repeat('-', 300) || '"/item/' || c || '" title="' || p_name || ' linked" "/item/' || a || '"'"""),
    "mvideo": ("""'<a href="/products/name-' || a || '">' || p_name || ' tile 1 999 ₽</a><a href="/product-list-page/products/q-999999">' || p_name || '</a>'""", """repeat('-', 300) || '<img title="' || p_name || ' titled"><a href="https://www.eldorado.ru/cat/detail/n-' || b || '/">x</a>'""", """repeat('-', 300) || '<i title="' || p_name || ' linked">/products/n' || c || '</i>'"""),
}
PAGE_STORES = tuple(PIECES)


@query("s18_s20_tiers", f"""WITH g AS (SELECT p_partkey AS page_id, {r._sql_pick(PAGE_STORES, 'p_partkey')} AS store, p_name, 100000000 + p_partkey * 10 AS n FROM part)
SELECT page_id, k::INT AS place, (n + k + 1)::VARCHAR AS id, CASE WHEN store = 'mvideo' AND k = 0 THEN p_name || ' tile 1 999 ₽' ELSE p_name || ' ' || ['tile', 'titled', 'linked'][k + 1] END AS title,
CASE WHEN k = 0 AND store = 'megamarket' THEN 1500.0::DOUBLE WHEN k = 0 AND store = 'mvideo' THEN 1999.0::DOUBLE WHEN k = 1 AND store = 'aliexpress' THEN 2300.0::DOUBLE END AS price,
CASE store WHEN 'megamarket' THEN 'https://megamarket.ru/catalog/details/' || (n + k + 1) || '/' WHEN 'aliexpress' THEN 'https://aliexpress.ru/item/' || (n + k + 1) || '.html' ELSE CASE WHEN k = 1 THEN 'https://www.eldorado.ru/cat/detail/' || (n + k + 1) || '/' ELSE 'https://www.mvideo.ru/products/' || (n + k + 1) END END AS url
FROM g, range(3) t(k)""")
def s18(spark, d):
    """Candidates on a search page for every product, in all forms that its store's pages have: tiles, links with a title before them, bare ids with one around them."""
    store, n = r.pick(PAGE_STORES, F.col("p_partkey")), F.lit(100_000_000) + F.col("p_partkey") * 10
    part = ti.spread(r.table(spark, d, "part")).select("p_partkey", "p_name", store.alias("store"), *[(n + k + 1).cast("string").alias(c) for k, c in enumerate("abc")])
    html = F.coalesce(*[F.when(F.col("store") == s, F.concat(F.lit("<html>"), *[F.expr(p) for p in pieces], F.lit(" " * 200))) for s, pieces in PIECES.items()])
    return search_pages.candidates(part.select(F.col("p_partkey").alias("page_id"), "store", html.alias("html"), F.col("p_name").alias("reference"))).drop("confidence")


#: Cards by store, in the forms of its tiers: structured data of several kinds, meta data, embedded state, style classes, and pages without a price.
CARDS = {
    "yandex_market": (
        """'<script type="application/ld+json">{"a":{"b":[{"name":"' || p_name || '","offers":[{"price":0},{"lowPrice":"1 ' || (100 + p_size) || '"}]}]}}</script>'""", """'<title> ' || p_name || '</title><meta content="' || (1100 + p_size) || '" itemprop="price">'""",
        """'<script>{"prices":{"x":1,"value":"' || (1100 + p_size) || '"}}</script>'""", """'<meta itemprop="price" content="5"> showcaptcha'""",
    ),
    "wildberries": (
        """'{"brand":"ACME","imt_name":"' || p_name || ' \\\\u0441","salePriceU":' || (110000 + p_size * 100) || '}'""", """'{"imt_name":"' || p_name || '","salePriceU":0,"priceU":' || (110000 + p_size * 100) || '}'""", """'{"imt_name":"' || p_name || '"}'""", """'{"priceU":' || (110000 + p_size * 100) || '}'""",
    ),
    "megamarket": (
        """'<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"gone","offers":{"price":1,"availability":"x/OutOfStock"}},{"@type":["Thing","Product"],"brand":{"name":"ACME"},"name":" ' || p_name || ' ","offers":[{"lowPrice":"1 ' || (100 + p_size) || ',4"}]}]}</script>'""",
        """'<meta property="og:title" content="' || p_name || '"><meta property="product:price:amount" content="' || (1100 + p_size) || ',4">'""", """'<script type="application/ld+json">{"mainEntity":{"@type":"Product","offers":{"price":5}}}</script>'""", """'robot check<meta itemprop="price" content="500">'""",
    ),
    "mvideo": (
        """'<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"Product","name":"' || p_name || '","price":"' || (1100 + p_size) || '"}]</script>'""", """'<meta property="og:title" content="' || p_name || '"><div class="a price__main-value b"> 1 ' || (100 + p_size) || ' ₽</div>'""",
        """'<meta itemprop="price" content="99">'""", """'<script type="application/ld+json">{"@type":"Product","name":"' || p_name || '","offers":{"price":7,"availability":"SoldOut"}}</script>'""",
    ),
}
CARD_STORES = tuple(CARDS)


@query("s22_s26_tiers", f"""WITH x AS (SELECT p_partkey AS page_id, p_name, (1100 + p_size)::BIGINT AS price, {r._sql_pick(CARD_STORES, 'p_partkey')} AS store, p_partkey // 4 % 4 AS f FROM part)
SELECT page_id, CASE WHEN f < 2 OR (f = 2 AND store = 'yandex_market') OR (f = 3 AND store = 'wildberries') THEN price END AS price,
CASE WHEN f = 0 AND store = 'wildberries' THEN 'ACME ' || p_name || ' с' WHEN f = 0 AND store = 'megamarket' THEN 'ACME ' || p_name WHEN f < 2 THEN p_name END AS title FROM x""")
def s22(spark, d):
    """Price and title of a card for every part, in the forms of all tiers of four stores."""
    k = F.col("p_partkey")
    form = F.expr("p_partkey div 4 % 4")
    html = F.coalesce(*[F.when((r.pick(CARD_STORES, k) == s) & (form == n), F.expr(f)) for s, forms in CARDS.items() for n, f in enumerate(forms)])
    return cards.cards(r.table(spark, d, "part").select(k.alias("page_id"), r.pick(CARD_STORES, k).alias("store"), html.alias("html")))
