"""Reviews, prices and products from raw pages.

Patterns run as expressions in the JVM; JSON of unknown depth is walked as VARIANT (trees.py), bounded in depth and in results a page, as the contract says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rating
from ..functions.price_text import offer_prices, ozon_numbers
from ..functions.titles import let
from . import trees
from .shared import stored

#: Keys under which a review's text and rating are looked for; deepest level; most reviews of a page; bounds of a text.
TEXT_KEYS, RATING_KEYS = ("text", "comment", "body", "content", "reviewbody", "description"), ("rating", "grade", "score", "stars", "productvaluation", "ratingvalue")
DEEPEST, MOST, SHORTEST, LONGEST = 16, 40, 15, 2000

SCRIPTS = r'(?is)<script[^>]*type="application/(?:ld\+)?json"[^>]*>(.*?)</script>'
MARKUP = r'(?is)<(?:p|div|span)[^>]*(?:data-review-text|itemprop="reviewBody"|class="[^"]*review[^"]*text[^"]*")[^>]*>(.*?)</(?:p|div|span)>'
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def plain(html: Column, entities: dict[str, str] = ENTITIES) -> Column:
    """Text of a piece of markup: no tags, entities read, single spaces."""
    x = F.regexp_replace(html, r"(?s)<[^>]+>", " ")
    for name, char in entities.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def markup_reviews(pages: DataFrame) -> DataFrame:
    """page_id, place, text of review blocks in the markup: 15 to 2000 characters, different, at most 40 a page."""
    blocks = F.transform(F.regexp_extract_all("html", F.lit(MARKUP), 1), lambda h: plain(h))
    good = F.slice(F.array_distinct(F.filter(blocks, lambda t: (F.length(t) >= SHORTEST) & (F.length(t) <= LONGEST))), 1, MOST)
    return pages.select("page_id", F.posexplode(good).alias("place", "text"))


def json_reviews(pages: DataFrame) -> DataFrame:
    """page_id, place, text, rating of reviews in embedded JSON, to a depth of 16, at most 40 different texts a page, in the order of a walk in depth. Bad JSON gives none."""
    scripts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPTS), 1)).alias("script", "json")).withColumn("tree", F.try_parse_json("json"))
    nodes = trees.descend(scripts, ["page_id", "script"], "tree", DEEPEST)
    low = F.transform(F.map_entries(trees.fields(F.col("node"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    of = lambda k: F.try_element_at(F.filter("low", lambda e: e["key"] == k), F.lit(-1))["value"]
    said = lambda v: F.when(F.length(F.trim(trees.text(v))).between(SHORTEST, LONGEST), F.trim(trees.text(v)))
    rated = lambda v: F.when(trees.number(v).between(1, 5), trees.number(v))
    found = nodes.select("page_id", "script", "path", low.alias("low")).where("low IS NOT NULL").select("page_id", "script", "path", F.coalesce(*[said(of(k)) for k in TEXT_KEYS]).alias("text"), F.coalesce(*[rated(of(k)) for k in RATING_KEYS]).alias("rating"))
    first = F.row_number().over(Window.partitionBy("page_id", "text").orderBy("script", "path"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("script", "path")) - 1
    return found.where("text IS NOT NULL").withColumn("n", first).where("n = 1").withColumn("place", place).where(F.col("place") < MOST).select("page_id", "place", "text", "rating")


def heading(html: Column) -> Column:
    """Text of a page's first heading, of entities only &amp; read; empty without one."""
    return plain(F.regexp_extract(html, HEADING, 1), {"&amp;": "&"})


def card(pages: DataFrame) -> DataFrame:
    """page_id, title, price, old_price, rating of a product card: structured data first, then markup."""
    got = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    number = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s ]", ""), ",", ".").try_cast("double")
    title = F.coalesce(got(r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]+)"'), plain(got(HEADING)), plain(got(r"(?is)<title[^>]*>(.*?)</title>")))
    price = F.coalesce(number(got(r'(?is)itemprop="price"[^>]*content="([\d.,\s]+)"')), number(got(r'"(?:price|lowPrice)"\s*:\s*"?([\d.]{2,})')), number(got(r"(?is)>\s*([\d\s ]{2,12})\s*₽")))
    return pages.select("page_id", title.alias("title"), price.alias("price"), number(got(r"(?is)<(?:del|s)[^>]*>\s*([\d\s ]{2,12})")).alias("old_price"), number(got(r"(\d[.,]\d)\s*(?:из\s*5|/\s*5)")).alias("rating"))


#: Words of pages that keep robots out, looked for at their start; states in which nothing can be bought.
BLOCKED, BLOCKED_WITHIN = r"(?i)captcha|доступ ограничен|access denied|are you a robot|слишком много запросов", 8000
GONE = r"(?i)OutOfStock|SoldOut|Discontinued"
#: Stores whose cards are read from structured data first, or from embedded state in hundredths; least price of the others' meta data.
STRUCTURED, HUNDREDTHS, SKIPS_GONE, LEAST_META = ("yandex_market", "megamarket", "aliexpress", "mvideo"), ("wildberries",), ("megamarket", "aliexpress", "mvideo"), {"mvideo": 100}


def store_cards(pages: DataFrame) -> DataFrame:
    """pages (store, html) with price and title of the card, by the store's rules: nothing from pages that keep robots out; structured data (first offer's price
    or low price, but not of what is sold out where the store says so), embedded state in hundredths, or meta data first, the others after it."""
    got = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    number = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s ]", ""), ",", ".").try_cast("double")
    store = F.col("store")
    open_ = ~F.substring("html", 1, BLOCKED_WITHIN).rlike(BLOCKED)
    offer = F.regexp_extract("html", SCRIPTS, 1)
    structured = F.nullif(F.coalesce(F.nullif(F.regexp_extract(offer, r'"price"\s*:\s*"?([\d.,\s]+)', 1), F.lit("")), F.regexp_extract(offer, r'"lowPrice"\s*:\s*"?([\d.,\s]+)', 1)), F.lit(""))
    buyable = ~store.isin(*SKIPS_GONE) | ~offer.rlike(GONE)
    state = number(F.coalesce(got(r'"salePriceU"\s*:\s*(\d+)'), got(r'"priceU"\s*:\s*(\d+)')))
    meta = number(F.coalesce(got(r'(?is)itemprop="price"[^>]*content="([\d.,\s]+)"'), got(r'(?is)property="product:price:amount"[^>]*content="([\d.,\s]+)"')))
    least = F.coalesce(*[F.when(store == s, F.lit(v)) for s, v in LEAST_META.items()], F.lit(1))
    from_meta = F.when(meta >= least, meta)
    from_structure = F.when(buyable, number(structured))
    hundred = F.when(state >= 1000, F.floor(state / 100 + 0.5)).otherwise(state)
    price = F.when(store.isin(*STRUCTURED), F.coalesce(from_structure, from_meta)).when(store.isin(*HUNDREDTHS), F.coalesce(hundred, from_meta)).otherwise(F.coalesce(from_meta, from_structure))
    name = F.coalesce(got(r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]+)"'), F.nullif(F.regexp_extract(offer, r'"name"\s*:\s*"([^"]+)"', 1), F.lit("")), got(r'"imt_name"\s*:\s*"([^"]+)"'), plain(got(r"(?is)<h1[^>]*>(.*?)</h1>")), plain(got(r"(?is)<title[^>]*>(.*?)</title>")))
    return pages.withColumn("price", F.when(open_ & (price > 0), F.floor(price + 0.5))).withColumn("title", F.when(open_, name))


#: Names of widgets that tell ratings, that are a product's, and that are searched in depth; the title of a card without one; how deep.
RATING_WIDGET, PRODUCT_WIDGET, DEEP_WIDGET = r"(?i)rating|review|score", r"(?i)webPrice|webSale|product", r"(?i)webPrice|webSale|pdp|productHeading|webProduct"
UNTITLED, WIDGET_DEPTH = "Товар на Ozon", 8


def _amount(v: Column) -> Column:
    """A price that is a positive number, rounded, or the digits of a text; else null."""
    digits = F.regexp_replace(trees.text(v), r"\D", "").try_cast("double")
    return F.nullif(F.coalesce(F.when(trees.number(v) > 0, F.floor(trees.number(v) + 0.5).cast("double")), digits), F.lit(0.0))


def widget_offer(node: Column) -> Column:
    """struct(title, price, old, rating, reviews) of a widget's state (VARIANT), null without a price: its own price or card price, then two nested lists of prices, then the atom's."""
    at = lambda *path: F.try_variant_get(node, "$." + ".".join(path), "variant")
    listed = lambda *path: F.transform(trees.items(at(*path)), lambda p: _amount(F.try_variant_get(p, "$.text", "variant")))
    numbers = lambda *path: offer_prices(ozon_numbers(F.filter(F.coalesce(listed(*path), F.array().cast("array<double>")), lambda v: v.isNotNull())))
    own = F.coalesce(_amount(at("price")), _amount(at("cardPrice")))
    given = F.struct(own.alias("own"), numbers("priceV2", "price").alias("v2"), numbers("webPrice", "price").alias("web"), _amount(F.when(trees.is_text(at("webPrice", "price")), at("webPrice", "price"))).alias("said"), _amount(at("originalPrice")).alias("old"))

    def told(g: Column) -> Column:
        price = F.coalesce(g["own"], g["v2"]["price"], g["said"], g["web"]["price"], _amount(at("webPrice", "cardPrice")), _amount(at("atom", "price")))
        # the list that gave the price gives the old price too
        old = F.when(g["own"].isNotNull(), g["old"]).when(g["v2"]["price"].isNotNull(), g["v2"]["old"]).when(g["said"].isNull() & g["web"]["price"].isNotNull(), F.coalesce(g["web"]["old"], g["old"])).otherwise(g["old"])
        title = F.coalesce(F.nullif(F.trim(trees.text(at("title"))), F.lit("")), F.nullif(F.trim(trees.text(at("atom", "text"))), F.lit("")), F.lit(UNTITLED))
        rated, counted = F.coalesce(*[trees.number(at(k)) for k in ("rating", "totalScore", "score")]), F.coalesce(*[trees.number(at(k)) for k in ("reviewCount", "reviewsCount")])
        return F.when(price.isNotNull(), F.struct(title.alias("title"), price.alias("price"), F.when(old > price, old).alias("old"), rating(rated).alias("rating"), counted.cast("bigint").alias("reviews")))

    return let(given, told)


def widget_offers(pages: DataFrame) -> DataFrame:
    """page_id, title, price, old, rating, reviews of a page's widget states (column states: a JSON object of JSON strings, in order), nulls where none has a price. The last widget that is a
    product's wins; without one the first object with a price inside a product's widget, then inside any; then the first search item. A product without rating or reviews takes those of
    the last widget that tells ratings. Widgets with bad JSON are passed over."""
    widgets = pages.select("page_id", F.posexplode(F.from_json("states", "map<string,string>")).alias("n", "name", "raw")).withColumn("state", F.try_parse_json("raw"))
    s = F.col("state")
    at = lambda k: F.try_variant_get(s, f"$.{k}", "variant")
    some = lambda k: F.coalesce(trees.text(at(k)) != "", trees.number(at(k)) != 0, F.lit(False))
    direct = F.when(some("title") | some("price") | F.col("name").rlike(PRODUCT_WIDGET), widget_offer(s))
    rated = rating(F.coalesce(*[trees.number(at(k)) for k in ("totalScore", "score", "rating")]))
    counted = F.coalesce(trees.number(at("reviewsCount")), F.regexp_replace(trees.text(at("count")), r"\D", "").try_cast("double"))
    tells = F.when(F.col("name").rlike(RATING_WIDGET) & rated.isNotNull(), F.struct(rated.alias("rating"), F.when(counted > 0, counted).cast("bigint").alias("reviews")))
    item = F.filter(F.transform(trees.items(at("items")), widget_offer), lambda o: o.isNotNull())
    read = stored(widgets.select("page_id", "n", "name", "state", direct.alias("direct"), tells.alias("tells"), F.try_element_at(item, F.lit(1)).alias("item")), "widgets")
    # only pages without a product's widget are searched in depth
    lost = read.groupBy("page_id").agg(F.max(F.col("direct").isNotNull()).alias("found")).where("NOT found").select("page_id")
    nodes = trees.descend(read.join(lost, "page_id", "left_semi"), ["page_id", "n"], "state", WIDGET_DEPTH, strings=True)
    deep = nodes.join(read.select("page_id", "n", F.col("name").alias("widget")), ["page_id", "n"]).where(trees.fields(F.col("node")).isNotNull()).withColumn("offer", F.explode(F.array(widget_offer(F.col("node"))))).where("offer IS NOT NULL")
    first = deep.groupBy("page_id").agg(F.min_by("offer", F.struct(~F.col("widget").rlike(DEEP_WIDGET), F.col("n"), F.col("path"))).alias("deep"))
    of_page = read.groupBy("page_id").agg(
        F.max_by("direct", F.when(F.col("direct").isNotNull(), F.col("n"))).alias("direct"), F.max_by("tells", F.when(F.col("tells").isNotNull(), F.col("n"))).alias("tells"), F.min_by("item", F.when(F.col("item").isNotNull(), F.col("n"))).alias("item"),
    )
    product = F.coalesce("direct", "deep")
    best = F.coalesce(product, "item")
    filled = lambda k: F.coalesce(best[k], F.when(product.isNotNull(), F.col("tells")[k]))
    return pages.select("page_id").join(of_page.join(first, "page_id", "left"), "page_id", "left").select("page_id", best["title"].alias("title"), best["price"].alias("price"), best["old"].alias("old"), filled("rating").alias("rating"), filled("reviews").alias("reviews"))


FEEDBACKS = "struct<feedbacks:array<struct<text:string,productValuation:double>>,feedbacksData:struct<feedbacks:array<struct<text:string,productValuation:double>>>>"
ANALYSIS = "struct<qualityScore:double,fakeRisk:string,verdict:string,qualitySummary:string,verdictExplanation:string,pros:array<string>,cons:array<string>>"


def feedbacks(payloads: DataFrame, most: int = 30) -> DataFrame:
    """page_id, place, text and rating of the feedbacks in a payload (JSON), at either of two places, blank texts left out, the first `most`. Bad JSON gives none."""
    read = F.from_json("payload", FEEDBACKS)
    found = F.filter(F.coalesce(read["feedbacks"], read["feedbacksData"]["feedbacks"]), lambda f: F.trim(F.coalesce(f["text"], F.lit(""))) != "")
    return payloads.select("page_id", F.posexplode(F.slice(found, 1, most)).alias("place", "f")).select("page_id", "place", F.trim("f.text").alias("text"), F.col("f.productValuation").alias("rating"))


def analysis_error(payload: Column) -> Column:
    """The first field of an analysis (JSON) that isn't as it must be, or null."""
    a = F.from_json(payload, ANALYSIS)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(a.isNull() | F.coalesce(F.trim(payload), F.lit("")).rlike(r"^[^{]") | blank(payload), "not_json").when(~F.coalesce(a["qualityScore"].between(1, 10), F.lit(False)), "qualityScore")
        .when(~F.coalesce(a["fakeRisk"].isin("low", "medium", "high"), F.lit(False)), "fakeRisk").when(~F.coalesce(a["verdict"].isin("buy_now", "wait_discount", "not_recommended"), F.lit(False)), "verdict")
        .when(blank(a["qualitySummary"]), "qualitySummary").when(blank(a["verdictExplanation"]), "verdictExplanation")
    )


LINKED = {"wildberries": r'href="(?:https?://[^"/]*)?/catalog/(\d{5,})/[^"]*"[^>]*>\s*([^<]*)', "aliexpress": r'href="[^"]*/item/(\d{8,})[^"]*"[^>]*>\s*([^<]*)', "mvideo": r'href="[^"]*/products/[^"]*?(\d{6,})"[^>]*>\s*([^<]*)', "megamarket": r'href="[^"]*/catalog/details/[^"]*?(\d{6,})[^"]*"[^>]*>\s*([^<]*)'}


def search_results(pages: DataFrame, most: int = 8) -> DataFrame:
    """page_id, place, id and title of the candidates on search pages (page_id, store, html): links of the store's form, each id once, the first `most`."""
    numbers, titles = (F.coalesce(*[F.when(F.col("store") == s, F.regexp_extract_all("html", F.lit("(?is)" + p), F.lit(g))) for s, p in LINKED.items()]) for g in (1, 2))
    pairs = F.zip_with(numbers, titles, lambda i, x: F.struct(i.alias("id"), F.trim(x).alias("title")))
    both = let(pairs, lambda ps: F.struct(ps.alias("pairs"), F.transform(ps, lambda q: q["id"]).alias("ids")))
    first = let(both, lambda b: F.filter(b["pairs"], lambda p, k: F.array_position(b["ids"], p["id"]) == k + 1))
    return pages.select("page_id", F.posexplode(F.slice(first, 1, most)).alias("place", "c")).select("page_id", "place", "c.id", "c.title")
