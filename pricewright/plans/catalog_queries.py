"""Queries over offers as kept and shown, publishing, mapping history and reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import titles as ti
from ..operators import catalog as c
from ..registry import query
from ..sources import relations as r
from ..sources.relations import with_views


def _linked(spark, d):
    link = F.when(F.col("product") % 9 == 0, F.lit("https://x/search?q=1")).when(F.col("product") % 8 != 0, F.concat(F.lit("https://x/p/"), F.col("product")))
    return r.offers(spark, d).withColumn("url", link)


LINKED = "linked AS (SELECT *, CASE WHEN product % 9 = 0 THEN 'https://x/search?q=1' WHEN product % 8 <> 0 THEN 'https://x/p/' || product END AS url FROM offers)"


@query("f15_alertable", with_views(f"WITH {LINKED} SELECT product, marketplace FROM linked WHERE price > 0 AND status IN ('verified', 'probable', 'serp_only') AND NOT regexp_matches(url, 'search\\?', 'i')"))
def f15(spark, d):
    """Offers that may raise alerts."""
    o = _linked(spark, d)
    return o.where(c.alertable(o)).select("product", "marketplace")


@query("m12_merge_all", with_views("""WITH w AS (SELECT product, marketplace, CASE WHEN product % 5 <> 0 THEN price * 1.1::DOUBLE END AS price, CASE WHEN product % 7 = 0 THEN 'oos' ELSE status END AS status, CASE WHEN product % 3 <> 0 THEN rating END AS rating FROM offers)
SELECT coalesce(o.product, w.product) AS product, coalesce(o.marketplace, w.marketplace) AS marketplace, CASE WHEN w.status = 'oos' THEN NULL WHEN w.price > 0 THEN w.price ELSE o.price END AS price, coalesce(w.status, o.status) AS status, coalesce(w.rating, o.rating) AS rating
FROM offers o FULL JOIN w ON o.product = w.product AND o.marketplace = w.marketplace"""))  # fmt: skip
def m12_all(spark, d):
    """Every offer merged with its next reading: a changed price, no price, no rating, or out of stock."""
    o = r.offers(spark, d)
    k = F.col("product")
    new = o.withColumn("price", F.when(k % 5 != 0, F.col("price") * 1.1)).withColumn("status", F.when(k % 7 == 0, "oos").otherwise(F.col("status"))).withColumn("rating", F.when(k % 3 != 0, F.col("rating")))
    return c.merged(o, new, ["product", "marketplace"])


@query("t5_t7_d27_fallback", with_views("""SELECT product, marketplace, tier FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY tier, confidence DESC, marketplace) AS n FROM (SELECT *, CASE WHEN confidence >= 55 AND price > 0 AND greatest(price, reference_price) / least(price, reference_price) <= 1.3 THEN 0
WHEN confidence > 50 AND price > 0 AND greatest(price, reference_price) / least(price, reference_price) <= 1.69 THEN 1 WHEN confidence >= 40 THEN 2 END AS tier FROM offers) WHERE tier IS NOT NULL) WHERE n = 1"""))  # fmt: skip
def t5(spark, d):
    """Best candidate of each product, by a ladder of looser limits (t6, t8: the first N by the same window)."""
    ratio = F.greatest("price", "reference_price") / F.least("price", "reference_price")
    ladder = [(F.col("confidence") >= 55) & (F.col("price") > 0) & (ratio <= 1.3), (F.col("confidence") > 50) & (F.col("price") > 0) & (ratio <= 1.69), F.col("confidence") >= 40]
    best = c.with_fallback(r.offers(spark, d), "product", [F.desc("confidence"), F.col("marketplace")], ladder)
    return best.select("product", "marketplace", F.col("tier").cast("bigint").alias("tier"))


@query("t12_shown", with_views("""SELECT product, marketplace, place, place <= 4 AS visible FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY CASE WHEN marketplace = 'ozon' THEN 0 WHEN price > 0 THEN 1 ELSE 3 END,
CASE WHEN marketplace <> 'ozon' AND price > 0 THEN price END, marketplace) AS place FROM offers)"""))  # fmt: skip
def t12(spark, d):
    """Order of each product's offers in a table, and which are visible."""
    return c.shown(r.offers(spark, d), "product", F.col("marketplace") == "ozon").select("product", "marketplace", "place", "visible")


@query("t13_all_my_products", with_views("""WITH k AS (SELECT product, min(price) FILTER (price > 0) AS low, lower(min(title)) AS name FROM offers GROUP BY 1), a AS (SELECT l_partkey AS product, min(l_shipdate) AS added FROM lineitem GROUP BY 1)
SELECT product, row_number() OVER (ORDER BY added DESC, product) AS by_added, row_number() OVER (ORDER BY low NULLS LAST, product) AS by_price, row_number() OVER (ORDER BY name, product) AS by_title FROM k JOIN a USING (product)"""))  # fmt: skip
def t13_all(spark, d):
    """The place of every product in each of the three sort modes: newest first, cheapest offer first, by title."""
    low = r.offers(spark, d).groupBy("product").agg(F.min(F.when(F.col("price") > 0, F.col("price"))).alias("low"), F.lower(F.min("title")).alias("name"))
    added = r.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("product")).agg(F.min("l_shipdate").alias("added"))
    rows = low.join(added, "product")
    orders = {"by_added": F.desc("added"), "by_price": F.asc_nulls_last("low"), "by_title": F.asc("name")}
    places = [c.placed(rows.select("product", "added", "low", "name"), [order, F.col("product")], name).select("product", name) for name, order in orders.items()]
    return places[0].join(places[1], "product").join(places[2], "product")


GATE = """CASE WHEN score IS NULL THEN 'empty_analysis' WHEN src = 'local' THEN 'local_source' WHEN score < 4 THEN 'low_quality' WHEN reviews < 3 AND overview < 200 THEN 'insufficient_reviews' WHEN pros < 1 OR cons < 1 THEN 'thin_content'
WHEN length(p_name) < 8 THEN 'weak_title' END"""


@query("f22_f23_gates", f"""SELECT p_partkey, {GATE} AS reason FROM (SELECT *, CASE WHEN p_size % 10 <> 0 THEN (p_size % 10)::DOUBLE END AS score, CASE WHEN p_partkey % 6 = 0 THEN 'local' ELSE 'model' END AS src, p_partkey % 7 AS reviews, p_partkey % 400 AS overview,
p_partkey % 5 AS pros, p_partkey % 11 AS cons FROM part)""")  # fmt: skip
def f22(spark, d):
    """First reason against publishing each page."""
    k, s = F.col("p_partkey"), F.col("p_size")
    reason = c.gate(F.when(s % 10 != 0, (s % 10).cast("double")), F.when(k % 6 == 0, "local").otherwise("model"), k % 7, k % 400, k % 5, k % 11, F.col("p_name"), 4, 3, 200)
    return r.table(spark, d, "part").select("p_partkey", reason.alias("reason"))


@query("n3_publish_outcomes", f"""SELECT coalesce({GATE}, 'published') AS outcome, count(*) AS pages FROM (SELECT *, CASE WHEN p_size % 10 <> 0 THEN (p_size % 10)::DOUBLE END AS score, CASE WHEN p_partkey % 6 = 0 THEN 'local' ELSE 'model' END AS src, p_partkey % 7 AS reviews, p_partkey % 400 AS overview,
p_partkey % 5 AS pros, p_partkey % 11 AS cons FROM part) GROUP BY 1""")  # fmt: skip
def n3(spark, d):
    """Outcomes of a publishing run."""
    return f22(spark, d).groupBy(F.coalesce("reason", F.lit("published")).alias("outcome")).agg(F.count(F.lit(1)).alias("pages"))


DROP = "({now} < {was} AND (({was} - {now}) / {was} * 100 >= 5 OR {was} - {now} >= 100))"


@query("d42_compare_alerts", with_views(f"""WITH o AS (SELECT product, marketplace, price AS before FROM offers WHERE product % 3 <> 0), w AS (SELECT product, marketplace, price * CASE WHEN product % 2 = 0 THEN 0.9::DOUBLE ELSE 0.999::DOUBLE END AS now FROM offers),
x AS (SELECT w.product, w.marketplace, before, now, s.own, coalesce({DROP.format(now='now', was='before')}, false) AS fell, coalesce(now < before * 0.35::DOUBLE AND before - now > 20000, false) AS absurd
FROM w LEFT JOIN o ON w.product = o.product AND w.marketplace = o.marketplace LEFT JOIN (SELECT product, before AS own FROM o WHERE marketplace = 'ozon') s ON s.product = w.product WHERE now > 0),
k AS (SELECT *, CASE WHEN fell AND NOT absurd THEN 'drop' WHEN NOT fell AND marketplace <> 'ozon' AND coalesce({DROP.format(now='now', was='own')}, false) AND now < before THEN 'cheaper_elsewhere' END AS kind FROM x)
SELECT product, marketplace, before, now, kind FROM k WHERE kind IS NOT NULL"""))  # fmt: skip
def d42(spark, d):
    """Price drops on a store and cheaper offers elsewhere, planned for all products at once."""
    o = r.offers(spark, d)
    new = o.withColumn("price", F.col("price") * F.when(F.col("product") % 2 == 0, 0.9).otherwise(0.999))
    return c.compare_alerts(o.where("product % 3 <> 0"), new, "ozon", 100, 5)


@query("j15_m16_same_products", "SELECT DISTINCT first, id FROM (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY k) AS first FROM (SELECT p_partkey, unnest([p_brand || '|' || p_name, p_type || '|' || p_size || '|' || p_name]) AS k FROM part)) WHERE id <> first")
def j15(spark, d):
    """Products that share any of two keys, linked to each key's first."""
    keys = F.array(F.concat_ws("|", "p_brand", "p_name"), F.concat_ws("|", "p_type", F.col("p_size").cast("string"), "p_name"))
    return c.same_products(r.table(spark, d, "part").select(F.col("p_partkey").alias("id"), keys.alias("keys")), "keys")


@query("m16_clusters", """WITH RECURSIVE k AS (SELECT p_partkey AS id, unnest([p_brand || '|' || p_name, p_type || '|' || p_size || '|' || p_name]) AS k FROM part), reach AS (SELECT p_partkey AS id, p_partkey AS other FROM part
UNION SELECT r.id, b.id FROM reach r JOIN k a ON a.id = r.other JOIN k b USING (k)) SELECT id, min(other) AS component FROM reach GROUP BY 1""")  # fmt: skip
def m16(spark, d):
    """The cluster of every product: all that chains of shared keys (j15) connect."""
    return c.clusters(r.table(spark, d, "part").select(F.col("p_partkey").alias("id")), j15(spark, d))


@query("m11_t14_reviews", "SELECT source, lang, count(*) AS reviews FROM (SELECT DISTINCT source, lang, text FROM documents) GROUP BY 1, 2")
def m11(spark, d):
    """Different review texts by source and language."""
    return r.table(spark, d, "documents").select("source", "lang", "text").distinct().groupBy("source", "lang").agg(F.count(F.lit(1)).alias("reviews"))


@query("m23_mapping_history")
def m23(spark, d):
    """State of every mapping edge after its events, in order."""
    e = r.table(spark, d, "events")
    action = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "dispute").otherwise("upsert")
    return c.mapping_state(e.select((F.col("user_id") * 7 + F.col("event_id") % 7).alias("edge"), r.micros(F.col("ts")).alias("at"), F.col("event_id").alias("id"), action.alias("action"), r.pick(("auto", "multi_user", "manual"), F.col("event_id")).alias("evidence"), (F.col("event_id") % 101).alias("confidence")))


def _sql_words(pairs, subject):
    return " ".join(f"WHEN {subject.format(w.replace(chr(39), chr(39) * 2))} THEN '{f.replace(chr(39), chr(39) * 2)}'" for w, f in pairs)


COLOR_WORDS = [(w, f) for f, ws in t.COLORS.items() for w in ws]
COLOR_SQL = f"""CASE {_sql_words(COLOR_WORDS, "low = '{}'")} {_sql_words([wf for wf in COLOR_WORDS if " " in wf[0]], "contains(low, '{}')")} {_sql_words([wf for wf in COLOR_WORDS if " " not in wf[0]], "contains(low, '{}')")} END"""
BRAND_SQL = f"""CASE {_sql_words([(b, b) for b in t.BRANDS], "contains(lower({{x}}), '{}')")} END"""
FAMILY_SQL = f"CASE {{x}} {' '.join(f'WHEN {b!r} THEN {f!r}' for b, f in t.FAMILIES.items())} ELSE {{x}} END"
#: Makers that titles of parts are given: of one family, of others, and none.
MAKERS = ("Xiaomi", "Redmi", "POCO", "Huawei", "Honor", "Apple", "Dyson", "noname")


@query("x5_x18_d13_all_titles", f"""WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS low, p_name || ' ' || {list(MAKERS)}[(p_partkey % {len(MAKERS)} + 1)::INT] AS a, p_name || ' ' || {list(MAKERS)}[(p_partkey // {len(MAKERS)} % {len(MAKERS)} + 1)::INT] AS b FROM part),
k AS (SELECT p_partkey, {COLOR_SQL} AS color, {BRAND_SQL.format(x='a')} AS brand, {BRAND_SQL.format(x='b')} AS other FROM n)
SELECT p_partkey, color, brand, brand IS NULL OR other IS NULL OR {FAMILY_SQL.format(x='brand')} = {FAMILY_SQL.format(x='other')} AS compatible FROM k""")  # fmt: skip
def x5_all(spark, d):
    """Colour family of every part's name, the brand of its title, and whether that fits the brand of another title of the part."""
    part = r.table(spark, d, "part")
    title = lambda k: F.concat_ws(" ", "p_name", r.pick(MAKERS, k))
    named = part.select("p_partkey", "p_name", t.brand_of(title(F.col("p_partkey"))).alias("brand"), t.brand_of(title(F.expr(f"p_partkey div {len(MAKERS)}"))).alias("other"))
    return named.select("p_partkey", t.color(F.col("p_name")).alias("color"), "brand", t.brands_compatible(F.col("brand"), F.col("other")).alias("compatible"))


@query("x1_titles")
def x1(spark, d):
    """Normalised title, storage, volume, package count and slug of every line of every document; a null text is one line of nulls."""
    lines = ti.spread(r.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode_outer(F.split("text", r"\r\n?|\n")).alias("line", "text"))
    x = F.col("text")
    measured = F.when(x.rlike("[0-9]"), x)  # sizes, volumes and counts have a digit
    return lines.select("doc_id", "line", t.normal_title(x).alias("title"), t.storage(measured).alias("storage"), t.volume_ml(measured).alias("volume_ml"), t.package_count(measured).alias("package_count"), t.slug(x).alias("slug"))


@query("x28_hashes", with_views("SELECT DISTINCT search_query, printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(search_query, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS hash FROM search_metrics"))
def x28(spark, d):
    """Query hash of every search."""
    return r.search_metrics(spark, d).select("search_query").distinct().select("search_query", t.fnv1a(F.col("search_query")).alias("hash"))


@query("x63_x65_calendar", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, floor(avg(o_totalprice) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS mean FROM orders GROUP BY 1")
def x63(spark, d):
    """Orders by month with two-decimal means."""
    return r.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orders"), (F.floor(F.avg("o_totalprice") * 100 + 0.5) / 100.0).alias("mean"))
