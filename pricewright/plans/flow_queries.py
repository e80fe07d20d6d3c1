"""Queries of price texts, reviews, analysis reuse, offers on their way, links and text search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import links as lk
from ..functions import numbers as n
from ..functions import price_text as pt
from ..functions import reviews as rv
from ..functions import search as se
from ..functions import text as t
from ..functions import titles as ti
from ..operators import offer_flow as of
from ..operators import reuse as ru
from ..registry import query
from ..sources import relations as r
from ..sources.relations import with_views


def _k():
    return F.col("p_partkey")
PART = "(SELECT *, 1000 + p_partkey * 37 % 9000 AS a FROM part)"


def _part(spark, d):
    return r.table(spark, d, "part").withColumn("a", 1000 + _k() * 37 % 9000)


BLOCK_TEXT = """CASE p_partkey % 6 WHEN 0 THEN a || ' ₽' WHEN 1 THEN a || ' ₽ с банками ' || a * 105 // 100 || ' руб.' WHEN 2 THEN '-20 % ' || a || ' ₽ ' || a * 13 // 10 || ' ₽' WHEN 3 THEN 'Пэй ' || a || ' ₽ ' || a * 12 // 10 || ' ₽ ' || a * 2 || ' ₽'
WHEN 4 THEN a // 2 || ' ₽/шт ' || a || ' ₽ ' || a * 103 // 100 || ' ₽' ELSE 'нет цены' END"""


def _block_text():
    a, div = F.col("a"), lambda e: F.expr(e).cast("string")
    return (
        F.when(_k() % 6 == 0, F.concat(a, F.lit(" ₽"))).when(_k() % 6 == 1, F.concat(a, F.lit(" ₽ с банками "), div("a * 105 div 100"), F.lit(" руб."))).when(_k() % 6 == 2, F.concat(F.lit("-20 % "), a, F.lit(" ₽ "), div("a * 13 div 10"), F.lit(" ₽")))
        .when(_k() % 6 == 3, F.concat(F.lit("Пэй "), a, F.lit(" ₽ "), div("a * 12 div 10"), F.lit(" ₽ "), div("a * 2"), F.lit(" ₽"))).when(_k() % 6 == 4, F.concat(div("a div 2"), F.lit(" ₽/шт "), a, F.lit(" ₽ "), div("a * 103 div 100"), F.lit(" ₽"))).otherwise("нет цены")
    )


PRICES = rf"""p AS (SELECT p_partkey, x, [v::BIGINT for v in regexp_extract_all(regexp_replace(x, '(\d[\d\s]*)\s*(?:₽|руб\.?)\s*/\s*шт', '', 'g'), '(\d[\d\s]*?)\s*(?:₽|руб\.?)', 1)] AS found FROM (SELECT p_partkey, {BLOCK_TEXT} AS x FROM {PART})),
q AS (SELECT *, list_sort(list_distinct([v for v in found if v >= 50 AND v < 50000000])) AS p FROM p)"""


@query("x43_listing_prices", f"WITH {PRICES} SELECT p_partkey, len(p) AS prices, list_sum(p)::BIGINT AS total FROM q")
def x43(spark, d):
    """Rouble amounts of every price block, but for prices of one piece."""
    p = F.array_distinct(pt.listing_prices(_block_text()))
    return _part(spark, d).select("p_partkey", p.alias("p")).select("p_partkey", F.size("p").cast("bigint").alias("prices"), F.when(F.size("p") > 0, F.aggregate("p", F.lit(0).cast("bigint"), lambda s, v: s + v)).alias("total"))


def _breakdown_sql(labels: str, above: float, low: float, high: float) -> str:
    return f"""WITH {PRICES}, o AS (SELECT *, p[1] AS lo, p[-1] AS hi, regexp_matches(x, '{labels}', 'i') AS label, CASE WHEN (len(p) >= 2 AND regexp_matches(x, '(?:−|-|–)\\s*\\d{{1,2}}\\s*%') AND p[-1] > p[1] * 1.05::DOUBLE) OR (len(p) >= 3 AND p[-1] > p[1] * {above}::DOUBLE) THEN p[-1] END AS old FROM q WHERE len(p) > 0),
l AS (SELECT *, CASE WHEN old IS NULL THEN p WHEN lo < old * 0.98::DOUBLE THEN [v for v in p if v < old * 0.98::DOUBLE] ELSE [lo] END AS w FROM o),
m AS (SELECT *, CASE WHEN w[-1] > w[1] * 1.01::DOUBLE THEN w[-1] END AS base, len(w) >= 2 AND w[-1]::DOUBLE / w[1] BETWEEN {low} AND {high} AS pair FROM l),
z AS (SELECT *, CASE WHEN label THEN coalesce(base, w[1]) WHEN pair THEN w[-1] ELSE w[1] END AS price FROM m)
SELECT p_partkey, price, CASE WHEN label THEN base WHEN pair THEN w[-1] ELSE w[1] END AS base, CASE WHEN label OR pair THEN w[1] END AS pay, CASE WHEN old > price THEN old END AS old FROM z"""


@query("x46_ozon_blocks", _breakdown_sql(pt.BANK, 1.08, 1.005, 1.08))
def x46(spark, d):
    """Base, bank-card and old price of every price block."""
    return _part(spark, d).select("p_partkey", pt.ozon_block(_block_text()).alias("b")).where("b IS NOT NULL").select("p_partkey", "b.*")


@query("x47_yandex_blocks", _breakdown_sql(pt.PAY, 1.12, 1.04, 1.35))
def x47(spark, d):
    """Base, pay-service and old price of every price block."""
    return _part(spark, d).select("p_partkey", pt.yandex_block(_block_text()).alias("b")).where("b IS NOT NULL").select("p_partkey", "b.*")


def _numbers():
    a = F.col("a")
    return F.array(a, F.when(_k() % 2 == 0, F.expr("a * 104 div 100")).otherwise(F.expr("a * 13 div 10")), F.when(_k() % 3 == 0, F.expr("a div 3")).otherwise(a * 2), F.when(_k() % 5 == 0, a * 3).otherwise(a))


@query("x44_n45_number_breakdowns")
def x44(spark, d):
    """Base, pay and old price of bare numbers, prices of one piece dropped."""
    return _part(spark, d).select("p_partkey", pt.ozon_numbers(_numbers()).alias("b")).select("p_partkey", "b.*", pt.offer_prices(F.col("b"))["pay"].alias("shown_pay"))


NUMBERS = "[a, CASE WHEN p_partkey % 2 = 0 THEN a * 104 // 100 ELSE a * 13 // 10 END, CASE WHEN p_partkey % 3 = 0 THEN a // 3 ELSE a * 2 END, CASE WHEN p_partkey % 5 = 0 THEN a * 3 ELSE a END]"


@query("n46_n55_price_filters", f"""WITH q AS (SELECT p_partkey, a, list_sort(list_distinct({NUMBERS})) AS p FROM {PART}), f AS (SELECT *, CASE WHEN p[-1] >= 5000 THEN greatest(500, floor(p[-1] * 0.12::DOUBLE)) ELSE greatest(400, floor(p[-1] * 0.4::DOUBLE)) END AS floor FROM q),
k AS (SELECT *, [v for v in p if v >= floor] AS kept FROM f)
SELECT p_partkey, CASE WHEN len(p) <= 1 OR p[-1] < 1000 OR len(kept) = 0 THEN p[1] ELSE kept[1] END AS cheapest, coalesce(list_max([v for v in p if v < a * 2 * 0.98::DOUBLE]), p[-1]) AS base FROM k""")
def n46(spark, d):
    """Cheapest price without courier fees, and the largest below an old price."""
    return _part(spark, d).select("p_partkey", F.array_min(pt.without_shipping(_numbers())).alias("cheapest"), pt.base_price(_numbers(), F.col("a") * 2).alias("base"))


@query("x50_x51_tile_ratings", """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 AND p_partkey % 5 >= 1 THEN floor((p_partkey % 5 + (p_partkey % 10) / 10.0::DOUBLE) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE END AS rating, CASE WHEN p_partkey % 4 <> 3 AND p_partkey > 0 THEN p_partkey END AS reviews,
CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 3 = 1 THEN 5 ELSE 4 END AS guessed FROM part""")
def x50(spark, d):
    """Rating and number of reviews that a tile's text says, and the rating that words suggest."""
    tile = F.when(_k() % 4 != 3, F.concat((_k() % 5).cast("string"), F.lit(","), (_k() % 10).cast("string"), F.lit(" из 5 · "), _k().cast("string"), F.lit(" отзывов"))).otherwise("новинка")
    words = F.when(_k() % 3 == 0, "Товар плохой").when(_k() % 3 == 1, "Отличный!").otherwise("обычный")
    return r.table(spark, d, "part").select("p_partkey", rv.rating_and_count(tile).alias("r"), rv.guessed_rating(words).alias("guessed")).select("p_partkey", "r.*", "guessed")


REVIEWS = "(SELECT d.doc_id, d.source, d.lang, d.text, CASE WHEN l.quality = 1 THEN 5.0::DOUBLE WHEN l.quality = 0 THEN 1.0::DOUBLE END AS stars FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"


def _reviews(spark, d):
    labels = r.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return r.table(spark, d, "documents").select("doc_id", "source", "lang", "text").join(labels, "doc_id", "left").withColumn("stars", F.when(F.col("quality") == 1, 5.0).when(F.col("quality") == 0, 1.0))


@query("f17_review_filters", f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN coalesce(stars, CASE WHEN regexp_matches(lower(text), '{rv.BAD_STEMS}') THEN 2 WHEN regexp_matches(lower(text), '{rv.GOOD_STEMS}') THEN 5 ELSE 4 END) <= 3 WHEN 1 THEN doc_id % 3 = 0 WHEN 2 THEN doc_id % 50 <= 30 ELSE true END AS kept FROM {REVIEWS}""")
def f17(spark, d):
    """Which reviews the filters keep: negative, with a photo, of the last month, all."""
    i = F.col("doc_id")
    kind = r.pick(("negative", "with_photo", "last_month", "all"), i)
    return _reviews(spark, d).select("doc_id", rv.kept_by(kind, F.col("text"), F.col("stars"), i % 3 == 0, i % 50).alias("kept"))


@query("a30_d55_review_analysis")
def a30(spark, d):
    """Rating, pros and cons, risk and verdict of each source's reviews; stems and topics are parameters, taken from words of these reviews."""
    topics = ((("the", "que"), "praise of a", "complaints of a"), (("and", "und"), "praise of b", "complaints of b"), (("xyz",), None, "complaints of c"))
    return rv.analysis(_reviews(spark, d), ["source", "lang"], topics, ("tion", "lich", "ment"), ("idiot", "trash", "stupid"), ("worthless",))


@query("d53_said_ratings", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 4.5::DOUBLE WHEN 1 THEN (p_partkey % 5 + 1)::DOUBLE WHEN 2 THEN 5.0::DOUBLE WHEN 3 THEN 3.0::DOUBLE END AS stars FROM part")
def d53(spark, d):
    """Stars that a review's text names."""
    said = F.when(_k() % 5 == 0, "Оценка: 4.5").when(_k() % 5 == 1, "2 / 5 итого").when(_k() % 5 == 2, "⭐⭐⭐⭐⭐ топ").when(_k() % 5 == 3, "Rating stars 3").otherwise("без оценки")
    return r.table(spark, d, "part").select("p_partkey", rv.said_rating(said).alias("stars"))


@query("d51_authenticity")
def d51(spark, d):
    """Whether each listing is sold as original, or has words of copies."""
    return r.listings(spark, d).select("product", rv.authenticity(F.col("title"), F.col("specs"), F.col("product") % 11 == 0).alias("authenticity"))


@query("n41_clamped_answers", """SELECT p_partkey, least(5.0::DOUBLE, greatest(1.0::DOUBLE, CASE WHEN p_size % 9 <> 0 THEN (p_size % 9)::DOUBLE ELSE 3.0::DOUBLE END)) AS rating, CASE WHEN p_partkey % 4 < 3 THEN ['low', 'medium', 'high'][(p_partkey % 4 + 1)::INT] ELSE 'medium' END AS risk,
CASE WHEN p_partkey % 4 < 3 THEN ['buy_now', 'wait_discount', 'not_recommended'][(p_partkey % 4 + 1)::INT] ELSE 'wait_discount' END AS verdict, least(5, p_size % 8) AS pros, 0::BIGINT AS cons FROM part""")
def n41(spark, d):
    """Answers of a model brought within their limits."""
    four = lambda *v: F.element_at(F.array(*map(F.lit, v)), (_k() % 4 + 1).cast("int"))
    pros = F.slice(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: i.cast("string")), F.lit(1), (F.col("p_size") % 8).cast("int"))
    c = rv.clamped((F.col("p_size") % 9).cast("double"), four("low", "medium", "high", "odd"), four("buy_now", "wait_discount", "not_recommended", "maybe"), pros, F.lit(None).cast("array<string>"))
    return r.table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.rating", "c.risk", "c.verdict", F.size("c.pros").cast("bigint").alias("pros"), F.size("c.cons").cast("bigint").alias("cons"))


@query("d49_reuse_decisions", """WITH x AS (SELECT p_partkey, p_partkey % 101 AS score, p_partkey % 13 = 0 AS rejected, p_partkey % 5 <> 0 AS fresh, p_partkey % 7 = 0 AS moved, p_partkey % 23 = 0 AS forced, p_partkey % 3 = 0 AS soft, p_partkey % 4 = 1 AS mapped, p_partkey % 2 = 0 AS sku, p_partkey % 9 < 4 AS same FROM part),
y AS (SELECT *, CASE WHEN forced OR NOT fresh OR (moved AND NOT soft) OR rejected THEN 'NEW_ANALYSIS' WHEN soft THEN CASE WHEN score >= 70 OR sku THEN 'SOFT_REFRESH' ELSE 'NEW_ANALYSIS' END WHEN mapped THEN CASE WHEN score >= 80 THEN 'CROSS_MARKETPLACE' ELSE 'NEW_ANALYSIS' END
WHEN sku AND same THEN 'REVIEWS_MATCH' WHEN sku THEN 'SAME_SKU' WHEN same AND score >= 80 THEN 'REVIEWS_MATCH' WHEN score >= 80 THEN 'LOCAL_CACHE' ELSE 'NEW_ANALYSIS' END AS reason FROM x)
SELECT p_partkey, reason <> 'NEW_ANALYSIS' AS reuse, reason, greatest(score, CASE WHEN sku AND reason = 'REVIEWS_MATCH' THEN 90 WHEN reason = 'SAME_SKU' THEN 85 ELSE 0 END) AS score FROM y""")
def d49(spark, d):
    """Whether an analysis is used again, and why."""
    c = ru.decision(_k() % 101, _k() % 13 == 0, _k() % 5 != 0, _k() % 7 == 0, _k() % 23 == 0, _k() % 3 == 0, _k() % 4 == 1, _k() % 2 == 0, _k() % 9 < 4)
    return r.table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.*")


@query("d48_n37_cache_confidence")
def d48(spark, d):
    """How surely each listing is the product of an earlier analysis, and whether that is used again (n37)."""
    f = ti.with_told(r.listings(spark, d).select("product", "price", "title", "specs"), ["title", "specs"], f=ti.features_of("title", "specs"))
    short = F.struct("f.brand", F.col("f.e.model.model").alias("model"), "f.storage", "f.color", "f.category")
    now = f.select("product", "price", short.alias("x"))
    then = now.select((F.col("product") + 40).alias("product"), F.col("price").alias("price_then"), F.col("x").alias("y"))
    rows = now.join(then, "product").withColumn("c", ru.confidence(F.col("x"), F.col("y"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    no = F.lit(False)
    said = ru.decision(F.col("c.score"), F.col("c.rejected"), F.lit(True), ru.price_moved(F.col("price_then"), F.col("price")), no, no, F.lit(None).cast("boolean"), F.col("product") % 2 == 0, no)
    return rows.select("product", "c.score", "c.rejected", said["reason"].alias("reason"))


@query("n38_review_cache", """SELECT p_partkey, p_partkey % 8 >= 3 AND (p_size < 6 OR p_partkey % 3 = 0 OR (p_size * 5 < 168 AND p_partkey % 20 > 0 AND abs(p_size % 22 - p_partkey % 20)::DOUBLE / greatest(p_partkey % 20, 1) <= 0.12 AND p_size % 22 >= 3 AND p_size % 22 > 0)) AS reusable
FROM (SELECT p_partkey, p_size FROM part)""")
def n38(spark, d):
    """Whether an analysis of reviews still stands."""
    s = F.col("p_size")
    age = F.when(s < 6, s).otherwise(s * 5)
    return r.table(spark, d, "part").select("p_partkey", F.coalesce(ru.reviews_reusable(_k() % 8, age, F.lit("a"), F.when(_k() % 3 == 0, "a").otherwise("b"), _k() % 20, s % 22), F.lit(False)).alias("reusable"))


HASH = r"[regexp_replace(left(x, 48), '\s+', ' ', 'g') for x in {part}]"


@query("x30_review_hashes", rf"""WITH g AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, coalesce(text, '')) AS l FROM conversations GROUP BY 1)
SELECT conv_id, len(l)::VARCHAR || '|' || array_to_string({HASH.format(part='l[1:5]')}, ';') || '|' || array_to_string({HASH.format(part='l[greatest(0, len(l) // 2 - 1) + 1:greatest(0, len(l) // 2 - 1) + 3]')}, ';') || '|' || array_to_string({HASH.format(part='l[greatest(1, len(l) - 2):]')}, ';') AS hash FROM g""")
def x30(spark, d):
    """A mark of each conversation's texts: their number and the starts of some."""
    texts = r.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return texts.select("conv_id", ru.reviews_hash(F.transform("t", lambda x: x["text"]), ";").alias("hash"))


@query("n39_cross_store_cache", with_views("""SELECT m.source_product_id, m.target_product_id, c.price FROM cross_market_mapping m JOIN price_cache c ON m.target_marketplace = c.marketplace AND m.target_product_id = c.product_id
WHERE m.status = 'active' AND (m.evidence IN ('manual', 'multi_user') OR m.confidence >= 85)"""))
def n39(spark, d):
    """Stored results of other stores that a mapping lends."""
    edges = r.cross_market_mapping(spark, d).where((F.col("status") == "active") & ru.mapping_allows(F.col("status"), F.col("evidence"), F.col("confidence")))
    cache = r.price_cache(spark, d).select(F.col("marketplace").alias("target_marketplace"), F.col("product_id").alias("target_product_id"), "price")
    return edges.join(cache, ["target_marketplace", "target_product_id"]).select("source_product_id", "target_product_id", "price")


POOL = "CASE WHEN product % 3 = 0 THEN 3 ELSE 0 END"
STATUSES = ("verified", "needs_choice", "oos", "loading_card", "probable", "serp_only")


def _offer(o):
    """An offer with a pool of candidates."""
    k = F.col("product")
    url = lambda i: F.concat(F.lit("https://x/p/"), (k + i).cast("string"))
    pool = F.array(*[F.struct(url(i).alias("url"), (F.col("confidence") - 10 * i).alias("confidence"), F.lit(None).cast("bigint").alias("priority")) for i in range(3)])
    none = F.array().cast("array<struct<url:string,confidence:bigint,priority:bigint>>")
    return o.select(
        "product", "marketplace",
        F.struct(
            "price", url(0).alias("url"), r.pick(STATUSES, k).alias("status"), F.when(k % 10 == 0, "Нет в наличии").alias("error"), "rating", F.when(k % 8 == 0, "specs").alias("specs"), (k % 4 == 0).alias("manual"),
            F.when(k % 3 == 0, pool).otherwise(none).alias("pool"), F.array(url(1)).alias("rejected_urls"), F.lit(None).cast("array<string>").alias("rejected_prints"),
        ).alias("o"),
    )


OFFER = f"(SELECT *, {r._sql_pick(STATUSES, 'product')} AS st, product % 4 = 0 AS manual, {POOL} AS pool, product % 10 = 0 AS gone, coalesce(price > 0, false) AS priced FROM offers)"


@query("f14_n27_final_offers", with_views(f"""SELECT product, marketplace, (manual AND pool > 0) OR priced OR coalesce(rating BETWEEN 1 AND 5, false) OR product % 8 = 0 AS useful, manual AND pool > 0 AS pending,
CASE WHEN (manual OR st = 'needs_choice') AND pool > 0 THEN 'needs_choice' WHEN priced AND NOT manual THEN st WHEN st = 'oos' OR gone THEN 'oos' ELSE 'not_found' END AS status, CASE WHEN NOT ((manual OR st = 'needs_choice') AND pool > 0) AND priced AND NOT manual THEN price END AS price FROM {OFFER}"""))
def f14(spark, d):
    """Which offers are of use or wait for a choice, and what each becomes when its search ends."""
    o = _offer(r.offers(spark, d)).withColumn("f", of.finalised(F.col("o")))
    return o.select("product", "marketplace", of.useful(F.col("o")).alias("useful"), of.pending(F.col("o")).alias("pending"), "f.status", "f.price")


@query("n29_n33_rejections", with_views("""WITH u AS (SELECT product, marketplace, 'https://x/p/' || product AS zero, 'https://x/p/' || (product + 1) AS one, 'https://x/p/' || (product + 2) AS two, product % 3 = 0 AS filled FROM offers),
x AS (SELECT *, filled AND NOT (contains(two, zero) OR contains(zero, two) OR contains(two, one) OR contains(one, two)) AS stays FROM u)
SELECT product, marketplace, 2 AS urls, CASE WHEN stays THEN 1 ELSE 0 END AS pool, CASE WHEN stays THEN 'needs_choice' ELSE 'not_found' END AS status, CASE WHEN stays THEN two END AS next FROM x"""))
def n29(spark, d):
    """Every slot after its first candidate is rejected: urls and identities barred, the rest kept for a choice (n33)."""
    o = _offer(r.offers(spark, d)).withColumn("s", of.rejected_slot(F.col("o"), F.col("o.url"), F.concat(F.lit(" FP"), F.col("product").cast("string"))))
    return o.select("product", "marketplace", F.size("s.urls").alias("urls"), F.size("s.pool").cast("bigint").alias("pool"), "s.status", "s.next")


@query("n31_n32_n34_kept_slots", with_views(f"""SELECT product, marketplace, product % 13 = 0 OR (st = 'verified' AND priced AND NOT manual) AS preserved, product % 200 < 168 AS pool_fresh, priced AND product % 10 < 6 AS comparison_fresh FROM {OFFER}"""))
def n31(spark, d):
    """Slots that a new search keeps, and whether pools and stored comparisons are fresh."""
    k, o = F.col("product"), F.col("o")
    return _offer(r.offers(spark, d)).select("product", "marketplace", of.preserved(k % 13 == 0, o).alias("preserved"), of.fresh_pool(k % 200).alias("pool_fresh"), of.fresh_comparison(n.has_price(o["price"]), k % 10).alias("comparison_fresh"))


@query("m14_folded_offers", """WITH o AS (SELECT l_partkey AS product, l_suppkey % 5 AS slot, l_shipdate AS seen, l_orderkey AS id, l_linenumber AS line, l_extendedprice AS price, CASE WHEN l_orderkey % 9 = 0 THEN 'oos' WHEN l_orderkey % 2 = 0 THEN 'verified' ELSE 'probable' END AS status, (l_orderkey % 7)::DOUBLE AS rating,
l_extendedprice::VARCHAR AS tie FROM lineitem), w AS (SELECT *, row_number() OVER (PARTITION BY product, slot ORDER BY seen DESC, id DESC, line DESC, price DESC) AS last, max(CASE WHEN status = 'oos' THEN struct_pack(a := seen, b := id, c := line, d := price) END) OVER (PARTITION BY product, slot) AS ended, struct_pack(a := seen, b := id, c := line, d := price) AS place FROM o)
SELECT product, slot, arg_max(price, place) FILTER (status <> 'oos' AND price > 0 AND (ended IS NULL OR place > ended)) AS price, arg_max(status, place) AS status, arg_max(rating, place) FILTER (rating BETWEEN 1 AND 5) AS rating FROM w GROUP BY 1, 2""")
def m14(spark, d):
    """Last known good of every product's slot after all its offers in order."""
    i = F.col("l_orderkey")
    o = r.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("product"), (F.col("l_suppkey") % 5).alias("slot"), F.col("l_shipdate").alias("seen"), i.alias("id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"),
        F.when(i % 9 == 0, "oos").when(i % 2 == 0, "verified").otherwise("probable").alias("status"), (i % 7).cast("double").alias("rating"), F.lit(None).cast("string").alias("url"),
    )
    return of.folded(o, ["product", "slot"], ["seen", "id", "line", "price"]).drop("url")


@query("m15_merged_products")
def m15(spark, d):
    """Two records of each product as one: offers, links and pools by store, the longer title, the later time."""
    o = r.offers(spark, d)
    side = lambda rows, tail, at: rows.groupBy("product").agg(
        F.concat(F.min("title"), F.lit(tail)).alias("title"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("marketplace", F.struct("price", "status"))))).alias("offers"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("marketplace", F.concat(F.lit("https://x/"), "marketplace"))))).alias("urls"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("marketplace", F.array("confidence"))))).alias("pools"), F.lit(at).alias("compared_at"),
    )
    old, new = side(o.where("confidence < 80"), "", 1), side(o.where("confidence >= 60"), " (2)", 2)
    empty = lambda s, k: F.coalesce(F.col(f"{s}.{k}"), F.create_map().cast(old.schema[k].dataType.simpleString()))
    pack = lambda s: F.struct(F.col(f"{s}.title").alias("title"), *[empty(s, k).alias(k) for k in ("offers", "urls", "pools")], F.col(f"{s}.compared_at").alias("compared_at"))
    both = old.select("product", F.struct("*").alias("a")).join(new.select("product", F.struct("*").alias("b")), "product", "full").select("product", of.products_merged(pack("a"), pack("b")).alias("m"))
    return both.select("product", "m.title", F.size("m.offers").alias("offers"), F.size("m.urls").alias("urls"), "m.compared_at")


@query("n26_offers_of_products", with_views(f"""WITH p AS (SELECT p_partkey AS product, {r._sql_pick(r.WATCHED, 'p_partkey')} AS source, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS source_price FROM part), g AS (SELECT *, unnest({list(r.WATCHED)}) AS marketplace FROM p)
SELECT g.product, g.marketplace, CASE WHEN o.status IS NULL AND g.source = g.marketplace THEN g.source_price ELSE o.price END AS price, CASE WHEN o.status IS NULL AND g.source = g.marketplace AND g.source_price > 0 THEN 'verified' ELSE coalesce(o.status, 'not_found') END AS status
FROM g LEFT JOIN (SELECT * FROM offers WHERE confidence > 60) o USING (product, marketplace)"""))
def n26(spark, d):
    """The offer of every product on every store: stored, its own, or not found."""
    p = r.table(spark, d, "part").select(_k().alias("product"), r.pick(r.WATCHED, _k()).alias("source"), F.when(_k() % 3 != 0, F.col("p_retailprice")).alias("source_price"))
    return of.offers_of(p, r.WATCHED, r.offers(spark, d).where("confidence > 60"))


@query("n12_payload_offers", with_views("SELECT product, marketplace, price FROM offers WHERE price > 0 AND (ends_with('wb-' || product, product::VARCHAR) OR product::VARCHAR = 'x')"))
def n12(spark, d):
    """Priced offers of users' stored maps whose id fits the product's, either being the end of the other."""
    o = r.offers(spark, d)
    kept = o.groupBy("product").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("marketplace", "price")))).alias("prices")).select(F.concat(F.lit("wb-"), F.col("product").cast("string")).alias("id"), "product", "prices")
    rows = kept.select("id", "product", F.explode("prices").alias("marketplace", "price"))
    return rows.where(of.ids_match(F.col("id"), F.col("product").cast("string")) & n.has_price(F.col("price"))).select("product", "marketplace", "price")


@query("m10_serp_candidates", """WITH s AS (SELECT l_orderkey AS search, l_suppkey % 3 AS slot, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS position, CASE WHEN l_partkey % 4 <> 0 THEN l_extendedprice END AS price, l_partkey::VARCHAR AS title FROM lineitem)
SELECT search, slot, min(position) AS position, min(price) AS price, arg_min(title, struct_pack(a := price IS NULL, b := price, c := position)) AS title FROM s GROUP BY 1, 2""")
def m10(spark, d):
    """Results of each search, those of a slot as one: the first place, the lowest price."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    s = r.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("search"), F.col("l_suppkey"), place.cast("bigint").alias("position"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_extendedprice")).alias("price"), F.col("l_partkey").cast("string").alias("title"))
    return of.upserted_candidates(s, ["search"], F.col("l_suppkey") % 3)


@query("n14_research_order", with_views("""SELECT product, marketplace, row_number() OVER (PARTITION BY product ORDER BY confidence DESC, CASE WHEN product % 2 = 0 THEN price END NULLS LAST, marketplace) AS place,
confidence >= 55 AND (NOT coalesce(price > 0, false) OR product % 2 = 1 OR price / reference_price BETWEEN 0.35 AND 2.8) AS verified FROM offers"""))
def n14(spark, d):
    """Order of a product's research results, and which are verified; half of the products have a reference price."""
    ref = F.when(F.col("product") % 2 == 0, F.col("reference_price"))
    order = Window.partitionBy("product").orderBy(F.desc("confidence"), F.asc_nulls_last(F.when(ref.isNotNull(), F.col("price"))), "marketplace")
    return r.offers(spark, d).select("product", "marketplace", F.row_number().over(order).cast("bigint").alias("place"), of.research_verified(F.col("confidence"), F.col("price"), ref).alias("verified"))


@query("n15_research_targets", f"""SELECT p_partkey, array_to_string([s for s in {list(r.WATCHED)} if s <> {r._sql_pick(r.WATCHED, 'p_partkey')} AND (p_partkey % 3 = 0 OR s IN ('ozon', 'aliexpress'))], ',') AS targets FROM part""")
def n15(spark, d):
    """Stores to ask for every product."""
    asked = F.when(_k() % 3 != 0, F.array(F.lit(" aliexpress"), F.lit("ozon"), F.lit("other")))
    return r.table(spark, d, "part").select("p_partkey", F.array_join(of.research_targets(F.array(*map(F.lit, r.WATCHED)), r.pick(r.WATCHED, _k()), asked), ",").alias("targets"))


@query("n16_n17_shortlist", with_views(f"""SELECT category, product, marketplace, place, place <= 10 AS shortlisted FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY list_position({list(r.WATCHED)}, marketplace), product) AS place FROM offers) WHERE place <= 30"""))
def n16(spark, d):
    """Results of all stores for every category, store by store, the first 30; without constraints the first ten of them all match (n17)."""
    rows = of.first_found(r.offers(spark, d).select("category", "product", F.col("marketplace").alias("source"), F.col("product").alias("position")), ["category"], r.WATCHED)
    return rows.select("category", "product", F.col("source").alias("marketplace"), "place", (F.col("place") <= 10).alias("shortlisted"))


@query("j18_n49_agent_offers", with_views("""WITH ranked AS (SELECT product, marketplace, row_number() OVER (PARTITION BY product ORDER BY confidence DESC, marketplace) AS place FROM offers) SELECT r.product, r.marketplace, r.place, o.price FROM ranked r JOIN offers o USING (product, marketplace) WHERE o.confidence >= 55"""))
def j18(spark, d):
    """Ranked results with the offers that matched."""
    o = r.offers(spark, d)
    place = F.row_number().over(Window.partitionBy("product").orderBy(F.desc("confidence"), "marketplace"))
    return o.select("product", "marketplace", place.cast("bigint").alias("place")).join(o.where("confidence >= 55").select("product", "marketplace", "price"), ["product", "marketplace"])


STORE_URLS = (
    "https://www.wildberries.ru/catalog/%/feedbacks?x=1", "https://www.ozon.ru/product/tovar-%/?at=1", "https://market.yandex.ru/card/name/%?sku=2", "https://sbermegamarket.ru/catalog/details/name-%/", "https://aliexpress.com/item/%.html",
    "https://mvideo.ru/products/name-%", "https://www.dns-shop.ru/product/abc%/x/", "https://www.citilink.ru/product/name-%/", "https://www.lamoda.ru/p/mp%/shoes/", "https://shop.example/ozon.ru/%",
)
STORES = [*lk.HOSTS, None]


@query("x33_x35_store_links", f"""WITH u AS (SELECT p_partkey, replace({r._sql_pick(STORE_URLS, 'p_partkey')}, '%', (p_partkey + 123456789)::VARCHAR) AS url FROM part)
SELECT p_partkey, [{', '.join(f"'{s}'" if s else 'NULL' for s in STORES)}][(p_partkey % 10 + 1)::INT] AS store, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS plain, CASE WHEN p_partkey % 10 = 9 THEN NULL WHEN p_partkey % 10 = 6 THEN 'abc' || (p_partkey + 123456789) WHEN p_partkey % 10 = 8 THEN 'mp' || (p_partkey + 123456789) ELSE (p_partkey + 123456789)::VARCHAR END AS article,
p_partkey % 10 <> 9 AS product_page, left(regexp_replace(url, '[?#].*$', ''), 200) AS redacted FROM u""")
def x33(spark, d):
    """Store, number (x36), page kind (x37), plain form and redaction (x58) of every link, by its host."""
    url = F.replace(r.pick(STORE_URLS, _k()), F.lit("%"), (_k() + 123456789).cast("string"))
    return r.table(spark, d, "part").select("p_partkey", lk.store_of(url).alias("store"), lk.plain_url(url).alias("plain"), lk.article_of(url).alias("article"), lk.product_page(url).alias("product_page"), lk.redacted(url).alias("redacted"))


@query("x34_n22_n24_parsed_links", f"""WITH u AS (SELECT p_partkey, p_name, replace({r._sql_pick(STORE_URLS, 'p_partkey')}, '%', (p_partkey + 123456789)::VARCHAR) AS url, (p_partkey + 123456789)::VARCHAR AS i FROM part)
SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'https://www.wildberries.ru/catalog/' || i || '/detail.aspx' WHEN 3 THEN 'https://megamarket.ru/catalog/details/name-' || i WHEN 4 THEN 'https://aliexpress.ru/item/' || i || '.html' WHEN 5 THEN 'https://www.mvideo.ru/products/name-' || i ELSE rtrim(regexp_replace(url, '[?#].*$', ''), '/') END AS url,
p_name || ' смотри' AS hint FROM u""")
def x34(spark, d):
    """The link in every message: its canonical form (x34, n22) and what the message says besides."""
    url = F.replace(r.pick(STORE_URLS, _k()), F.lit("%"), (_k() + 123456789).cast("string"))
    return r.table(spark, d, "part").select("p_partkey", lk.parsed_link(F.concat_ws(" ", "p_name", url, F.lit("смотри"))).alias("l")).select("p_partkey", "l.url", "l.hint")


@query("x59_search_vectors", """WITH f AS (SELECT p_partkey, unnest([w for w in string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+') if w <> '']) AS token, 1.0::DOUBLE AS weight FROM part UNION ALL SELECT p_partkey, unnest([w for w in string_split_regex(lower(p_brand), '[^\\p{L}\\p{N}]+') if w <> '']), 1.0::DOUBLE FROM part
UNION ALL SELECT p_partkey, unnest([w for w in string_split_regex(lower(p_type), '[^\\p{L}\\p{N}]+') if w <> '']), 0.4::DOUBLE FROM part), v AS (SELECT p_partkey, token, max(weight) AS weight FROM f GROUP BY 1, 2)
SELECT p_partkey, count(*) AS tokens, sum(weight) AS total, coalesce(sum(weight) FILTER (token IN ('steel', 'widget')), 0.0::DOUBLE) / 2 AS rank FROM v GROUP BY 1""")
def x59(spark, d):
    """Weighted tokens of every page, and its rank for a query."""
    v = se.weighted_vector((F.col("p_name"), "A"), (F.col("p_brand"), "A"), (F.col("p_type"), "B"))
    rows = r.table(spark, d, "part").select("p_partkey", v.alias("v"))
    return rows.select("p_partkey", F.size("v").cast("bigint").alias("tokens"), F.aggregate(F.map_values("v"), F.lit(0.0), lambda s, w: s + w).alias("total"), se.rank(F.col("v"), F.lit("steel widget")).alias("rank"))


@query("x60_web_search", """WITH w AS (SELECT p_partkey, ' ' || array_to_string([w for w in string_split_regex(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+') if w <> ''], ' ') || ' ' AS x FROM part)
SELECT p_partkey FROM w WHERE (contains(x, ' widget ') OR contains(x, ' gadget ')) AND NOT contains(x, ' cold ')""")
def x60(spark, d):
    """Pages that answer a query with alternatives and an exclusion."""
    return r.table(spark, d, "part").where(se.matches(F.concat_ws(" ", "p_name", "p_type"), "widget OR gadget -cold")).select("p_partkey")


@query("x29_n10_page_hashes", """SELECT p_partkey, sha256('{"title":"' || p_name || '","brand":"' || p_brand || '","size":' || p_size || '}') AS hash FROM part""")
def x29(spark, d):
    """Hash of what a page is made of, keys in a fixed order (n10: the text itself)."""
    return r.table(spark, d, "part").select("p_partkey", F.sha2(F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))), 256).alias("hash"))


@query("a34_run_stats", with_views("""SELECT marketplace, source, count(*) AS checked, count(*) FILTER (success) AS updated, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success IS NULL) AS skipped FROM (SELECT marketplace, p_source AS source, success FROM telemetry_events) GROUP BY 1, 2"""))
def a34(spark, d):
    """Outcomes of update runs by store and source."""
    e, many = r.telemetry_events(spark, d).withColumn("source", F.col("payload")["source"]), lambda c: F.count(F.when(c, 1))
    return e.groupBy("marketplace", "source").agg(F.count(F.lit(1)).alias("checked"), many(F.col("success")).alias("updated"), many(~F.col("success")).alias("failed"), many(F.col("success").isNull()).alias("skipped"))


@query("n19_n50_allowed", with_views(f"""SELECT id, marketplace IN {r.MONITORED[:2]} AND id % 7 <> 0 AS allowed, CASE WHEN length(product_id) >= 2 THEN product_id ELSE product_url END AS source_id FROM tracked_products"""))
def n19(spark, d):
    """Whether a row's store is watched (flag and cost guard), and the id that mappings are looked up by."""
    x = r.tracked_products(spark, d)
    guard = F.col("marketplace").isin(*r.MONITORED[:2])
    return x.select("id", (guard & (F.col("id") % 7 != 0)).alias("allowed"), F.coalesce(F.when(F.length("product_id") >= 2, F.col("product_id")), F.col("product_url")).alias("source_id"))


@query("n56_tracked_sync", with_views("""WITH l AS (SELECT user_id, product_id, max(id) AS id FROM tracked_products WHERE id % 2 = 0 OR id % 3 = 0 GROUP BY 1, 2), m AS (SELECT user_id, product_id, max(id) AS id, arg_max(deleted, id) AS deleted FROM tracked_products WHERE id % 3 <> 0 GROUP BY 1, 2)
SELECT coalesce(l.user_id, m.user_id) AS user_id, coalesce(l.product_id, m.product_id) AS product_id, greatest(coalesce(l.id, -1), coalesce(m.id, -1)) AS id FROM l FULL JOIN m ON l.user_id = m.user_id AND l.product_id = m.product_id WHERE NOT coalesce(m.deleted, false)"""))
def n56(spark, d):
    """Local and remote tracked rows as one list: remote deletions win, of a row on both sides the newer stays."""
    x = r.tracked_products(spark, d)
    by = ["user_id", "product_id"]
    local = x.where("id % 2 = 0 OR id % 3 = 0").groupBy(*by).agg(F.max("id").alias("l"))
    remote = x.where("id % 3 <> 0").groupBy(*by).agg(F.max("id").alias("m"), F.max_by("deleted", "id").alias("gone"))
    return local.join(remote, by, "full").where(~F.coalesce("gone", F.lit(False))).select(*by, F.greatest(F.coalesce("l", F.lit(-1)), F.coalesce("m", F.lit(-1))).alias("id"))


@query("n58_diagnostics", with_views("""SELECT install_id, count(*) AS kept, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warnings, max(created_at) AS last_at FROM (SELECT *, row_number() OVER (PARTITION BY install_id ORDER BY created_at DESC, event_id DESC) AS n FROM telemetry_events) WHERE n <= 50 GROUP BY 1"""))
def n58(spark, d):
    """Each installation's package: its last 50 events by level."""
    order = Window.partitionBy("install_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    e = r.telemetry_events(spark, d).withColumn("n", F.row_number().over(order)).where("n <= 50")
    return e.groupBy("install_id").agg(F.count(F.lit(1)).alias("kept"), F.count(F.when(F.col("level") == "error", 1)).alias("errors"), F.count(F.when(F.col("level") == "warn", 1)).alias("warnings"), F.max("created_at").alias("last_at"))


@query("n42_n43_texts", with_views("""WITH o AS (SELECT product, min(reference_price) AS ref, min(price) FILTER (price > 0) AS low, arg_min(marketplace, struct_pack(a := price, b := marketplace)) FILTER (price > 0) AS store, count(*) FILTER (price > 0) AS offers FROM offers GROUP BY 1)
SELECT product, concat_ws('; ', CASE WHEN low < ref THEN 'discount ' || floor((ref - low) * 100.0::DOUBLE / ref + 0.5::DOUBLE)::BIGINT || ' %' END, 'cheapest on ' || store, CASE WHEN offers > 1 THEN 'in ' || offers || ' stores' END) AS insight FROM o"""))
def n42(spark, d):
    """What is said of every product's price: discount, cheapest store, number of offers; unknown parts are left out."""
    p = F.when(n.has_price(F.col("price")), F.col("price"))
    g = r.offers(spark, d).groupBy("product").agg(F.min("reference_price").alias("ref"), F.min(p).alias("low"), F.min(F.when(p.isNotNull(), F.struct("price", "marketplace")))["marketplace"].alias("store"), F.count(p).alias("offers"))
    discount = F.when(F.col("low") < F.col("ref"), F.concat(F.lit("discount "), F.floor((F.col("ref") - F.col("low")) * 100.0 / F.col("ref") + 0.5).cast("string"), F.lit(" %")))
    return g.select("product", F.concat_ws("; ", discount, F.concat(F.lit("cheapest on "), "store"), F.when(F.col("offers") > 1, F.concat(F.lit("in "), F.col("offers").cast("string"), F.lit(" stores")))).alias("insight"))


@query("d64_agent_steps", """WITH s AS (SELECT p_partkey, ['start', 'parsed', 'searched', 'evaluated', 'ranked'][(p_partkey % 5 + 1)::INT] AS phase, p_size % 8 AS steps, p_size % 4 AS searches, (p_partkey % 12) / 10.0::DOUBLE AS cost, p_partkey % 50 AS seconds, p_partkey % 4 AS matched, p_partkey % 3 = 0 AS exact FROM part),
b AS (SELECT *, seconds >= 45 OR steps >= 6 OR cost >= 1.0::DOUBLE AS stop FROM s)
SELECT p_partkey, CASE phase WHEN 'ranked' THEN 'answer' WHEN 'start' THEN CASE WHEN stop THEN 'answer' WHEN exact THEN 'search' ELSE 'parse' END WHEN 'parsed' THEN CASE WHEN stop OR searches >= 3 THEN 'answer' ELSE 'search' END WHEN 'searched' THEN CASE WHEN stop THEN 'answer' ELSE 'evaluate' END
ELSE CASE WHEN matched >= 3 THEN CASE WHEN stop THEN 'answer' ELSE 'rank' END WHEN stop OR searches >= 3 THEN 'answer' ELSE 'search' END END AS step FROM b""")
def d64(spark, d):
    """The next step of every search by an agent, within its budgets of steps, searches, cost and time."""
    s = F.col("p_size")
    step = of.agent_step(r.pick(("start", "parsed", "searched", "evaluated", "ranked"), _k()), s % 8, s % 4, (_k() % 12) / 10.0, _k() % 50, _k() % 4, _k() % 3 == 0)
    return r.table(spark, d, "part").select("p_partkey", step.alias("step"))


@query("x53_x54_clean_titles", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE p_name || ' - Amazon' END AS cleaned, CASE WHEN p_partkey % 4 = 0 THEN true ELSE false END AS promo FROM part""")
def x53(spark, d):
    """Titles without a store's tail, and which are badges instead of names."""
    given = F.concat("p_name", r.pick((" | Ozon официальный сайт", " купить в Москве", " - Amazon"), _k()))
    return r.table(spark, d, "part").select("p_partkey", t.clean_title(given).alias("cleaned"), t.promo_title(F.when(_k() % 4 == 0, "Распродажа").otherwise(F.col("p_name"))).alias("promo"))
