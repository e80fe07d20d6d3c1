"""Queries over offers, candidates, feedback and mappings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as n
from ..functions import text as t
from ..operators import matching as m
from ..operators import series as s
from ..registry import query
from ..sources import relations as r
from ..sources.relations import as_of, with_views


def half_up(x: str, digits: int = 0) -> str:
    return f"floor(({x}) * {10.0**digits}::DOUBLE + 0.5::DOUBLE) / {10.0**digits}::DOUBLE"


PRIORITY = """least(120.0, greatest(0.0, floor(confidence + CASE WHEN price > 0 AND reference_price > 0 THEN
 CASE WHEN price / reference_price >= 0.7 AND price / reference_price <= 1.2 THEN 8 WHEN price / reference_price >= 0.55 AND price / reference_price <= 1.4 THEN 3 ELSE 0 END +
 CASE WHEN price <= reference_price THEN 8 WHEN price <= reference_price * 1.1::DOUBLE THEN 4 WHEN price > reference_price * 1.35::DOUBLE THEN -12 WHEN price > reference_price * 1.2::DOUBLE THEN -6 ELSE 0 END ELSE 0 END
 + CASE WHEN rating >= 4.7 THEN 2 WHEN rating >= 4.3 THEN 1 ELSE 0 END + 5 + 0.5)))::BIGINT"""
STATUS = "CASE WHEN confidence >= 90 AND alternatives = 0 THEN 'verified' WHEN confidence >= 70 AND alternatives > 0 THEN 'probable' WHEN confidence >= 85 THEN 'verified' WHEN confidence >= 55 THEN 'probable' ELSE 'not_found' END"


@query("d19_priority", with_views(f"SELECT product, marketplace, {PRIORITY} AS priority FROM offers"))
def d19(spark, d):
    """Rank of every candidate offer."""
    o = r.offers(spark, d)
    return o.select("product", "marketplace", m.priority(F.col("confidence"), F.col("price"), F.col("reference_price"), F.col("rating"), F.lit(True)).alias("priority"))


@query("d20_status", with_views(f"WITH o AS (SELECT *, product % 3 AS alternatives FROM offers) SELECT product, marketplace, {STATUS} AS match_status FROM o"))
def d20(spark, d):
    """Status of every offer from its confidence and alternatives."""
    return r.offers(spark, d).select("product", "marketplace", m.status(F.col("confidence"), F.col("product") % 3).alias("match_status"))


TOP2 = """ranked AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY confidence DESC, price NULLS LAST, marketplace) AS n, count(*) OVER (PARTITION BY product) - 1 AS alternatives FROM offers),
best AS (SELECT product, max(confidence) FILTER (n = 1) AS best, max(confidence) FILTER (n = 2) AS second, max(alternatives) AS alternatives FROM ranked GROUP BY 1)"""
TIE = "coalesce(best >= 70 AND second >= 55 AND best - second <= 5, false)"


def _top2(spark, d):
    w = Window.partitionBy("product")
    ranked = r.offers(spark, d).withColumn("n", F.row_number().over(w.orderBy(F.desc("confidence"), F.asc_nulls_last("price"), "marketplace"))).withColumn("alternatives", F.count(F.lit(1)).over(w) - 1)
    return ranked.groupBy("product").agg(F.max(F.when(F.col("n") == 1, F.col("confidence"))).alias("best"), F.max(F.when(F.col("n") == 2, F.col("confidence"))).alias("second"), F.max("alternatives").alias("alternatives"))


@query("d21_d22_d23_outcome", with_views(f"""WITH {TOP2} SELECT product, best >= 70 AND NOT {TIE} AS auto_pick,
CASE WHEN best < 55 THEN CASE WHEN alternatives > 0 THEN 'needs_choice' ELSE 'not_found' END WHEN best < 70 OR {TIE} THEN 'needs_choice' ELSE {STATUS.replace('confidence', 'best')} END AS outcome,
{TIE} AS tie, {TIE} OR (best >= 75 AND best < 90) AS tiebreak FROM best"""))  # fmt: skip
def d21(spark, d):
    """Whether each product's best candidate is picked, left to the user, or tied (w11)."""
    o = _top2(spark, d).withColumn("o", m.outcome(F.col("best"), F.col("second"), F.col("alternatives")))
    return o.select("product", F.col("o.auto_pick").alias("auto_pick"), F.col("o.status").alias("outcome"), m.tie(F.col("best"), F.col("second")).alias("tie"), m.needs_tiebreak(F.col("best"), F.col("second")).alias("tiebreak"))


@query("t3_t4_top_candidates", with_views(f"""SELECT product, marketplace, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY {PRIORITY} DESC, confidence DESC, price NULLS LAST, marketplace) AS n FROM offers) WHERE n <= 3"""))
def t3(spark, d):
    """Each product's three best candidates: priority, confidence, then price (n30 takes the first)."""
    p = m.priority(F.col("confidence"), F.col("price"), F.col("reference_price"), F.col("rating"), F.lit(True))
    order = Window.partitionBy("product").orderBy(F.desc("p"), F.desc("confidence"), F.asc_nulls_last("price"), "marketplace")
    return r.offers(spark, d).withColumn("p", p).withColumn("place", F.row_number().over(order).cast("bigint")).where("place <= 3").select("product", "marketplace", "place")


@query("t9_d25_cheapest_close", with_views("""WITH c AS (SELECT *, max(confidence) OVER w - confidence <= 5 AND coalesce(price > 0, false) AS close FROM offers WINDOW w AS (PARTITION BY product)),
k AS (SELECT *, count(*) FILTER (close) OVER w AS n_close, min(price) FILTER (close) OVER w AS low, max(price) FILTER (close) OVER w AS high FROM c WINDOW w AS (PARTITION BY product)),
r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY CASE WHEN n_close >= 2 AND close THEN 0 ELSE 1 END, CASE WHEN n_close >= 2 AND close THEN price END NULLS FIRST, confidence DESC, marketplace) AS n FROM k)
SELECT product, marketplace, price, confidence, n_close >= 2 AND high / low >= 1.05 AS large_spread FROM r WHERE n = 1"""))  # fmt: skip
def t9(spark, d):
    """Cheapest of the offers whose confidence is close to the best, and whether their prices spread too far."""
    out = m.cheapest_of_close(r.offers(spark, d), "product")
    return out.withColumn("large_spread", F.coalesce("large_spread", F.lit(False)))


@query("t11_cheapest_offer", with_views("""SELECT product, marketplace, price FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY price, marketplace) AS n FROM offers
WHERE price > 0 AND (status IN ('verified', 'probable') OR confidence >= 55)) WHERE n = 1"""))  # fmt: skip
def t11(spark, d):
    """Cheapest trustworthy offer of each product (f13)."""
    good = r.offers(spark, d).where(n.has_price(F.col("price")) & (F.col("status").isin("verified", "probable") | (F.col("confidence") >= 55)))
    return s.newest(good, ["product"], F.col("price"), F.col("marketplace")).select("product", "marketplace", "price")


@query("m9_best_of_key", with_views("SELECT product, marketplace, confidence FROM (SELECT *, row_number() OVER (PARTITION BY product, status ORDER BY confidence DESC, marketplace) AS n FROM offers) WHERE n = 1"))
def m9(spark, d):
    """Best row of each key, first one on ties (m10, m11, m13, m19 differ in their order)."""
    return s.newest(r.offers(spark, d), ["product", "status"], F.desc("confidence"), F.col("marketplace")).select("product", "marketplace", "confidence")


@query("f7_f10_price_rules", with_views("""SELECT product, marketplace, CASE WHEN coalesce(price > 0, false) AND reference_price > 0 THEN greatest(price, reference_price) / least(price, reference_price) <= 1.3 ELSE true END AS compatible,
coalesce(price > 0 AND reference_price > 0 AND greatest(price, reference_price) / least(price, reference_price) > 2, false) AS outlier, coalesce(price > 0 AND price < reference_price * 0.2::DOUBLE, false) AS too_cheap FROM offers"""))  # fmt: skip
def f7(spark, d):
    """Price compatibility (f7, f8), search outliers (f9) and absurdly cheap cards (f10)."""
    p, ref = F.col("price"), F.col("reference_price")
    return r.offers(spark, d).select("product", "marketplace", n.prices_compatible(p, ref, 1.3).alias("compatible"), n.serp_outlier(ref, p).alias("outlier"), n.too_cheap(ref, p).alias("too_cheap"))


@query("j17_pairs", with_views("""SELECT a.product AS reference, b.product AS candidate FROM (SELECT * FROM offers WHERE marketplace = 'ozon') a JOIN (SELECT * FROM offers WHERE marketplace = 'wildberries') b USING (brand, category)
WHERE a.product <> b.product AND least(a.price, b.price) > 0 AND greatest(a.price, b.price) / least(a.price, b.price) <= 1.3"""))  # fmt: skip
def j17(spark, d):
    """Candidate pairs across two stores, blocked by brand and category."""
    o = r.offers(spark, d)
    return m.pairs_by_block(o.where("marketplace = 'ozon'"), o.where("marketplace = 'wildberries'"), ["brand", "category"], 1.3).select("reference", "candidate")


@query("d6_d9_d10_similarity", """WITH p AS (SELECT p_partkey, p_name AS a, p_type || ' ' || split_part(p_name, ' ', 1) AS b FROM part),
w AS (SELECT p_partkey, a, b, list_distinct([x for x in string_split(trim(regexp_replace(regexp_replace(lower(a), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') if len(x) > 2 AND x NOT IN ('the', 'and', 'with', 'new', 'pro')]) AS x,
  list_distinct([x for x in string_split(trim(regexp_replace(regexp_replace(lower(b), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') if len(x) > 2 AND x NOT IN ('the', 'and', 'with', 'new', 'pro')]) AS y FROM p)
SELECT p_partkey, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / greatest(len(x), len(y)) END AS overlap,
  1 - levenshtein(lower(a), lower(b))::DOUBLE / greatest(len(a), len(b)) AS edit_similarity,
  floor(len([k for k in string_split(lower(a), ' ') if len(k) > 2 AND list_contains([z for z in string_split(lower(b), ' ') if len(z) > 2], k)]) * 100.0::DOUBLE / len([k for k in string_split(lower(a), ' ') if len(k) > 2]) + 0.5::DOUBLE)::BIGINT AS title_score FROM w""")  # fmt: skip
def d6(spark, d):
    """Three title similarities (d8 is the distance itself)."""
    a, b = F.col("p_name"), F.concat(F.col("p_type"), F.lit(" "), F.split("p_name", " ")[0])
    return r.table(spark, d, "part").select("p_partkey", t.word_overlap(a, b).alias("overlap"), t.edit_similarity(a, b).alias("edit_similarity"), t.title_score(a, b).cast("bigint").alias("title_score"))


F_NOW = "(SELECT max(created_at) FROM match_feedback)"
FEED = f"""feed AS (SELECT {{key}}count(*) FILTER (accepted) AS accepts, count(*) FILTER (NOT accepted) AS rejects, count(DISTINCT created_at::DATE) FILTER (accepted) AS accept_days, count(DISTINCT user_id) FILTER (accepted) AS distinct_users,
  floor(avg(match_confidence) FILTER (accepted AND match_confidence > 0) + 0.5::DOUBLE)::BIGINT AS avg_confidence, count(*) FILTER (NOT accepted AND created_at >= {F_NOW} - INTERVAL 7 DAY) AS recent_rejects FROM match_feedback {{group}})"""
BY_PRINT = FEED.format(key="lower(trim(fingerprint)) AS fingerprint, ", group="GROUP BY 1")


@query("a23_a24_feedback", with_views(f"WITH {BY_PRINT} SELECT * FROM feed"))
def a23(spark, d):
    """Accepts and rejects by fingerprint."""
    rows = r.match_feedback(spark, d)
    return m.feedback_by(rows, as_of(rows, "created_at"), F.lower(F.trim("fingerprint")).alias("fingerprint"))


@query("d30_d31_promotion", with_views(f"""WITH {BY_PRINT} SELECT fingerprint, CASE WHEN accepts < 2 THEN 'insufficient_accepts' WHEN accept_days < 2 THEN 'insufficient_accept_days' WHEN distinct_users > 0 AND distinct_users < 2 THEN 'insufficient_distinct_users'
WHEN rejects > 0 AND rejects >= accepts * 0.5 THEN 'reject_ratio' WHEN rejects >= accepts THEN 'rejects_gte_accepts' WHEN recent_rejects > 0 THEN 'recent_reject_cooldown' WHEN avg_confidence < 70 THEN 'avg_confidence_low' ELSE 'ok' END AS reason,
CASE WHEN avg_confidence > 0 THEN least(95, greatest(least(95, 70 + accepts * 5), avg_confidence)) ELSE least(95, 70 + accepts * 5) END AS promoted_confidence FROM feed"""))  # fmt: skip
def d30(spark, d):
    """Why a mapping isn't shared yet, and the confidence that it would have (d33: the pipeline's decision)."""
    return m.promotion(a23(spark, d)).select("fingerprint", "reason", "promoted_confidence")


@query("d29_bias", with_views(f"""WITH {BY_PRINT} SELECT fingerprint, CASE WHEN recent_rejects > 0 OR rejects > accepts THEN -0.08::DOUBLE WHEN rejects > 0 THEN -least(0.08::DOUBLE, rejects * 0.02::DOUBLE + greatest(0, rejects - accepts) * 0.02::DOUBLE)
WHEN accepts > 0 THEN least(0.06::DOUBLE, accepts * 0.015::DOUBLE) ELSE 0.0::DOUBLE END AS delta, recent_rejects > 0 OR rejects > accepts AS blocked FROM feed"""))  # fmt: skip
def d29(spark, d):
    """What feedback adds to a score."""
    b = m.feedback_bias(F.col("accepts"), F.col("rejects"), F.col("recent_rejects"))
    return a23(spark, d).select("fingerprint", b["delta"].alias("delta"), b["blocked"].alias("blocked"))


CAL = """cases AS (SELECT l_orderkey % 101 AS best, l_partkey % 101 AS second, l_suppkey % 4 AS alternatives, CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'N' THEN 'probable' ELSE 'not_found' END AS expected FROM lineitem),
o AS (SELECT *, coalesce(best >= 70 AND second >= 55 AND best - second <= 5, false) AS tie FROM cases),
q AS (SELECT *, best >= 72 AND NOT tie AS auto_pick, CASE WHEN best < 57 THEN CASE WHEN alternatives > 0 THEN 'needs_choice' ELSE 'not_found' END WHEN best < 72 OR tie THEN 'needs_choice'
  WHEN best >= 90 AND alternatives = 0 THEN 'verified' WHEN alternatives > 0 THEN 'probable' WHEN best >= 85 THEN 'verified' ELSE 'probable' END AS said FROM o)"""


@query("a25_calibration", f"""WITH {CAL} SELECT count(*) FILTER (auto_pick AND expected <> 'verified')::DOUBLE / count(*) AS false_auto_pick_rate,
count(*) FILTER (said = 'verified' AND expected = 'verified')::DOUBLE / count(*) FILTER (said = 'verified') AS precision_verified, count(*) FILTER (said = 'needs_choice')::DOUBLE / count(*) AS needs_choice_rate,
count(*) FILTER (said = 'verified') AS verified_count, count(*) AS total FROM q""")  # fmt: skip
def a25(spark, d):
    """How well the calibrated thresholds decide."""
    expected = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "probable").otherwise("not_found")
    cases = r.table(spark, d, "lineitem").select((F.col("l_orderkey") % 101).alias("best"), (F.col("l_partkey") % 101).alias("second"), (F.col("l_suppkey") % 4).alias("alternatives"), expected.alias("expected"))
    return m.calibration(cases, m.CALIBRATED)


@query("j9_n6_lookup", with_views("""SELECT source_product_id, target_product_id, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY source_product_id ORDER BY rank, confidence DESC, target_product_id) AS n
FROM cross_market_mapping WHERE status = 'active') WHERE n <= 4"""))  # fmt: skip
def j9(spark, d):
    """Up to four active edges of each source, by rank."""
    edges = r.cross_market_mapping(spark, d).where("status = 'active'")
    order = Window.partitionBy("source_product_id").orderBy("rank", F.desc("confidence"), "target_product_id")
    return edges.withColumn("place", F.row_number().over(order).cast("bigint")).where("place <= 4").select("source_product_id", "target_product_id", "place")


@query("j10_n11_priced_edges", with_views("""SELECT m.source_product_id, m.target_product_id, c.price FROM cross_market_mapping m JOIN price_cache c ON m.target_marketplace = c.marketplace AND m.target_product_id = c.product_id
WHERE m.status = 'active' AND c.price > 0"""))  # fmt: skip
def j10(spark, d):
    """Active edges with the cached price of their target."""
    edges = r.cross_market_mapping(spark, d).where("status = 'active'")
    cache = r.price_cache(spark, d).select(F.col("marketplace").alias("target_marketplace"), F.col("product_id").alias("target_product_id"), "price").where("price > 0")
    return edges.join(cache, ["target_marketplace", "target_product_id"]).select("source_product_id", "target_product_id", "price")


PRICED = f"""e AS (SELECT *, row_number() OVER (PARTITION BY source_marketplace, source_product_id, target_marketplace ORDER BY rank, confidence DESC, target_product_id) AS turn FROM cross_market_mapping WHERE status = 'active' AND source_marketplace <> target_marketplace),
p AS (SELECT e.*, c.price, s.price AS source_price, list_position({list(r.WATCHED)}, target_marketplace) AS store FROM e LEFT JOIN price_cache c ON c.price > 0 AND c.marketplace = target_marketplace AND c.product_id = target_product_id
  LEFT JOIN price_cache s ON s.price > 0 AND s.marketplace = source_marketplace AND s.product_id = source_product_id)"""


@query("n6_offers_snapshot", with_views(f"""WITH {PRICED}, u AS (SELECT DISTINCT source_marketplace, source_product_id, source_marketplace AS marketplace, source_product_id AS product_id, c.price, 0 AS store, 0 AS turn FROM cross_market_mapping JOIN price_cache c ON price > 0 AND c.marketplace = source_marketplace AND c.product_id = source_product_id
UNION ALL SELECT source_marketplace, source_product_id, target_marketplace, target_product_id, price, store, turn FROM p WHERE turn <= 3 AND price IS NOT NULL)
SELECT source_marketplace, source_product_id, marketplace, product_id, price, row_number() OVER (PARTITION BY source_marketplace, source_product_id ORDER BY store, turn) AS place FROM u QUALIFY place <= 6"""))  # fmt: skip
def n6(spark, d):
    """Priced offers of each source: its own, then of up to three edges a store, six at most."""
    return m.offers_snapshot(r.cross_market_mapping(spark, d), r.price_cache(spark, d), r.WATCHED)


@query("n11_cheap_offers", with_views(f"""WITH {PRICED} SELECT source_marketplace, source_product_id, target_marketplace, target_product_id, price, row_number() OVER (PARTITION BY source_marketplace, source_product_id ORDER BY price, store) AS place
FROM p WHERE turn = 1 AND price IS NOT NULL AND (source_price IS NULL OR price < source_price)"""))  # fmt: skip
def n11(spark, d):
    """Of each source's first edge a store, the priced ones below the source's own price, cheapest first."""
    return m.cheap_offers(r.cross_market_mapping(spark, d), r.price_cache(spark, d), r.WATCHED)


@query("d32_m24_dispute", with_views("""SELECT source_product_id, target_product_id, greatest(0, confidence - 35) AS confidence, greatest(0, hits - 2) AS hits, CASE WHEN fail_count >= 3 THEN 'dead' ELSE 'disputed' END AS status FROM cross_market_mapping"""))
def d32(spark, d):
    """What a dispute makes of every edge."""
    c = F.col
    return r.cross_market_mapping(spark, d).select("source_product_id", "target_product_id", F.greatest(F.lit(0), c("confidence") - 35).alias("confidence"), F.greatest(F.lit(0), c("hits") - 2).alias("hits"), F.when(c("fail_count") >= 3, "dead").otherwise("disputed").alias("status"))


@query("d50_reuse", with_views("SELECT evidence, status, count(*) FILTER (status = 'active' AND (evidence IN ('manual', 'multi_user') OR (evidence = 'auto' AND confidence >= 85))) AS reusable, count(*) AS edges FROM cross_market_mapping GROUP BY 1, 2"))
def d50(spark, d):
    """Edges whose analysis may be reused."""
    ok = (F.col("status") == "active") & (F.col("evidence").isin("manual", "multi_user") | ((F.col("evidence") == "auto") & (F.col("confidence") >= 85)))
    return r.cross_market_mapping(spark, d).groupBy("evidence", "status").agg(F.count(F.when(ok, 1)).alias("reusable"), F.count(F.lit(1)).alias("edges"))


@query("j14_all_alert_pairs", with_views("""WITH w AS (SELECT product, marketplace, price * 0.8::DOUBLE AS new_price FROM offers)
SELECT coalesce(o.product, w.product) AS product, coalesce(o.marketplace, w.marketplace) AS marketplace, o.price AS old_price, new_price FROM offers o FULL JOIN w ON o.product = w.product AND o.marketplace = w.marketplace"""))  # fmt: skip
def j14_all(spark, d):
    """Every offer's old and new price, either side kept."""
    o = r.offers(spark, d)
    new = o.select("product", "marketplace", (F.col("price") * 0.8).alias("new_price"))
    return o.select("product", "marketplace", F.col("price").alias("old_price")).join(new, ["product", "marketplace"], "full")


@query("j19_peers", "SELECT a.p_partkey AS page, count(*) AS peers FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey GROUP BY 1")
def j19(spark, d):
    """How many other pages share each page's canonical product."""
    part = r.table(spark, d, "part")
    group = part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("size"))
    return part.join(group, ["p_brand", "p_type"]).where("size > 1").select(F.col("p_partkey").alias("page"), (F.col("size") - 1).alias("peers"))


@query("t15_primary", "SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_retailprice NULLS LAST, p_partkey) AS n FROM part) WHERE n = 1")
def t15(spark, d):
    """Primary page of each canonical product."""
    return s.newest(r.table(spark, d, "part"), ["p_brand", "p_type"], F.desc("p_size"), F.asc_nulls_last("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_type", "p_partkey")


@query("x32_slug_collisions", """SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS base,
row_number() OVER (PARTITION BY regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') ORDER BY p_partkey) AS n FROM part)""")  # fmt: skip
def x32(spark, d):
    """A slug for each page (x31); later ones of a slug get a number."""
    base = r.table(spark, d, "part").select("p_partkey", t.slug(F.col("p_name")).alias("base"))
    place = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return base.withColumn("n", place).select("p_partkey", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("slug"))


@query("t1_t2_pages", "SELECT p_partkey, p_retailprice FROM part WHERE (p_retailprice, p_partkey) < (1500.0::DOUBLE, 0) ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 20")
def t1(spark, d):
    """A page of 20 after a cursor (order, limit and keyset in one; the limit is the feature)."""
    part = r.table(spark, d, "part")
    after = (F.col("p_retailprice") < 1500.0) | ((F.col("p_retailprice") == 1500.0) & (F.col("p_partkey") < 0))
    return part.where(after).orderBy(F.desc("p_retailprice"), F.desc("p_partkey")).limit(20).select("p_partkey", "p_retailprice")


@query("f3_search", "SELECT p_partkey FROM part WHERE p_name ILIKE '%a%' OR p_brand ILIKE '%1%'")
def f3(spark, d):
    """Pages whose title or brand contains a query."""
    return r.table(spark, d, "part").where(F.col("p_name").ilike("%a%") | F.col("p_brand").ilike("%1%")).select("p_partkey")


@query("x42_x48_x49_x52_numbers", f"""SELECT p_partkey, CASE WHEN p_retailprice >= 1000 THEN floor(p_retailprice / 100 + 0.5::DOUBLE)::BIGINT ELSE floor(p_retailprice + 0.5::DOUBLE)::BIGINT END AS rubles,
CASE WHEN p_size / 10.0::DOUBLE >= 1 AND p_size / 10.0::DOUBLE <= 5 THEN {half_up('p_size / 10.0::DOUBLE', 1)} END AS rating,
CASE WHEN (CASE WHEN p_size > 10 AND p_size <= 100 THEN p_size / 10.0::DOUBLE ELSE p_size::DOUBLE END) BETWEEN 1 AND 10 THEN {half_up('CASE WHEN p_size > 10 AND p_size <= 100 THEN p_size / 10.0::DOUBLE ELSE p_size::DOUBLE END', 1)} END AS quality FROM part""")  # fmt: skip
def x42(spark, d):
    """Kopecks, ratings and quality scores normalised."""
    c = F.col
    return r.table(spark, d, "part").select("p_partkey", n.whole_rubles(c("p_retailprice")).alias("rubles"), n.rating(c("p_size") / 10.0).alias("rating"), n.quality_score(c("p_size").cast("double")).alias("quality"))


@query("x38_ids", with_views("SELECT id, CASE marketplace WHEN 'wildberries' THEN 'wb-' WHEN 'ozon' THEN 'ozon-' ELSE 'ym-' END || product_id AS prefixed, product_id AS bare, length(product_id) >= 4 AS stable FROM tracked_products"))
def x38(spark, d):
    """Product ids with their store's prefix and without (x38, x39), and which are stable articles (x40)."""
    mp, pid = F.col("marketplace"), F.col("product_id")
    full = t.prefixed_id(mp, pid)
    return r.tracked_products(spark, d).select("id", full.alias("prefixed"), t.bare_id(mp, full).alias("bare"), t.stable_article(pid).alias("stable"))


@query("d52_sentiment", """SELECT doc_id, CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE (p - n)::DOUBLE / (p + n) END AS sentiment FROM (SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT AS p,
contains(lower(text), 'idiot')::INT + contains(lower(text), 'trash')::INT AS n FROM documents)""")  # fmt: skip
def d52(spark, d):
    """Sentiment by stems, which are parameters."""
    return r.table(spark, d, "documents").select("doc_id", t.sentiment(F.col("text"), ("the", "and"), ("idiot", "trash")).alias("sentiment"))


@query("a29_fake_risk", """SELECT source, CASE WHEN count(*) < 3 THEN 'medium' WHEN avg(length(text)) < 60 AND count(*) FILTER (contains(lower(text), 'worthless')) > count(*) * 0.5 THEN 'high'
WHEN count(DISTINCT lower(left(text, 40)))::DOUBLE / count(*) < 0.5 OR count(*) FILTER (contains(lower(text), 'worthless')) > count(*) * 0.35 THEN 'medium' ELSE 'low' END AS risk FROM documents GROUP BY 1""")  # fmt: skip
def a29(spark, d):
    """Risk that a source's reviews are fake; template phrases are parameters."""
    docs = r.table(spark, d, "documents")
    many, template = F.count(F.lit(1)), F.count(F.when(F.lower("text").contains("worthless"), 1))
    starts = F.count_distinct(F.lower(F.substring("text", 1, 40)))
    risk = F.when(many < 3, "medium").when((F.avg(F.length("text")) < 60) & (template > many * 0.5), "high").when((starts / many < 0.5) | (template > many * 0.35), "medium").otherwise("low")
    return docs.groupBy("source").agg(risk.alias("risk"))


@query("a28_d54_reviews", """WITH g AS (SELECT source, floor(avg(CASE WHEN quality = 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS rating, count(*) FILTER (quality = 1)::DOUBLE / count(*) AS good, count(*) FILTER (quality = 0)::DOUBLE / count(*) AS bad
FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT *, CASE WHEN rating >= 4.3 AND bad < 0.25 THEN 'buy_now' WHEN rating >= 3.8 AND bad < 0.35 THEN 'wait_discount' WHEN rating < 3.0 OR bad > 0.55 THEN 'not_recommended' WHEN rating >= 3.3 AND good >= bad THEN 'wait_discount' ELSE 'not_recommended' END AS verdict FROM g""")  # fmt: skip
def a28(spark, d):
    """Rating and shares of each source's reviews, and the verdict at low fake risk (a26: the mean alone)."""
    rows = r.table(spark, d, "documents").select("doc_id", "source").join(r.table(spark, d, "labels"), "doc_id")
    stars, c = F.when(F.col("quality") == 1, 5.0).otherwise(1.0), F.col
    many = F.count(F.lit(1))
    g = rows.groupBy("source").agg(n.round_half_up(F.avg(stars), 1).alias("rating"), (F.count(F.when(stars >= 4, 1)) / many).alias("good"), (F.count(F.when(stars <= 2.5, 1)) / many).alias("bad"))
    verdict = (
        F.when((c("rating") >= 4.3) & (c("bad") < 0.25), "buy_now").when((c("rating") >= 3.8) & (c("bad") < 0.35), "wait_discount").when((c("rating") < 3.0) | (c("bad") > 0.55), "not_recommended")
        .when((c("rating") >= 3.3) & (c("good") >= c("bad")), "wait_discount").otherwise("not_recommended")
    )
    return g.withColumn("verdict", verdict)
