"""Queries over offers, tracked rows and titles: filters, choices, identity, links, prices in text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as t
from ..operators import offers as o
from ..operators import series as s
from ..registry import query
from ..sources import relations as r
from ..sources.relations import with_views

RATIO = "greatest(price, reference_price) / least(price, reference_price)"


@query("f1_f2_f4_filters", with_views("""SELECT id, marketplace FROM tracked_products WHERE marketplace IN ('ozon', 'wildberries') AND NOT deleted AND last_price >= 1000
AND (last_checked IS NULL OR last_checked > (SELECT max(last_checked) FROM tracked_products) - INTERVAL 90 DAY)"""))  # fmt: skip
def f1(spark, d):
    """Live rows of two stores from a price on, never checked or checked within 90 days."""
    rows = r.tracked_products(spark, d)
    recent = F.col("last_checked") > r.as_of(rows, "last_checked") - F.expr("INTERVAL 90 DAYS")
    return rows.where(F.col("marketplace").isin("ozon", "wildberries") & ~F.col("deleted") & (F.col("last_price") >= 1000) & (F.col("last_checked").isNull() | recent)).select("id", "marketplace")


@query("f13_f16_n9_budget", with_views("SELECT product, count(*) FILTER (price > 0) AS priced, count(*) FILTER (price IS NULL OR price <= reference_price) AS within_budget FROM offers GROUP BY product"))
def f16(spark, d):
    """Priced offers of each product, and those within a budget."""
    rows = r.offers(spark, d)
    return rows.groupBy("product").agg(F.count_if(num.has_price(F.col("price"))).alias("priced"), F.count_if(o.within_budget(F.col("price"), F.col("reference_price"))).alias("within_budget"))


@query("f24_track_limit", with_views("""SELECT id, user_id, deleted OR count(*) FILTER (NOT deleted) OVER (PARTITION BY user_id ORDER BY updated_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 5 AS allowed FROM tracked_products"""))
def f24(spark, d):
    """Whether each tracked row fits its owner's limit."""
    return o.track_allowed(r.tracked_products(spark, d), "user_id", ["updated_at", "id"], 5).select("id", "user_id", "allowed")


@query("j4_f26_without_license", with_views("SELECT id, user_id FROM tracked_products WHERE user_id NOT IN (SELECT p.user_id FROM user_premium p JOIN license_keys k ON p.license_key_id = k.id WHERE k.is_active)"))
def j4(spark, d):
    """Tracked rows whose owner has no active license: the rest of a delete by subquery."""
    active = r.user_premium(spark, d).join(r.license_keys(spark, d).where("is_active"), F.col("license_key_id") == F.col("id"), "left_semi")
    return r.tracked_products(spark, d).join(active, "user_id", "left_anti").select("id", "user_id")


@query("j7_j11_n25_latest_by_id", with_views("""SELECT wanted, id FROM (SELECT w.wanted, p.id, row_number() OVER (PARTITION BY w.wanted ORDER BY p.updated_at DESC, p.id) AS n
FROM (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'ozon-' || user_id % 200 ELSE (user_id % 200)::VARCHAR END AS wanted FROM events) w
JOIN tracked_products p ON p.marketplace = 'ozon' AND p.product_id = regexp_replace(w.wanted, '^ozon-', '')) WHERE n = 1"""))  # fmt: skip
def j11(spark, d):
    """Newest tracked row of each id, with or without its store's prefix: the prefix goes before the join."""
    number = (F.col("user_id") % 200).cast("string")
    wanted = r.table(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("ozon-"), number)).otherwise(number).alias("wanted")).distinct()
    rows = r.tracked_products(spark, d).where("marketplace = 'ozon'")
    met = wanted.withColumn("product_id", F.regexp_replace("wanted", "^ozon-", "")).join(rows, "product_id")
    return s.newest(met, ["wanted"], F.desc("updated_at"), F.col("id")).select("wanted", "id")


@query("a18_a20_subscribers", with_views("SELECT marketplace, count(*) FILTER (NOT deleted) AS active, sum(consecutive_unavailable_count)::BIGINT AS failures, count(*) AS tracked FROM tracked_products GROUP BY 1"))
def a20(spark, d):
    """Live rows, sums and counts by store."""
    return r.tracked_products(spark, d).groupBy("marketplace").agg(F.count_if(~F.col("deleted")).alias("active"), F.sum("consecutive_unavailable_count").alias("failures"), F.count(F.lit(1)).alias("tracked"))


@query("a26_ratings", with_views("""SELECT product, CASE WHEN count(tenths) >= 3 THEN floor(sum(tenths)::DOUBLE / count(tenths) + 0.5::DOUBLE) / 10.0::DOUBLE END AS rating
FROM (SELECT product, CASE WHEN rating >= 1 AND rating <= 5 THEN round(rating * 10)::BIGINT END AS tenths FROM offers) GROUP BY product"""))  # fmt: skip
def a26(spark, d):
    """Mean rating of each product, if three or more offers have one from 1 to 5."""
    tenths = F.when(F.col("rating").between(1, 5), F.round(F.col("rating") * 10).cast("bigint"))
    by = r.offers(spark, d).groupBy("product").agg(F.count(tenths).alias("n"), F.sum(tenths).alias("total"))
    return by.select("product", F.when(F.col("n") >= 3, F.floor(F.col("total") / F.col("n") + 0.5) / 10.0).alias("rating"))


@query("a27_reviews", "SELECT source, count(*) FILTER (regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')) AS reviews FROM documents GROUP BY source")
def a27(spark, d):
    """Reviews with any text, by source."""
    return r.table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("text").rlike(r"[^ \t\n\r\f\x0B]")).alias("reviews"))


@query("w11_tie_window", with_views("""SELECT product, max(confidence) FILTER (n = 1) AS best, max(confidence) FILTER (n = 2) AS second, coalesce(max(confidence) FILTER (n = 1) - max(confidence) FILTER (n = 2) <= 5, false) AS tie,
max(price) FILTER (price > 0 AND top - confidence <= 5) - min(price) FILTER (price > 0 AND top - confidence <= 5) AS spread
FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY confidence DESC, marketplace) AS n, max(confidence) OVER (PARTITION BY product) AS top FROM offers) GROUP BY product"""))  # fmt: skip
def w11(spark, d):
    """First two candidates of each product, and the price spread of close ones."""
    return o.tie_window(r.offers(spark, d), "product", [F.desc("confidence"), F.col("marketplace")], 5).select("product", "best", "second", "tie", "spread")


@query("t6_top_matches", with_views(f"""SELECT product, marketplace, place FROM (SELECT product, marketplace, row_number() OVER (PARTITION BY product ORDER BY confidence DESC, marketplace) AS place FROM offers
WHERE confidence >= 46.75::DOUBLE AND (coalesce(price, 0) <= 0 OR {RATIO} <= 1.82::DOUBLE)) WHERE place <= 3"""))  # fmt: skip
def t6(spark, d):
    """The three best matches under loosened limits."""
    fits = (F.col("confidence") >= 46.75) & num.prices_compatible(F.col("price"), F.col("reference_price"), 1.82)
    best = Window.partitionBy("product").orderBy(F.desc("confidence"), "marketplace")
    return r.offers(spark, d).where(fits).withColumn("place", F.row_number().over(best)).where("place <= 3").select("product", "marketplace", "place")


@query("t10_n30_picker", with_views("SELECT product, marketplace, row_number() OVER (PARTITION BY product ORDER BY status = 'verified' DESC, confidence DESC, marketplace) AS place FROM offers WHERE status <> 'needs_choice'"))
def t10(spark, d):
    """Candidates that aren't excluded, verified ones first: the first is the next in the pool."""
    order = Window.partitionBy("product").orderBy((F.col("status") == "verified").desc(), F.desc("confidence"), "marketplace")
    return r.offers(spark, d).where("status <> 'needs_choice'").select("product", "marketplace", F.row_number().over(order).alias("place"))


@query("m4_words", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def m4(spark, d):
    """Words of titles as rows, counted."""
    return r.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("m8_latest_by_owner", with_views("""SELECT user_id, marketplace, product_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, marketplace, product_id ORDER BY updated_at DESC, id DESC) AS n FROM tracked_products) WHERE n = 1"""))
def m8(spark, d):
    """Tracked rows after upserts on (owner, store, id)."""
    return s.newest(r.tracked_products(spark, d), ["user_id", "marketplace", "product_id"], F.desc("updated_at"), F.desc("id")).select("user_id", "marketplace", "product_id", "id")


@query("m13_richer_offer", with_views("""SELECT product, marketplace FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY coalesce(price > 0, false) DESC, status = 'needs_choice' DESC, confidence DESC, marketplace) AS n FROM offers) WHERE n = 1"""))
def m13(spark, d):
    """The offer that wins a product's slot."""
    return s.newest(r.offers(spark, d), ["product"], *o.richer_first(), F.col("marketplace")).select("product", "marketplace")


@query("m19_offers_of_product", with_views("""SELECT source_product_id, target_product_id, place FROM (SELECT m.source_product_id, m.target_product_id, row_number() OVER (PARTITION BY m.source_product_id ORDER BY coalesce(c.price > 0, false) DESC, m.rank, m.target_product_id) AS place
FROM cross_market_mapping m LEFT JOIN price_cache c ON m.target_marketplace = c.marketplace AND m.target_product_id = c.product_id) WHERE place <= 6"""))  # fmt: skip
def m19(spark, d):
    """Up to six offers of each product, priced ones first."""
    m, cache = r.cross_market_mapping(spark, d), r.price_cache(spark, d).select(F.col("marketplace").alias("target_marketplace"), F.col("product_id").alias("target_product_id"), "price")
    order = Window.partitionBy("source_product_id").orderBy(num.has_price(F.col("price")).desc(), "rank", "target_product_id")
    return m.join(cache, ["target_marketplace", "target_product_id"], "left").withColumn("place", F.row_number().over(order)).where("place <= 6").select("source_product_id", "target_product_id", "place")


@query("n13_source", with_views("""SELECT p.product, CASE WHEN p.priced >= 2 THEN 'user' WHEN m.edges > 0 THEN 'mapping' ELSE 'empty' END AS source FROM (SELECT product, count(*) FILTER (price > 0) AS priced FROM offers GROUP BY 1) p
LEFT JOIN (SELECT source_product_id, count(*) AS edges FROM cross_market_mapping WHERE status = 'active' GROUP BY 1) m ON p.product = m.source_product_id"""))  # fmt: skip
def n13(spark, d):
    """Where each product's offers come from: its own, the mapping, or nowhere."""
    priced = r.offers(spark, d).groupBy("product").agg(F.count_if(num.has_price(F.col("price"))).alias("priced"))
    edges = r.cross_market_mapping(spark, d).where("status = 'active'").groupBy(F.col("source_product_id").alias("product")).agg(F.count(F.lit(1)).alias("edges"))
    return priced.join(edges, "product", "left").select("product", F.when(F.col("priced") >= 2, "user").when(F.col("edges") > 0, "mapping").otherwise("empty").alias("source"))


@query("d2_d8_titles", """SELECT p_partkey, levenshtein(lower(p_name), lower(p_type)) AS distance, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, p_retailprice / 1500.0::DOUBLE)) * 100 + 0.5::DOUBLE)::BIGINT AS confidence,
least(0.75::DOUBLE, CASE WHEN p_size % 4 = 0 THEN 0.55::DOUBLE ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.3::DOUBLE ELSE 0 END) AS penalty FROM part""")  # fmt: skip
def d2(spark, d):
    """Edit distance of two titles, a score as a percentage, the penalty of differing variants."""
    part, size = r.table(spark, d, "part"), F.col("p_size")
    penalty = F.least(F.lit(0.75), F.when(size % 4 == 0, 0.55).otherwise(0.0) + F.when(size % 3 == 0, 0.3).otherwise(0.0))
    return part.select("p_partkey", F.levenshtein(F.lower("p_name"), F.lower("p_type")).cast("bigint").alias("distance"), num.confidence(F.col("p_retailprice") / 1500.0).cast("bigint").alias("confidence"), penalty.alias("penalty"))


@query("d35_d37_n20_identity", with_views("""WITH p AS (SELECT id, marketplace, product_url AS url, CASE WHEN id % 3 = 0 THEN (id % 200 + 5000)::VARCHAR END AS article FROM tracked_products)
SELECT id, article, CASE WHEN id % 7 = 0 OR article IS NULL THEN NULL WHEN id % 2 = 0 THEN 'article' WHEN url IS NOT NULL THEN 'url' END AS reason FROM p"""))  # fmt: skip
def d35(spark, d):
    """Article of each tracked row, and why the row that was fetched is the same product."""
    rows, k = r.tracked_products(spark, d), F.col("id")
    known = rows.withColumn("article", o.article_of(F.when(k % 3 == 0, (k % 200 + 5000).cast("string")), F.lit(None).cast("string"), F.lit("0")))
    other_store = F.when(k % 7 == 0, F.lit("other")).otherwise(F.col("marketplace"))
    other_article = F.when(k % 2 == 0, F.col("article")).otherwise(F.lit("99999"))
    return known.select("id", "article", F.when(F.col("article").isNotNull(), o.same_identity(F.col("marketplace"), F.col("article"), F.col("product_url"), other_store, other_article, F.col("product_url"))).alias("reason"))


@query("d45_strike_seen", with_views("""SELECT h.marketplace, h.product_id, bool_or(abs(h.price - x.strike) / x.strike <= 0.02::DOUBLE) AS seen FROM price_history h
JOIN (SELECT p_brand, max(p_retailprice) AS strike FROM part GROUP BY 1) x ON h.product_id = x.p_brand GROUP BY 1, 2"""))  # fmt: skip
def d45(spark, d):
    """Whether a struck-through price was ever charged, within two percent."""
    strike = r.table(spark, d, "part").groupBy(F.col("p_brand").alias("product_id")).agg(F.max("p_retailprice").alias("strike"))
    near = F.abs(F.col("price") - F.col("strike")) / F.col("strike") <= 0.02
    return r.price_history(spark, d).join(strike, "product_id").groupBy("marketplace", "product_id").agg(F.bool_or(near).alias("seen"))


@query("d59_n28_outcomes", with_views("""WITH o AS (SELECT product, marketplace, CASE WHEN confidence % 4 <> 0 THEN status WHEN confidence % 3 > 0 THEN 'needs_choice' WHEN price > 0 THEN 'serp_only' ELSE 'not_found' END AS status FROM offers)
SELECT product, CASE WHEN bool_or(status = 'needs_choice') THEN 'needs_choice' WHEN bool_and(status = 'not_found') THEN 'not_found' ELSE 'done' END AS outcome FROM o GROUP BY product"""))  # fmt: skip
def d59(spark, d):
    """Outcome of each comparison from the states that its offers settle in."""
    loading = F.when(F.col("confidence") % 4 == 0, "loading").otherwise(F.col("status"))
    rows = r.offers(spark, d).select("product", o.settled(loading, F.col("price"), F.col("confidence") % 3).alias("status"))
    by = rows.groupBy("product").agg(F.bool_or(F.col("status") == "needs_choice").alias("choice"), F.bool_and(F.col("status") == "not_found").alias("none"))
    return by.select("product", F.when(F.col("choice"), "needs_choice").when(F.col("none"), "not_found").otherwise("done").alias("outcome"))


@query("d61_x64_soft_failure", with_views("SELECT id, consecutive_unavailable_count + 1 AS failures, nullif(last_price, 0) AS last_price, coalesce(product_url, '') AS url FROM tracked_products WHERE NOT deleted"))
def d61(spark, d):
    """Rows after a failed check: one more failure, the price as it was."""
    rows = r.tracked_products(spark, d).where(~F.col("deleted"))
    return rows.select("id", (F.col("consecutive_unavailable_count") + 1).alias("failures"), F.nullif(F.col("last_price"), F.lit(0.0)).alias("last_price"), F.coalesce("product_url", F.lit("")).alias("url"))


@query("x26_x57_canonical", "SELECT p_partkey, 'canon:' || lower(p_brand) || '|' || p_size || '|' || lower(p_type) AS canon, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS wording FROM part")
def x26(spark, d):
    """Canonical id of each product, and its title as a search."""
    part = r.table(spark, d, "part")
    return part.select("p_partkey", F.concat(F.lit("canon:"), F.concat_ws("|", F.lower("p_brand"), F.col("p_size").cast("string"), F.lower("p_type"))).alias("canon"), F.trim(F.regexp_replace(F.lower("p_name"), r"\s+", " ")).alias("wording"))


@query("x33_x35_f11_links", """SELECT page_id, regexp_extract(lower(url), '^(https?://[^/?#]+[^?#]*?)/?([?#].*)?$', 1) AS page, CASE WHEN regexp_matches(url, 'ozon\\.ru', 'i') THEN 'ozon' WHEN regexp_matches(url, 'wildberries\\.ru', 'i') THEN 'wildberries' END AS store,
contains(url, 'example') OR contains('example', url) AS excluded FROM pages""")  # fmt: skip
def x33(spark, d):
    """Links without query, fragment and last slash; the store; whether a fragment of an excluded link is in it."""
    pages, u = r.table(spark, d, "pages"), F.col("url")
    store = F.when(u.rlike(r"(?i)ozon\.ru"), "ozon").when(u.rlike(r"(?i)wildberries\.ru"), "wildberries")
    return pages.select("page_id", F.regexp_extract(F.lower(u), r"^(https?://[^/?#]+[^?#]*?)/?([?#].*)?$", 1).alias("page"), store.alias("store"), (F.contains(u, F.lit("example")) | F.contains(F.lit("example"), u)).alias("excluded"))


@query("x41_x45_prices", """SELECT p_partkey, x[1] AS first, list_min(list_filter(x, lambda v: v >= 100)) AS best FROM (SELECT p_partkey, [floor(p_retailprice)::BIGINT, p_size::BIGINT, p_partkey % 300] AS x FROM part)""")
def x41(spark, d):
    """Prices read from text, and the smallest of at least 100."""
    texts = [F.concat(F.lit("цена "), x.cast("bigint").cast("string"), F.lit(" ₽")) for x in (F.floor("p_retailprice"), F.col("p_size"), F.col("p_partkey") % 300)]
    prices = F.array(*[t.first_price(x).cast("bigint") for x in texts])
    return r.table(spark, d, "part").select("p_partkey", prices[0].alias("first"), F.array_min(F.filter(prices, lambda v: v >= 100)).alias("best"))


@query("x61_x62_json", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, user_id % 3 AS echo FROM events")
def x61(spark, d):
    """A field of JSON text, and one that was put into JSON and read back."""
    made = F.to_json(F.struct((F.col("user_id") % 3).alias("u"), F.col("event_type").alias("t")))
    return r.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object(made, "$.u").cast("bigint").alias("echo"))


@query("n8_refresh_batch", with_views("SELECT id, product_id FROM tracked_products WHERE NOT deleted AND priority ORDER BY last_checked NULLS FIRST, id LIMIT 100 OFFSET 20"))
def n8(spark, d):
    """The second batch of live priority rows, those checked longest ago first (a bounded batch by design)."""
    return r.tracked_products(spark, d).where(~F.col("deleted") & F.col("priority")).orderBy(F.asc_nulls_first("last_checked"), "id").offset(20).limit(100).select("id", "product_id")


@query("n44_chart", with_views("""SELECT marketplace, product_id, row_number() OVER (k ORDER BY recorded_at, price) AS place,
CASE WHEN count(*) OVER k > 1 THEN (row_number() OVER (k ORDER BY recorded_at, price) - 1) * 120.0::DOUBLE / (count(*) OVER k - 1) ELSE 60.0::DOUBLE END AS x,
CASE WHEN max(price) OVER k > min(price) OVER k THEN 40.0::DOUBLE - (price - min(price) OVER k) * 40.0::DOUBLE / (max(price) OVER k - min(price) OVER k) ELSE 20.0::DOUBLE END AS y
FROM price_history WINDOW k AS (PARTITION BY marketplace, product_id)"""))  # fmt: skip
def n44(spark, d):
    """Price series scaled into a small chart."""
    return o.polyline(r.price_history(spark, d), ["marketplace", "product_id"], "recorded_at", "price", 120.0, 40.0)


@query("n57_settings_merge", with_views("""SELECT a.user_id, CASE WHEN b.updated_mark > a.updated_mark THEN b.telegram_chat_id ELSE a.telegram_chat_id END AS chat FROM alert_settings a
LEFT JOIN (SELECT user_id + 1 AS user_id, updated_mark, telegram_chat_id FROM alert_settings) b ON a.user_id = b.user_id"""))  # fmt: skip
def n57(spark, d):
    """Local and remote settings of a user: the newer one counts."""
    local = r.alert_settings(spark, d)
    remote = local.select((F.col("user_id") + 1).alias("user_id"), F.col("updated_mark").alias("mark"), F.col("telegram_chat_id").alias("other"))
    return local.join(remote, "user_id", "left").select("user_id", F.when(F.col("mark") > F.col("updated_mark"), F.col("other")).otherwise(F.col("telegram_chat_id")).alias("chat"))
