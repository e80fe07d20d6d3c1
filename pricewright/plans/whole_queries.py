"""Queries that do the whole of a row where an older query does a part, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity as ident
from ..functions import numbers as n
from ..functions import text
from ..functions import titles as ti
from ..operators import matching as m
from ..operators import series as s
from ..operators import whole as w
from ..registry import query
from ..sources import extract, ingest
from ..sources import relations as r
from ..sources.relations import as_of, with_views
from ..sources.shared import stored
from .matching_queries import BY_PRINT
from .series_queries import NOW


def _k():
    return F.col("p_partkey")


@query("t16_all_targets", f"""WITH t AS (SELECT p_partkey, store, pos, CASE WHEN p_partkey % (pos + 3) = 0 THEN 'u' END AS url, ['server', 'api', 'tab'][((p_partkey + pos) % 3 + 1)::INT] AS tier FROM part, (SELECT unnest({list(r.WATCHED)}) AS store, unnest(range({len(r.WATCHED)})) AS pos))
SELECT p_partkey, store, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN url IS NOT NULL THEN 0 WHEN tier = 'api' THEN 1 WHEN tier = 'tab' THEN 3 ELSE 2 END, pos) AS place FROM t""")
def t16(spark, d):
    """Order in which stores are asked for every product."""
    rows = r.table(spark, d, "part").select("p_partkey", F.posexplode(F.array(*map(F.lit, r.WATCHED))).alias("at", "store"))
    tier = F.element_at(F.array(F.lit("server"), F.lit("api"), F.lit("tab")), ((_k() + F.col("at")) % 3 + 1).cast("int"))
    order = Window.partitionBy("p_partkey").orderBy(w.target_rank(F.when(_k() % (F.col("at") + 3) == 0, "u"), tier), "at")
    return rows.select("p_partkey", "store", F.row_number().over(order).cast("bigint").alias("place"))


@query("d63_n18_all_configs", f"""WITH g AS (SELECT c_custkey, unnest({list(r.MONITORED)}) AS store FROM customer), x AS (SELECT c_custkey, {r._sql_pick(r.MONITORED, 'c_custkey')} AS store, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 400 - 20 END AS run, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END AS flag FROM customer)
SELECT g.c_custkey, g.store, greatest(1, least(160, coalesce(run, 50))) AS per_run, coalesce(flag, true) AS enabled FROM g LEFT JOIN x USING (c_custkey, store)""")
def d63(spark, d):
    """Settings of every account and store: defaults under the stored row's values, within their range."""
    c = r.table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    grid = c.select("c_custkey", F.explode(F.array(*map(F.lit, r.MONITORED))).alias("store"))
    rows = c.select("c_custkey", r.pick(r.MONITORED, k).alias("store"), F.when(k % 4 != 0, k % 400 - 20).alias("run"), F.when(k % 5 != 0, k % 2 == 0).alias("flag"))
    return grid.join(rows, ["c_custkey", "store"], "left").select("c_custkey", "store", w.clamped(F.col("run"), F.lit(50), 1, 160).alias("per_run"), F.coalesce("flag", F.lit(True)).alias("enabled"))


@query("x42_price_picks", "WITH p AS (SELECT p_partkey, [v for v in [p_retailprice, p_retailprice * (1 + p_partkey % 4 / 100.0::DOUBLE), p_size - 25] if v > 0] AS p FROM part) SELECT p_partkey, list_min(p) AS price, CASE WHEN list_max(p) > list_min(p) * 1.02::DOUBLE THEN list_max(p) END AS old_price FROM p")
def x42(spark, d):
    """Current and old price of the numbers on every card."""
    prices = F.array(F.col("p_retailprice"), F.col("p_retailprice") * (1 + _k() % 4 / 100.0), (F.col("p_size") - 25).cast("double"))
    return r.table(spark, d, "part").select("p_partkey", n.current_and_old(prices).alias("p")).select("p_partkey", "p.price", "p.old_price")


CLEAN = r"trim(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '\s+', ' ', 'g'))"


def _review_pages(spark, d):
    """Pages that hold each document as a review, in markup and in embedded JSON."""
    x = r.table(spark, d, "documents").where("text IS NOT NULL")
    text = F.trim(F.regexp_replace(F.regexp_replace("text", "[<>&]", " "), r"\s+", " "))
    json = F.to_json(F.struct(F.array(F.struct(text.alias("reviewBody"), (F.col("doc_id") % 6).alias("rating"))).alias("review")))
    html = F.concat(F.lit('<html><div class="review-text"> <b>'), text, F.lit('</b></div><script type="application/ld+json">'), json, F.lit("</script></html>"))
    return x.select(F.col("doc_id").alias("page_id"), html.alias("html"))


@query("s16_all_markup_reviews", rf"SELECT doc_id AS page_id, 0 AS place, {CLEAN} AS text FROM documents WHERE length({CLEAN}) BETWEEN 15 AND 2000")
def s16(spark, d):
    """Review blocks in the markup of a page for every document."""
    return extract.markup_reviews(_review_pages(spark, d))


@query("s15_s17_all_json_reviews", rf"SELECT doc_id AS page_id, 0 AS place, {CLEAN} AS text, CASE WHEN doc_id % 6 BETWEEN 1 AND 5 THEN (doc_id % 6)::DOUBLE END AS rating FROM documents WHERE length({CLEAN}) BETWEEN 15 AND 2000")
def s15(spark, d):
    """Reviews in the embedded JSON of a page for every document."""
    return extract.json_reviews(_review_pages(spark, d))


@query("a33_all_hubs", """SELECT 'brand' AS kind, p_brand AS hub, count(*) AS pages, arg_max(p_type, p_partkey) FILTER (p_type IS NOT NULL) AS label FROM part GROUP BY p_brand HAVING count(*) >= 2
UNION ALL SELECT 'category', p_type, count(*), arg_max(p_name, p_partkey) FROM part GROUP BY p_type HAVING count(*) >= 2""")
def a33(spark, d):
    """Brands and categories with two pages or more, and the last label of each."""
    part = r.table(spark, d, "part")
    hub = lambda kind, key, label: w.hub_counts(part, key, label, ["p_partkey"]).select(F.lit(kind).alias("kind"), F.col(key).alias("hub"), "pages", "label")
    return hub("brand", "p_brand", "p_type").unionByName(hub("category", "p_type", "p_name"))


@query("j20_all_related", with_views("""WITH p AS (SELECT p_partkey AS page, p_brand, p_type FROM part), l AS (SELECT DISTINCT source_product_id AS page, target_product_id AS other FROM cross_market_mapping WHERE status = 'active'),
e AS (SELECT page, other, 0 AS turn FROM l UNION ALL SELECT a.page, b.page, 1 FROM p a JOIN p b USING (p_brand) UNION ALL SELECT a.page, b.page, 2 FROM p a JOIN p b USING (p_type)), o AS (SELECT page, other, min(turn) AS turn FROM e WHERE page <> other GROUP BY 1, 2)
SELECT page, other, row_number() OVER (PARTITION BY page ORDER BY turn, other) AS place FROM o QUALIFY place <= 6"""))
def j20(spark, d):
    """Six related pages of every page: mapped ones, then of its brand, then of its category."""
    pages = r.table(spark, d, "part").select(_k().alias("page"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    edges = r.cross_market_mapping(spark, d).where("status = 'active'").select(F.col("source_product_id").alias("page"), F.col("target_product_id").alias("other")).distinct()
    return w.related_pages(pages, edges, 6).select("page", "other", "place")


@query("j21_all_windows", with_views("""WITH n AS (SELECT max(created_at) AS now FROM match_feedback), a AS (SELECT fingerprint, bool_or(NOT accepted AND created_at >= now - INTERVAL 30 DAY) AS rejected, bool_or(match_confidence > 90 AND created_at >= now - INTERVAL 24 HOUR) AS moderated FROM match_feedback, n GROUP BY 1)
SELECT fingerprint, coalesce(rejected, false) AS rejected, coalesce(moderated, false) AS moderated FROM a"""))
def j21(spark, d):
    """Of every fingerprint, whether it was rejected in 30 days or moderated in 24 hours."""
    rows = r.match_feedback(spark, d)
    now = as_of(rows, "created_at")
    since = lambda span: F.col("created_at") >= now - F.expr(f"INTERVAL {span}")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy("fingerprint").agg(any_(~F.col("accepted") & since("'30' DAY")).alias("rejected"), any_((F.col("match_confidence") > 90) & since("'24' HOUR")).alias("moderated"))


@query("f24_all_writes", with_views("""WITH b AS (SELECT *, count(*) FILTER (NOT deleted) OVER (PARTITION BY user_id ORDER BY updated_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active FROM tracked_products)
SELECT id, deleted OR (id % 3 = 0 AND id % 5 <> 0) OR active < 5 AS allowed FROM b"""))
def f24(spark, d):
    """Whether each write fits its owner's limit: deletions, updates, returns from deletion, new rows."""
    x = r.tracked_products(spark, d)
    before = Window.partitionBy("user_id").orderBy("updated_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = x.withColumn("active", F.count(F.when(~F.col("deleted"), 1)).over(before))
    i = F.col("id")
    return rows.select("id", w.write_allowed(i, F.col("active"), F.col("deleted"), i % 3 == 0, i % 5 == 0, 5).alias("allowed"))


@query("f26_premium_users", with_views("""WITH n AS (SELECT TIMESTAMP '1996-02-01' AS now) SELECT DISTINCT p.user_id FROM user_premium p, n WHERE (p.expires_at IS NULL OR p.expires_at > now) AND EXISTS (SELECT 1 FROM license_keys k WHERE k.id = p.license_key_id AND k.is_active AND (k.license_expires_at IS NULL OR k.license_expires_at > now))"""))
def f26(spark, d):
    """Users whose term and license both last at a given time."""
    return w.premium_users(r.user_premium(spark, d), r.license_keys(spark, d), F.expr("TIMESTAMP_NTZ '1996-02-01 00:00:00'"))


PURGED = {
    "product_cache": ("orders", "o_orderdate", "'7' DAY"), "price_cache": ("orders", "o_orderdate", "'6' HOUR"), "telemetry": ("events", "ts", "'90' DAY"), "ai_requests": ("events", "ts", "'90' DAY"), "search_metrics": ("events", "ts", "'30' DAY"),
    "edge_log": ("events", "ts", "'72' HOUR"), "agent_searches": ("events", "ts", "'48' HOUR"), "moderation": ("lineitem", "l_shipdate", "'90' DAY"), "search_results": ("lineitem", "l_shipdate", "'6' HOUR"),
}
_INTERVAL = lambda t: "INTERVAL " + t.replace("'", "")


@query("m5_f29_all_retention", " UNION ALL ".join(f"SELECT '{name}' AS relation, count(*) AS purged FROM {t} WHERE {c} < (SELECT max({c}) FROM {t}) - {_INTERVAL(ttl)}" for name, (t, c, ttl) in PURGED.items())
       + " UNION ALL SELECT 'own_expiry', count(*) FROM orders WHERE o_orderdate + to_days((o_orderkey % 30)::INT) < (SELECT max(o_orderdate) FROM orders)")
def m5(spark, d):
    """Rows beyond the time to live of ten relations; one has an expiry of its own."""
    tables = {name: r.table(spark, d, name) for name in ("orders", "events", "lineitem")}
    counts = s.purge_counts({name: (tables[t], c, as_of(tables[t], c), ttl) for name, (t, c, ttl) in PURGED.items()})
    o = tables["orders"]
    own = o.where(F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 30).cast("int")) < as_of(o, "o_orderdate")).agg(F.count(F.lit(1)).alias("purged"))
    return counts.union(own.select(F.lit("own_expiry").alias("relation"), "purged"))


@query("d46_top_drops", with_views(f"""WITH items AS (SELECT * FROM (SELECT user_id, marketplace, product_id, price AS last_price, row_number() OVER (PARTITION BY user_id, marketplace, product_id ORDER BY recorded_at DESC, id) AS n FROM price_history) WHERE n = 1),
before AS (SELECT user_id, marketplace, product_id, price AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, marketplace, product_id ORDER BY abs(epoch_us(recorded_at) - epoch_us({NOW} - INTERVAL 24 HOUR)), recorded_at DESC, price) AS n,
  abs(epoch_us(recorded_at) - epoch_us({NOW} - INTERVAL 24 HOUR)) AS away FROM price_history WHERE recorded_at >= {NOW} - INTERVAL 48 HOUR AND price > 0) WHERE n = 1 AND away <= 129600000000)
SELECT user_id, marketplace, product_id, last_price - value AS delta, row_number() OVER (PARTITION BY user_id, marketplace ORDER BY last_price - value, product_id) AS place FROM items JOIN before USING (user_id, marketplace, product_id) WHERE last_price - value <= -50 QUALIFY place <= 3"""))
def d46(spark, d):
    """The three deepest drops since a day ago of each user on each store."""
    history = r.price_history(spark, d)
    now = r.newest_price(spark, d)
    items = s.newest(history, s.KEY, F.desc("recorded_at"), F.col("id")).select(*s.KEY, F.col("price").alias("last_price"))
    before = s.nearest(history, s.KEY, "recorded_at", "price", now - F.expr("INTERVAL '24' HOUR"), now - F.expr("INTERVAL '48' HOUR"), 36 * s.HOUR)
    return w.top_drops(s.digest(items, before, s.price_minima(history, now), s.KEY), ["user_id", "marketplace"]).select(*s.KEY, "delta", "place")


@query("d33_promotion_pipeline", with_views(f"""WITH {BY_PRINT}, g AS (SELECT fingerprint, CASE WHEN accepts < 2 THEN 'insufficient_accepts' WHEN accept_days < 2 THEN 'insufficient_accept_days' WHEN distinct_users > 0 AND distinct_users < 2 THEN 'insufficient_distinct_users'
WHEN rejects > 0 AND rejects >= accepts * 0.5 THEN 'reject_ratio' WHEN rejects >= accepts THEN 'rejects_gte_accepts' WHEN recent_rejects > 0 THEN 'recent_reject_cooldown' WHEN avg_confidence < 70 THEN 'avg_confidence_low' ELSE 'ok' END AS reason FROM feed)
SELECT m.source_product_id, m.target_product_id, CASE WHEN coalesce(g.reason, 'no_feedback') <> 'ok' THEN coalesce(g.reason, 'no_feedback') WHEN m.status IN ('disputed', 'dead') THEN 'status_' || m.status WHEN m.evidence = 'manual' THEN 'manual_kept' ELSE 'promoted' END AS outcome
FROM cross_market_mapping m LEFT JOIN g ON g.fingerprint = 'fp' || m.source_product_id % 40"""))
def d33(spark, d):
    """What the promotion of every mapping comes to, by the feedback on its fingerprint, its status and evidence."""
    rows = r.match_feedback(spark, d)
    gates = m.promotion(m.feedback_by(rows, as_of(rows, "created_at"), F.lower(F.trim("fingerprint")).alias("fingerprint"))).select("fingerprint", "reason")
    edges = r.cross_market_mapping(spark, d).withColumn("fingerprint", F.concat(F.lit("fp"), (F.col("source_product_id") % 40).cast("string")))
    outcome = w.promotion_outcome(F.coalesce("reason", F.lit("no_feedback")), F.col("status"), F.col("evidence"))
    return edges.join(gates, "fingerprint", "left").select("source_product_id", "target_product_id", outcome.alias("outcome"))


@query("n2_publish_reasons", """WITH p AS (SELECT CASE WHEN p_size > 10 THEN 'published' ELSE 'rejected' END AS status, CASE WHEN p_size <= 10 THEN ['low_quality', 'thin_content', 'weak_title'][(p_partkey % 3 + 1)::INT] END AS reason, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS category, CASE WHEN p_size % 3 <> 0 THEN p_size END AS quality FROM part)
SELECT status, reason, count(*) AS pages, count(category) AS with_category, count(*) - count(category) AS without_category, floor(avg(coalesce(quality, 0)) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS avg_quality FROM p GROUP BY 1, 2""")
def n2(spark, d):
    """Pages by status and reason, with and without category, and mean quality, a missing one counting 0."""
    c = F.col("p_size")
    p = r.table(spark, d, "part").select(F.when(c > 10, "published").otherwise("rejected").alias("status"), F.when(c <= 10, r.pick(("low_quality", "thin_content", "weak_title"), _k())).alias("reason"), F.when(_k() % 4 != 0, F.col("p_type")).alias("category"), F.when(c % 3 != 0, c).alias("quality"))
    many = F.count(F.lit(1))
    return p.groupBy("status", "reason").agg(many.alias("pages"), F.count("category").alias("with_category"), (many - F.count("category")).alias("without_category"), n.round_half_up(F.avg(F.coalesce("quality", F.lit(0))), 1).alias("avg_quality"))


PACK = "struct<version:string,min_confidence:double,roles:array<struct<id:string,pattern:string>>,hosts:array<struct<id:string,pattern:string>>,relations:array<string>>"


def _pack(version, confidence, roles, hosts):
    entries = lambda many: F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct(i.cast("string").alias("id"), F.when(many, "x").otherwise("").alias("pattern")))
    return F.struct(version.alias("version"), confidence.alias("min_confidence"), entries(roles).alias("roles"), F.when(hosts, entries(F.lit(True))).alias("hosts"), F.array(F.lit("r")).alias("relations")).cast(PACK)


@query("n52_n53_rule_packs", """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'invalid_payload' WHEN p_partkey % 4 = 0 OR p_partkey % 4 = 3 THEN 'invalid_version' WHEN p_size > 40 OR p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN 'invalid_payload' END AS error,
CASE WHEN p_partkey % 11 = 0 THEN '1.0.0' ELSE ['0.9.9', '1.0.0', '2.1', '1.x'][(p_partkey % 4 + 1)::INT] END AS merged_version, 2 AS hosts FROM part""")
def n52(spark, d):
    """Why rule packs are refused, and what each gives laid over the bundled one."""
    version = F.when(_k() % 11 != 0, r.pick(("0.9.9", "1.0.0", "2.1", "1.x"), _k()))
    pack = _pack(version, F.col("p_size") / 40.0, _k() % 7 != 0, _k() % 5 != 0)
    base = _pack(F.lit("1.0.0"), F.lit(0.55), F.lit(True), F.lit(True))
    return r.table(spark, d, "part").select("p_partkey", w.pack_error(pack).alias("error"), w.packs_merged(base, pack).alias("m")).select("p_partkey", "error", F.col("m.version").alias("merged_version"), F.size("m.hosts").alias("hosts"))


@query("f20_redacted_payloads", with_views("""SELECT event_id, 3 AS keys, 'https://x/p/' || event_id AS page_url, CASE WHEN length(name) > 60 THEN left(name, 59) || '…' ELSE name END AS query FROM telemetry_events"""))
def f20(spark, d):
    """Payloads without private keys, links without their query, long values cut."""
    given = F.create_map(F.lit("page_url"), F.concat(F.lit("https://x/p/"), F.col("event_id").cast("string"), F.lit("?token=1#a")), F.lit("search_query"), F.concat(F.lit(" "), F.col("name")), F.lit("note"), F.repeat(F.lit("x"), 400), F.lit("authToken"), F.lit("secret"), F.lit("Email"), F.lit("a@b"))
    return r.telemetry_events(spark, d).select("event_id", w.redacted_payload(given).alias("p")).select("event_id", F.size("p").alias("keys"), F.col("p")["page_url"].alias("page_url"), F.col("p")["search_query"].alias("query"))


@query("f3_safe_search", "SELECT p_partkey FROM part WHERE p_name ILIKE '%wid%' OR p_brand ILIKE '%wid%'")
def f3(spark, d):
    """Pages whose title or brand contains what a search box holds, its special characters left out."""
    like = w.like_pattern(F.lit(" %w_i.d( "))
    return r.table(spark, d, "part").where(F.ilike(F.col("p_name"), like) | F.ilike(F.col("p_brand"), like)).select("p_partkey")


@query("s4_s6_sinks", with_views("""SELECT 'search' AS sink, marketplace AS key, count(*) AS rows, count(*) FILTER (success) AS good FROM search_metrics GROUP BY 2 UNION ALL SELECT 'ai', provider, count(*), count(*) FILTER (success) FROM ai_request_log GROUP BY 2
UNION ALL SELECT 'authenticity', status, count(*), count(*) FILTER (source = 'badge') FROM (SELECT ['original', 'not_original', 'unknown'][(event_id % 3 + 1)::INT] AS status, CASE WHEN event_id % 2 = 0 THEN 'badge' ELSE 'text' END AS source FROM events) GROUP BY 2"""))
def s4(spark, d):
    """Searches, requests to models and authenticity events through their sinks: appended as files, read back, counted."""
    count = lambda df, sink, key, good: df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(good, 1)).alias("good")).select(F.lit(sink).alias("sink"), "key", "rows", "good")
    i = F.col("event_id")
    seen = r.table(spark, d, "events").select(r.pick(("original", "not_original", "unknown"), i).alias("status"), F.when(i % 2 == 0, "badge").otherwise("text").alias("source"))
    searches, requests, events = stored(ingest.searches(r.search_metrics(spark, d)), "searches"), stored(r.ai_request_log(spark, d), "requests"), stored(seen, "authenticity")
    return count(searches, "search", "marketplace", F.col("success")).unionByName(count(requests, "ai", "provider", F.col("success"))).unionByName(count(events, "authenticity", "status", F.col("source") == "badge"))


CARD_STORES = ("yandex_market", "wildberries", "megamarket", "aliexpress", "mvideo", "ozon")


@query("s22_s26_store_cards", f"""WITH c AS (SELECT p_partkey, {r._sql_pick(CARD_STORES, 'p_partkey')} AS store, p_name, 100 + p_partkey % 9000 AS price, p_partkey % 17 = 0 AS blocked, p_partkey % 13 = 0 AS gone FROM part)
SELECT p_partkey, CASE WHEN blocked THEN NULL WHEN store = 'wildberries' THEN CASE WHEN price * 100 >= 1000 THEN price ELSE price * 100 END WHEN store IN ('megamarket', 'aliexpress', 'mvideo') AND gone THEN NULL ELSE price END AS price, CASE WHEN NOT blocked THEN p_name END AS title FROM c""")
def s22(spark, d):
    """Price and title of every product's card, by the rules of its store."""
    k, price = _k(), (100 + _k() % 9000).cast("string")
    stock = F.when(k % 13 == 0, "OutOfStock").otherwise("InStock")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"'), "p_name", F.lit('","offers":{"price":"'), price, F.lit('","availability":"https://schema.org/'), stock, F.lit('"}}</script>'))
    state = F.concat(F.lit('<script>{"imt_name":"'), "p_name", F.lit('","salePriceU":'), ((100 + k % 9000) * 100).cast("string"), F.lit("}</script>"))
    meta = F.concat(F.lit('<meta property="og:title" content="'), "p_name", F.lit('"><meta itemprop="price" content="'), price, F.lit('">'))
    store = r.pick(CARD_STORES, k)
    html = F.when(k % 17 == 0, "<html>captcha: Доступ ограничен</html>").otherwise(F.concat(F.lit("<html>"), F.when(store == "wildberries", state).when(store == "ozon", meta).otherwise(ld), F.lit("</html>")))
    return extract.store_cards(r.table(spark, d, "part").select("p_partkey", store.alias("store"), html.alias("html"))).select("p_partkey", F.col("price").cast("bigint").alias("price"), "title")


@query("n54_image_scores", """WITH i AS (SELECT p_partkey, ['https://a.lmcdn.ru/product/' , 'https://x/product-medias/', 'https://x/width=150/', 'https://x/nw_banner/', 'https://cdn.citilink.ru/product-images/width:55/'][(p_partkey % 5 + 1)::INT] || p_partkey AS url FROM part)
SELECT p_partkey, [80, 50, -15, -80, 65][(p_partkey % 5 + 1)::INT] AS points FROM i""")
def n54(spark, d):
    """How likely an image link is the product's own picture."""
    url = F.concat(r.pick(("https://a.lmcdn.ru/product/", "https://x/product-medias/", "https://x/width=150/", "https://x/nw_banner/", "https://cdn.citilink.ru/product-images/width:55/"), _k()), _k().cast("string"))
    return r.table(spark, d, "part").select("p_partkey", text.image_score(url).alias("points"))


@query("x27_page_groups", r"""WITH g AS (SELECT p_partkey, string_split(trim(regexp_replace(p_brand || ' ' || p_name || ' ' || p_size || ' ГБ', '\s+', ' ', 'g')), ' ') AS w, p_size, p_type FROM part),
n AS (SELECT *, regexp_replace(lower(w[1]), '[\s().,]+', '', 'g') AS brand, regexp_replace(lower(array_to_string(w[2:5], ' ')), '[\s().,]+', '', 'g') AS model FROM g)
SELECT p_partkey, CASE WHEN brand <> '' AND model <> '' THEN left('canon:' || brand || '|' || model || '|' || p_size || 'gb|' || p_type, 160) END AS page_group FROM n""")
def x27(spark, d):
    """The group that a page's title puts it in: first word, next four, memory, category."""
    title = F.concat_ws(" ", "p_brand", "p_name", F.col("p_size").cast("string"), F.lit("ГБ"))
    return r.table(spark, d, "part").select("p_partkey", ident.page_group(title, F.lit(None).cast("string"), F.col("p_type")).alias("page_group"))


@query("n48_feedback_payloads", r"""SELECT doc_id AS page_id, unnest(range(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END))::INT AS place, trim(text, ' ') AS text, (doc_id % 5 + 1)::DOUBLE AS rating FROM documents WHERE trim(text, ' ') <> '' AND doc_id % 7 <> 0""")
def n48(spark, d):
    """Feedbacks in a payload for every document: at one of two places, some payloads broken."""
    i = F.col("doc_id")
    one = F.struct("text", (i % 5 + 1).alias("productValuation"))
    many = F.when(i % 3 == 0, F.array(one, one)).otherwise(F.array(one))
    payload = F.when(i % 7 == 0, '{"feedbacks": [').when(i % 2 == 0, F.to_json(F.struct(many.alias("feedbacks")))).otherwise(F.to_json(F.struct(F.struct(many.alias("feedbacks")).alias("feedbacksData"))))
    return extract.feedbacks(r.table(spark, d, "documents").where("text IS NOT NULL").select(i.alias("page_id"), payload.alias("payload")))


@query("n40_analysis_checks", """SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'not_json' WHEN p_size % 12 < 1 OR p_size % 12 > 10 THEN 'qualityScore' WHEN p_partkey % 4 = 3 THEN 'fakeRisk' WHEN p_partkey % 5 = 4 THEN 'verdict' WHEN p_partkey % 7 = 0 THEN 'qualitySummary' WHEN p_partkey % 11 = 0 THEN 'verdictExplanation' END AS error FROM part""")
def n40(spark, d):
    """The first field of every analysis that isn't as it must be."""
    k = _k()
    fields = F.struct(
        (F.col("p_size") % 12).alias("qualityScore"), r.pick(("low", "medium", "high", "odd"), k).alias("fakeRisk"), r.pick(("buy_now", "wait_discount", "not_recommended", "buy_now", "sell"), k).alias("verdict"),
        F.when(k % 7 == 0, " ").otherwise(F.col("p_name")).alias("qualitySummary"), F.when(k % 11 != 0, F.col("p_name")).alias("verdictExplanation"),
    )
    return r.table(spark, d, "part").select("p_partkey", extract.analysis_error(F.when(k % 13 == 0, "no json").otherwise(F.to_json(fields))).alias("error"))


@query("s18_s20_s28_search_pages", f"""WITH g AS (SELECT p_partkey AS page_id, unnest(range(10))::INT AS i, p_name FROM part) SELECT page_id, i AS place, (123456780 + page_id * 10 + i)::VARCHAR AS id, p_name || ' ' || i AS title FROM g WHERE i < 8""")
def s18(spark, d):
    """Candidates on a search page of four stores for every product: ten links, each twice, of which eight count."""
    k = _k()
    number, store = lambda i: (123456780 + k * 10 + i).cast("string"), r.pick(tuple(extract.LINKED), k)
    path = lambda i: F.when(store == "wildberries", F.concat(F.lit("/catalog/"), number(i), F.lit("/detail.aspx"))).when(store == "aliexpress", F.concat(F.lit("https://aliexpress.ru/item/"), number(i), F.lit(".html"))).when(store == "mvideo", F.concat(F.lit("/products/name-"), number(i))).otherwise(F.concat(F.lit("/catalog/details/name-"), number(i), F.lit("/")))
    link = lambda i: F.concat(F.lit('<a class="c" href="'), path(i), F.lit('" data-x>'), "p_name", F.lit(f" {i} "), F.lit("</a>"))
    html = F.concat(F.lit("<html>"), *[link(i) for i in range(10)], *[link(i) for i in range(10)], F.lit("</html>"))
    return extract.search_results(ti.spread(r.table(spark, d, "part")).select(k.alias("page_id"), store.alias("store"), html.alias("html")))
