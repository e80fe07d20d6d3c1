"""Queries of scheduled monitoring: entitlement, staleness, coalescing, alerts, synchronisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as n
from ..functions import text as t
from ..operators import monitoring as mo
from ..operators import series as s
from ..registry import query
from ..sources import relations as r
from ..sources.relations import as_of, with_views

T_NOW = "(SELECT max(updated_at) FROM tracked_products)"
REST = "least(21600000000 * CASE WHEN consecutive_unavailable_count <= 1 THEN 1 WHEN consecutive_unavailable_count <= 3 THEN 4 ELSE 12 END, 259200000000)"


@query("f5_f6_stale", with_views(f"SELECT id, last_checked IS NULL OR epoch_us({T_NOW}) - epoch_us(last_checked) >= {REST} AS stale FROM tracked_products"))
def f5(spark, d):
    """Which products are due, with back-off after failures."""
    rows = r.tracked_products(spark, d)
    return rows.select("id", mo.stale(F.col("last_checked"), F.col("consecutive_unavailable_count"), as_of(rows, "updated_at"), 6 * mo.HOUR).alias("stale"))


P_NOW = "TIMESTAMP '1997-06-01'"
ACTIVE = f"(p.expires_at IS NULL OR p.expires_at > {P_NOW}) AND l.id IS NOT NULL AND l.is_active AND (l.license_expires_at IS NULL OR l.license_expires_at > {P_NOW})"
PREMIUM = f"prem AS (SELECT p.user_id, coalesce({ACTIVE}, false) AS active FROM user_premium p LEFT JOIN license_keys l ON p.license_key_id = l.id)"


def _now():
    return F.expr("TIMESTAMP_NTZ '1997-06-01 00:00:00'")


@query("f25_j2_n1_premium", with_views(f"WITH {PREMIUM} SELECT * FROM prem"))
def f25(spark, d):
    """Whether each premium row holds (f2, f26: the semi join of the active ones)."""
    return mo.premium(r.user_premium(spark, d), r.license_keys(spark, d), _now())


TRIALS = "trials AS (SELECT c_custkey AS user_id, TIMESTAMP '1997-01-01' + to_days((c_custkey % 300)::INT) AS trial_expires_at FROM customer WHERE c_custkey % 4 = 1)"
KINDS = f"""kinds AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey IN (SELECT user_id FROM prem WHERE active) THEN 'premium'
  WHEN c_custkey IN (SELECT user_id FROM trials WHERE trial_expires_at > {P_NOW}) THEN 'trial' ELSE 'free' END AS kind FROM customer)"""


@query("d66_plans", with_views(f"WITH {PREMIUM}, {TRIALS}, {KINDS} SELECT * FROM kinds"))
def d66(spark, d):
    """Each user's plan."""
    users = r.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    trials = users.where("user_id % 4 = 1").select("user_id", (F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'") + F.make_dt_interval((F.col("user_id") % 300).cast("int"))).alias("trial_expires_at"))
    return mo.plans(users, f25(spark, d), trials, _now())


LIMITED = f"""live AS (SELECT t.*, k.kind, row_number() OVER (PARTITION BY t.user_id ORDER BY updated_at DESC, id) AS n FROM tracked_products t JOIN kinds k ON t.user_id = k.user_id WHERE NOT deleted),
queued AS (SELECT * FROM live WHERE n <= CASE kind WHEN 'premium' THEN 50 WHEN 'trial' THEN 10 ELSE 3 END)"""


@query("w5_j6_work_queue", with_views(f"WITH {PREMIUM}, {TRIALS}, {KINDS}, {LIMITED} SELECT id, user_id, kind FROM queued"))
def w5(spark, d):
    """Rows to check: each user's newest, as many as the plan allows (f24: the same count as a gate)."""
    return mo.within_plan(r.tracked_products(spark, d), d66(spark, d), {"premium": 50, "trial": 10, "free": 3}).select("id", "user_id", "kind")


KEYED = "keyed AS (SELECT *, marketplace || ':' || product_id AS key FROM tracked_products)"


@query("a19_d38_coalesced", with_views(f"""WITH {KEYED} SELECT key, bool_or(priority) AS priority, arg_min(product_url, id) FILTER (product_url IS NOT NULL) AS product_url, count(*) AS subscribers, count(*) FILTER (NOT deleted) AS active_subscribers
FROM keyed GROUP BY 1"""))  # fmt: skip
def a19(spark, d):
    """One fetch for all subscribers of a product (a20: how many are live)."""
    return mo.coalesced(r.tracked_products(spark, d))


SEEN = "seen AS (SELECT marketplace || ':' || product_id AS key, min(last_price) * 0.95::DOUBLE AS price FROM tracked_products GROUP BY 1)"


@query("d40_d41_alerts", with_views(f"""WITH {KEYED}, {SEEN} SELECT id, k.user_id, price, coalesce(price < last_price AND last_price > 0 AND (min_drop_percent + x <= 0 OR (last_price - price) / last_price * 100 >= min_drop_percent + x) AND last_price - price >= min_drop_rub + y, false) AS drop_alert,
coalesce(price <= target_price, false) AS target_alert FROM (SELECT *, CASE WHEN marketplace = 'ozon' THEN 2 ELSE 0 END AS x, CASE WHEN marketplace = 'ozon' THEN 100 ELSE 0 END AS y FROM keyed WHERE NOT deleted) k
JOIN seen USING (key) JOIN alert_settings a ON a.user_id = k.user_id AND a.notifications_enabled"""))  # fmt: skip
def d40(spark, d):
    """Alerts of all subscribers after a round of fetches: the scheduled check as one plan."""
    rows = r.tracked_products(spark, d).withColumn("key", mo.monitoring_key(F.col("marketplace"), F.col("product_id"), F.col("product_url")))
    observed = rows.groupBy("key").agg((F.min("last_price") * 0.95).alias("price"))
    return mo.alerts(rows, observed, r.alert_settings(spark, d))


@query("d36_d39_d47_moves", with_views("""SELECT product, marketplace, coalesce(price < reference_price AND ((reference_price - price) / reference_price * 100 >= 1 OR reference_price - price >= 100), false) AS client_drop,
coalesce(price > 0 AND price < reference_price AND ((reference_price - price) / reference_price >= 0.4 OR reference_price - price >= 5000), false) AS suspicious,
coalesce(price > 0 AND (abs(price - reference_price) >= 500 OR abs(price - reference_price) >= reference_price * 0.1::DOUBLE), false) AS significant FROM offers"""))  # fmt: skip
def d36(spark, d):
    """Client drop (either limit), suspicious drop without identity, significant change."""
    p, ref = F.col("price"), F.col("reference_price")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return r.offers(spark, d).select(
        "product", "marketplace", flag(n.dropped_client(ref, p, F.lit(100.0), F.lit(1.0))).alias("client_drop"), flag(n.suspicious_drop(ref, p, F.lit(False))).alias("suspicious"), n.significant_change(ref, p).alias("significant")
    )


@query("w1_j3_chat_owner", with_views("SELECT user_id, CASE WHEN n > 1 THEN '' ELSE telegram_chat_id END AS telegram_chat_id FROM (SELECT *, row_number() OVER (PARTITION BY telegram_chat_id ORDER BY updated_mark DESC NULLS LAST, user_id) AS n FROM alert_settings)"))
def w1(spark, d):
    """A chat belongs to its most recent user; the others lose it."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("telegram_chat_id").orderBy(F.desc_nulls_last("updated_mark"), "user_id"))
    return r.alert_settings(spark, d).withColumn("n", place).select("user_id", F.when(F.col("n") > 1, "").otherwise(F.col("telegram_chat_id")).alias("telegram_chat_id"))


@query("j5_m20_claim", with_views("""WITH device AS (SELECT id, marketplace, product_id FROM tracked_products WHERE user_id % 2 = 1), owned AS (SELECT DISTINCT marketplace, product_id FROM tracked_products WHERE user_id % 2 = 0 AND deleted)
SELECT id, CASE WHEN (marketplace, product_id) IN (SELECT (marketplace, product_id) FROM owned) THEN 'merged' ELSE 'claimed' END AS fate FROM device"""))  # fmt: skip
def j5(spark, d):
    """Device rows merged into or claimed by a user."""
    rows = r.tracked_products(spark, d)
    return mo.claimed(rows.where("user_id % 2 = 1").select("id", "marketplace", "product_id"), rows.where("user_id % 2 = 0 AND deleted"), ["marketplace", "product_id"]).select("id", "fate")


@query("j12_reconcile_all", with_views("SELECT DISTINCT user_id, marketplace, product_id FROM tracked_products WHERE NOT deleted EXCEPT SELECT user_id, marketplace, product_id FROM tracked_products WHERE priority"))
def j12_all(spark, d):
    """Of every user, live remote keys that are on no local row (those with priority): tombstones."""
    rows = r.tracked_products(spark, d)
    return mo.reconciled(rows.where("priority"), rows.where("NOT deleted"), ["user_id", "marketplace", "product_id"])


LISTS = "lists AS (SELECT user_id, marketplace, product_id FROM tracked_products WHERE deleted UNION (SELECT user_id, marketplace, product_id FROM tracked_products WHERE NOT deleted EXCEPT SELECT user_id, marketplace, product_id FROM tracked_products WHERE priority))"


@query("m18_tombstones", with_views(f"WITH {LISTS} SELECT user_id, marketplace, product_id FROM lists"))
def m18(spark, d):
    """Tombstones of every user, each key once: deleted rows and what reconciling finds."""
    deleted = r.tracked_products(spark, d).where("deleted").select("user_id", "marketplace", "product_id")
    return deleted.union(j12_all(spark, d).select("user_id", "marketplace", "product_id")).distinct()


@query("j13_pending", with_views(f"WITH {LISTS} SELECT id, (user_id, marketplace, product_id) IN (SELECT (user_id, marketplace, product_id) FROM lists) AS pending FROM tracked_products"))
def j13(spark, d):
    """Of every remote row, whether a tombstone suppresses it."""
    key = ["user_id", "marketplace", "product_id"]
    marked = r.tracked_products(spark, d).select("id", *key).join(m18(spark, d).withColumn("hit", F.lit(True)), key, "left")
    return marked.select("id", F.coalesce("hit", F.lit(False)).alias("pending"))


@query("t14_unique_links", with_views("""SELECT user_id, product_url, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place, place <= 20 AS kept FROM (SELECT user_id, product_url, min(id) AS first FROM tracked_products WHERE product_url IS NOT NULL GROUP BY 1, 2)"""))
def t14(spark, d):
    """Different links of every user in the order in which they came first; a kept list holds the first 20."""
    once = r.tracked_products(spark, d).where("product_url IS NOT NULL").groupBy("user_id", "product_url").agg(F.min("id").alias("first"))
    rows = once.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).cast("bigint"))
    return rows.select("user_id", "product_url", "place", (F.col("place") <= 20).alias("kept"))


@query("m21_activations", "SELECT o_custkey, o_orderpriority, n <= 3 AS granted FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderdate), o_orderpriority) AS n FROM orders GROUP BY 1, 2)")
def m21(spark, d):
    """First three devices of each license."""
    return mo.activations(r.table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderdate", F.lit(3)).select("o_custkey", "o_orderpriority", "granted")


@query("j21_recent_rejects", with_views("SELECT DISTINCT fingerprint FROM match_feedback WHERE fingerprint IN (SELECT fingerprint FROM match_feedback WHERE NOT accepted AND created_at >= (SELECT max(created_at) FROM match_feedback) - INTERVAL 30 DAY)"))
def j21(spark, d):
    """Fingerprints with a reject in the last 30 days."""
    rows = r.match_feedback(spark, d)
    recent = rows.where(~F.col("accepted") & (F.col("created_at") >= as_of(rows, "created_at") - F.expr("INTERVAL '30' DAY"))).select("fingerprint")
    return rows.join(recent, "fingerprint", "left_semi").select("fingerprint").distinct()


@query("j20_related", "SELECT p_partkey, (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand OR b.p_type = a.p_type) - 1 AS related FROM part a")
def j20(spark, d):
    """How many pages share a brand or a category: counts by each and by both, not an OR join."""
    part = r.table(spark, d, "part")
    by = lambda *k: part.groupBy(*k).agg(F.count(F.lit(1)).alias("n_" + "_".join(k)))
    both = part.join(by("p_brand"), "p_brand").join(by("p_type"), "p_type").join(by("p_brand", "p_type"), ["p_brand", "p_type"])
    return both.select("p_partkey", (F.col("n_p_brand") + F.col("n_p_type") - F.col("n_p_brand_p_type") - 1).alias("related"))


@query("d60_event_expansion", with_views("""SELECT event_id, unnest(CASE WHEN p_source = 'cache' THEN ['telegram_monitor_check', 'telegram_monitor_cache_hit'] WHEN level = 'error' THEN ['telegram_monitor_check', 'telegram_monitor_error']
ELSE ['telegram_monitor_check', 'telegram_monitor_scrape'] END) AS name FROM telemetry_events"""))  # fmt: skip
def d60(spark, d):
    """Each monitored row as one or two events."""
    second = F.when(F.col("payload")["source"] == "cache", "telegram_monitor_cache_hit").when(F.col("level") == "error", "telegram_monitor_error").otherwise("telegram_monitor_scrape")
    return r.telemetry_events(spark, d).select("event_id", F.explode(F.array(F.lit("telegram_monitor_check"), second)).alias("name"))


@query("d56_d57_failures", """SELECT p_partkey, CASE WHEN contains(e, 'timeout') THEN 'timeout' WHEN contains(e, 'captcha') THEN 'captcha' WHEN regexp_matches(e, '5\\d\\d') THEN 'http_5xx' WHEN p_size % 2 = 0 THEN 'unavailable' ELSE 'exception' END AS kind,
CASE WHEN contains(e, 'timeout') THEN 'timeout' WHEN contains(e, 'parse') THEN 'parser_error' WHEN contains(e, '503') OR contains(e, 'captcha') THEN 'marketplace_unavailable' ELSE 'unknown' END AS reason
FROM (SELECT p_partkey, p_size, ['timeout', 'captcha page', 'http 503', 'parse failed', 'other'][(p_partkey % 5 + 1)::INT] AS e FROM part)""")  # fmt: skip
def d56(spark, d):
    """Why fetches failed, by the server's rules and by the funnel's."""
    e = r.pick(("timeout", "captcha page", "http 503", "parse failed", "other"), F.col("p_partkey"))
    return r.table(spark, d, "part").select("p_partkey", t.failure_kind(e, F.lit(False), F.col("p_size") % 2 == 0).alias("kind"), t.funnel_failure(e).alias("reason"))


@query("n2_publish_metrics", "SELECT p_brand, count(*) FILTER (p_size > 10) AS published, count(*) FILTER (p_size <= 10) AS rejected, floor(avg(coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size END, 0)) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS avg_quality FROM part GROUP BY 1")
def n2(spark, d):
    """Publishing by brand; a missing quality counts as 0."""
    quality = F.coalesce(F.when(F.col("p_size") % 3 != 0, F.col("p_size")), F.lit(0))
    return r.table(spark, d, "part").groupBy("p_brand").agg(F.count(F.when(F.col("p_size") > 10, 1)).alias("published"), F.count(F.when(F.col("p_size") <= 10, 1)).alias("rejected"), n.round_half_up(F.avg(quality), 1).alias("avg_quality"))


@query("f27_f28_windows", with_views(f"""SELECT id, epoch_us({T_NOW}) - epoch_us(updated_at) BETWEEN 0 AND 21599999999 AS in_grace, last_checked IS NULL OR epoch_us({T_NOW}) - epoch_us(last_checked) >= 28800000000 AS client_refresh FROM tracked_products"""))
def f27(spark, d):
    """Rows too new for alerts, and rows the client refreshes."""
    rows = r.tracked_products(spark, d)
    now = r.micros(as_of(rows, "updated_at"))
    age = now - r.micros(F.col("updated_at"))
    return rows.select("id", ((age >= 0) & (age < 6 * mo.HOUR)).alias("in_grace"), (F.col("last_checked").isNull() | (now - r.micros(F.col("last_checked")) >= 8 * mo.HOUR)).alias("client_refresh"))


@query("x36_n21_n23_links", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '/(\\d+)(?:[/?#]|$)', 1) AS article, len(regexp_extract_all(html, 'https?://[^\\s\"<>]+')) AS links FROM pages")
def x36(spark, d):
    """Host and article of each page's link, and the links in its text."""
    return r.table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"/(\d+)(?:[/?#]|$)", 1).alias("article"), F.regexp_count("html", F.lit(r"https?://[^\s\"<>]+")).cast("bigint").alias("links")
    )


@query("m17_sync", with_views("""WITH l AS (SELECT marketplace, product_id, max(updated_at) AS u FROM tracked_products WHERE user_id % 2 = 0 GROUP BY 1, 2), rm AS (SELECT marketplace, product_id, max(updated_at) AS u FROM tracked_products WHERE user_id % 2 = 1 GROUP BY 1, 2),
dead AS (SELECT DISTINCT marketplace, product_id FROM tracked_products WHERE user_id % 2 = 1 AND deleted AND priority)
SELECT marketplace, product_id, epoch_us(max(u)) AS changed FROM (SELECT * FROM l UNION ALL SELECT * FROM rm) WHERE (marketplace, product_id) NOT IN (SELECT (marketplace, product_id) FROM dead) GROUP BY 1, 2"""))  # fmt: skip
def m17(spark, d):
    """Two-way merge of tracked products: remote deletions win, else the newer row stays (n56, n57)."""
    rows, key = r.tracked_products(spark, d), ["marketplace", "product_id"]
    dead = rows.where("user_id % 2 = 1 AND deleted AND priority").select(*key).distinct()
    merged = s.upsert(rows.where("user_id % 2 = 0").select(*key, "updated_at"), rows.where("user_id % 2 = 1").select(*key, "updated_at"), key, "updated_at")
    return merged.join(dead, key, "left_anti").select(*key, r.micros(F.col("updated_at")).alias("changed"))
