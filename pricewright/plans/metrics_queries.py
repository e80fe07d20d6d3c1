"""Queries over event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import cost_units, duration_bucket
from ..operators import metrics as m
from ..registry import query
from ..sources import relations as r
from ..sources.relations import as_of, micros, with_views

RATE = "round(100.0::DOUBLE * count(*) FILTER (WHERE success) / nullif(count(*), 0), 2)"


@query("a1_search_daily", with_views(f"""
SELECT marketplace, created_at::DATE::VARCHAR AS day, count(*) AS total_requests, count(*) FILTER (WHERE success) AS successful_requests, count(*) FILTER (WHERE NOT success) AS failed_requests,
  {RATE} AS success_rate_pct, round(avg(response_time_ms), 0) AS avg_response_time_ms
FROM search_metrics WHERE created_at >= (SELECT max(created_at) FROM search_metrics) - INTERVAL 30 DAY GROUP BY ALL"""))  # fmt: skip
def a1(spark, d):
    """Daily search reliability by marketplace."""
    rows = r.search_metrics(spark, d)
    return m.search_by_day(rows, as_of(rows, "created_at")).withColumn("day", F.col("day").cast("string"))


@query("a2_search_weekly", with_views(f"""
SELECT marketplace, date_trunc('week', created_at)::DATE::VARCHAR AS week_start, count(*) AS total_requests, count(*) FILTER (WHERE success) AS successful_requests,
  {RATE} AS success_rate_pct, round(avg(response_time_ms), 0) AS avg_response_time_ms
FROM search_metrics WHERE created_at >= (SELECT max(created_at) FROM search_metrics) - INTERVAL 7 DAY GROUP BY ALL"""))  # fmt: skip
def a2(spark, d):
    """Search reliability of the last seven days by ISO week."""
    rows = r.search_metrics(spark, d)
    return m.search_by_week(rows, as_of(rows, "created_at")).withColumn("week_start", F.col("week_start").cast("string"))


TOKENS = "coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)"


@query("a3_ai_daily", with_views(f"""
SELECT provider, model, created_at::DATE::VARCHAR AS day, count(*) AS total_requests, count(*) FILTER (WHERE success) AS successful_requests, count(*) FILTER (WHERE NOT success) AS failed_requests,
  round(avg(duration_ms), 0) AS avg_duration_ms, round(avg({TOKENS}), 0) AS avg_tokens, sum({TOKENS})::BIGINT AS total_tokens
FROM ai_request_log WHERE created_at >= (SELECT max(created_at) FROM ai_request_log) - INTERVAL 30 DAY GROUP BY ALL"""))  # fmt: skip
def a3(spark, d):
    """Daily model requests."""
    rows = r.ai_request_log(spark, d)
    return m.ai_by_day(rows, as_of(rows, "created_at")).withColumn("day", F.col("day").cast("string"))


@query("a4_pipeline_daily", with_views("""
SELECT coalesce(pipeline, 'single') AS pipeline, created_at::DATE::VARCHAR AS day, count(*) AS total_requests, count(*) FILTER (WHERE success) AS successful_requests,
  count(*) FILTER (WHERE web_research_used) AS web_research_requests, count(*) FILTER (WHERE web_research_cached) AS web_research_cached, round(avg(duration_ms), 0) AS avg_duration_ms
FROM ai_request_log WHERE created_at >= (SELECT max(created_at) FROM ai_request_log) - INTERVAL 30 DAY GROUP BY 1, 2"""))  # fmt: skip
def a4(spark, d):
    """Daily requests by pipeline."""
    rows = r.ai_request_log(spark, d)
    return m.pipelines_by_day(rows, as_of(rows, "created_at")).withColumn("day", F.col("day").cast("string"))


DAY = f"""day AS (
  SELECT w.marketplace, coalesce(total_requests, 0) AS total_requests, coalesce(successful_requests, 0) AS successful_requests, coalesce(rate, 100.0::DOUBLE) AS success_rate_pct, avg_response_time_ms
  FROM (SELECT unnest({list(r.WATCHED)}) AS marketplace) w LEFT JOIN (
    SELECT marketplace, count(*) AS total_requests, count(*) FILTER (WHERE success) AS successful_requests, {RATE} AS rate, round(avg(response_time_ms), 0) AS avg_response_time_ms
    FROM search_metrics WHERE created_at >= (SELECT max(created_at) FROM search_metrics) - INTERVAL 24 HOUR GROUP BY 1) USING (marketplace))"""


@query("a5_j1_last_day", with_views(f"WITH {DAY} SELECT * FROM day"))
def a5(spark, d):
    """24-hour success of every watched marketplace, by left join with the dimension."""
    rows = r.search_metrics(spark, d)
    return m.last_day(rows, as_of(rows, "created_at"))


@query("a6_last_day_single", with_views(f"WITH {DAY} SELECT total_requests, successful_requests, success_rate_pct FROM day WHERE marketplace = 'wildberries'"))
def a6(spark, d):
    """The same for one marketplace."""
    return a5(spark, d).where("marketplace = 'wildberries'").select("total_requests", "successful_requests", "success_rate_pct")


@query("a7_alerts", with_views(f"WITH {DAY} SELECT *, total_requests >= 5 AND success_rate_pct < 85 AS alert FROM day"))
def a7(spark, d):
    """Which marketplaces are below the alert threshold."""
    return m.alerts(a5(spark, d))


def pct(a, b):
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE floor({a} * 1000.0::DOUBLE / {b} + 0.5::DOUBLE) / 10.0::DOUBLE END"


DONE = "name = 'compare_completed' AND (coalesce(success, false) OR p_outcome = 'success')"


@query("a8_funnel", with_views(f"""
WITH c AS (SELECT count(*) FILTER (name = 'extension_installed') AS installs, count(*) FILTER (name = 'extension_started') AS started, count(*) FILTER (name = 'marketplace_page_detected') AS pages,
  count(*) FILTER (name = 'product_card_opened') AS cards, count(*) FILTER (name = 'compare_started') AS comparisons, count(*) FILTER ({DONE}) AS successful,
  count(*) FILTER (name = 'ai_analysis_completed') AS ai_done, count(*) FILTER (name = 'ai_started') AS ai_begun, count(*) FILTER (name = 'ai_analysis_cache_hit') AS hits,
  count(*) FILTER (name = 'ai_analysis_completed' AND p_source = 'cache') AS hits2, count(*) FILTER (name = 'product_tracking_added') AS tracked,
  count(*) FILTER (name = 'telegram_connected') AS connected, count(*) FILTER (name = 'telegram_linked') AS linked,
  count(*) FILTER (name IN ('trial_claimed', 'premium_active', 'premium_page_opened')) AS premium_trial, count(*) FILTER (name IN ('trial_claimed', 'premium_active')) AS paid FROM telemetry_events
), s AS (SELECT *, CASE WHEN pages <> 0 THEN pages ELSE cards END AS marketplace_detected, CASE WHEN ai_done <> 0 THEN ai_done ELSE ai_begun END AS ai,
  CASE WHEN hits <> 0 THEN hits ELSE hits2 END AS ai_cache_hits, CASE WHEN connected <> 0 THEN connected ELSE linked END AS telegram FROM c)
SELECT installs, started, marketplace_detected, comparisons, successful, ai, ai_cache_hits, greatest(ai - ai_cache_hits, 0) AS ai_generated, tracked, telegram, premium_trial,
  {pct('comparisons', 'installs')} AS install_to_comparison, {pct('successful', 'comparisons')} AS comparison_to_success, {pct('tracked', 'successful')} AS success_to_tracking,
  {pct('telegram', 'tracked')} AS tracking_to_telegram, {pct('paid', 'started')} AS started_to_premium FROM s"""))  # fmt: skip
def a8(spark, d):
    """The product funnel and its conversions (a9)."""
    return m.funnel(r.telemetry_events(spark, d))


@query("a8_funnel_by_marketplace", with_views(f"""
WITH g AS (SELECT coalesce(marketplace, 'unknown') AS marketplace, count(*) FILTER (name = 'compare_started') AS comparisons, count(*) FILTER ({DONE}) AS success,
  count(*) FILTER (name = 'comparison_failed' OR (name = 'compare_completed' AND success = false)) AS failed FROM telemetry_events GROUP BY 1)
SELECT *, {pct('success', '(CASE WHEN comparisons <> 0 THEN comparisons ELSE success + failed END)')} AS success_rate_pct FROM g WHERE marketplace <> 'unknown' OR comparisons + success + failed > 0"""))  # fmt: skip
def a8_mp(spark, d):
    """The funnel by marketplace."""
    return m.funnel_by_marketplace(r.telemetry_events(spark, d))


@query("a10_funnel_errors", with_views("""
SELECT coalesce(p_failure_reason, 'unknown') AS reason, coalesce(marketplace, 'unknown') AS marketplace, count(*) AS errors, epoch_us(max(created_at)) AS last_seen FROM telemetry_events
WHERE name IN ('comparison_failed', 'monitoring_refresh_failed', 'ai_analysis_failed') GROUP BY 1, 2 ORDER BY errors DESC, 1, 2 LIMIT 40"""))  # fmt: skip
def a10(spark, d):
    """Most frequent errors (a top-k report)."""
    return m.funnel_errors(r.telemetry_events(spark, d)).withColumn("last_seen", micros(F.col("last_seen")))


@query("a8_providers", with_views("SELECT coalesce(p_provider, 'unknown') AS provider, count(*) AS events FROM telemetry_events WHERE name IN ('ai_analysis_completed', 'ai_started', 'ai_analysis_cache_hit') GROUP BY 1"))
def a8_providers(spark, d):
    """Events by model provider."""
    return m.providers(r.telemetry_events(spark, d))


WEIGHT = "CASE p_source WHEN 'scrappey' THEN 10 WHEN 'tab' THEN 3 WHEN 'legacy' THEN 1 WHEN 'api' THEN 1 ELSE 0 END"
COUNTS = ", ".join(f"count(*) FILTER (name = '{e}') AS {c}" for c, e in m.COUNTERS.items())
SOME_OPS = ", ".join(f"'{e}'" for e in m.COUNTERS.values())
OPS_RATES = f"""{pct('scrape_cache_hit', '(scrape_cache_hit + scrape_cache_miss)')} AS scrape_cache_hit_rate_pct, {pct('monitor_cache_hit', '(monitor_cache_hit + monitor_scrape)')} AS monitor_cache_hit_rate_pct,
  CASE WHEN monitor_check > 0 THEN floor(monitor_scrape * 1000.0::DOUBLE / monitor_check + 0.5::DOUBLE) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS scrape_per_monitor_check"""
OPS = f"""ops AS (SELECT coalesce(marketplace, 'unknown') AS marketplace, {COUNTS},
  sum(CASE WHEN name IN ('scrape_request', 'telegram_monitor_scrape') THEN {WEIGHT} ELSE 0 END)::BIGINT AS scrape_cost_units FROM telemetry_events WHERE name IN ({SOME_OPS}) GROUP BY 1)"""


@query("a11_operations", with_views(f"WITH {OPS} SELECT *, {OPS_RATES}, {pct('search_success', '(CASE WHEN search_started <> 0 THEN search_started ELSE search_success + search_failed END)')} AS search_success_rate_pct FROM ops"))
def a11(spark, d):
    """Operations by marketplace."""
    return m.operations(r.telemetry_events(spark, d))


@query("a11_operations_total", with_views(f"WITH {OPS}, t AS (SELECT {', '.join(f'coalesce(sum({c}), 0)::BIGINT AS {c}' for c in (*m.COUNTERS, 'scrape_cost_units'))} FROM ops) SELECT *, {OPS_RATES} FROM t"))
def a11_total(spark, d):
    """Operations over all marketplaces."""
    return m.operations_total(r.telemetry_events(spark, d))


@query("a12_cost_weight", with_views(f"SELECT p_source AS source, sum({WEIGHT})::BIGINT AS units, count(*) AS events FROM telemetry_events GROUP BY 1"))
def a12(spark, d):
    """Cost units by source."""
    rows = r.telemetry_events(spark, d)
    source = F.col("payload")["source"]
    return rows.groupBy(source.alias("source")).agg(F.sum(cost_units(source)).cast("bigint").alias("units"), F.count(F.lit(1)).alias("events"))


@query("a13_most_expensive", with_views(f"WITH {OPS} SELECT marketplace, scrape_cost_units, monitor_scrape, scrape_request FROM ops ORDER BY scrape_cost_units DESC, marketplace LIMIT 5"))
def a13(spark, d):
    """Most expensive marketplaces (a top-k report)."""
    return m.most_expensive(a11(spark, d))


@query("a13_most_failed", with_views(f"""WITH {OPS} SELECT marketplace, search_failed, monitor_error, search_failed + monitor_error AS total_failures FROM ops
WHERE search_failed + monitor_error > 0 ORDER BY total_failures DESC, marketplace LIMIT 8"""))  # fmt: skip
def a13_failed(spark, d):
    """Most failing marketplaces (a top-k report)."""
    return m.most_failed(a11(spark, d))


@query("a11_monitor_errors", with_views("""SELECT coalesce(error_code, p_reason, 'unknown') AS reason, coalesce(marketplace, 'unknown') AS marketplace, count(*) AS errors FROM telemetry_events
WHERE name = 'telegram_monitor_error' GROUP BY 1, 2 ORDER BY errors DESC, 1, 2 LIMIT 30"""))  # fmt: skip
def a11_errors(spark, d):
    """Monitoring errors by reason (a top-k report)."""
    return m.monitor_errors(r.telemetry_events(spark, d))


SUBS = """watchers AS (SELECT DISTINCT user_id FROM alert_settings WHERE server_monitoring AND telegram_enabled AND notifications_enabled AND telegram_chat_id <> ''),
subs AS (SELECT DISTINCT marketplace, product_id, user_id FROM tracked_products WHERE NOT deleted AND user_id IN (SELECT user_id FROM watchers)),
inv AS (SELECT coalesce(sum(s), 0)::BIGINT AS total_subscriber_links, count(*) AS unique_monitoring_targets,
  CASE WHEN count(*) > 0 THEN floor(sum(s)::DOUBLE / count(*) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_subscribers_per_target, coalesce(max(s), 0) AS max_subscribers_per_target
  FROM (SELECT count(*) AS s FROM subs GROUP BY marketplace, product_id))"""


@query("a14_inventory", with_views(f"WITH {SUBS} SELECT * FROM inv"))
def a14(spark, d):
    """Subscribers per monitored product."""
    return m.inventory(r.alert_settings(spark, d), r.tracked_products(spark, d))


@query("a14_targets_by_marketplace", with_views(f"WITH {SUBS} SELECT marketplace, count(DISTINCT product_id) AS unique_targets FROM subs GROUP BY 1"))
def a14_mp(spark, d):
    """Different monitored products by marketplace."""
    return m.targets_by_marketplace(r.alert_settings(spark, d), r.tracked_products(spark, d))


def _r(x, digits):
    return f"(floor(({x}) * {10.0**digits}::DOUBLE + 0.5::DOUBLE) / {10.0**digits}::DOUBLE)"


RUB_DAY = {k: _r(f"paid * {k} * {m.RUB_PER_CALL}::DOUBLE / 30.0::DOUBLE", 2) for k in (1, 2)}


@query("a15_economics", with_views(f"""
WITH {OPS}, {SUBS}, f AS (SELECT sum(monitor_check)::BIGINT AS checks, sum(monitor_scrape)::BIGINT AS scrapes, sum(monitor_cache_hit)::BIGINT AS hits, sum(monitor_error)::BIGINT AS errors,
  (SELECT count(*) FROM telemetry_events WHERE name = 'telegram_monitor_scrape' AND p_source = 'scrappey') AS paid FROM ops), x AS (SELECT * FROM f, inv)
SELECT {_r('checks / 30.0::DOUBLE', 3)} AS checks_per_day, {_r('scrapes / 30.0::DOUBLE', 3)} AS scrapes_per_day, {pct('hits', '(hits + scrapes)')} AS cache_hit_rate_pct,
  {_r('errors / 30.0::DOUBLE', 3)} AS failures_per_day, CASE WHEN total_subscriber_links > 0 THEN {_r('scrapes / total_subscriber_links', 3)} ELSE 0.0::DOUBLE END AS scrapes_per_active,
  CASE WHEN unique_monitoring_targets > 0 THEN {_r('scrapes / unique_monitoring_targets', 3)} ELSE 0.0::DOUBLE END AS scrapes_per_unique,
  CASE WHEN unique_monitoring_targets > 0 THEN {_r('total_subscriber_links / unique_monitoring_targets', 3)} ELSE total_subscriber_links::DOUBLE END AS dedup_factor,
  greatest(0.0::DOUBLE, {_r(_r('checks * greatest(1.0::DOUBLE, avg_subscribers_per_target)', 3) + ' - scrapes', 3)}) AS estimated_scrapes_saved,
  {RUB_DAY[1]} AS rub_day_optimistic, {RUB_DAY[2]} AS rub_day_pessimistic, {_r(RUB_DAY[1] + ' * 30', 2)} AS rub_month_optimistic, {_r(RUB_DAY[2] + ' * 30', 2)} AS rub_month_pessimistic FROM x"""))  # fmt: skip
def a15(spark, d):
    """What monitoring costs: one row of inventory joined with one row of operations."""
    rows = r.telemetry_events(spark, d)
    paid = m.n((F.col("name") == "telegram_monitor_scrape") & (F.col("payload")["source"] == "scrappey"))
    ops = m.operations_total(rows).select(F.col("monitor_check").alias("checks"), F.col("monitor_scrape").alias("scrapes"), F.col("monitor_cache_hit").alias("cache_hits"), F.col("monitor_error").alias("errors"))
    inv = a14(spark, d).select(F.col("total_subscriber_links").alias("active"), F.col("unique_monitoring_targets").alias("unique_targets"), F.col("avg_subscribers_per_target").alias("avg_subscribers"))
    one = F.lit(1)
    # three relations of one row each
    both = ops.withColumn("k", one).join(inv.withColumn("k", one), "k").join(rows.agg(paid.alias("paid_scrapes")).withColumn("k", one), "k")
    return m.economics(both, 30)


@query("a16_tagged_scrapes", with_views("SELECT count(*) FILTER (name = 'telegram_monitor_scrape' AND p_source = 'scrappey') AS tagged FROM telemetry_events"))
def a16(spark, d):
    """Monitor scrapes that went to the paid scraper."""
    return r.telemetry_events(spark, d).agg(m.n((F.col("name") == "telegram_monitor_scrape") & (F.col("payload")["source"] == "scrappey")).alias("tagged"))


@query("a17_top_endpoints", with_views("SELECT endpoint, count(*) AS events FROM edge_request_log GROUP BY 1 ORDER BY events DESC, endpoint LIMIT 12"))
def a17(spark, d):
    """Busiest endpoints (a top-k report)."""
    return m.top_counts(r.edge_request_log(spark, d), "endpoint")


@query("a33_hubs", "SELECT p_brand, count(*) AS pages, max(p_type) AS label FROM part WHERE p_brand IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def a33(spark, d):
    """Brands with at least two pages."""
    return m.hubs(r.table(spark, d, "part"), "p_brand", "p_type")


@query("a35_levels", with_views("SELECT level, count(*) AS events FROM telemetry_events GROUP BY 1"))
def a35(spark, d):
    """Events by level."""
    return r.telemetry_events(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("events"))


@query("d58_durations", with_views("""SELECT CASE WHEN elapsed_ms IS NULL OR elapsed_ms < 1000 THEN 'lt_1s' WHEN elapsed_ms < 3000 THEN '1_3s' WHEN elapsed_ms < 10000 THEN '3_10s'
WHEN elapsed_ms < 30000 THEN '10_30s' ELSE '30s_plus' END AS bucket, count(*) AS events FROM telemetry_events GROUP BY 1"""))  # fmt: skip
def d58(spark, d):
    """Events by duration bucket."""
    return r.telemetry_events(spark, d).groupBy(duration_bucket(F.col("elapsed_ms")).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))
