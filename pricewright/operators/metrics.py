"""Aggregations over event logs: reliability, funnel, operations, economics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cost_units, first_nonzero, percent, round_half_up
from ..sources.relations import WATCHED


def n(condition: Column) -> Column:
    """Rows for which a condition is true; null counts as false."""
    return F.count(F.when(condition, 1))


def success_rate(digits: int = 2) -> Column:
    """Share of successes in percent; null without rows."""
    return F.round(F.lit(100.0) * n(F.col("success")) / F.nullif(F.count(F.lit(1)), F.lit(0)), digits)


def search_by_day(rows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    recent = rows.where(F.col("created_at") >= now - F.expr(f"INTERVAL '{days}' DAY"))
    return recent.groupBy("marketplace", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total_requests"), n(F.col("success")).alias("successful_requests"), n(~F.col("success")).alias("failed_requests"),
        success_rate().alias("success_rate_pct"), F.round(F.avg("response_time_ms"), 0).alias("avg_response_time_ms"),
    )


def search_by_week(rows: DataFrame, now: Column) -> DataFrame:
    recent = rows.where(F.col("created_at") >= now - F.expr("INTERVAL '7' DAY"))
    return recent.groupBy("marketplace", F.to_date(F.date_trunc("week", "created_at")).alias("week_start")).agg(
        F.count(F.lit(1)).alias("total_requests"), n(F.col("success")).alias("successful_requests"), success_rate().alias("success_rate_pct"),
        F.round(F.avg("response_time_ms"), 0).alias("avg_response_time_ms"),
    )


def ai_by_day(rows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return rows.where(F.col("created_at") >= now - F.expr(f"INTERVAL '{days}' DAY")).groupBy("provider", "model", F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total_requests"), n(F.col("success")).alias("successful_requests"), n(~F.col("success")).alias("failed_requests"),
        F.round(F.avg("duration_ms"), 0).alias("avg_duration_ms"), F.round(F.avg(tokens), 0).alias("avg_tokens"), F.sum(tokens).alias("total_tokens"),
    )


def pipelines_by_day(rows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return rows.where(F.col("created_at") >= now - F.expr(f"INTERVAL '{days}' DAY")).groupBy(F.coalesce("pipeline", F.lit("single")).alias("pipeline"), F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total_requests"), n(F.col("success")).alias("successful_requests"), n(F.col("web_research_used")).alias("web_research_requests"),
        n(F.col("web_research_cached")).alias("web_research_cached"), F.round(F.avg("duration_ms"), 0).alias("avg_duration_ms"),
    )


def last_day(rows: DataFrame, now: Column) -> DataFrame:
    """The last 24 hours of each watched marketplace, those without searches included (at 100 %)."""
    recent = rows.where(F.col("created_at") >= now - F.expr("INTERVAL '24' HOUR")).groupBy("marketplace").agg(
        F.count(F.lit(1)).alias("total_requests"), n(F.col("success")).alias("successful_requests"), success_rate().alias("rate"), F.round(F.avg("response_time_ms"), 0).alias("avg_response_time_ms"),
    )
    every = rows.sparkSession.createDataFrame([(m,) for m in WATCHED], "marketplace string")
    return every.join(recent, "marketplace", "left").select(
        "marketplace", F.coalesce("total_requests", F.lit(0)).alias("total_requests"), F.coalesce("successful_requests", F.lit(0)).alias("successful_requests"),
        F.coalesce("rate", F.lit(100.0)).alias("success_rate_pct"), "avg_response_time_ms",
    )


def alerts(day: DataFrame, threshold: float = 85.0, at_least: int = 5) -> DataFrame:
    return day.withColumn("alert", (F.col("total_requests") >= at_least) & (F.col("success_rate_pct") < threshold))


def _done() -> Column:
    return (F.col("name") == "compare_completed") & (F.coalesce("success", F.lit(False)) | (F.col("payload")["outcome"] == "success"))


def funnel(rows: DataFrame) -> DataFrame:
    """One row: steps with their fallbacks, and conversions between them. One pass over the events."""
    is_ = lambda *names: n(F.col("name").isin(*names))
    counted = rows.agg(
        is_("extension_installed").alias("installs"), is_("extension_started").alias("started"), is_("marketplace_page_detected").alias("pages"), is_("product_card_opened").alias("cards"),
        is_("compare_started").alias("comparisons"), n(_done()).alias("successful"), is_("ai_analysis_completed").alias("ai_done"), is_("ai_started").alias("ai_begun"),
        is_("ai_analysis_cache_hit").alias("hits"), n((F.col("name") == "ai_analysis_completed") & (F.col("payload")["source"] == "cache")).alias("hits_by_source"),
        is_("product_tracking_added").alias("tracked"), is_("telegram_connected").alias("connected"), is_("telegram_linked").alias("linked"),
        is_("trial_claimed", "premium_active", "premium_page_opened").alias("premium_trial"), is_("trial_claimed", "premium_active").alias("paid"),
    )
    c = F.col
    steps = counted.select(
        "installs", "started", first_nonzero(c("pages"), c("cards")).alias("marketplace_detected"), "comparisons", "successful", first_nonzero(c("ai_done"), c("ai_begun")).alias("ai"),
        first_nonzero(c("hits"), c("hits_by_source")).alias("ai_cache_hits"), "tracked", first_nonzero(c("connected"), c("linked")).alias("telegram"), "premium_trial", "paid",
    )
    return steps.select(
        "installs", "started", "marketplace_detected", "comparisons", "successful", "ai", "ai_cache_hits", F.greatest(c("ai") - c("ai_cache_hits"), F.lit(0)).alias("ai_generated"),
        "tracked", "telegram", "premium_trial", percent(c("comparisons"), c("installs")).alias("install_to_comparison"), percent(c("successful"), c("comparisons")).alias("comparison_to_success"),
        percent(c("tracked"), c("successful")).alias("success_to_tracking"), percent(c("telegram"), c("tracked")).alias("tracking_to_telegram"), percent(c("paid"), c("started")).alias("started_to_premium"),
    )


def funnel_by_marketplace(rows: DataFrame) -> DataFrame:
    failed = (F.col("name") == "comparison_failed") | ((F.col("name") == "compare_completed") & (F.col("success") == F.lit(False)))
    grouped = rows.groupBy(F.coalesce("marketplace", F.lit("unknown")).alias("marketplace")).agg(
        n(F.col("name") == "compare_started").alias("comparisons"), n(_done()).alias("success"), n(failed).alias("failed")
    )
    some = (F.col("marketplace") != "unknown") | (F.col("comparisons") + F.col("success") + F.col("failed") > 0)
    return grouped.where(some).withColumn("success_rate_pct", percent(F.col("success"), first_nonzero(F.col("comparisons"), F.col("success") + F.col("failed"))))


def funnel_errors(rows: DataFrame, most: int = 40) -> DataFrame:
    bad = rows.where(F.col("name").isin("comparison_failed", "monitoring_refresh_failed", "ai_analysis_failed"))
    grouped = bad.groupBy(F.coalesce(F.col("payload")["failure_reason"], F.lit("unknown")).alias("reason"), F.coalesce("marketplace", F.lit("unknown")).alias("marketplace"))
    return grouped.agg(F.count(F.lit(1)).alias("errors"), F.max("created_at").alias("last_seen")).orderBy(F.desc("errors"), "reason", "marketplace").limit(most)


def providers(rows: DataFrame) -> DataFrame:
    ai = rows.where(F.col("name").isin("ai_analysis_completed", "ai_started", "ai_analysis_cache_hit"))
    return ai.groupBy(F.coalesce(F.col("payload")["provider"], F.lit("unknown")).alias("provider")).agg(F.count(F.lit(1)).alias("events"))


#: Counter of operations, and the event name that it counts.
COUNTERS = {
    "search_started": "marketplace_search_started", "search_success": "marketplace_search_success", "search_failed": "marketplace_search_failed", "scrape_request": "scrape_request",
    "scrape_cache_hit": "scrape_cache_hit", "scrape_cache_miss": "scrape_cache_miss", "monitor_check": "telegram_monitor_check", "monitor_cache_hit": "telegram_monitor_cache_hit",
    "monitor_scrape": "telegram_monitor_scrape", "alerts_sent": "telegram_alert_sent", "monitor_error": "telegram_monitor_error",
}


def _rates(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select(
        "*", percent(c("scrape_cache_hit"), c("scrape_cache_hit") + c("scrape_cache_miss")).alias("scrape_cache_hit_rate_pct"),
        percent(c("monitor_cache_hit"), c("monitor_cache_hit") + c("monitor_scrape")).alias("monitor_cache_hit_rate_pct"),
        F.when(c("monitor_check") > 0, F.floor(c("monitor_scrape") * 1000.0 / c("monitor_check") + 0.5) / 1000.0).otherwise(0.0).alias("scrape_per_monitor_check"),
    )


def operations(rows: DataFrame) -> DataFrame:
    """Counters, cost units and rates of each marketplace that has any operation."""
    ops = rows.where(F.col("name").isin(*COUNTERS.values()))
    spent = F.when(F.col("name").isin("scrape_request", "telegram_monitor_scrape"), cost_units(F.col("payload")["source"])).otherwise(0)
    counted = ops.groupBy(F.coalesce("marketplace", F.lit("unknown")).alias("marketplace")).agg(
        *[n(F.col("name") == event).alias(counter) for counter, event in COUNTERS.items()], F.sum(spent).cast("bigint").alias("scrape_cost_units")
    )
    return _rates(counted).withColumn("search_success_rate_pct", percent(F.col("search_success"), first_nonzero(F.col("search_started"), F.col("search_success") + F.col("search_failed"))))


def operations_total(rows: DataFrame) -> DataFrame:
    sums = operations(rows).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTERS, "scrape_cost_units")])
    return _rates(sums)


def most_expensive(ops: DataFrame, most: int = 5) -> DataFrame:
    return ops.orderBy(F.desc("scrape_cost_units"), "marketplace").limit(most).select("marketplace", "scrape_cost_units", "monitor_scrape", "scrape_request")


def most_failed(ops: DataFrame, most: int = 8) -> DataFrame:
    failures = ops.select("marketplace", "search_failed", "monitor_error", (F.col("search_failed") + F.col("monitor_error")).alias("total_failures"))
    return failures.where("total_failures > 0").orderBy(F.desc("total_failures"), "marketplace").limit(most)


def monitor_errors(rows: DataFrame, most: int = 30) -> DataFrame:
    bad = rows.where(F.col("name") == "telegram_monitor_error")
    reason = F.coalesce("error_code", F.col("payload")["reason"], F.lit("unknown"))
    return bad.groupBy(reason.alias("reason"), F.coalesce("marketplace", F.lit("unknown")).alias("marketplace")).agg(F.count(F.lit(1)).alias("errors")).orderBy(F.desc("errors"), "reason", "marketplace").limit(most)


def watchers(settings: DataFrame) -> DataFrame:
    on = F.col("server_monitoring") & F.col("telegram_enabled") & F.col("notifications_enabled") & (F.col("telegram_chat_id") != "")
    return settings.where(on).select("user_id").distinct()


def subscriptions(settings: DataFrame, tracked: DataFrame) -> DataFrame:
    """Different (marketplace, product_id, user_id) of users that are watched and rows that aren't deleted."""
    live = tracked.where(~F.col("deleted") & (F.trim("product_id") != "")).select(F.coalesce("marketplace", F.lit("unknown")).alias("marketplace"), F.trim("product_id").alias("product_id"), "user_id")
    return live.join(watchers(settings), "user_id", "left_semi").distinct()


def inventory(settings: DataFrame, tracked: DataFrame) -> DataFrame:
    targets = subscriptions(settings, tracked).groupBy("marketplace", "product_id").agg(F.count(F.lit(1)).alias("subscribers"))
    links, unique = F.coalesce(F.sum("subscribers"), F.lit(0)), F.count(F.lit(1))
    return targets.agg(
        links.alias("total_subscriber_links"), unique.alias("unique_monitoring_targets"),
        F.when(unique > 0, round_half_up(links / unique, 3)).otherwise(0.0).alias("avg_subscribers_per_target"), F.coalesce(F.max("subscribers"), F.lit(0)).alias("max_subscribers_per_target"),
    )


def targets_by_marketplace(settings: DataFrame, tracked: DataFrame) -> DataFrame:
    return subscriptions(settings, tracked).groupBy("marketplace").agg(F.count_distinct("product_id").alias("unique_targets"))


#: Fixed value: rubles for a call of the paid scraper.
RUB_PER_CALL = 4 / 1000


def economics(figures: DataFrame, days: int) -> DataFrame:
    """Rates and costs of monitoring from one row of inventory and operations figures."""
    c, d = F.col, float(max(1, days))
    three = lambda x: round_half_up(x, 3)
    paid = F.coalesce(c("paid_scrapes"), c("scrapes"))
    per = lambda x, by: F.when(by > 0, three(x / by)).otherwise(0.0)
    day = lambda calls: round_half_up(paid * calls * RUB_PER_CALL / d, 2)
    return figures.select(
        three(c("checks") / d).alias("checks_per_day"), three(c("scrapes") / d).alias("scrapes_per_day"), percent(c("cache_hits"), c("cache_hits") + c("scrapes")).alias("cache_hit_rate_pct"),
        three(c("errors") / d).alias("failures_per_day"), per(c("scrapes"), c("active")).alias("scrapes_per_active"), per(c("scrapes"), c("unique_targets")).alias("scrapes_per_unique"),
        F.when(c("unique_targets") > 0, three(c("active") / c("unique_targets"))).otherwise(c("active").cast("double")).alias("dedup_factor"),
        F.greatest(F.lit(0.0), three(three(c("checks") * F.greatest(F.lit(1.0), c("avg_subscribers"))) - c("scrapes"))).alias("estimated_scrapes_saved"),
        day(1).alias("rub_day_optimistic"), day(2).alias("rub_day_pessimistic"), round_half_up(day(1) * 30, 2).alias("rub_month_optimistic"), round_half_up(day(2) * 30, 2).alias("rub_month_pessimistic"),
    )


def top_counts(rows: DataFrame, key: str, most: int = 12) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), key).limit(most)


def hubs(pages: DataFrame, slug: str, label: str, at_least: int = 2) -> DataFrame:
    return pages.where(F.col(slug).isNotNull()).groupBy(slug).agg(F.count(F.lit(1)).alias("pages"), F.max(label).alias("label")).where(F.col("pages") >= at_least)
