"""Price series: compaction, minima, insights, nearest prices, keyed latest values, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import near_minimum
from ..sources.relations import micros

KEY = ["user_id", "marketplace", "product_id"]
HOUR = 3_600_000_000
DAY = 24 * HOUR


def _tiered(history: DataFrame, now: Column) -> DataFrame:
    age = lambda days: now - F.expr(f"INTERVAL '{days}' DAY")
    t = F.col("recorded_at")
    tier = F.when(t >= age(30), "raw").when(t >= age(365), "week").otherwise("month")
    bucket = F.when(tier == "week", F.date_trunc("week", t)).when(tier == "month", F.date_trunc("month", t))
    return history.select("*", tier.alias("tier"), bucket.alias("bucket"))


def _extremes(tiered: DataFrame) -> DataFrame:
    """Of each key's week or month its cheapest and dearest row (ties: the earliest, then the smaller id) and the number of rows: two rows of each task and bucket at most reach the shuffle."""
    rest = [c for c in tiered.columns if c not in (*KEY, "tier", "bucket")]
    row = F.struct(*rest)
    low, high = F.struct("price", "recorded_at", "id"), F.struct(F.col("price").isNull(), -F.col("price"), "recorded_at", "id")
    return tiered.where("tier <> 'raw'").groupBy(*KEY, "tier", "bucket").agg(F.min_by(row, low).alias("low"), F.min_by(row, high).alias("high"), F.count(F.lit(1)).alias("n"))


def compacted(history: DataFrame, now: Column) -> DataFrame:
    """Rows that stay: all of the last 30 days, which aren't shuffled; of a week, back to 365 days, and of a month before that, the cheapest and the dearest (ids are unique)."""
    tiered = _tiered(history, now)
    kept = _extremes(tiered).select(*KEY, "tier", F.explode(F.array_distinct(F.array("low", "high"))).alias("row")).select(*KEY, "row.*", "tier")
    return tiered.where("tier = 'raw'").select(*history.columns, "tier").union(kept.select(*history.columns, "tier"))


def compacted_away(history: DataFrame, now: Column) -> DataFrame:
    """tier, deleted: how many rows of each tier don't stay (tiers that lose some)."""
    gone = F.col("n") - F.when(F.col("low") == F.col("high"), 1).otherwise(2)
    return _extremes(_tiered(history, now)).groupBy("tier").agg(F.sum(gone).alias("deleted")).where("deleted > 0")


def price_minima(history: DataFrame, now: Column, most: int = 500) -> DataFrame:
    """Minima over 30, 90 and 365 days and the points of 90, of each key's newest `most` points of the last year."""
    within = lambda days: F.col("recorded_at") >= now - F.expr(f"INTERVAL '{days}' DAY")
    newest = Window.partitionBy(*KEY).orderBy(F.desc("recorded_at"), "id")
    rows = history.where(within(365)).withColumn("n", F.row_number().over(newest)).where((F.col("n") <= most) & (F.col("price") > 0))
    return rows.groupBy(*KEY).agg(
        F.min(F.when(within(30), F.col("price"))).alias("min30"), F.min(F.when(within(90), F.col("price"))).alias("min90"), F.min("price").alias("min365"), F.count(F.when(within(90), 1)).alias("points90")
    )


def insights(history: DataFrame, key: list[str], current: DataFrame, few: int, seen_within: float = 0.02) -> DataFrame:
    """Kind of each current price (key, current_price, old_price) against its history.

    A struck-through price that history never came within 2 % of is unconfirmed while the history is shorter than `few`
    points, then a fake discount.
    """
    joined = history.join(current, key)
    strike = F.when((F.col("old_price") > F.col("current_price")) & (F.col("old_price") > 0), F.col("old_price"))
    stats = joined.groupBy(*key).agg(
        F.first("current_price").alias("now"), F.min("price").alias("low"), F.max("price").alias("high"), F.floor(F.avg("price") + 0.5).alias("mean"), F.count(F.lit(1)).alias("points"),
        F.max(strike.isNotNull()).alias("struck"), F.coalesce(F.bool_or(F.abs(F.col("price") - strike) / strike <= seen_within), F.lit(True)).alias("seen"),
    )
    c = F.col
    kind = (
        F.when(c("struck") & ~c("seen") & (c("points") < few), "unconfirmed_strikethrough").when(c("struck") & ~c("seen"), "fake_discount").when(c("points") < 2, "average")
        .when(c("now") <= c("low") * 1.02, "great_deal").when(c("now") < c("mean") * 0.97, "good_price").when(c("now") >= c("high") * 0.98, "high_price").otherwise("average")
    )
    return stats.select(*key, c("low").alias("min_price"), c("high").alias("max_price"), c("mean").alias("avg_price"), "points", kind.alias("kind"))


def nearest(points: DataFrame, key: list[str], time: str, value: str, target: Column, since: Column, within: int) -> DataFrame:
    """Of each key, the value nearest in time to `target` among points from `since` on, if at most `within` microseconds away."""
    away = F.abs(micros(F.col(time)) - micros(target))
    first = Window.partitionBy(*key).orderBy("away", F.desc(time), value)
    ranked = points.where((F.col(time) >= since) & (F.col(value) > 0)).withColumn("away", away).withColumn("n", F.row_number().over(first))
    return ranked.where(f"n = 1 AND away <= {within}").select(*key, F.col(value).alias("value"), "away")


def newest(rows: DataFrame, key: list[str], *order: Column, keep: int = 1) -> DataFrame:
    """Of each key, the first `keep` rows by the order given."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(f"__n <= {keep}").drop("__n")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], time: str) -> DataFrame:
    """Last write wins on the key; at equal times the incoming row does."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return newest(both, key, F.desc(time), F.desc("__new")).drop("__new")


def fresh(rows: DataFrame, time: str, now: Column, ttl: str) -> DataFrame:
    return rows.where(F.col(time) >= now - F.expr(f"INTERVAL {ttl}"))


def purge_counts(tables: dict[str, tuple[DataFrame, str, Column, str]]) -> DataFrame:
    """Rows older than its time to live in each table: name -> (table, time column, now, interval)."""
    out = None
    for name, (rows, time, now, ttl) in tables.items():
        one = rows.where(F.col(time) < now - F.expr(f"INTERVAL {ttl}")).agg(F.count(F.lit(1)).alias("purged")).select(F.lit(name).alias("relation"), "purged")
        out = one if out is None else out.union(one)
    return out


def without_repeats(points: DataFrame, key: list[str], time: str, value: str, within: int) -> DataFrame:
    """Drop a point if its value equals that of the last point kept and it is less than `within` microseconds younger.

    What is kept depends on what was kept before, so each key's points are folded in order. A key's points stay together; they
    come in Arrow batches sorted by Spark, and only the last point kept is held.
    """
    kind = points.schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last_value, last_time = None, None, 0
        for rows in batches:
            keep = []
            for k, v, t in zip(zip(*(rows[c] for c in key), strict=True), rows[value], rows["__t"], strict=True):
                drop = k == last_key and v == last_value and t - last_time < within
                keep.append(not drop)
                if not drop:
                    last_key, last_value, last_time = k, v, t
            yield rows.loc[keep].drop(columns="__t")

    sorted_ = points.withColumn("__t", micros(F.col(time))).repartition(*key).sortWithinPartitions(*key, "__t", value)
    return sorted_.mapInPandas(fold, kind)


def cooled_alerts(alerts: DataFrame, key: list[str], time: str, price: str, rest: int, deeper: float | None = 0.98) -> DataFrame:
    """Alerts that are sent: not within `rest` microseconds of the key's last one sent, unless the price is below `deeper` of that one's."""
    kind = alerts.schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last_price, last_time = None, 0.0, 0
        for rows in batches:
            keep = []
            for k, p, t in zip(zip(*(rows[c] for c in key), strict=True), rows[price], rows["__t"], strict=True):
                quiet = k == last_key and t - last_time < rest and (deeper is None or p >= last_price * deeper)
                keep.append(not quiet)
                if not quiet:
                    last_key, last_price, last_time = k, p, t
            yield rows.loc[keep].drop(columns="__t")

    sorted_ = alerts.withColumn("__t", micros(F.col(time))).repartition(*key).sortWithinPartitions(*key, "__t", price)
    return sorted_.mapInPandas(fold, kind)


def digest(items: DataFrame, before: DataFrame, minima: DataFrame, key: list[str], step: float = 50.0) -> DataFrame:
    """Each item's move since a day ago (up, down, flat, unknown) and its place above the 90-day minimum."""
    delta = F.col("last_price") - F.col("value")
    rows = items.where(F.col("last_price") > 0).join(before.select(*key, "value"), key, "left").join(minima, key, "left")
    move = F.when(F.col("value").isNull(), "unknown").when(delta <= -step, "down").when(delta >= step, "up").otherwise("flat")
    return rows.select(*key, "last_price", move.alias("move"), delta.alias("delta"), near_minimum(F.col("last_price"), F.col("min90"), F.coalesce("points90", F.lit(0))).alias("near"))


def near_minima(items: DataFrame, minima: DataFrame, key: list[str]) -> DataFrame:
    """Items (last_price) near their 90-day minimum, with it and how many percent above it they are."""
    rows = items.where(F.col("last_price") > 0).join(minima, key)
    near = rows.where(near_minimum(F.col("last_price"), F.col("min90"), F.coalesce("points90", F.lit(0))) == "near_min")
    return near.select(*key, "last_price", "min90", ((F.col("last_price") - F.col("min90")) / F.col("min90") * 100).alias("above"))
