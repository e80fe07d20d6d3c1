"""Scheduled price checks as set operations: who is entitled, what is stale, what one fetch serves, which alerts go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import back_off, dropped_server
from ..sources.relations import micros

HOUR = 3_600_000_000
#: Longest rest of a product that keeps failing: three days.
MOST_REST = 72 * HOUR


def stale(last_checked: Column, failures: Column, now: Column, base: int) -> Column:
    """Older than `base` microseconds times the back-off, at most three days; never checked is stale."""
    rest = F.least(F.lit(base).cast("bigint") * back_off(failures), F.lit(MOST_REST))
    return last_checked.isNull() | (micros(now) - micros(last_checked) >= rest)


def premium(rows: DataFrame, licenses: DataFrame, now: Column) -> DataFrame:
    """user_id, active: the row isn't expired, has a license, and that is active and isn't expired."""
    joined = rows.join(licenses, rows["license_key_id"] == licenses["id"], "left")
    ok = (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & F.col("id").isNotNull() & F.col("is_active") & (F.col("license_expires_at").isNull() | (F.col("license_expires_at") > now))
    return joined.select("user_id", F.coalesce(ok, F.lit(False)).alias("active"))


def plans(users: DataFrame, premium_rows: DataFrame, trials: DataFrame, now: Column) -> DataFrame:
    """user_id, kind: premium, trial or free."""
    paid = premium_rows.where("active").select("user_id").distinct().withColumn("paid", F.lit(True))
    trial = trials.where(F.col("trial_expires_at") > now).select("user_id").distinct().withColumn("trial", F.lit(True))
    kind = F.when(F.col("paid"), "premium").when(F.col("trial"), "trial").otherwise("free")
    return users.select("user_id").distinct().join(paid, "user_id", "left").join(trial, "user_id", "left").select("user_id", kind.alias("kind"))


def within_plan(tracked: DataFrame, kinds: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Each user's most recently updated live rows, as many as the plan allows."""
    limit = F.lit(0)
    for kind, n in limits.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "id")
    rows = tracked.where(~F.col("deleted")).join(kinds, "user_id")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def monitoring_key(marketplace: Column, product_id: Column, url: Column) -> Column:
    """store:id from the id, else from the number that ends the link; never from a title."""
    by_url = F.nullif(F.regexp_extract(url, r"(\d{4,})/?(?:[?#].*)?$", 1), F.lit(""))
    key = F.coalesce(F.nullif(F.trim(product_id), F.lit("")), by_url)
    return F.when(key.isNotNull(), F.concat(marketplace, F.lit(":"), key))


def coalesced(rows: DataFrame) -> DataFrame:
    """One row a product: any priority, the first link by row id, number of subscribers. Rows without a key are dropped."""
    keyed = rows.withColumn("key", monitoring_key(F.col("marketplace"), F.col("product_id"), F.col("product_url"))).where("key IS NOT NULL")
    first_link = F.min(F.when(F.col("product_url").isNotNull(), F.struct("id", "product_url")))["product_url"]
    return keyed.groupBy("key").agg(F.bool_or("priority").alias("priority"), first_link.alias("product_url"), F.count(F.lit(1)).alias("subscribers"), F.count(F.when(~F.col("deleted"), 1)).alias("active_subscribers"))


def alerts(rows: DataFrame, observed: DataFrame, settings: DataFrame) -> DataFrame:
    """Drop and target alerts of live rows whose product was observed at a new price; Ozon needs 100 rubles and 2 points more."""
    joined = rows.where(~F.col("deleted")).join(observed, "key").join(settings.where("notifications_enabled"), "user_id")
    ozon = F.col("marketplace") == "ozon"
    rub, pct = F.col("min_drop_rub") + F.when(ozon, 100).otherwise(0), F.col("min_drop_percent") + F.when(ozon, 2).otherwise(0)
    drop = dropped_server(F.col("last_price"), F.col("price"), rub, pct)
    target = F.col("price") <= F.col("target_price")
    return joined.select("id", "user_id", "price", F.coalesce(drop, F.lit(False)).alias("drop_alert"), F.coalesce(target, F.lit(False)).alias("target_alert"))


def reconciled(local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """Remote keys that are no longer local: to be deleted there."""
    return remote.select(*key).distinct().join(local.select(*key), key, "left_anti")


def claimed(device: DataFrame, owned: DataFrame, key: list[str]) -> DataFrame:
    """Device rows with what becomes of them: merged if the user has the product, else claimed."""
    has = owned.select(*key).distinct().withColumn("__has", F.lit(True))
    return device.join(has, key, "left").withColumn("fate", F.when(F.col("__has"), "merged").otherwise("claimed")).drop("__has")


def activations(requests: DataFrame, license_id: str, device: str, time: str, most: Column) -> DataFrame:
    """First `most` different devices of each license, by time; repeats of a device don't count again."""
    once = requests.groupBy(license_id, device).agg(F.min(time).alias("at"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy(license_id).orderBy("at", device))).withColumn("granted", F.col("n") <= most)
