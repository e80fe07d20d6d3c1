"""Typed rows from raw events: what an ingest sink keeps of them. The same projections serve batch and streaming reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stores that telemetry knows, and one that is another's older name.
STORES, OLDER = ("wildberries", "ozon", "yandex_market", "megamarket", "aliexpress", "mvideo", "dns", "citilink", "lamoda"), {"eldorado": "mvideo"}
LEVELS = ("info", "warn", "error")
#: Keys of personal data in payloads, and the payload keys that operations events may have.
PRIVATE = r"(?i)(email|phone|token|password|user_?id|chat_?id|name|title|url|query)"
OPS_KEYS = ("source", "reason", "outcome", "provider", "failure_reason", "stale_count", "duration_bucket", "count")
LONG = 64


def telemetry(raw: DataFrame) -> DataFrame:
    """level, stage, name, marketplace, success, elapsed_ms, error_code, error_message, payload (string), client_ms, received: cut to their lengths, typed, and limited to
    known levels and stores."""
    store = F.lower(F.trim("marketplace"))
    for old, new in OLDER.items():
        store = F.when(store == old, new).otherwise(store)
    return raw.select(
        F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise("info").alias("level"), F.substring("stage", 1, LONG).alias("stage"), F.substring("name", 1, LONG).alias("name"),
        F.when(store.isin(*STORES), store).alias("marketplace"), F.col("success"), F.floor(F.col("elapsed_ms") + 0.5).cast("int").alias("elapsed_ms"), F.substring("error_code", 1, LONG).alias("error_code"),
        F.substring("error_message", 1, 300).alias("error_message"), "payload", F.timestamp_millis(F.col("client_ms").cast("bigint")).alias("client_ts"), F.col("received").alias("created_at"),
    )


#: Longest texts of an event's fields.
CUTS = {"level": 16, "stage": 32, "name": 64, "product_id": 64, "query_hash": 32, "error_message": 300}


def typed(raw: DataFrame) -> DataFrame:
    """Events as they are stored, other columns as they are: texts cut (CUTS), 'system' where no stage is given and 'info' or 'warn' where no level is, times rounded, unknown stores null. Funnel
    and operations events (boolean columns funnel, ops) lose their ids and messages, and operations events their client's time."""
    own = F.coalesce("funnel", F.lit(False)) | F.coalesce("ops", F.lit(False))
    store = F.col("marketplace")
    for old, new in OLDER.items():
        store = F.when(store == old, new).otherwise(store)
    cut = lambda name, x: F.substring(x, 1, CUTS[name]).alias(name)
    told = {
        "level": cut("level", F.coalesce("level", F.when(own, "info").otherwise("warn"))), "stage": cut("stage", F.coalesce("stage", F.lit("system"))), "name": cut("name", F.coalesce("name", F.lit("event"))),
        "marketplace": F.when(store.isin(*STORES), store).alias("marketplace"), **{k: cut(k, F.when(~own, F.col(k))) for k in ("product_id", "query_hash", "error_message")},
        "elapsed_ms": F.floor(F.col("elapsed_ms") + 0.5).alias("elapsed_ms"), "client_ms": F.when(~F.coalesce("ops", F.lit(False)), F.col("client_ms")).alias("client_ms"),
    }
    return raw.select(*[told.get(c, F.col(c)) for c in raw.columns])


def sanitized(payload, keys: tuple[str, ...] = OPS_KEYS):
    """A payload map with the allowed keys that don't look personal, values cut."""
    kept = F.map_filter(payload, lambda k, v: k.isin(*keys) & ~k.rlike(PRIVATE))
    return F.transform_values(kept, lambda k, v: F.substring(v, 1, LONG))


def sampled(rows: DataFrame, rate: float = 0.1, key: str = "event_id") -> DataFrame:
    """All warnings and errors, and of the rest the share `rate` by a hash of the key: reruns agree."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return rows.where(F.col("level").isin("warn", "error") | (number % 10_000 < int(rate * 10_000)))


def searches(raw: DataFrame) -> DataFrame:
    """One row a search: known store, query cut to 200 characters, whether it found anything, whole milliseconds."""
    return raw.select(F.when(F.col("marketplace").isin(*STORES), F.col("marketplace")).alias("marketplace"), F.substring("search_query", 1, 200).alias("search_query"), F.col("success").cast("boolean").alias("success"), F.floor(F.col("response_time_ms")).cast("bigint").alias("response_time_ms"), "created_at")
