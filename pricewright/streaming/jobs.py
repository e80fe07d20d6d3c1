"""Streams over event files: windowed metrics, deduplication, cooldown state. Each starts from a streaming DataFrame; run() drives one to the end of
what is there (Trigger.AvailableNow) and returns what it wrote."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import shared_folder, ship

HOUR = 3_600_000
#: Rows of a micro-batch of slices().
SLICE_ROWS = 1_000_000
#: Keys that limited()'s users are dealt to.
SHARDS = 256
#: Keyed state with timers is kept in RocksDB.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream, with event time as a timestamp; late data are waited for a day (a policy of this engine)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")


def slices(spark: SparkSession, sf_dir: str, rows: int = SLICE_ROWS) -> DataFrame:
    """The events as a stream of micro-batches in the order of time, each of about `rows` rows: the file is first cut into ranges of time, one file each, of which a micro-batch
    takes one. So a key's rows of a micro-batch, which keyed state takes in order, are bounded, however many the key has."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = max(1, -(-table.count() // rows))
    folder = shared_folder(spark, "slices")
    table.withColumn("at", F.col("ts").cast("timestamp")).repartitionByRange(n, "ts", "event_id").write.parquet(folder)
    _age(spark, folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("at", "1 day")


def _age(spark: SparkSession, folder: str) -> None:
    """A file stream takes older files first: date the files of a range-partitioned table by their numbers. A driver's work on names alone."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath().getName(), f.getPath()) for f in files.listStatus(where) if f.getPath().getName().startswith("part-"))
    for n, (_, path) in enumerate(parts):
        files.setTimes(path, 1_000_000_000_000 + n * 1000, -1)


def daily(stream: DataFrame) -> DataFrame:
    """Events and failures by type and tumbling day."""
    return stream.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", "value")


def sliding_success(stream: DataFrame, slide: str = "6 hours") -> DataFrame:
    """Requests and successes of each user's group in sliding windows of 24 hours."""
    grouped = stream.groupBy(F.window("at", "24 hours", slide).alias("w"), (F.col("user_id") % 5).alias("shard"))
    return grouped.agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("event_type") != "error", 1)).alias("successes")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "shard", "requests", "successes")


def with_alert(rows: DataFrame, least: int = 5, below: float = 85.0) -> DataFrame:
    """Success rate in percent with one decimal, and whether it calls for an alert: enough requests, and a rate below the limit."""
    rate = F.floor(F.col("successes") * 1000.0 / F.col("requests") + 0.5) / 10.0
    return rows.withColumn("rate", rate).withColumn("alert", (F.col("requests") >= least) & (F.col("rate") < below))


def without_duplicates(stream: DataFrame, key: list[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(key)


def _in_order(rows: Iterator[Row], *by: str) -> list[Row]:
    """A key's rows of one micro-batch by time; slices() bounds them."""
    return sorted(rows, key=lambda r: tuple(r[k] for k in by))


class Cooldown(StatefulProcessor):
    """Alerts (user_id, ms, value) that pass a rest; the last one sent is a user's state, which a timer drops when the rest is over."""

    def __init__(self, rest_ms: int, deeper: float):
        self.rest, self.deeper = rest_ms, deeper

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at bigint, value double")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get() if self.last.exists() else None
        sent = None
        for row in _in_order(rows, "ms", "value"):
            if last is None or row["ms"] - last[0] >= self.rest or row["value"] < last[1] * self.deeper:
                last = sent = (row["ms"], row["value"])
                yield Row(user_id=key[0], ms=row["ms"], value=row["value"])
        if sent:
            self.last.update(sent)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(sent[0] + self.rest, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class RateLimit(StatefulProcessor):
    """Requests and whether each is within its user's limit. A key is a shard of many users, for each key costs calls to the state's store; the times of those let through in each user's trailing
    window, at most `most`, are its state, packed in one value. Users whose newest has left the window by the watermark are dropped from it."""

    def __init__(self, window_ms: int, most: int):
        self.window, self.most = window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("passed", "users binary, times binary, nobody array<bigint>")

    def _passed(self, watermark: int) -> dict[int | None, list[int]]:
        passed: dict[int | None, list[int]] = {}
        stored = self.state.get() if self.state.exists() else None
        if stored:
            for user, at in zip(np.frombuffer(stored[0], "<i8").tolist(), np.frombuffer(stored[1], "<i8").tolist(), strict=True):
                passed.setdefault(user, []).append(at)
            if stored[2]:
                passed[None] = list(stored[2])
        return {user: times for user, times in passed.items() if max(times) + self.window > watermark}

    def handleInputRows(self, key, rows, timerValues):
        passed = self._passed(timerValues.getCurrentWatermarkInMs())
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["nobody", "user", "ms", "event_id"], ignore_index=True)
        allowed = []
        for user, nobody, ms in zip(batch["user"].tolist(), batch["nobody"].tolist(), batch["ms"].tolist(), strict=True):
            user = None if nobody else user
            times = [t for t in passed.get(user, ()) if ms - t < self.window]
            allowed.append(len(times) < self.most)
            if allowed[-1]:
                times.append(ms)
            passed[user] = times
        nobody = passed.pop(None, [])
        pairs = np.array([(user, t) for user, times in passed.items() for t in times], "<i8").reshape(-1, 2)
        self.state.update((pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), nobody))
        yield pd.DataFrame({"event_id": batch["event_id"], "user_id": batch["user"].astype("Int64").mask(batch["nobody"]), "ms": batch["ms"], "allowed": allowed})

    def close(self) -> None:
        pass


class Failures(StatefulProcessor):
    """Each user's failures in a row after the last event so far, and how many times longer they rest for them; the count is the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "failures int")

    def handleInputRows(self, key, rows, timerValues):
        count = self.count.get()[0] if self.count.exists() else 0
        for row in _in_order(rows, "ms", "event_id"):
            count = count + 1 if row["failed"] else 0
        self.count.update((count,))
        yield Row(user_id=key[0], failures=count, rest=1 if count <= 1 else 4 if count <= 3 else 12)

    def close(self) -> None:
        pass


def cooled(stream: DataFrame, rest_ms: int, deeper: float = 0.98) -> DataFrame:
    """Alerts (user_id, at, value) that pass a cooldown."""
    ship(stream.sparkSession)
    rows = stream.select("user_id", "at", F.unix_millis("at").alias("ms"), "value")
    return rows.groupBy("user_id").transformWithState(Cooldown(rest_ms, deeper), "user_id bigint, ms bigint, value double", "Append", "EventTime")


def limited(stream: DataFrame, window_ms: int, most: int) -> DataFrame:
    """Requests (event_id, user_id, ms) and whether each is within its user's limit."""
    ship(stream.sparkSession)
    shard = F.pmod(F.xxhash64("user_id"), F.lit(SHARDS)).alias("shard")
    rows = stream.select(shard, "event_id", F.coalesce("user_id", F.lit(0).cast("bigint")).alias("user"), F.col("user_id").isNull().alias("nobody"), "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("shard").transformWithStateInPandas(RateLimit(window_ms, most), "event_id bigint, user_id bigint, ms bigint, allowed boolean", "Append", "EventTime")


def failures(stream: DataFrame) -> DataFrame:
    """user_id, failures, rest after each micro-batch that has events of the user."""
    ship(stream.sparkSession)
    rows = stream.select("user_id", "event_id", F.unix_millis("at").alias("ms"), (F.col("event_type") == "error").alias("failed"))
    return rows.groupBy("user_id").transformWithState(Failures(), "user_id bigint, failures int, rest int", "Update", "None")


def two_clocks(stream: DataFrame) -> DataFrame:
    """Events by day of the client's clock where it is given, else of the server's; rows are appended as they come."""
    client = F.when(F.col("event_id") % 3 != 0, F.col("at") - F.expr("INTERVAL '2' HOUR"))
    return stream.select("event_id", F.date_format(F.coalesce(client, F.col("at")), "yyyy-MM-dd").alias("day"))


def run(result: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Drive a stream to its end; 'complete' replaces what was written at each batch, 'append' and 'update' add to it. Of an update's rows the last of each key counts,
    so that the stream may drop its state by the watermark."""
    spark = result.sparkSession
    folder = shared_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    if mode == "complete":
        return spark.read.schema(result.schema).parquet(f"{folder}/out")
    if mode == "append":
        return spark.read.schema(result.schema).parquet(f"{folder}/out/*")
    rows = spark.read.schema(StructType([*result.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/out")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*result.columns), "batch").alias("r")).select("r.*")
