"""What the operators share: shared tables, Arrow text buffers, shipping of the package to executors."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once, unless a single text is longer.
SLICE_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that their Python can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_pricewright_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    zipped = os.path.join(tempfile.mkdtemp(prefix="pricewright-"), "pricewright_package.zip")
    with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("pricewright", os.path.relpath(full, root)))
    sc.addPyFile(zipped)
    sc._pricewright_shipped = True


#: Paths that results may still read; deleted when the driver's Python ends.
_LEFT: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark._jvm, spark.sparkContext._jsc
    conf = context.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@atexit.register
def _delete_left() -> None:
    for path, spark in _LEFT.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM or the folder is gone already
            return


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local one only if it is unset in local mode. What is still there is
    deleted when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pricewright-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/pricewright-{tag}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def save(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors cost no rework."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pricewright_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of save() that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df._pricewright_path)
        _LEFT.pop(df._pricewright_path, None)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


#: Rows of a small table that every executor may hold: 100 000 of about 100 bytes.
SMALL = 100_000


def meet(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: Column, alone: Column | None = None) -> DataFrame:
    """rows, each with the columns of the row of a saved table that has its key (null matches null), or nulls: a left join.

    A table of at most SMALL rows is broadcast. Of a larger one, those rows are broadcast whose weight (about the rows that they meet) is
    over a thousandth of all weights: at most 1000 rows; the others meet theirs by shuffle, where no key is hot. Rows that have met
    a hot key, and those that are known to be `alone`, are spread over all tasks by `spread`.
    """
    fields = [c for c in table.columns if c not in (key, weight)]

    def side(name: str, some: DataFrame) -> DataFrame:
        return F.broadcast(some.select(F.col(key).alias(f"{name}_key"), *[F.col(f).alias(f"{name}_{f}") for f in fields], F.lit(True).alias(f"{name}_met")))

    n, total = table.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if n <= SMALL:
        return rows.join(side("few", table), F.col(key).eqNullSafe(F.col("few_key")), "left").select(*rows.columns, *[F.col(f"few_{f}").alias(f) for f in fields])
    hot = F.col(weight) > total / 1000
    done = F.col("hot_met").isNotNull() if alone is None else F.col("hot_met").isNotNull() | alone
    warm = rows.join(side("hot", table.where(hot)), F.col(key).eqNullSafe(F.col("hot_key")), "left").withColumn("turn", F.when(done, spread.bitwiseOR(F.lit(1))).otherwise(0))
    cold = table.where(~hot).select(F.col(key).alias("cold_key"), *[F.col(f).alias(f"cold_{f}") for f in fields], F.lit(0).cast("bigint").alias("cold_turn"))
    both = warm.join(cold, F.col(key).eqNullSafe(F.col("cold_key")) & (F.col("turn") == F.col("cold_turn")), "left")
    return both.select(*rows.columns, *[F.coalesce(f"hot_{f}", f"cold_{f}").alias(f) for f in fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels must not be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def flat_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    binary = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = binary.buffers()
    offs = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - (offs[0] if len(offs) else 0)


def slices(sizes: np.ndarray, most: int = SLICE_BYTES):
    """(from, to) row ranges whose sizes add up to at most `most`, or one row."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)
