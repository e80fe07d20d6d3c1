"""Folders that all executors share, and tables kept there while results may read them."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Folders to delete when the driver's Python ends.
_LEFT: dict[str, SparkSession] = {}


@atexit.register
def _delete_left() -> None:
    for path, spark in _LEFT.items():
        try:
            jvm, context = spark._jvm, spark.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM or the folder is gone already
            return


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session: what their Python calls by name must be importable there."""
    sc = spark.sparkContext
    if getattr(sc, "_pricewright_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    zipped = os.path.join(tempfile.mkdtemp(prefix="pricewright-"), "pricewright_package.zip")
    with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in (n for n in sorted(names) if n.endswith(".py")):
                z.write(os.path.join(folder, name), os.path.join("pricewright", os.path.relpath(os.path.join(folder, name), root)))
    sc.addPyFile(zipped)
    sc._pricewright_shipped = True


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pricewright-streams-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/pricewright-{tag}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once and read back: costly columns are computed once, and lost executors cost no rework."""
    path, schema = shared_folder(df.sparkSession, tag), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
