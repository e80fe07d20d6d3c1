"""A bounded sample of labelled rows to fit on: never a held-out row, never more than `most` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, save

#: Labelled rows that a classifier is fitted on, at most.
SAMPLE = 8000


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, seed: int = 0) -> DataFrame:
    """doc_id, text, label (0 or 1) of up to `most` documents, picked by a hash of the doc_id.

    Of labels that repeat a doc_id the largest counts, of documents that do the smallest text; null ids and labels are left out. The picked
    labels are bounded, so the documents meet them in a broadcast join and are not shuffled. The result is a table in the shared folder.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    picked = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return save(rows, f"sample-{label}")
