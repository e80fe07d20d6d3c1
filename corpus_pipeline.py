"""A training-data pipeline: toxic documents go, one of each group of near copies stays, documents with benchmark text go, sources
are mixed to their weights, and what is left is written as token-id files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of docs. Between stages
the rows are written as Parquet and read again, so no stage is computed twice and a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewright.llm import decontam, mixing, near_dup, token_file, toxicity
from pricewright.llm.common import drop, save, table

#: Similarity in percent from which the near_dup stage links copies (op3's SQL has 85).
NEAR = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut of the toxicity lexicon, learned from labelled rows that aren't held out."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked from a similarity of NEAR percent: that of the smallest doc_id."""
    return near_dup.clean(docs, NEAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.emit(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the documents, read back: doc_id, start, n_tokens, ids_crc32 of each copy."""
    return token_file.round_trip(docs)


STAGES = [("toxicity", without_toxic), ("near_dup", without_near_copies), ("decontam", without_benchmark), ("mixing", mixed), ("token_ids", token_ids)]

#: Learned lexicons and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    if before is not None:
        drop(before)
    return out
