"""The queries opN_<name> of the operators in this subpackage, over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language, mixing, near_dup, quality, substrings, token_count, token_file, topk, toxicity, vector_codes, warc, whitening
from .common import shared_path, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a ranking fitted on labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, read the archives back."""
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    # the archives are this query's own: a gap in them is an error, not a row to leave out
    sound = F.when(F.col("kind") == "record", True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("damaged archive:"), "file", "reason")).cast("boolean"))
    records = warc.read(spark, path, with_payload=False).where(sound)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document."""
    return near_dup.groups(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of highest integer inner product for each vec_id divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % topk.EVERY == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a lexicon learned from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.plan(table(spark, sf_dir, "documents"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document lie in benchmark windows."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's token ids, read the files back."""
    return token_file.round_trip(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document repeats of earlier ones, in strings of 50 bytes."""
    return substrings.report(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first components of the distinct ones, at unit variance."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.transform(vectors, whitening.fit(vectors))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by models of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs.where(~language.held_out(F.col("doc_id")))))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of every vector after two rounds."""
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_warc, op3_near_dup, op4_topk, op5_toxicity, op6_mixing, op7_token_count, op8_decontam, op9_token_file, op10_substrings, op11_whitening, op12_language, op13_vector_codes)}

ORACLE_SQL: dict[str, str] = {"op2_warc": warc.ORACLE_SQL, "op3_near_dup": near_dup.ORACLE_SQL, "op4_topk": topk.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL, "op8_decontam": decontam.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
