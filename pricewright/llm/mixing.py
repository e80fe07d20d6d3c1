"""Mix sources to target weights: whole copies of each document plus one hash-seeded Bernoulli copy.

DataFrame operations only. One scan measures the documents into a narrow saved table (doc_id, source, size), which all later steps read; sums per
source are partial before their shuffle. The table of sources has one row each, is ordered in a single task (ten million sources are about
1 GB, which Spark spills), and is broadcast to the documents while it is small; beyond, only sources with over a thousandth of all rows are
broadcast, and the others meet their documents by shuffle. Texts are never shuffled while the table of sources is small.

Defined results: a null or empty text has size 0 and is taken 0 words; texts of any length are counted whole; null source is a source of its own, last in
order; a source without words has target 0; sources of equal cap and weight are filled in code point order; rows that repeat a doc_id are decided
alike, since the coin is seeded by doc_id (null counts as the empty string); an empty table gives an empty result; other columns are ignored
by plan() and kept by emit(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, meet, save

#: Weights of the sources in code point order, repeating; share of all words that the mix takes; most repeats.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def coin(doc_id, seed: int = 0):
    """A number in [0, 1) that depends on the seed and the doc_id alone."""
    text = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target), by filling to a common level.

    In the order of cap / weight, a source stops at its cap while its share of what is left, by weight, reaches the
    cap; the first that stays below sets the level per weight of all that follow.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    by_level = every.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    before = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(by_level), F.lit(0)).alias("cap_before"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_level), F.lit(0))).alias("w_left"),
        (F.sum("source_size").over(every) * share).alias("wanted"),
    )
    level = (F.col("wanted") - F.col("cap_before")) / F.col("w_left")
    free = before.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    lowest = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(every)
    return free.select(
        "source", "source_size",
        F.when(F.col("free"), lowest["level"] * F.col("w")).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def rates(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate (copies of each document, on average) and n (documents) of each source; a saved table."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = targets(totals.select("source", "source_size"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    counted = totals.select(F.col("source").alias("counted"), "n")
    return save(goals.join(counted, F.col("source").eqNullSafe(F.col("counted"))).select("source", "source_size", "target", rate.alias("rate"), "n"), "rates")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of each document; a saved table."""
    return save(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "sizes")


def copies_of(doc_id, rate, seed: int = 0):
    """How often a document is taken."""
    whole = F.floor(rate)
    return (whole + F.when(coin(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("bigint")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source)."""
    sized = measured(docs)
    met = meet(sized, rates(sized, weights, share, most), "source", "n", F.xxhash64("doc_id", "size"))
    planned = met.withColumn("copies", copies_of(F.col("doc_id"), F.col("rate"), seed))
    return planned.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; all columns as they were."""
    sized = measured(docs)
    goals = rates(sized, weights, share, most).select("source", "rate", "n")
    drop(sized)
    # only the operator's own columns meet the rates: the row itself travels in a struct
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source")
    copies = copies_of(F.col("doc_id"), F.col("rate"), seed).cast("int")
    return meet(rows, goals, "source", "n", F.xxhash64("doc_id")).select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * 2 AS cap FROM sized GROUP BY source
), ranked AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM totals
), filled AS (
  SELECT *, coalesce(sum(cap) OVER up, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS w_left,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted
  FROM ranked
  WINDOW up AS (ORDER BY cap::DOUBLE / w::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (wanted - cap_before::DOUBLE) / w_left::DOUBLE AS level FROM filled
), freed AS (
  SELECT *, cap::DOUBLE > level * w::DOUBLE AS free FROM levels
), picked AS (
  SELECT level AS common FROM freed WHERE free ORDER BY cap::DOUBLE / w::DOUBLE, source IS NULL, source LIMIT 1
), goals AS (
  SELECT source, source_size, CASE WHEN free THEN (SELECT common FROM picked) * w::DOUBLE ELSE cap::DOUBLE END AS target FROM freed
), rated AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size::DOUBLE ELSE 0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:0:' || coalesce(s.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656::DOUBLE AS u
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), copied AS (
  SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM copied
"""
