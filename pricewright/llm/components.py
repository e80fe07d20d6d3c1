"""Connected components of links between ids, by alternating large and small stars; fewer than FOLD edges are folded in one bounded task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save

#: Edges that a task folds at once before the shuffles.
FOLD = 200_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a bounded run of edges by a star for each of its components: fewer edges, shorter paths."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        at = x
        while parent[at] != at:
            at = parent[at]
        while parent[x] != at:
            parent[x], x = at, parent[x]
        return at

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    n = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            parent[max(a, b)] = min(a, b)
        n += batch.num_rows
        if n >= FOLD:
            yield stars()
            parent, n = {}, 0
    if parent:
        yield stars()


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m the smaller of u and its smallest v. Sums before the shuffle; a hot u is split by the skew join."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(low, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (two columns of bigint): the smallest id that it reaches. A saved table."""
    now = save(edges.toDF("u", "v").where("u <> v").mapInArrow(_forests, "u bigint, v bigint"), "stars")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.max("u")).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
        if mark[0] < FOLD:
            following = save(now.coalesce(1).mapInArrow(_forests, "u bigint, v bigint"), "stars")
            drop(now)
            now = following
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = _lowest(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = save(small, "stars")
        drop(now)
        now = following
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    out = save(now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots), "components")
    drop(now)
    return out
