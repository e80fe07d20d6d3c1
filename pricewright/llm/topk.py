"""Exact top-k by inner product: query rows scatter weighted postings into dense score arrays.

Vectors are scaled to integers. Rows are dealt into candidate slices and query groups of bounded size; each (group, slice)
pair is one cogrouped task call that holds only its own rows. There, a candidate chunk's nonzero components form one
posting list a dimension, and for each dimension of a block of queries the weighted postings are added to the block's
dense score array (chunk x block). Each chunk's best are selected by partition and merged, and a window over the few
rows that are left of each query ranks them.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without vec_id;
vectors of other lengths count as padded with zeros; ties go to the smaller vec_id; a query's own row is every row of its
vec_id; queries that repeat a vec_id are answered once, over all their scores; scores beyond 64 bits saturate; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

K, EVERY, SCALE = 20, 20, 64
#: Rows of a candidate slice, a query group, a candidate chunk, a query block.
SLICE, GROUP, CHUNK, QUERIES = 8192, 4096, 1024, 256
LONGEST = np.iinfo(np.int64).max


def _matrix(rows: pa.Table, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) as rows of an integer matrix: int64, or Python integers where those could overflow."""
    lists = rows["embedding"].combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    values = np.floor(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64) * scale)
    wide = len(values) and np.abs(values).max() >= 2.0**31
    out = np.zeros((len(sizes), dims), object if wide else np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = [int(v) for v in values] if wide else values.astype(np.int64)
    return out


def _longest(rows: pa.Table) -> int:
    sizes = rows["embedding"].combine_chunks().value_lengths().to_numpy()
    return int(sizes.max()) if len(sizes) else 0


def scores(postings: list, n: int, queries: np.ndarray, kind) -> np.ndarray:
    """Dense scores (candidates x queries), a term at a time. postings: of each term, (rows or None for all, values)."""
    out = np.zeros((n, len(queries)), kind)
    for term, (rows, values) in enumerate(postings):
        weights = queries[:, term]
        if not len(values) or not weights.any():
            continue
        if rows is None:
            out += values[:, None] * weights[None, :]
        else:
            out[rows] += values[:, None] * weights[None, :]
    return out


def _postings(chunk: np.ndarray) -> list:
    lists = []
    for term in range(chunk.shape[1]):
        column = chunk[:, term]
        rows = np.flatnonzero(column)
        # a list that most rows are in is added as a whole column: zeros change nothing
        lists.append((None, column.copy()) if 2 * len(rows) > len(column) else (rows, column[rows]))
    return lists


def search(queries: pa.Table, candidates: pa.Table, k: int, scale: int) -> tuple[list, list, list]:
    """query_id, vec_id, score of the best k candidates of each query, ties to the smaller vec_id."""
    candidates = candidates.sort_by("vec_id")
    dims = max(_longest(queries), _longest(candidates))
    q, c = _matrix(queries, scale, dims), _matrix(candidates, scale, dims)
    query_ids, ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    most = (int(np.abs(q).max()) if q.size else 0) * (int(np.abs(c).max()) if c.size else 0) * max(dims, 1)
    kind = np.int32 if most < 2**30 else np.int64 if most < 2**50 else object
    q, c = q.astype(kind), c.astype(kind)
    best: list[list] = [[] for _ in query_ids]
    for at in range(0, len(ids), CHUNK):
        chunk_ids = ids[at : at + CHUNK]
        n = len(chunk_ids)
        postings = _postings(c[at : at + CHUNK])
        for first in range(0, len(query_ids), QUERIES):
            block = query_ids[first : first + QUERIES]
            dense = scores(postings, n, q[first : first + QUERIES], kind)
            own = np.searchsorted(chunk_ids, block), np.searchsorted(chunk_ids, block, "right")
            if kind is object:
                for j in range(len(block)):
                    rows = [i for i in range(n) if not own[0][j] <= i < own[1][j]]
                    best[first + j] += [(-dense[i, j], int(chunk_ids[i])) for i in sorted(rows, key=lambda i: (-dense[i, j], i))[:k]]
                continue
            # one number orders a candidate: its score, then its place among ascending ids
            key = np.ascontiguousarray(dense.T).astype(np.int64) * CHUNK + np.arange(CHUNK - 1, CHUNK - 1 - n, -1)
            for j in np.flatnonzero(own[0] < own[1]).tolist():
                key[j, own[0][j] : own[1][j]] = -LONGEST
            kept = np.partition(key, n - k, axis=1)[:, n - k :] if n > k else key
            for j, row in enumerate(kept):
                row = row[row > -LONGEST]
                best[first + j] += zip((-(row // CHUNK)).tolist(), chunk_ids[CHUNK - 1 - row % CHUNK].tolist(), strict=True)
        if at // CHUNK % 16 == 15:
            best = [sorted(b)[:k] for b in best]
    out = [(int(qid), v, min(max(-s, -LONGEST - 1), LONGEST)) for qid, b in zip(query_ids, best, strict=True) for s, v in sorted(b)[:k]]
    return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score; is_query: the condition of the rows of vectors (vec_id, embedding) to answer."""
    ship(vectors.sparkSession)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    n, nq = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    slices, groups = max(1, -(-n // SLICE)), max(1, -(-nq // GROUP))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    candidates = rows.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).alias("slice"), every(groups).alias("grp"))
    queries = rows.where(is_query).select("vec_id", "embedding", every(slices).alias("slice"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("grp"))

    def answer(asked: pa.Table, given: pa.Table) -> pa.Table:
        found = search(asked, given, k, scale) if asked.num_rows and given.num_rows else ([], [], [])
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    found = queries.groupBy("grp", "slice").cogroup(candidates.groupBy("grp", "slice")).applyInArrow(answer, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH rows AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.v, c.v, true)])::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
