"""Whitening of embeddings: Spark MLlib's computeSVD on centred distributed rows, singular values rescaled by divisor n.

Entries become whole numbers, floor(scale * c). The fit list holds each distinct vector once; it is written to the shared folder, so a
vector with a third of all rows weighs as one, and is summed to one row in each task before it is shuffled. From it come n, the sums S (exact),
the right singular vectors of the rows minus S / n (RowMatrix: only the dims x dims Gramian reaches the driver), and eigenvalues e = s^2 / n. The
total variance is not read off the singular values, which may be fewer than the dimensions: it is the sum of the exact whole
numbers sum((n * x - S)^2), over n^3. All singular vectors are asked for, so MLlib takes its dense solver, which gives
them to double precision, up to DENSE dimensions; beyond that it iterates to its own tolerance of 1e-10.

Defined results: rows whose vector is null or holds null or non-finite entries are left out of the fit and the result; vectors of
other lengths count as padded with zeros; rows without vec_id are whitened like others, repeated rows each; components of no variance
(e below 1e-12 of the total) are left out, so equal vectors alone give no rows, nor does an empty table; of equal eigenvalues any basis is
right; whole numbers beyond 2^62 count as that, and deviations beyond 64 bits as the largest; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save, ship

SCALE, COMPONENTS = 256, 4
#: Dimensions up to which all singular vectors are asked for.
DENSE = 2048
#: Share of the total variance below which a component has none.
NONE = 1e-12
#: Largest whole number of an entry; sums and squares of such are exact all the same.
LARGEST = 1 << 62
LONGEST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Whitener:
    """n and sums of the fit list (exact), a column of `axes` and an eigenvalue for each component, and the total variance."""

    scale: int
    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    total: float
    identity_error: float = 0.0


def whole(vectors: DataFrame, scale: int = SCALE, *more: str) -> DataFrame:
    """vec_id, `more` columns and x = floor(scale * entry) of the rows that take part."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = lambda c: F.floor(F.greatest(F.least(F.lit(float(scale)) * c.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    return vectors.where(F.col("embedding").isNotNull() & sound).select("vec_id", *more, F.transform("embedding", x).alias("x"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    values = lists.flatten().to_numpy().astype(np.int64)
    if len(values) == len(sizes) * dims and (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row sum((n * x - S)^2), exact."""
    most = max([abs(n) * int(np.abs(x).max()), *map(abs, sums)]) if x.size else 0
    if (2 * most) ** 2 * max(x.shape[1], 1) < LONGEST:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    return ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1).tolist() if x.size else [0] * len(x)


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """Per dimension, a row of each task's sums at most."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x = matrix(batch["x"], dims)
            halves = (x >> 26).sum(0).tolist(), (x & (1 << 26) - 1).sum(0).tolist()  # neither overflows in a batch
            total = [t + (a << 26) + b for t, a, b in zip(total, *halves, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], ["dim", "part"])

    rows = fit.mapInArrow(partial, "dim int, part string").groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["dim"]: int(r["total"]) for r in rows}
    return [found.get(d, 0) for d in range(dims)]


def _moments(fit: DataFrame, model: Whitener) -> tuple[int, np.ndarray, np.ndarray]:
    """Over the fit list: the sum of deviations, and of the whitened rows their means and second moments."""
    k, dims, sent = model.axes.shape[1], len(model.sums), model

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = matrix(batch["x"], dims)
            w = project(x, sent)
            total, first, second = total + sum(deviations(x, sent.n, sent.sums)), first + w.sum(0), second + w.T @ w
        cells, halves = np.concatenate([first, second.ravel()]).tolist(), divmod(total, 10**15)  # the exact sum may pass 38 digits
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(cells)), pa.int32()), pa.array([0.0, *cells]), *[pa.array([str(half)] + ["0"] * len(cells)) for half in halves]], ["cell", "value", "high", "low"],
        )

    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    rows = fit.mapInArrow(partial, "cell int, value double, high string, low string").groupBy("cell").agg(F.sum("value").alias("value"), exact("high"), exact("low")).collect()
    found = {r["cell"]: r for r in rows}
    cells = np.array([found[c]["value"] for c in range(k + k * k)])
    return int(found[-1]["high"]) * 10**15 + int(found[-1]["low"]), cells[:k], cells[k:].reshape(k, k)


def project(x: np.ndarray, model: Whitener) -> np.ndarray:
    """Centred rows on the axes, each over the root of its eigenvalue."""
    return (x - np.array(model.sums, float) / model.n) @ (model.axes / np.sqrt(model.eigenvalues))


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitener | None:
    """Of the distinct vectors; None where no component has variance."""
    ship(vectors.sparkSession)
    dims = whole(vectors, scale).agg(F.max(F.size("x"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0).cast("bigint"), dims - F.size("x"))
    rows = whole(vectors, scale).select(F.when(F.size("x") < dims, F.concat("x", zeros)).otherwise(F.col("x")).alias("x"))
    distinct = save(rows.distinct(), "whitening")
    n = distinct.count()
    if not n or not dims:
        drop(distinct)
        return None
    sums = _sums(distinct, dims)
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = distinct.select(array_to_vector(F.zip_with("x", mean, lambda x, m: x.cast("double") - m)).alias("v"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, dims).computeSVD(dims if dims <= DENSE else min(components, dims - 1))
    eigenvalues, axes = found.s.toArray() ** 2 / n, found.V.toArray()
    some = max(0, min(components, int((eigenvalues > NONE * max(eigenvalues.sum(), 1e-300)).sum())))
    model = Whitener(scale, n, sums, axes[:, :some].copy(), eigenvalues[:some].copy(), 0.0)
    total, first, second = _moments(distinct, model) if some else (0, np.zeros(0), np.zeros((0, 0)))
    drop(distinct)
    if not some:
        return None
    off = np.abs(second / n - np.outer(first, first) / n**2 - np.eye(some)).max()
    return Whitener(scale, n, sums, model.axes, model.eigenvalues, total / n**3, float(off))


def transform(vectors: DataFrame, model: Whitener | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component."""
    ship(vectors.sparkSession)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    sent, share = model, model.eigenvalues / model.total

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = len(sent.eigenvalues), len(sent.sums)
        for batch in batches:
            x = matrix(batch["x"], dims)
            wide = pa.array([min(d, LONGEST) for d in deviations(x, sent.n, sent.sums)], pa.int64())
            every, rows = pa.array(np.repeat(np.arange(len(x)), k)), len(x) * k
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, sent.n)), wide.take(every), pa.array(project(x, sent).ravel()),
                 pa.array(np.tile(share, len(x))), pa.array(np.full(rows, sent.identity_error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return whole(vectors, model.scale).withColumn("vec_id", F.col("vec_id").cast("bigint")).mapInArrow(whiten, schema)
