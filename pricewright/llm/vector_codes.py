"""Product codes of vectors by delta-maintained Lloyd rounds.

Vectors of whole numbers, floor(scale * c), are cut into equal parts; each part position has a codebook of up to ENTRIES entries. Every round
writes each row with the code it had and the code it gets to the shared folder. The driver keeps, for each part and entry, a count and integer
sums over the parts assigned to it; from one round to the next only the parts whose entry changed send their numbers, plus to the
new entry and minus from the old, summed in each task before the shuffle (at most parts x ENTRIES rows a task). In the first
round all are new. Integer sums make the result the same as summing anew, in any order of tasks.

Defined results: rows whose vector is null or holds null or non-finite entries are left out; vectors of other lengths, and lengths that the parts don't divide, count as
padded with zeros; the codebook starts with the smallest vec_ids (nulls last), of repeated ids with the smaller vectors first, and has fewer
entries where there are fewer rows; repeated rows are coded each; ties go to the lower index; unused entries stay; whole numbers beyond 2^62 count as that,
errors beyond 64 bits as the largest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, meet, save, ship
from .whitening import LONGEST, matrix, whole

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows whose distances are worked on at once.
BLOCK = 4096


@dataclass
class Codebooks:
    """entries, sums (parts x entries x width) and counts (parts x entries); whole numbers of any size."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def start(cls, first: np.ndarray, parts: int) -> Codebooks:
        entries = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
        return cls(entries, np.zeros(entries.shape, object), np.zeros(entries.shape[:2], object))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows, the nearest entry of each part and its squared distance."""
        parts, entries, width = self.entries.shape
        most = max(int(np.abs(x).max()) if x.size else 0, int(np.abs(self.entries).max()) if self.entries.size else 0)
        kind = np.int64 if (2 * most) ** 2 * parts * max(width, 1) < LONGEST else object
        cut, books = x.reshape(len(x), parts, width).astype(kind), self.entries.astype(kind)
        codes, error = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), kind)
        for at in range(0, len(x), BLOCK):
            for p in range(parts):
                # |x|^2 is the same for all entries: it comes in when the nearest is known
                own, book = cut[at : at + BLOCK, p], books[p]
                far = (book * book).sum(1)[None, :] - 2 * (own @ book.T)
                best = far.argmin(1)
                codes[at : at + BLOCK, p] = best
                error[at : at + BLOCK, p] = far[np.arange(len(own)), best] + (own * own).sum(1)
        return codes, error

    def move(self, changes: list) -> None:
        """Add contributions (part, entry, count, sums), then put each used entry at the floor of its mean."""
        for part, entry, count, sums in changes:
            self.counts[part, entry] += count
            self.sums[part, entry] += np.array(sums, object)
        used = np.argwhere(self.counts > 0)
        for part, entry in used.tolist():
            self.entries[part, entry] = [s // self.counts[part, entry] for s in self.sums[part, entry]]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _assigned(rows: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    """vec_id, label, x, the code that a row had (or null), the new one, and its error."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = books.assign(matrix(batch["x"], dims))
            new = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            total = pa.array([min(e, LONGEST) for e in error.sum(1).tolist()] if error.dtype == object else error.sum(1), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["x"], batch["code"], new, total], ["vec_id", "label", "x", "was", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id bigint, label {label}, x array<bigint>, was binary, code binary, error bigint")


def _changes(assigned: DataFrame, books: Codebooks, dims: int) -> list[tuple[int, int, int, list[int]]]:
    """Plus and minus contributions of the parts whose entry changed, summed by part and entry."""
    parts, entries, width = books.entries.shape

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), object)
        for batch in batches:
            x = matrix(batch["x"], dims).reshape(-1, parts, width)
            new = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts)
            had = batch["was"].to_pylist()
            known = np.array([h is not None for h in had], bool)
            old = np.frombuffer(b"".join(h or bytes(parts) for h in had), np.uint8).reshape(-1, parts)
            for codes, sign, moved in ((new, 1, (new != old) | ~known[:, None]), (old, -1, (new != old) & known[:, None])):
                row, part = np.nonzero(moved)
                cell = part * entries + codes[row, part]
                counts += sign * np.bincount(cell, minlength=len(counts))
                for shift in (26, 0):  # halves: neither overflows in a batch
                    half = x[row, part] >> 26 if shift else x[row, part] & (1 << 26) - 1
                    add = np.zeros((len(counts), width), np.int64)
                    np.add.at(add, cell, half)
                    sums += sign * (add.astype(object) << shift)
        some = np.flatnonzero((counts != 0) | (sums != 0).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some // entries, pa.int32()), pa.array(some % entries, pa.int32()), pa.array(counts[some]), pa.array([[str(v) for v in sums[c]] for c in some.tolist()], pa.list_(pa.string()))], ["part", "entry", "count", "sums"])

    moved = assigned.where(F.col("was").isNull() | (F.col("was") != F.col("code"))).select("x", "was", "code").mapInArrow(contributions, "part int, entry int, count bigint, sums array<string>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return [(r["part"], r["entry"], r["count"], [int(r[f"s{i}"]) for i in range(width)]) for r in moved.groupBy("part", "entry").agg(F.sum("count").alias("count"), *total).collect()]


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Codebooks, DataFrame] | None:
    """The codebooks after the rounds, and a saved table of rows (vec_id, label, code, error, ...) that they code; None without rows. vectors: vec_id, embedding, label."""
    if not 1 <= entries <= 256:
        raise ValueError("a part's code is one byte: 1 to 256 entries")
    ship(vectors.sparkSession)
    rows = whole(vectors, scale, "label").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None
    dims = max(-(-longest // parts), 1) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()
    books = Codebooks.start(matrix(first["x"], dims), parts)
    at = rows.withColumn("code", F.lit(None).cast("binary"))
    for turn in range(rounds + 1):
        done = save(_assigned(at, books, dims), f"codes-{turn}")
        if turn:
            drop(at)
        at = done
        if turn < rounds:
            books.move(_changes(done, books, dims))
    return books, at


def encode(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    found = train(vectors, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books, rows = found
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = save(rows.groupBy("label").agg(F.least(exact, F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error"), F.count(F.lit(1)).alias("rows")), "label-errors")
    coded = rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label")
    out = meet(coded, by_label, "label", "rows", F.xxhash64("vec_id"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds as SQL: points by part, nearest entry by window, means by floor division."""
    ctes = [
        f"""rows AS (SELECT row_number() OVER () AS r, vec_id, label, [floor({SCALE} * c::DOUBLE)::BIGINT for c in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0)""",
        f"points AS (SELECT r, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS v FROM rows, range({PARTS}) t(p))",
        f"firsts AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e, r FROM rows QUALIFY e < {ENTRIES})",
        "book0 AS (SELECT p, e, v FROM firsts JOIN points USING (r))",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(f"""near{k} AS (SELECT r, q.p, e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(q.v, b.v)])::BIGINT AS d, q.v FROM points q JOIN book{k} b ON q.p = b.p
  QUALIFY row_number() OVER (PARTITION BY r, q.p ORDER BY d, e) = 1)""")
        if k < ROUNDS:
            ctes.append(f"""sums{k} AS (SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS c FROM near{k}, unnest(range(1, len(v) + 1)) t(i) GROUP BY p, e, i)""")
            ctes.append(f"moved{k} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS v FROM sums{k} GROUP BY p, e)")
            ctes.append(f"book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN moved{k} m ON m.p = b.p AND m.e = b.e)")
    ctes.append(f"sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})")
    ctes.append(f"coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r)")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN rows USING (r), sha"


ORACLE_SQL = _sql()
