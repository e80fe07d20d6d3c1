"""Remove text that repeats an earlier document: exact 50-byte repeats found by suffix sorting, over any number of tasks.

One suffix array over the whole corpus would be one task. Instead, every 50-byte string is led to a bucket that all its
occurrences share, and buckets are suffix-sorted by themselves:

1. Documents are packed into batches of bounded size: a table bucketed by batch, so that later steps meet a batch's text
   without moving it again.
2. Each batch finds the anchor of every 50-byte window: its GRAM-byte string of smallest hash. Equal windows have equal
   anchors. A batch asks an anchor's bucket whether any other document has it, with one entry a batch and different anchor,
   however many documents hold it; the answers are bits.
3. Consecutive windows of one repeated anchor are a segment. Equal segments of a batch are one entry, with their smallest
   doc_id, and go to their anchor's bucket. (An anchor that more than HOT batches hold is split further: each of its
   windows goes to the bucket of its own hash.)
4. A bucket merges equal segments, sorts the suffixes of those that share an anchor in two stages (see suffix_sort), and
   computes adjacent common prefixes. Runs of prefixes of 50 bytes or more are equal windows; the smallest doc_id of a run is
   the window's first document. A segment without a partner has its own smallest doc_id throughout.
5. Each batch cuts its segments again, gets the first documents of their windows, and removes the bytes covered by windows
   whose first document is smaller than their own.

Hashes only lead to buckets; what is removed rests on compared bytes (equal segments of a bucket are told by 128 bits of hash).

Defined results: null and empty texts and those under 50 bytes lose nothing; a null doc_id counts as larger than all
others; rows that repeat a doc_id never remove each other's text; an empty table gives no rows; other columns are ignored. A
task needs about 100 bytes of memory for a byte of the longest text.

Buckets grow in number with the corpus (up to 2 ** 24, at BUCKET_BYTES of text each 64 TB). A batch sends each bucket a row, so beyond a few hundred GB
those rows carry few anchors each, and their shuffle costs more than the text does: there larger batches and buckets (BATCH_BYTES and bucket_bytes, as memory
allows) are the cheaper choice.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, flat_text, save, shared_path, ship, slices
from .shingles import _BYTE, mix, powers
from .suffix_sort import common_prefixes, suffix_array

#: Bytes of a repeat; of an anchor. Batches that make an anchor hot. Bytes of segments sorted at once. Bytes of text for each bucket.
SPAN, GRAM, HOT, SORT_BYTES, BUCKET_BYTES = 50, 20, 2048, 1 << 19, 4 << 20
WINDOWS = SPAN - GRAM + 1
#: Bytes of text in a batch, or one text.
BATCH_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
ROWS = "kind int, batch bigint, bucket bigint, data binary"
_ROWS = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
TEXT, ASK, STATE, ANSWER = range(4)
#: Bytes by which a bucket knows an anchor (anchors that they don't tell apart may be taken for repeated, which costs work, not results); most buckets.
LOW, MOST_BUCKETS = 5, 1 << 24


def put(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        parts += [struct.pack("<4sQ", a.dtype.str.encode(), a.nbytes), np.ascontiguousarray(a).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def get(data: bytes) -> list[np.ndarray]:
    plain, at, out = zstandard.ZstdDecompressor().decompress(data), 4, []
    for _ in range(struct.unpack_from("<I", plain)[0]):
        kind, size = struct.unpack_from("<4sQ", plain, at)
        kind = np.dtype(kind.rstrip(b"\0").decode())
        out.append(np.frombuffer(plain, kind, size // kind.itemsize, at + 12))
        at += 12 + size
    return out


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)] if rows else [pa.array([], f.type) for f in _ROWS], schema=_ROWS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        raw, offs = flat_text(batch.column("text"))
        ids = batch.column("doc_id")
        keys, nulls = ids.fill_null(LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        for lo, hi in slices(np.diff(offs), BATCH_BYTES):
            data = put(keys[lo:hi], nulls[lo:hi].view(np.uint8), offs[lo : hi + 1] - offs[lo], raw[offs[lo] : offs[hi]])
            yield _table([(TEXT, part << 32 | number, 0, data)]).to_batches()[0]
            number += 1


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each `width` neighbours, in steps that double."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw))[0][: len(raw)], out=sums[1:])
    return sums


def anchors(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor, start and end of each segment: a run of windows of one text with their anchor in one place.

    Of equal smallest hashes in a window the first is its anchor.
    """
    n = len(raw)
    if n < SPAN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = _sums(raw)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n)[1][: n - GRAM + 1])
    place = np.uint64(0xFFFFFFFF)
    low = _sliding((grams & ~place) | np.arange(len(grams), dtype=np.uint64), WINDOWS, np.minimum) & place
    sizes = np.diff(offs)
    room = np.repeat(offs[1:], sizes)[: len(low)] - np.arange(len(low))  # bytes from here to the end of the text
    start = np.flatnonzero(room >= SPAN)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = low[start].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return grams[at[first]], start[first], start[last] + SPAN


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, from its upper 24 bits; LOW bytes are those below."""
    return ((hashes >> np.uint64(8 * LOW)) % np.uint64(buckets)).astype(np.int64)


def _different(raw: np.ndarray, offs: np.ndarray, keys: np.ndarray, buckets: int):
    """The batch's segments (start, end, owner), its different anchors by bucket, where each segment's is, and whether two owners hold it."""
    hashes, begin, end = anchors(raw, offs)
    owner = keys[np.searchsorted(offs, begin, "right") - 1]
    different, inverse = np.unique(hashes, return_inverse=True)
    bucket = _bucket(different, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    inverse = place[inverse]
    least, most = np.full(len(order), LAST), np.full(len(order), -LAST - 1)
    np.minimum.at(least, inverse, owner)
    np.maximum.at(most, inverse, owner)
    return begin, end, owner, different[order], bucket[order], inverse, least < most


def _split(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of runs."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), a, b


def _ask(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("batch").to_pylist(), batch.column("data").to_pylist(), strict=True):
                keys, _, offs, raw = get(data)
                _, _, _, hashes, bucket, _, several = _different(raw, offs, keys, buckets)
                low = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW]
                rows = [(ASK, number, b, put(low[i:j].reshape(-1), several[i:j].view(np.uint8))) for b, i, j in _split(bucket)]
                if rows:
                    yield _table(rows).to_batches()[0]

    return ask


def _answer(hot: int):
    def answer(asked: pa.Table) -> pa.Table:
        """For each batch's anchors of a bucket: 0 in one document only, 1 repeated, 2 hot."""
        parts = [get(d) for d in asked["data"].to_pylist()]
        sizes = [len(p[1]) for p in parts]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :LOW] = np.concatenate([p[0] for p in parts]).reshape(-1, LOW)
        _, inverse, batches = np.unique(wide.view("<u8").reshape(-1), return_inverse=True, return_counts=True)
        several = np.zeros(len(batches), bool)
        several[inverse[np.concatenate([p[1] for p in parts]).astype(bool)]] = True
        state = (several | (batches > 1)).astype(np.uint8) + (batches > hot)
        ends = np.cumsum(sizes)
        return _table([(STATE, n, b, put(s)) for n, b, s in zip(asked["batch"].to_pylist(), asked["bucket"].to_pylist(), np.split(state[inverse], ends[:-1]), strict=True)])

    return answer


def _segment_rows(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray, owner: np.ndarray, buckets: int):
    """Merge equal segments of equal groups: the asks by bucket, and for each segment where its ask is."""
    sums, down = _sums(raw), powers(len(raw))[1]
    body = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    bucket = _bucket(group, buckets)
    order = np.lexsort((owner, body, group, bucket))
    new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (body[order][1:] != body[order][:-1])]) if len(order) else np.zeros(0, bool)
    first = order[new]  # of equal ones, that of the smallest doc_id
    ask = np.empty(len(order), np.int64)
    ask[order] = np.cumsum(new) - 1
    return first, bucket[first], ask


def _sorted(rows: pa.Table, kind: int) -> list[list[np.ndarray]]:
    """What the rows of a kind hold, by bucket."""
    some = [(b, d) for k, b, d in zip(rows["kind"].to_pylist(), rows["bucket"].to_pylist(), rows["data"].to_pylist(), strict=True) if k == kind]
    return [get(d) for _, d in sorted(some)]


def _segments(raw, offs, keys, state: list, buckets: int):
    """Start, end, group and owner of the batch's segments with repeated anchors; None if it has none."""
    if not state:
        return None
    begin, end, owner, hashes, _, inverse, _ = _different(raw, offs, keys, buckets)
    state = np.concatenate([s[0] for s in state])[inverse]
    group = hashes[inverse]
    warm, very = state == 1, np.flatnonzero(state == 2)
    b, e, g, o = [begin[warm]], [end[warm]], [group[warm]], [owner[warm]]
    if len(very):  # every window of a hot anchor is a segment, and its hash its group
        counts = end[very] - begin[very] - SPAN + 1
        start = np.repeat(begin[very], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        b, e, g, o = [*b, start], [*e, start + SPAN], [*g, _grams(raw, start, start + SPAN)], [*o, np.repeat(owner[very], counts)]
    b, e, g, o = map(np.concatenate, (b, e, g, o))
    return (b, e, g, o) if len(b) else None


def _cut(buckets: int):
    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """From a batch's text and the state of its anchors: its segments, as asks."""
        if not texts.num_rows:
            return _table([])
        keys, _, offs, raw = get(texts["data"][0].as_py())
        found = _segments(raw, offs, keys, _sorted(answers, STATE), buckets)
        if found is None:
            return _table([])
        b, e, g, o = found
        first, bucket, _ = _segment_rows(raw, *found, buckets)
        out = []
        for k, i, j in _split(bucket):
            some = first[i:j]
            sizes = e[some] - b[some]
            text = raw[np.repeat(b[some], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            out.append((ASK, texts["batch"][0].as_py(), k, put(g[some], o[some], sizes.astype(np.uint8), text)))
        return _table(out)

    return cut


def _grams(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = _sums(raw)
    return mix((sums[end] - sums[begin]) * powers(len(raw))[1][begin])


def firsts(text: np.ndarray, sizes: np.ndarray, group: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The first document of every window of segments (end to end in text, sorted by group), in order.

    Segments alone in their group hold their own document's number; the others are suffix-sorted, whole groups at a time.
    """
    windows = sizes - SPAN + 1
    out = np.repeat(docs, windows)
    to = np.cumsum(windows)
    begin = np.cumsum(sizes) - sizes
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    many = np.flatnonzero(np.diff(edges) > 1)
    dense = np.zeros(256, np.uint8)
    k = 0
    while k < len(many):
        some, size = [], 0
        while k < len(many) and (not some or size < SORT_BYTES):
            a, b = edges[many[k]], edges[many[k] + 1]
            some.append(np.arange(a, b))
            size += int(sizes[a:b].sum())
            k += 1
        some = np.concatenate(some)
        each = sizes[some] + 1
        ends = np.cumsum(each)
        joined = np.zeros(ends[-1], np.uint8)
        inside = np.ones(len(joined), bool)
        inside[ends - 1] = False
        take = np.repeat(begin[some], sizes[some]) + np.arange(sizes[some].sum()) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        plain = text[take]
        used = np.unique(plain)  # UTF-8 leaves bytes unused: all that occur fit above the 0 that ends a segment
        dense[used] = np.arange(1, len(used) + 1)
        joined[inside] = dense[plain]
        order = suffix_array(joined)
        segment = np.repeat(np.arange(len(some)), each)
        offset = np.arange(len(joined)) - np.repeat(ends - each, each)
        whole = offset[order] < windows[some][segment[order]]
        order = order[whole]
        shared = common_prefixes(joined, order)
        # a repeat must lie in one group: others that share it have met it at that group's anchor
        run = np.flatnonzero(shared < SPAN)
        least = np.minimum.reduceat(docs[some][segment[order]], run)
        seg = segment[order]
        out[to[some[seg]] - windows[some[seg]] + offset[order]] = np.repeat(least, np.diff(np.append(run, len(order))))
    return out


def _sort(asked: pa.Table) -> pa.Table:
    """For each batch's segments of a bucket: runs (offset, first document) of their windows."""
    parts = [get(d) for d in asked["data"].to_pylist()]
    counts = [len(p[0]) for p in parts]
    group, docs, sizes, text = (np.concatenate([p[i] for p in parts]) for i in range(4))
    sizes = sizes.astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    body = _grams(text, begin, begin + sizes)
    order = np.lexsort((docs, body, group))
    new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (body[order][1:] != body[order][:-1])])
    one = order[new]
    merged = np.empty(len(order), np.int64)
    merged[order] = np.cumsum(new) - 1
    size = sizes[one]
    flat = text[np.repeat(begin[one], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    first = firsts(flat, size, group[one], docs[one])
    windows = size - SPAN + 1
    starts = np.cumsum(windows) - windows
    change = np.ones(len(first), bool)
    change[1:] = first[1:] != first[:-1]
    change[starts] = True
    at = np.flatnonzero(change)
    runs_of = np.searchsorted(at, np.append(starts, len(first)))
    offset = (at - np.repeat(starts, np.diff(runs_of))).astype(np.uint8)
    doc = first[at]
    out, ends = [], np.cumsum(counts)
    for number, bucket, mine in zip(asked["batch"].to_pylist(), asked["bucket"].to_pylist(), np.split(merged, ends[:-1]), strict=True):
        n = runs_of[mine + 1] - runs_of[mine]
        take = np.repeat(runs_of[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append((ANSWER, number, bucket, put(n, offset[take], doc[take], windows[mine])))
    return _table(out)


REPORTS = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string"
_REPORTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])


def _remove(buckets: int):
    def remove(texts: pa.Table, rows: pa.Table) -> pa.Table:
        """From a batch's text, the state of its anchors and the first documents of its segments' windows: what goes."""
        if not texts.num_rows:
            return _REPORTS.empty_table()
        keys, nulls, offs, raw = get(texts["data"][0].as_py())
        delta = np.zeros(len(raw) + 1, np.int64)
        found = _segments(raw, offs, keys, _sorted(rows, STATE), buckets)
        if found is not None:
            begin, _, _, owner = found
            _, _, ask = _segment_rows(raw, *found, buckets)
            n, offset, doc, windows = (np.concatenate([a[i] for a in _sorted(rows, ANSWER)]) for i in range(4))
            offset = offset.astype(np.int64)
            last = np.cumsum(n)
            stop = np.append(offset[1:], 0)
            stop[last - 1] = windows  # a run ends where the next begins, or with the segment's windows
            runs = n[ask]
            take = np.repeat((last - n)[ask], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            goes = doc[take] < np.repeat(owner, runs)
            take, base = take[goes], np.repeat(begin, runs)[goes]
            np.add.at(delta, base + offset[take], 1)
            np.add.at(delta, base + stop[take] + SPAN - 1, -1)
        return _report(keys, nulls, offs, raw, delta)

    return remove


def _report(keys, nulls, offs, raw, delta) -> pa.Table:
    gone = np.cumsum(delta[:-1]) > 0
    out = {f.name: [] for f in _REPORTS}
    out["doc_id"] = [None if z else k for k, z in zip(keys.tolist(), nulls.tolist(), strict=True)]
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        mine = gone[a:b]
        edge = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
        out["n_bytes"].append(b - a)
        out["n_removed"].append(int(mine.sum()))
        out["spans"].append([{"start": s, "end": e} for s, e in zip(first, last, strict=True)])
        out["kept_sha256"].append(hashlib.sha256(raw[a:b][~mine].tobytes()).hexdigest())
    return pa.table(out, _REPORTS)


def repeats(docs: DataFrame, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """REPORTS for each row of docs (doc_id, text): the byte spans that repeat a document of smaller doc_id."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 16
    while buckets < size / bucket_bytes and buckets < MOST_BUCKETS:
        buckets *= 2
    # batches of one file of the table follow each other, so files may hold any number of them
    files = min(max(12, -(-size // (4 * BATCH_BYTES))), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    path, name = shared_path(spark, "texts"), f"pricewright_texts_{uuid.uuid4().hex}"
    packed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_pack, ROWS)
    try:
        packed.write.format("parquet").option("compression", "none").option("path", path).bucketBy(files, "batch").saveAsTable(name)
        texts = spark.table(name)
        # the usual number of partitions, or one for 64 MB of text where that is more
        parts = size // (16 * bucket_bytes)
        dealt = lambda rows: rows.repartition(parts, "bucket") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows
        state = save(dealt(texts.mapInArrow(_ask(buckets), ROWS)).groupBy("bucket").applyInArrow(_answer(hot), ROWS), "state", "none")
        asked = texts.groupBy("batch").cogroup(state.groupBy("batch")).applyInArrow(_cut(buckets), ROWS)
        answers = dealt(asked).groupBy("bucket").applyInArrow(_sort, ROWS)
        out = save(texts.groupBy("batch").cogroup(state.union(answers).groupBy("batch")).applyInArrow(_remove(buckets), REPORTS), "repeats")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    texts._pricewright_path = path
    drop(texts, state)
    return out


def report(docs: DataFrame, **options) -> DataFrame:
    return repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def brute_force(docs: list[tuple], span: int = SPAN) -> list[tuple]:
    """What report() gives, by a table of all strings of `span` bytes, for tests."""
    first: dict[bytes, int] = {}
    plain = [(LAST if d is None else d, d, (t or "").encode()) for d, t in docs]
    for key, _, t in plain:
        for p in range(len(t) - span + 1):
            s = t[p : p + span]
            first[s] = min(first.get(s, LAST), key)
    out = []
    for key, d, t in plain:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < key:
                gone[p : p + span] = True
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
