"""Token ids in files of fixed-width bit packing.

write(): documents are dealt by ranges of doc_id (rows of equal doc_id in the order of their text's hash), encoded, and
packed into shard files in the fewest bits that hold any id of the vocabulary. A shard holds whole documents until SHARD_IDS
ids are reached. Its layout, little-endian:

    magic b"PWIDS1\\0\\0" | part u32 | shard u32 | width u32 | n_docs u32 | n_ids u64 | crc32 of all that follows u32 | block ids u32
    doc_id i64 each | null flags u8 each | ids of each document u64 each | offset of each block in the payload u64 each
    payload: blocks of BLOCK ids, each starting at a byte

(part, shard) orders the files by doc_id. Spark's text sink writes a shard as one file and ends it with a line end, which the
reader passes over. unpack() is vectorised: eight ids fill `width` whole bytes, so every id of a group of eight sits at the same
place in each group. ids_of() reads one document through the block offsets.

Defined results: a null or empty text is the end id alone; texts of any length are encoded whole, in stretches that end where no merge reaches
across; null doc_id comes first; rows that repeat a doc_id follow each other, each with a start of its own; an empty table writes no shards and gives no rows; other columns are ignored. Special strings
inside texts become what the library makes of them by default.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat_text, save, shared_path, ship, slices, tidy
from .segments import STRETCH, Cache, cuts, pieces, stretches

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Ids of a block and, about, of a shard.
BLOCK, SHARD_IDS = 4096, 4 << 20
MAGIC = b"PWIDS1\0\0"
HEAD = struct.Struct("<8sIIIIQII")

_tokenizers: dict[str, tuple] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str) -> tuple:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path), Cache()
    return _tokenizers[path]


def _ids(raw: np.ndarray, offs: np.ndarray, tokenizer, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and how many each has."""
    begins = cuts(raw, offs, True)
    if not len(begins):
        return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
    index, keys = pieces(raw, begins)

    def encode(ks: list[bytes]) -> Iterator[bytes]:
        for e in tokenizer.encode_batch_fast([k.decode() for k in ks], add_special_tokens=False):
            yield np.array(e.ids, np.uint32).tobytes()

    parts = cache.look_up(keys, encode)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), np.uint32)
    each = sizes[index]
    ends = np.cumsum(each)
    first = np.cumsum(sizes) - sizes
    take = np.arange(ends[-1]) + np.repeat(first[index] - (ends - each), each)
    place = np.searchsorted(begins, offs)
    ends = np.concatenate([[0], ends])
    return flat[take], ends[place[1:]] - ends[place[:-1]]


def encode(texts: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, ids, ids of each row) of slices, without end ids."""
    tokenizer, cache = _tokenizer(path)
    raw, offs = flat_text(texts)
    for lo, hi in slices(np.diff(offs), STRETCH // 4):
        a, b = offs[lo], offs[hi]
        if hi - lo == 1 and b - a > STRETCH:
            parts = [_ids(s, np.array([0, len(s)]), tokenizer, cache)[0] for s in stretches(raw[a:b], True)]
            yield lo, hi, np.concatenate(parts), np.array([sum(map(len, parts))])
        else:
            yield lo, hi, *_ids(raw[a:b], offs[lo : hi + 1] - a, tokenizer, cache)


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def _overlaps(width: int) -> Iterator[tuple[int, int, int]]:
    """Of a group of eight ids: (id, byte, how far the id is shifted left to lie over that byte)."""
    for k in range(8):
        for b in range(k * width // 8, ((k + 1) * width + 7) // 8):
            yield k, b, k * width - 8 * b


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids (below 2 ** width) in order, lowest bits first, the last group of eight filled up with zeros."""
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint32)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), width), np.uint8)
    for k, b, shift in _overlaps(width):
        column = groups[:, k]
        out[:, b] |= ((column << np.uint32(shift) if shift >= 0 else column >> np.uint32(-shift)) & np.uint32(0xFF)).astype(np.uint8)
    return out.tobytes()


def unpack(data, width: int, n: int) -> np.ndarray:
    """The first n ids of what pack() gave."""
    packed = np.frombuffer(data, np.uint8, -(-n // 8) * width).reshape(-1, width)
    out = np.zeros((len(packed), 8), np.uint32)
    for k, b, shift in _overlaps(width):
        column = packed[:, b].astype(np.uint32)
        out[:, k] |= column >> np.uint32(shift) if shift >= 0 else column << np.uint32(-shift)
    return out.reshape(-1)[:n] & np.uint32((1 << width) - 1)


def shard(part: int, number: int, width: int, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    size = BLOCK * width // 8
    blocks = np.arange(-(-len(ids) // BLOCK), dtype=np.uint64) * np.uint64(size)
    body = b"".join([
        np.array([d or 0 for d in doc_ids], np.int64).tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        counts.astype(np.uint64).tobytes(), blocks.tobytes(), pack(ids, width),
    ])
    return HEAD.pack(MAGIC, part, number, width, len(doc_ids), len(ids), zlib.crc32(body), BLOCK) + body


class Shard:
    """A shard file's bytes, opened."""

    def __init__(self, data: bytes):
        magic, self.part, self.number, self.width, n, self.n_ids, check, self.block = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, np.int64, n, at)
        self.nulls = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.counts = np.frombuffer(data, np.uint64, n, at + 9 * n).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, np.uint64, blocks, at + 17 * n)
        self.payload = at + 17 * n + 8 * blocks
        size = -(-self.n_ids // 8) * self.width
        if zlib.crc32(memoryview(data)[at : self.payload + size]) != check:
            raise ValueError("token file is damaged")
        self.data, self.starts = data, np.cumsum(self.counts) - self.counts

    def ids(self) -> np.ndarray:
        return unpack(memoryview(self.data)[self.payload :], self.width, self.n_ids)

    def ids_of(self, doc: int) -> np.ndarray:
        """Ids of the document at this place, from its blocks alone."""
        first, n = int(self.starts[doc]), int(self.counts[doc])
        block = first // self.block
        view = memoryview(self.data)[self.payload + int(self.offsets[block]) :]
        return unpack(view, self.width, first - block * self.block + n)[first - block * self.block :]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write docs (doc_id, text) as shards under path."""
    ship(docs.sparkSession)
    tokenizer = tokenizer or tokenizer_path()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = width_of(max(_tokenizer(tokenizer)[0].get_vocab_size(), end_id + 1))
        part = TaskContext.get().partitionId()
        doc_ids, counts, parts, n, number = [], [], [], 0, 0
        for batch in batches:
            ids_column = batch.column("doc_id")
            for lo, hi, ids, each in encode(batch.column("text"), tokenizer):
                parts.append(np.insert(ids, np.cumsum(each), end_id))
                counts.append(each + 1)
                doc_ids += ids_column.slice(lo, hi - lo).to_pylist()
                n += len(parts[-1])
                if n >= SHARD_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([shard(part, number, width, doc_ids, np.concatenate(counts), np.concatenate(parts))], pa.binary())], ["shard"])
                    doc_ids, counts, parts, n, number = [], [], [], 0, number + 1
            tidy()
        if doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([shard(part, number, width, doc_ids, np.concatenate(counts), np.concatenate(parts))], pa.binary())], ["shard"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    written = rows.mapInArrow(shards, "shard binary").select(F.col("shard").cast("string"))
    written.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the shards under path.

    Each shard is unpacked once, into rows with starts counted from the shard's own, which are saved; what the shards before it hold is
    summed over one row a shard (a shard holds SHARD_IDS ids, so the table of shards is small for any corpus).
    """
    ship(spark)
    schema = "part bigint, shard bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = Shard(batch.column("content")[k].as_py())
                plain, at = memoryview(s.ids().astype("<u4").tobytes()), (s.starts * 4).tolist()
                sums = [zlib.crc32(plain[a : a + 4 * c]) for a, c in zip(at, s.counts.tolist(), strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, s.part), pa.int64()), pa.array(np.full(n, s.number), pa.int64()), pa.array(s.doc_ids, pa.int64(), mask=s.nulls.astype(bool)),
                    pa.array(s.starts, pa.int64()), pa.array(s.counts, pa.int64()), pa.array(sums, pa.int64()),
                ], ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"])
                del s, plain, at, sums
        tidy()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = save(files.select("content").mapInArrow(rows, schema), "token-rows")
    sizes = found.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return found.join(offsets, ["part", "shard"]).select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs to the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
