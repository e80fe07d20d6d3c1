"""Find benchmark text inside documents: one Aho-Corasick automaton over all windows, each text scanned once.

A window is ten consecutive words of an item (all its words, if fewer). Normal form: A-Z lower-cased, words
joined by single spaces. The normal form keeps the word count, so a match's end, counted in spaces, is a word index, and
word indexes map back to byte offsets of the original text.

The automaton's patterns are seeds of five words, so placed in an item that each of its windows holds one whole (every sixth word begins one), and
items of less than ten words as they are: about as many letters as the benchmark, a tenth of what all windows have. Around a seed that is met, each run of ten
words is looked up among the items' windows (hashes in order, each with one place and its items) and compared with one word by word. A window that repeats, in an item or a
text, is one window, so repetitive text takes no longer than other text.

The benchmark is broadcast in blocks of at most BLOCK_BYTES of text each (about 60 bytes of memory for a byte): one block for any usual benchmark.
More than RESIDENT blocks make more passes over the documents, each with its own automatons, never a larger automaton or one built twice.

Defined results: null and empty texts have no words and no hits; texts of any length are scanned whole, in memory for one text at a time; items without
words match nothing; items that repeat an item_id count once; a null item_id is the empty string; rows that repeat a doc_id are judged one by one; an
empty benchmark or an empty table gives no hits or no rows; other columns play no part, whatever their names, and clean() keeps them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, save, ship, tidy

#: Words of a window; most bytes of benchmark text in one automaton; automatons that a task holds at once.
WINDOW, BLOCK_BYTES, RESIDENT = 10, 2 << 20, 2

#: A-Z to a-z; ASCII that no word holds, to a space; all else as it is.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Word index first..last (inclusive) of a hit run, its bytes start..end (exclusive) in the original text.
SPANS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
VERDICT = f"struct<n_words:bigint,spans:{SPANS},items:array<string>>"
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_VERDICT = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])

@dataclass(frozen=True)
class Windows:
    """Items with their words; the automaton over seeds and short items (a pattern's value: its words, the items that it is the whole of, whether it is a seed); and the different windows by
    hash: of each a place (item, first word) and its items, from starts[k] on in `holders`."""

    items: list[tuple[str, list[bytes]]]
    found: ahocorasick.Automaton
    window: int
    keys: np.ndarray
    places: np.ndarray
    starts: np.ndarray
    holders: np.ndarray

    def at(self, words: list[bytes], firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the text's windows from these words on are items' windows, and which of these."""
        if not len(firsts) or not len(self.keys):
            return firsts[:0], firsts[:0]
        asked = rolling(hashed(words), self.window)[firsts]
        which = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        same = np.flatnonzero(self.keys[which] == asked)
        firsts, which = firsts[same], which[same]
        sure = np.zeros(len(firsts), bool)
        for k, (first, (n, i)) in enumerate(zip(firsts.tolist(), self.places[which].tolist(), strict=True)):
            sure[k] = words[first : first + self.window] == self.items[n][1][i : i + self.window]
        return firsts[sure], which[sure]


def hashed(words: list[bytes]) -> np.ndarray:
    """64 bits of each word, the same within a process."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def rolling(values: np.ndarray, window: int, step: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each run of `window` values."""
    n = max(len(values) - window + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(window):
        out = out * np.uint64(step) + values[k : k + n]
    return out


_built: dict[str, Windows] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def automaton(items: list[tuple[str, str | None]], window: int) -> Windows:
    """Of all seeds of the items."""
    size = max(1, window // 2)
    known = [(item, words) for item, text in items if (words := words_of((text or "").encode("utf-8", "surrogatepass")))]
    whole: dict[bytes, set[str]] = defaultdict(set)
    seeds: set[bytes] = set()
    for item, words in known:
        if len(words) < window:
            whole[b" ".join(words)].add(item)
        else:
            seeds.update(b" ".join(words[k : k + size]) for k in range(0, len(words) - size + 1, window - size + 1))
    found = ahocorasick.Automaton()
    for pattern in seeds | whole.keys():
        # bytes as latin-1, so that positions are byte positions; spaces at both ends keep to whole words
        found.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, pattern, sorted(whole.get(pattern, ())), pattern in seeds))
    found.make_automaton()
    long = [(n, hashed(words)) for n, (_, words) in enumerate(known) if len(words) >= window]
    many = [len(h) - window + 1 for _, h in long]
    holder = np.repeat(np.array([n for n, _ in long], np.int64), many)
    at = np.concatenate([np.arange(m) for m in many]) if many else np.zeros(0, np.int64)
    step = 0x9E3779B97F4A7C15
    keys, others = (np.concatenate([rolling(h, window, x) for _, h in long]) if long else np.zeros(0, np.uint64) for x in (step, 0xD6E8FEB86659FD93))
    order = np.lexsort((at, holder, keys))
    keys, others, holder, at = keys[order], others[order], holder[order], at[order]
    if len(keys) and ((keys[1:] == keys[:-1]) & (others[1:] != others[:-1])).any():
        raise RuntimeError("two different windows share a hash")  # one chance in about 2^64 / windows^2
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    new = first.copy()  # the first of each item with a window
    new[1:] |= holder[1:] != holder[:-1]
    starts = np.append(np.flatnonzero(first[new]), new.sum())
    return Windows(known, found, window, keys[first], np.stack([holder[first], at[first]], 1), starts, holder[new])


def _runs(words: list[bytes], begins: np.ndarray, matches: list, windows: Windows) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs (first word, end) of the text that are windows, and the items that they are of."""
    runs, ids, seen, near = [], set(), set(), []
    size = max(1, windows.window // 2)
    for begin, (_, (length, pattern, whole, seed)) in zip(begins.tolist(), matches, strict=True):
        if whole:
            runs.append((begin, begin + length))
            if pattern not in seen:
                seen.add(pattern)
                ids.update(whole)
        if seed:
            near.append(begin)
    if near:
        # every window holds a seed whole: those around the seeds are all that there can be
        firsts = np.unique(np.array(near)[:, None] - np.arange(windows.window - size + 1)[None, :])
        firsts, which = windows.at(words, firsts[(firsts >= 0) & (firsts <= len(words) - windows.window)])
        runs += [(a, a + windows.window) for a in firsts.tolist()]
        for k in np.unique(which).tolist():
            ids.update(windows.items[n][0] for n in windows.holders[windows.starts[k] : windows.starts[k + 1]].tolist())
    return runs, ids


def scan(text: bytes, windows: Windows) -> tuple[int, list[dict], list[str]]:
    """Number of words, merged runs of hit words, ids of the items with windows in the text."""
    folded = text.translate(FOLD)
    words = folded.split()
    if not words or not windows.items:
        return len(words), [], []
    normal = b" " + b" ".join(words) + b" "
    matches = list(windows.found.iter(normal.decode("latin-1")))
    if not matches:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    begins = np.searchsorted(spaces, np.array([m[0] for m in matches])) - np.array([m[1][0] for m in matches])
    runs, ids = _runs(words, begins, matches, windows)
    if not runs:
        return len(words), [], []
    delta = np.zeros(len(words) + 1, np.int64)
    np.add.at(delta, [r[0] for r in runs], 1)
    np.add.at(delta, [r[1] for r in runs], -1)
    hit = np.diff(np.concatenate([[0], (np.cumsum(delta[:-1]) > 0).astype(np.int8), [0]]))
    firsts, lasts = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1) - 1
    inside = np.diff(np.concatenate([[0], (np.frombuffer(folded, np.uint8) != 32).astype(np.int8), [0]]))
    word_start, word_end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    spans = [
        {"first": a, "last": b, "start": s, "end": e}
        for a, b, s, e in zip(firsts.tolist(), lasts.tolist(), word_start[firsts].tolist(), word_end[lasts].tolist(), strict=True)
    ]
    return len(words), spans, sorted(ids)


def _judge(sent, name: str, window: int):
    """Of a broadcast block, the function of texts that gives VERDICT."""

    def judge(texts: pa.Array) -> pa.Array:
        found = _built.get(name)
        if found is None:
            while len(_built) >= RESIDENT:
                del _built[next(iter(_built))]
            found = _built[name] = automaton(sent.value, window)
        raw, offs = flat_text(texts)
        raw, offs = raw.tobytes(), offs.tolist()
        out = [scan(raw[a:b], found) for a, b in zip(offs, offs[1:], strict=False)]
        del raw
        tidy()
        return pa.array([{"n_words": n, "spans": s, "items": i} for n, s, i in out], _VERDICT)

    return judge


def verdicts(text, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[list]:
    """Passes over the documents: each up to RESIDENT columns of VERDICT, one for each block of the benchmark (item_id, text)."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("words"))
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    columns = []
    for k in range(blocks):
        # bounded: about block_bytes of text, dealt by a hash of the item
        rows = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast([(r["item"], r["words"]) for r in rows])
        columns.append(F.arrow_udf(_judge(sent, uuid.uuid4().hex, window), VERDICT)(text))
    return [columns[k : k + RESIDENT] for k in range(0, blocks, RESIDENT)]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans, items for each row of docs (doc_id, text); spans of several blocks may overlap."""
    judged, names = docs.select("doc_id", "text"), []
    for turn, columns in enumerate(verdicts(F.col("text"), benchmark, window, block_bytes)):
        judged = save(judged, "judged") if turn else judged
        new = [f"v{turn}x{k}" for k in range(len(columns))]
        judged = judged.select("doc_id", "text", *names, *[c.alias(n) for c, n in zip(columns, new, strict=True)])
        names += new
    many = [F.col(n) for n in names]
    return judged.select(
        "doc_id", many[0]["n_words"].alias("n_words"),
        (many[0]["spans"] if len(many) == 1 else F.concat(*[v["spans"] for v in many])).alias("spans"),
        F.array_sort(F.array_distinct(many[0]["items"] if len(many) == 1 else F.concat(*[v["items"] for v in many]))).alias("items"),
    )


def n_hit(spans):
    """Number of different words in runs that may overlap: runs in order, each adds what lies beyond the furthest so far."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["last"] - F.greatest(acc["far"], s["first"] - 1), F.lit(0))).alias("n"), F.greatest(acc["far"], s["last"]).alias("far")
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("far"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What the contract asks for each document."""
    found = hits(docs, benchmark, window, block_bytes).withColumn("n_hit", n_hit(F.col("spans")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; all columns as they were, no shuffle."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    for turn, columns in enumerate(verdicts(F.col("text"), benchmark, window, block_bytes)):
        marked = save(marked, "unmarked") if turn else marked
        marked = marked.select("row", "text", *[c.alias(f"v{k}") for k, c in enumerate(columns)])
        for k in range(len(columns)):
            marked = marked.where(F.size(F.col(f"v{k}.spans")) == 0)
        marked = marked.select("row", "text")
    return marked.select("row.*")


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same by plain search, for tests."""
    out = []
    for doc, text in docs:
        words = words_of((text or "").encode())
        hit, ids = set(), set()
        for item, other in items:
            have = words_of((other or "").encode())
            for k in range(max(len(have) - window, 0) + 1 if have else 0):
                w = have[k : k + window]
                for p in range(len(words) - len(w) + 1):
                    if words[p : p + len(w)] == w:
                        hit.update(range(p, p + len(w)))
                        ids.add(str(item))
        out.append((doc, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH item_words AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[k:k + least(len(ws), {WINDOW}) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW}, 0) + 2)) AS k FROM item_words WHERE len(ws) > 0)
), doc_words AS (
  SELECT doc_id, row_number() OVER () AS row_no, coalesce({_WORDS}, []) AS ws FROM documents
), lengths AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT row_no, k, n, array_to_string(ws[k:k + n - 1], ' ') AS w
  FROM (SELECT row_no, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM doc_words, lengths WHERE len(ws) >= n)
), matches AS (
  SELECT d.row_no, d.k, d.n, i.item FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.w = i.w
), counted AS (
  SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT row_no, k, n FROM matches)) GROUP BY row_no
), named AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row_no, item FROM matches) GROUP BY row_no
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN counted USING (row_no) LEFT JOIN named USING (row_no)
"""
