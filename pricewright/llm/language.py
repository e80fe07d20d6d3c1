"""Language identification by interpolated Kneser-Ney character models, one a language, in sorted hash arrays.

A text is read as symbols: lower-case letters and their marks, and one space for each run of anything else; it starts after spaces and ends
with one. learn() counts the ORDER-grams of every row to learn from (summed in each task before the shuffle; the counts grow with the corpus, nothing is
sampled). The levels below follow by counting the different symbols before a gram, level by level, each from the one above. Each
level is discounted by n1 / (n1 + 2 n2) of its language; the mass taken from a context (and that of its left-out grams) goes to the level
below, at last to all symbols evenly, so every model sums to 1 over the same symbols. What the driver collects and tasks hold has a documented bound:
`entries` grams over all languages and levels. If more are found, those of the smallest counts go, as far as needed; single symbols stay.
A gram is its 64-bit hash in an array that is searched by bisection.

identify() gives each text to the language of the lowest cross-entropy (nats a symbol). The score is that language's probability when
the entropies are weighed by `sharpness` x symbols^`power`, both fitted on every row to learn from: rows fall into two halves by a hash of the text, and each half is measured by
models of the other's counts (models of all counts judge). A text is rejected if its entropy lies above what but a share `reject` of the measured rows of its language show (of all
languages, where its own has fewer than 1 / `reject` rows; where all have fewer, none is rejected), allowing for short texts (deviations shrink with the root of the symbols). Losses are
summed and ranks are counted on Spark, exactly and in any order of rows alike.

Defined results: null texts and texts without a letter are `und`, with score 0, and so is every text if there is nothing to learn from; texts of any length
are read whole, in stretches; rows to learn from need a text, a lang and a doc_id; ties go to the smaller language; an empty table gives no rows; other
columns are ignored by identify() and kept by clean().
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, free, save, ship, tidy

UNKNOWN = "und"
#: Symbols of the longest grams; grams that a model holds, of all languages and levels; share of rows of a language that are rejected.
ORDER, ENTRIES, REJECT = 5, 500_000, 0.005
#: Characters of a text that are folded at once; symbols that are counted or scored at once.
PIECE, STRETCH = 1 << 19, 1 << 19
#: Settings that calibration tries, milder first; parts of a nat in which losses are summed.
SETTINGS = [(power, float(sharpness)) for power in (0.0, 0.25, 0.5, 0.75, 1.0) for sharpness in np.exp(np.arange(-3, 5.1, 0.5))]
NAT = 1 << 24
#: Entropy of a language that a model has no row of.
UNSEEN = 1e6
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark, 0 for others."""
    return np.frombuffer(bytes({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8)


def symbols(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """The symbols of a text in pieces, each with whether it has a letter."""
    last = 32
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _kinds()[codes]
        codes = np.where(kinds > 0, codes, np.uint32(32))
        codes = codes[(codes != 32) | (np.concatenate([[last], codes[:-1]]) != 32)]
        last = int(codes[-1]) if len(codes) else last
        yield codes, bool((kinds == 2).any())
    if last != 32:
        yield np.array([32], np.uint32), False


def hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Item k - 1: at each place the hash of the k symbols that end there (before the k-th place, of fewer)."""
    mixed = codes.astype(np.uint64) * np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(29)
    out, step = [], 1
    for k in range(order):
        step = step * _STEP % 2**64
        term = mixed * np.uint64(step)
        total = out[-1].copy() if k else np.zeros(len(codes), np.uint64)
        total[k:] += term[: len(codes) - k]
        out.append(total)
    return out


def _stretches(texts: Iterator[str | None], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]]:
    """Symbols of texts end to end, each piece after the order - 1 symbols before it; the places to predict; their texts' numbers; whether texts have letters, one for
    each text that has ended by then."""
    codes, owner, letters, held = [], [], [], 0

    def made():
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        own = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        return flat, np.flatnonzero(own >= 0), own[own >= 0], letters

    for n, text in enumerate(texts):
        before, letter = np.full(order - 1, 32, np.uint32), False
        for piece, some in symbols(text or ""):
            letter |= some
            if not len(piece):
                continue
            joined = np.concatenate([before, piece])
            own = np.full(len(joined), n)
            own[: order - 1] = -1
            codes.append(joined)
            owner.append(own)
            before, held = joined[len(joined) - order + 1 :], held + len(joined)
            if held >= STRETCH:
                yield made()
                codes, owner, letters, held = [], [], [], 0
        letters.append(letter)
    yield made()


def _different(codes: np.ndarray, at: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes by level, a place of each different gram among the places `at`, and which of them each place holds."""
    levels = hashes(codes, order)
    found = pa.array(levels[-1][at]).dictionary_encode()
    which = found.indices.to_numpy()
    place = np.zeros(len(found.dictionary), np.int64)
    place[which] = at
    return levels, place, which


def _grams(codes: np.ndarray, ends: np.ndarray, order: int) -> list[str]:
    wide = codes[ends[:, None] + np.arange(1 - order, 1)[None, :]]
    return np.ascontiguousarray(wide, np.uint32).view(f"<U{order}").ravel().tolist()


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                rows = np.flatnonzero(langs.indices.to_numpy() == k)
                for codes, at, _, _ in _stretches((batch["text"][int(i)].as_py() for i in rows), order):
                    if len(at):
                        _, place, which = _different(codes, at, order)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(place), pa.string()), pa.array(_grams(codes, place, order), pa.string()), pa.array(np.bincount(which, minlength=len(place)))], ["lang", "gram", "c"])
        tidy()

    return count


@dataclass
class Model:
    """Of each language and level (from 1): sorted hashes of grams with their discounted shares; of contexts (from level 2) with the mass they pass down."""

    order: int
    langs: list[str]
    base: float  # share of a symbol at the level below 1
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]]
    rest: list[float]  # what level 1 passes down
    power: float = 0.5
    sharpness: float = 1.0
    usual: list[float] = field(default_factory=list)
    slack: list[float] = field(default_factory=list)

    def surprise(self, levels: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """-log probability of the symbol at each place after those before it, a row a language."""
        # each different hash is looked up once, in ascending order, which is several times faster than in any order
        ends = [np.unique(level[place], return_inverse=True) for level in levels]
        befores = [np.unique(level[place - 1], return_inverse=True) for level in levels[:-1]]
        out = np.zeros((len(self.langs), len(place)))
        for n in range(len(self.langs)):
            p = _look(*self.grams[n][0], ends[0][0], 0.0)[ends[0][1]] + self.rest[n] * self.base
            for k in range(1, self.order):
                p = _look(*self.grams[n][k], ends[k][0], 0.0)[ends[k][1]] + _look(*self.contexts[n][k], befores[k - 1][0], 1.0)[befores[k - 1][1]] * p
            out[n] = -np.log(p)
        return out

    def entropies(self, texts: Iterator[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n texts: cross-entropy a language (texts x languages), symbols, whether there are letters."""
        total, size, letters = np.zeros((n, len(self.langs))), np.zeros(n), []
        for codes, at, owner, some in _stretches(texts, self.order):
            letters += some
            if len(at):
                levels, place, which = _different(codes, at, self.order)
                size += np.bincount(owner, minlength=n)
                for k, row in enumerate(self.surprise(levels, place)):
                    total[:, k] += np.bincount(owner, row[which], n)
        return total / np.maximum(size, 1)[:, None], size, np.array(letters, bool)

    def shares(self, entropy: np.ndarray, size: np.ndarray) -> np.ndarray:
        weighed = -(entropy - entropy.min(1, keepdims=True)) * (self.sharpness * np.maximum(size, 1) ** self.power)[:, None]
        e = np.exp(np.maximum(weighed, -500))
        return e / e.sum(1, keepdims=True)


def _look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), default)
    i = np.searchsorted(keys, asked)
    i[i == len(keys)] = 0
    return np.where(keys[i] == asked, values[i], default)


def _counts(rows: DataFrame, order: int) -> DataFrame:
    """Saved table lang, gram, c of the longest grams."""
    return save(rows.mapInArrow(_counter(order), "lang string, gram string, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")


def _levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """Tables lang, gram, c of each level, the longest last: its counts as given, of the others, saved, how many symbols come before."""
    levels = [counts]
    for _ in range(order - 1):
        levels.append(save(levels[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("c")), "grams"))
    return levels[::-1]


def _threshold(grams: DataFrame, entries: int) -> int:
    """The smallest count from which at most `entries` grams are left; single symbols always count."""
    # counts up to 64 one by one, above by powers of two: a bounded table
    low = F.when(F.col("c") <= 64, F.col("c")).otherwise(F.pow(F.lit(2), F.floor(F.log2("c"))).cast("bigint"))
    tally = grams.groupBy((F.col("k") == 1).alias("single"), low.alias("low")).agg(F.count(F.lit(1)).alias("n")).collect()
    left = entries - sum(r["n"] for r in tally if r["single"])
    from_ = 1 << 62
    for low, n in sorted(((r["low"], r["n"]) for r in tally if not r["single"]), reverse=True):
        left -= n
        if left < 0:
            break
        from_ = low
    return from_


def _arrays(table: pa.Table, text: str, value: str, langs: list[str], order: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Of each language and level, sorted hashes of the texts of that level with their values."""
    out = []
    lang, k = table["lang"].to_pandas().to_numpy(), table["k"].to_numpy()
    texts, values = table[text].to_pandas().to_numpy(), table[value].to_numpy()
    for name in langs:
        rows = []
        for level in range(1, order + 1):
            some = (lang == name) & (k == level)
            size = level - (text == "context")
            if not size:
                rows.append((np.zeros(0, np.uint64), np.zeros(0, np.float32)))
                continue
            codes = np.array(texts[some].tolist(), f"<U{size}").view(np.uint32) if some.any() else np.zeros(0, np.uint32)
            keys = hashes(codes, size)[-1][size - 1 :: size] if len(codes) else np.zeros(0, np.uint64)
            by = np.argsort(keys)
            rows.append((keys[by], values[some][by].astype(np.float32)))
        out.append(rows)
    return out


def estimate(rows: DataFrame, order: int = ORDER, entries: int = ENTRIES) -> Model:
    """Models of the languages of rows (lang, text), without calibration."""
    ship(rows.sparkSession)
    counts = _counts(rows, order)
    model = _estimate(counts, order, entries)
    drop(counts)
    return model


def _estimate(counts: DataFrame, order: int, entries: int) -> Model:
    """Models of the counts of the longest grams (lang, gram, c)."""
    levels = _levels(counts, order)
    grams = functools.reduce(DataFrame.unionByName, [x.withColumn("k", F.lit(k)) for k, x in enumerate(levels, 1)])
    from_ = _threshold(grams, entries)
    count = lambda c: F.count(F.when(F.col("c") == c, 1))
    few = {(r["lang"], r["k"]): (r["n1"], r["n2"]) for r in grams.groupBy("lang", "k").agg(count(1).alias("n1"), count(2).alias("n2")).collect()}
    discounts = [(lang, k, min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.1) for (lang, k), (n1, n2) in few.items()]
    if not discounts:
        drop(*levels[:-1])
        return Model(order, [], 1.0, [], [], [])
    spark = counts.sparkSession
    taken = F.broadcast(spark.createDataFrame(discounts, "lang string, k int, d double"))  # a row for each language and level
    context = F.expr("left(gram, k - 1)")
    shares = grams.join(taken, ["lang", "k"]).withColumn("context", context).withColumn("share", (F.col("c") - F.col("d")) / F.sum("c").over(Window.partitionBy("lang", "k", "context")))
    kept = save(shares.where((F.col("k") == 1) | (F.col("c") >= from_)).select("lang", "k", "gram", "context", "share"), "shares")
    down = kept.groupBy("lang", "k", "context").agg((1 - F.sum("share")).alias("passed"))
    langs = sorted({lang for lang, _, _ in discounts})
    base = 1 / (kept.where("k = 1").select("gram").distinct().count() + 1)
    passed = down.toArrow()
    model = Model(order, langs, base, _arrays(kept.select("lang", "k", "gram", "share").toArrow(), "gram", "share", langs, order), _arrays(passed, "context", "passed", langs, order), [])
    first = {r["lang"]: r["passed"] for r in passed.filter(pa.compute.equal(passed["k"], 1)).to_pylist()}
    model.rest = [max(first[lang], 1e-9) for lang in langs]
    drop(kept, *levels[:-1])
    return model


def _sortable(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles x; the same function leads back from their bits."""
    bits = np.ascontiguousarray(x, np.float64).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _double(v: int) -> float:
    bits = np.array([v], np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def order_statistics(rows: DataFrame, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Of rows (k, v: whole numbers) the v of each wanted (k, rank from 1 in k): found 16 bits at a time by counts of the numbers that begin alike, of which there are 65536 at most."""
    begun = {w: (None, w[1]) for w in wanted}  # the bits found so far; the rank among the numbers that begin with them
    for shift in (48, 32, 16, 0):
        starts = {(k, start) for (k, _), (start, _) in begun.items()}
        some = F.lit(False)
        for k, start in starts:
            some = some | ((F.col("k") == k) & (F.lit(True) if start is None else F.shiftright("v", shift + 16) == start))
        found: dict = {}
        for r in rows.where(some).groupBy("k", F.shiftright("v", shift).alias("start")).count().collect():
            found.setdefault((r["k"], r["start"] >> 16 if shift < 48 else None), []).append((r["start"], r["count"]))
        for w, (start, rank) in begun.items():
            for longer, n in sorted(found[w[0], start]):
                if rank <= n:
                    begun[w] = longer, rank
                    break
                rank -= n
    return {w: v for w, (v, _) in begun.items()}


def calibrate(model: Model, measured: DataFrame, reject: float = REJECT) -> None:
    """Fit sharpness and power, and what is rejected, on all rows of measured (own: the place of the row's language in model.langs, size: symbols, e: cross-entropy a language)."""
    n = len(model.langs)
    model.usual, model.slack = [0.0] * n, [float("inf")] * n
    sent = measured.sparkSession.sparkContext.broadcast(model)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(batch["e"].flatten()).reshape(-1, n), np.array(batch["size"]), np.array(batch["own"])

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model_order, sent.value.langs, 1.0, [], [], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            entropy, size, own = read(batch)
            sums = []
            for m.power, m.sharpness in SETTINGS:
                loss = -np.log(np.maximum(m.shares(entropy, size)[np.arange(len(own)), own], 1e-12))
                sums.append(int(np.round(loss * NAT).astype(np.int64).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(SETTINGS))), pa.array(sums)], ["i", "loss"])

    def ranks(usual: list[float] | None):
        """own and, as a sortable number, its entropy, or how far that lies from the usual one of its language."""

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                entropy, size, own = read(batch)
                x = entropy[np.arange(len(own)), own]
                x = x if usual is None else (x - np.array(usual)[own]) * np.sqrt(size)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(_sortable(x))], ["own", "v"])

        return save(measured.mapInArrow(told, "own int, v bigint").select(F.explode(F.array("own", F.lit(-1))).alias("k"), "v"), "ranks")

    model_order = model.order
    many = {r["own"]: r["count"] for r in measured.groupBy("own").count().collect()}
    many[-1] = sum(many.values())  # all languages
    if not many[-1]:
        return
    by_setting = {r["i"]: r["loss"] / NAT / many[-1] for r in measured.mapInArrow(losses, "i bigint, loss bigint").groupBy("i").agg(F.sum("loss").alias("loss")).collect()}
    best = None
    for i, (power, sharpness) in enumerate(SETTINGS):
        if best is None or by_setting[i] < best - 1e-4:  # of settings that fit alike, the milder
            best, model.power, model.sharpness = by_setting[i], power, sharpness
    rows = ranks(None)
    found = order_statistics(rows, {(k, r) for k, c in many.items() for r in ((c + 1) // 2, c // 2 + 1)})
    drop(rows)
    median = {k: (_double(found[k, (c + 1) // 2]) + _double(found[k, c // 2 + 1])) / 2 for k, c in many.items()}
    model.usual = [median.get(k, median[-1]) for k in range(n)]
    # what one more such row passes with probability `reject` at most; none where there are too few rows to say
    at = {k: int(np.ceil((c + 1) * (1 - reject))) for k, c in many.items()}
    rows = ranks(model.usual)
    found = order_statistics(rows, {(k, r) for k, r in at.items() if r <= many[k]})
    drop(rows)
    limit = {k: _double(v) for (k, _), v in found.items()}
    model.slack = [limit.get(k, limit.get(-1, float("inf"))) for k in range(n)]


def learn(docs: DataFrame, order: int = ORDER, entries: int = ENTRIES, reject: float = REJECT) -> Model:
    """Models of the languages of docs (doc_id, text, lang), all rows of which may be learned from: every one is counted, and every one calibrates, measured by models of the other half."""
    ship(docs.sparkSession)
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", half.alias("half"))
    both = _counts(rows.select(F.concat(F.col("half").cast("string"), "lang").alias("lang"), "text"), order)
    lang = F.expr("substring(lang, 2)").alias("lang")
    whole = save(both.groupBy(lang, "gram").agg(F.sum("c").alias("c")), "grams")
    model = _estimate(whole, order, entries)
    drop(whole)
    if not model.langs:
        drop(both)
        return model
    measured = functools.reduce(DataFrame.unionByName, [_measured(rows.where(F.col("half") == 1 - h), _estimate(both.where(F.col("lang").startswith(str(h))).select(lang, "gram", "c"), order, entries), model.langs) for h in (0, 1)])
    measured = save(measured, "measured")
    calibrate(model, measured, reject)
    drop(both, measured)
    return model


def _measured(rows: DataFrame, model: Model, langs: list[str]) -> DataFrame:
    """own, size, e of calibrate() of the rows (lang, text) whose language the model knows and that hold a symbol; e is in the order of langs."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    place = [langs.index(x) for x in model.langs]

    def measure(texts: pa.Array) -> pa.Array:
        entropy, size, _ = sent.value.entropies((t.as_py() for t in texts), len(texts))
        out = np.full((len(texts), 1 + len(langs)), UNSEEN)
        out[:, 0] = size
        out[:, [1 + k for k in place]] = entropy
        tidy()
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, 1 + len(langs), dtype=np.int32), out.ravel())

    own = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    found = rows.where(F.col("lang").isin(model.langs)).select(own.cast("int").alias("own"), F.arrow_udf(measure, "array<double>")("text").alias("x"))
    return found.select("own", F.col("x")[0].alias("size"), F.slice("x", 2, len(langs)).alias("e")).where("size > 0")


def verdict(text: Column, model: Model) -> Column:
    """struct lang, score, entropy, rejected of a text."""
    from pyspark.sql import SparkSession

    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])
    sent = SparkSession.active().sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> pa.Array:
        m = sent.value
        if not m.langs:
            return pa.array([{"lang": UNKNOWN, "score": 0.0, "entropy": None, "rejected": True}] * len(texts), kind)
        entropy, size, letters = m.entropies((t.as_py() for t in texts), len(texts))
        best, share = entropy.argmin(1), m.shares(entropy, size).max(1)
        low = entropy.min(1)
        odd = (low - np.array(m.usual)[best]) * np.sqrt(size) > np.array(m.slack)[best]
        tidy()
        fields = [pa.array(np.where(letters, np.array(m.langs, object)[best], UNKNOWN).tolist(), pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(low, mask=~letters), pa.array(odd | ~letters)]
        return pa.StructArray.from_arrays(fields, fields=list(kind))

    return F.arrow_udf(judge, "struct<lang:string,score:double,entropy:double,rejected:boolean>")(text)


def held_out(doc_id: Column) -> Column:
    """True for the rows that must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for each row of docs (doc_id, text)."""
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), verdict(F.col("text"), model).alias("v"))
    return found.select("doc_id", "held_out", F.col("v.lang").alias("lang_pred"), F.col("v.score").alias("score"), F.col("v.entropy").alias("entropy"), F.col("v.rejected").alias("rejected"))


def clean(docs: DataFrame, model: Model, langs: list[str], least: float = 0.5) -> DataFrame:
    """Rows of docs in one of the languages, with at least that score and not rejected."""
    (v,) = free(docs, "v")
    found = docs.withColumn(v, verdict(F.col("text"), model))
    return found.where(F.col(f"{v}.lang").isin(langs) & (F.col(f"{v}.score") >= least) & ~F.col(f"{v}.rejected")).drop(v)
