"""Toxicity by a weighted lexicon, matched by one Aho-Corasick automaton over folded text.

fold() lower-cases, maps homoglyphs to the letters they look like, drops invisible characters, reads digits and signs inside
words with letters as letters, and joins the words by single spaces. Lexicon entries are whole words (" idiot ") or
word beginnings (" achlich"); each hit adds the entry's weight, unless it lies inside an exception phrase. The sum is divided by a
power of the text's length, and score = sum / (sum + half).

learn() takes the entries from a bounded sample of labelled rows: candidates are words and word beginnings, counted by document as a Spark aggregation;
entries are those that toxic documents hold so much more often than others that chance would not give it (see SURPRISE). Of a word's beginnings that
the same documents hold the shortest is taken. Weights are log odds. Word pairs around hits that only non-toxic documents hold become
exception phrases. The length power and `half` are those of the best accuracy on the sample.

Defined results: null and empty texts score 0; texts of any length are scored whole, one in memory at a time; without toxic labels the lexicon is empty and every
score is 0; a score that equals the cut is toxic; rows that repeat a doc_id are scored one by one; an empty table gives no rows; other columns are ignored by
classify() and kept by clean(), whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, held_out, ship, tidy
from .sample import SAMPLE, labelled

#: Letters that look like Latin ones, in pairs (look-alike, Latin).
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "и": "u", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ɪ": "i", "ʟ": "l", "ᴏ": "o", "ս": "u", "օ": "o", "հ": "h",
}
#: Digits and signs that stand for letters inside words.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Characters that show nothing.
INVISIBLE = "­͏᠎​‌‍‎‏⁠﻿"

#: Shortest and longest word beginning that is a candidate; toxic documents that an entry must be in; times that toxic documents hold it more often than others.
SHORTEST, LONGEST, SUPPORT, LIFT = 3, 10, 3, 4.0
#: How unlikely an entry's share of toxic documents must be by chance, in nats (chance e^-12: of 100 000 candidates about one passes for nothing).
SURPRISE = 12.0
CUT = 0.5
#: Patterns that a task counts before it passes on what it has.
TALLY = 50_000


def _table() -> dict[int, str]:
    # full-width forms and mathematical alphabets, by their places in Unicode
    table: dict[int, str] = {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= {0xFF41 + k: chr(97 + k) for k in range(26)} | {0xFF10 + k: str(k) for k in range(10)}
    table |= {0x1D400 + 52 * f + 26 * c + k: chr(97 + k) for f in range(13) for c in range(2) for k in range(26)}
    table |= dict.fromkeys(map(ord, INVISIBLE), "")
    keep = set(map(ord, "@$"))
    table |= {c: " " for c in range(128) if not chr(c).isalnum() and c not in keep}
    return table | {c: " " for c in (*range(0x80, 0xAA), *range(0xAB, 0xAD), *range(0xAE, 0xB5), *range(0xB6, 0xBA), *range(0xBB, 0xC0), 0xD7, 0xF7, *range(0x2010, 0x2060), 0x3000)}


_FOLD = _table()
_SIGN = re.compile(r"[0-9@$]")
_DIGIT = str.maketrans(DIGITS)


def _unmix(word: str) -> str:
    word = word.rstrip("@$")
    return (word.translate(_DIGIT) if any(map(str.isalpha, word)) else word).replace("@", " ").replace("$", " ")


def fold(text: str) -> str:
    """Folded words with a space before and after each."""
    plain = text.lower().translate(_FOLD)
    words = plain.split()
    if _SIGN.search(plain):
        words = " ".join(_unmix(w) if _SIGN.search(w) else w for w in words).split()
    return f" {' '.join(words)} "


@dataclass(frozen=True)
class Lexicon:
    """entries: pattern to weight (a pattern starts with a space; one that ends with a space is a whole word)."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    power: float = 0.5
    half: float = 1.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for pattern, weight in self.entries.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            found.add_word(f" {fold(phrase).strip()} ", (len(fold(phrase)), None))
        if len(found):
            found.make_automaton()
        return found

    def weigh(self, folded: str, found: ahocorasick.Automaton) -> float:
        """Sum of the weights of hits outside exception phrases."""
        if not len(found):
            return 0.0
        hits, spared = [], []
        for end, (size, weight) in found.iter(folded):
            (spared if weight is None else hits).append((end - size + 1, end, weight))
        # both come in the order of their ends; a hit is spared if a phrase that ends with it or later begins no later: from the end on, the earliest beginning of those phrases says it
        total, first = 0.0, len(folded)
        for begin, end, weight in reversed(hits):
            while spared and spared[-1][1] >= end:
                first = min(first, spared.pop()[0])
            total += weight if first > begin else 0.0
        return total

    def score_of(self, weighed, words):
        density = weighed / (1 + words / 100) ** self.power
        return density / (density + self.half)


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    if lexicon.name not in _built:
        if len(_built) > 3:
            _built.clear()
        _built[lexicon.name] = lexicon.automaton()
    return _built[lexicon.name]


def candidates_of(folded: str) -> set[str]:
    """Patterns of the different words: the word itself, and its beginnings."""
    out = set()
    for word in set(folded.split()):
        if word.isalpha():
            out.add(f" {word} ")
            out.update(f" {word[:k]}" for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    return out


def _tallied(batches: Iterator[pa.RecordBatch], patterns) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each pattern, in partial sums of about TALLY patterns at most and one document's more."""
    tally = Counter(), Counter()

    def partial() -> pa.RecordBatch:
        names = list(tally[0].keys() | tally[1].keys())
        counts = pa.array([tally[1][n] for n in names], pa.int64()), pa.array([tally[0][n] for n in names], pa.int64())
        for t in tally:
            t.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], ["pattern", "toxic", "other"])

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            tally[label > 0].update(patterns(fold(text.as_py() or "")))
            if len(tally[0]) + len(tally[1]) > TALLY:
                yield partial()
    yield partial()
    tidy()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tallied(batches, candidates_of)


def surprise(toxic: Column, other: Column, share: float) -> Column:
    """Log likelihood ratio of toxic documents among a pattern's, against their share of all; 0 where it is not above that."""
    n = toxic + other
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return F.when(toxic > n * share, part(toxic, share) + part(other, 1 - share)).otherwise(0.0)


def shortest(passing: dict[str, tuple[int, int]]) -> list[str]:
    """Patterns without those that have a shorter beginning of the same counts."""
    return sorted(p for p in passing if not any(passing.get(p[:k]) == passing[p] for k in range(SHORTEST, len(p))))


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, support: int = SUPPORT, lift: float = LIFT, exceptions: tuple[str, ...] = (), unlikely: float = SURPRISE) -> Lexicon:
    """Fit on at most `most` labelled rows that are not held out; the driver gets the counts of patterns that pass, and two numbers of each row."""
    ship(docs.sparkSession)
    sample = labelled(docs, labels, "toxic", most)
    totals = {r["label"] > 0: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    counts = sample.mapInArrow(_count, "pattern string, toxic bigint, other bigint").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    c = F.col
    passes = (c("toxic") >= support) & (c("toxic") * good >= lift * bad * c("other")) & (surprise(c("toxic"), c("other"), bad / max(bad + good, 1)) >= (unlikely if good else 0.0))
    passing = {r["pattern"]: (r["toxic"], r["other"]) for r in counts.where(passes).collect()}
    odds = lambda p: math.log((passing[p][0] + 0.5) / (bad + 1)) - math.log((passing[p][1] + 0.5) / (good + 1))
    entries = {p: max(odds(p), 0.1) for p in shortest(passing)}
    start = Lexicon(entries, exceptions)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = start.automaton()

        def pairs(folded: str) -> set[str]:
            """A hit's word with the word before it, and with the word after it."""
            phrases = set()
            for end, (size, weight) in found.iter(folded) if len(found) else ():
                if weight is not None:
                    a = end - size + 1
                    b = folded.find(" ", a + 1)
                    before, after = folded[folded.rfind(" ", 0, a) + 1 : a], folded[b + 1 : b + 200].partition(" ")[0]
                    phrases |= {f"{before} {folded[a + 1 : b]}".strip(), f"{folded[a + 1 : b]} {after}".strip()}
            return {p for p in phrases if " " in p}

        yield from _tallied(batches, pairs)

    around = sample.mapInArrow(contexts, "pattern string, toxic bigint, other bigint").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    spared = tuple(sorted(r["pattern"] for r in around.where((F.col("toxic") == 0) & (F.col("other") >= support)).collect()))
    lexicon = Lexicon(entries, (*exceptions, *spared))
    weighed = sample.select("label", _weigh(F.col("text"), lexicon).alias("w")).collect()
    drop(sample)
    return tuned(lexicon, np.array([r["w"]["weighed"] for r in weighed]), np.array([r["w"]["words"] for r in weighed]), np.array([r["label"] for r in weighed]))


def tuned(lexicon: Lexicon, weighed: np.ndarray, words: np.ndarray, y: np.ndarray) -> Lexicon:
    """The length power and `half` with the fewest errors; ties to the larger power, then the middle of the gap."""
    best = (math.inf, 0.0, 1.0)
    for power in (1.0, 0.75, 0.5, 0.25, 0.0):
        density = weighed / (1 + words / 100) ** power
        order = np.argsort(-density, kind="stable")
        d, hits = density[order], np.cumsum(y[order] > 0)
        errors = (y > 0).sum() - hits + (np.arange(1, len(d) + 1) - hits)  # if the first k are called toxic
        ends = np.flatnonzero((d[:-1] != d[1:]) & (d[:-1] > 0)) if len(d) > 1 else []
        for k in ends:
            if errors[k] < best[0]:
                best = errors[k], power, (d[k] * max(d[k + 1], d[k] / 4)) ** 0.5
    return Lexicon(lexicon.entries, lexicon.exceptions, best[1] if best[0] < math.inf else lexicon.power, float(best[2]), lexicon.name)


def _weigh(text: Column, lexicon: Lexicon) -> Column:
    kind = pa.struct([("weighed", pa.float64()), ("words", pa.int64())])

    def weigh(texts: pa.Array) -> pa.Array:
        found, out = _automaton(lexicon), []
        for k in range(len(texts)):
            folded = fold(texts[k].as_py() or "")
            out.append({"weighed": lexicon.weigh(folded, found), "words": folded.count(" ") - 1 if len(folded) > 2 else 0})
        tidy()
        return pa.array(out, kind)

    return F.arrow_udf(weigh, "struct<weighed:double,words:bigint>")(text)


def score(text: Column, lexicon: Lexicon) -> Column:
    w = _weigh(text, lexicon)
    density = w["weighed"] / F.pow(1 + w["words"] / 100, F.lit(lexicon.power))
    return density / (density + F.lit(lexicon.half))


def classify(docs: DataFrame, lexicon: Lexicon, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score(F.col("text"), lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def clean(docs: DataFrame, lexicon: Lexicon, cut: float = CUT) -> DataFrame:
    """docs without the rows that score `cut` or more; all columns as they were, no shuffle."""
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score(F.col("text"), lexicon).alias("score"))
    return scored.where(F.col("score") < cut).select("row.*")
