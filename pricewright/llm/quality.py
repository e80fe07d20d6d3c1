"""Quality by Bradley-Terry ranking: weights from preference pairs, scores cut at a quantile.

Features are rates of a text's characters, words and lines (see NAMES). fit() draws pairs of a label-1 and a label-0
document of a bounded sample and maximises the likelihood that the first wins, sigmoid(w . (x1 - x0)), by Newton steps on
feature differences. The cut is the quantile of the sample's scores at its share of label 0 (or the one given); score() is
the sigmoid of the distance from the cut, shifted so that the cut itself has the probability `at`.

Defined results: null and empty texts have the features of an empty text and a score; texts of any length are measured whole, one in memory at a time;
without labels of both kinds all weights are 0 and every score is `at`; a score that equals the cut is label 1; rows that repeat a doc_id are scored one by
one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, flat_text, held_out, ship, tidy
from .sample import SAMPLE, labelled

#: Score at the cut; pairs drawn for each label-1 document; strength of the penalty on weights.
AT, PAIRS, RIDGE = 0.3, 8, 1e-3

#: Groups of bytes whose share of a text is a feature.
BYTES = {
    "upper": range(65, 91), "digit": range(48, 58), "symbol": b"%&$#*@^~=+<>{}[]\\/_", "bar": b"|", "bang": b"!", "comma": b",", "dot": b".",
    "space": b" ", "line": b"\n", "high": range(128, 256), "mark": b'!?;:-"()',
}
NAMES = [*BYTES, "log_words", "word_bytes", "different_words", "top_word", "twin_words", "repeated_lines", "log_line_bytes", "repeated_triples", "one_over_words"]
_GROUP = np.array([[c in set(g) for g in BYTES.values()] for c in range(256)], float)


def features(text: bytes) -> np.ndarray:
    """NAMES of a text in UTF-8."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, lines = max(len(words), 1), [x for x in text.split(b"\n") if x]
    tally = Counter(words)
    return np.array([
        *np.sqrt(counts @ _GROUP / max(len(text), 1)),
        np.log1p(n), (len(text) - counts[32] - counts[10]) / n, len(tally) / n**0.8, max(tally.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0, np.log1p(len(text) / max(len(lines), 1)),
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(n - 2, 1) if n > 2 else 0.0, 1 / n,
    ])


def _matrix(texts: pa.Array) -> np.ndarray:
    raw, offs = flat_text(texts)
    raw, offs = raw.tobytes(), offs.tolist()
    return np.array([features(raw[a:b]) for a, b in zip(offs, offs[1:], strict=False)]).reshape(-1, len(NAMES))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    at: float

    def terms(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and the squares of what is left of them within three deviations."""
        z = (x - self.mean) / self.scale
        return np.concatenate([np.clip(z, -8, 8), np.clip(z, -3, 3) ** 2], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.terms(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + shift, -500, 500)))


def rank(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, quantile: float | None = None, at: float = AT, seed: int = 0) -> Model:
    """Fit on features x (rows) and labels y (0 or 1)."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    start = Model(mean, scale, np.zeros(2 * len(NAMES)), 0.0, at)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(better) or not len(worse):
        return start
    terms = start.terms(x)
    draw = np.random.default_rng(seed)
    left = np.repeat(better, pairs)
    difference = terms[left] - terms[draw.choice(worse, len(left))]
    w = np.zeros(terms.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -500, 500)))  # that the better one wins
        slope = difference.T @ (1 - p) / len(p) - ridge * w
        bend = (difference * (p * (1 - p))[:, None]).T @ difference / len(p) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    cut = float(np.quantile(terms @ w, quantile if quantile is not None else len(worse) / len(y)))
    return Model(mean, scale, w, cut, at)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, **options) -> Model:
    """Fit on at most `most` labelled rows that are not held out; only their features reach the driver."""
    ship(docs.sparkSession)

    def measure(texts: pa.Array) -> pa.Array:
        return pa.array(list(_matrix(texts)), pa.list_(pa.float64()))

    sample = labelled(docs, labels, "quality", most)
    rows = sample.select("doc_id", "label", F.arrow_udf(measure, "array<double>")("text").alias("x")).orderBy("doc_id").collect()
    drop(sample)
    return rank(np.array([r["x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["label"] for r in rows]), **options)


def score(text: Column, model: Model) -> Column:
    def judge(texts: pa.Array) -> pa.Array:
        scores = model.scores(_matrix(texts))
        tidy()
        return pa.array(scores, pa.float64())

    return F.arrow_udf(judge, "double")(text)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= model.at).cast("int"))
