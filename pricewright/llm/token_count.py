"""Token counts by a sentencepiece model, lengths only, in Arrow functions.

An Arrow batch is worked on in slices of about equal bytes, and a longer text in stretches that end at safe cuts (see
segments). All pieces of a slice that differ are encoded in one call of the library; a text's count is the sum over its
pieces. No text is cut short, and special strings inside texts are what the library takes them for by default.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows that repeat a doc_id are counted one by one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, ship, slices, tidy
from .segments import DROPPED, STRETCH, Cache, cuts, pieces, stretches

MODEL, LIMIT = "piece_bpe_32k.model", 4096

_models: dict[str, tuple] = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _model(path: str) -> tuple:
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path), Cache()
    return _models[path]


def _lengths(raw: np.ndarray, offs: np.ndarray, inside: bool, model, cache: Cache) -> np.ndarray:
    """Tokens of each text; inside: the first text begins at a cut of a longer one."""
    begins = cuts(raw, offs, False)
    if not len(begins):
        return np.zeros(len(offs) - 1, np.int64)
    marked = raw.copy()
    starts = np.zeros(len(raw), bool)
    starts[offs[:-1][offs[1:] > offs[:-1]]] = True
    marked[begins[~starts[begins]]] = DROPPED
    if inside:
        marked[0] = DROPPED
    index, keys = pieces(marked, begins)
    mark = bytes([DROPPED])
    counts = cache.look_up(keys, lambda ks: map(len, model.encode([k[k[:1] == mark :].decode() for k in ks], num_threads=1)))
    ends = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[index])])
    place = np.searchsorted(begins, offs)
    return ends[place[1:]] - ends[place[:-1]]


def count(texts: pa.Array, path: str) -> np.ndarray:
    model, cache = _model(path)
    raw, offs = flat_text(texts)
    out = np.zeros(len(offs) - 1, np.int64)
    for lo, hi in slices(np.diff(offs), STRETCH):
        a, b = offs[lo], offs[hi]
        if hi - lo == 1 and b - a > STRETCH:
            out[lo] = sum(int(_lengths(s, np.array([0, len(s)]), k > 0, model, cache)[0]) for k, s in enumerate(stretches(raw[a:b], False)))
        else:
            out[lo:hi] = _lengths(raw[a:b], offs[lo : hi + 1] - a, False, model, cache)
    return out


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    path = path or model_path()

    def lengths(texts: pa.Array) -> pa.Array:
        counts = count(texts, path)
        tidy()
        return pa.array(counts, pa.int64())

    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.arrow_udf(lengths, "bigint")("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
