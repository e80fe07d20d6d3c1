"""Word shingles of texts as 64-bit hashes, and their MinHash signatures, over whole Arrow buffers at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import flat_text, slices

#: Words of a shingle. Signature: VALUES minima of BITS bits each.
WORDS, VALUES, BITS = 5, 48, 16

_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(1, 2**64, 256, dtype=np.uint64)
_PLACE = _draw.integers(1, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_TIMES = _draw.integers(1, 2**64, VALUES, dtype=np.uint64) | np.uint64(1)
_FLIP = _draw.integers(1, 2**64, VALUES, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and _BASE ** -i modulo 2 ** 64, for i up to n at least."""
    if not _powers or len(_powers[0]) <= n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n + 1, 1 << 16), base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; words never cross texts."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    border = np.zeros(n + 1, bool)
    border[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * up[:n], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(offs, first, "right") - 1


def shingle_hashes(words: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and the n_texts + 1 offsets of the texts in them; repeats included."""
    counts = np.bincount(text, minlength=n_texts)
    total = len(words)
    long = np.zeros(total, bool)
    if total >= WORDS:
        long[: total - WORDS + 1] = text[: total - WORDS + 1] == text[WORDS - 1 :]
    at = np.flatnonzero(long)
    sums = np.zeros(len(at), np.uint64)
    for j in range(WORDS):
        sums += words[at + j] * _PLACE[j]
    begins = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < WORDS))  # the whole sequence is their shingle
    rest = np.zeros(len(few), np.uint64)
    for j in range(WORDS - 1):
        has = counts[few] > j
        rest[has] += words[begins[few[has]] + j] * _PLACE[j]
    rest += counts[few].astype(np.uint64) * np.uint64(_BASE)
    owner = np.concatenate([text[at], few])
    order = np.argsort(owner, kind="stable")
    sizes = np.bincount(owner, minlength=n_texts)
    return mix(np.concatenate([sums, rest])[order]), np.concatenate([[0], np.cumsum(sizes)])


def sets(texts: pa.Array):
    """(row number, its sorted different shingle hashes) of each text."""
    raw, offs = flat_text(texts)
    for lo, hi in slices(np.diff(offs)):
        part = offs[lo : hi + 1] - offs[lo]
        hashes, at = shingle_hashes(*word_hashes(raw[offs[lo] : offs[hi]], part), hi - lo)
        for k in range(hi - lo):
            yield lo + k, np.unique(hashes[at[k] : at[k + 1]])


def signature(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """VALUES minima of each text's hashes, cut to BITS bits; texts without shingles give zeros."""
    out = np.zeros((len(offs) - 1, VALUES), np.uint16)
    filled = np.flatnonzero(offs[1:] > offs[:-1])
    if len(filled):
        for k in range(VALUES):
            low = np.minimum.reduceat((hashes ^ _FLIP[k]) * _TIMES[k], offs[:-1][filled])
            out[filled, k] = (mix(low) >> np.uint64(64 - BITS)).astype(np.uint16)
    return out


def digest(different: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes as two signed numbers."""
    a, b = int(mix(different).sum(dtype=np.uint64)), int(mix(different * np.uint64(_BASE)).sum(dtype=np.uint64)) ^ len(different)
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)
