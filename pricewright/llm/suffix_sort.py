"""Two-stage suffix sorting with numpy, for texts of many short segments.

A suffix is of kind B if it is smaller than the suffix one place on, else of kind A. Only B suffixes are sorted directly.
A scan over the buckets of first bytes in ascending order then places every A suffix: when the scan meets a suffix, the
one before it, if of kind A, is the next of its bucket. A bucket is scanned as an array, and runs of one byte in rounds.
"""

from __future__ import annotations

import numpy as np

#: Bytes to which suffixes are told apart; equal ones stay in the order of their places.
DEPTH = 56


def kinds(text: np.ndarray) -> np.ndarray:
    """True for kind A (greater than its successor). The last suffix is greater than the empty one."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[:-1].astype(np.int16) - text[1:])
    step[-1] = 1
    # an equal neighbour decides nothing: take the next place that does
    place = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(place[::-1])[::-1]] > 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes of text (uint8, 0 ends each segment) in ascending order to DEPTH bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    is_a = kinds(text)
    padded = np.concatenate([text, np.zeros(DEPTH, np.uint8)])
    b = np.flatnonzero(~is_a)
    heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, DEPTH)[b]).view(f"S{DEPTH}").reshape(-1)
    b = b[np.argsort(heads, kind="stable")]
    b_bounds = np.searchsorted(text[b], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        direct = b[b_bounds[c] : b_bounds[c + 1]]
        now = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        if not len(now) and not len(direct):
            continue
        induced = [now]
        while len(now):
            now = now[now > 0] - 1
            now = now[(text[now] == c) & is_a[now]]
            induced.append(now)
        bucket = np.concatenate([*induced, direct])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[is_a[before] & (text[before] > c)]
        if len(before):
            order = np.argsort(text[before], kind="stable")
            before = before[order]
            first = text[before]
            edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for part, at in zip(np.split(before, edges[1:]), edges, strict=True):
                waiting[first[at]].append(part)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix in order, how many bytes (up to DEPTH) it shares with the one before it; the first shares none."""
    if not len(order):
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(DEPTH, np.uint8)])
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, DEPTH)[order])
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), DEPTH)
    return np.concatenate([[0], shared])
