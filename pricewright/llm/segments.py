"""Cut texts where no tokenizer merge can reach across, so that equal pieces are encoded once.

A cut lies before a single white space between two visible characters. Both tokenizer families used here start a new unit
there: byte-level BPE splits texts into words that begin with their space, and no entry of the sentencepiece vocabulary
holds its space mark after another character. Where the neighbours of a space are not plainly visible characters (white
space, anything that might be white space or be normalised), no cut is made; a piece is then just longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Byte 0xFF never occurs in UTF-8: it stands for a space that a cut drops.
DROPPED = 0xFF
#: Longest stretch of one text that is worked on at once; bytes of pieces that the cache holds in a generation; longest piece that it keeps.
STRETCH, CACHED, KEPT = 8 << 20, 1 << 20, 64

_VISIBLE, _LEAD, _LETTER, _MARK, _BLANK, _LINE, _TAIL = 1, 2, 4, 8, 16, 32, 64
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] |= _VISIBLE
_CLASS[0xC3:0xE0] |= _LEAD  # leads of two-byte characters from U+00C0 on
_CLASS[0x41:0x5B] |= _LETTER
_CLASS[0x61:0x7B] |= _LETTER
_CLASS[[ord(c) for c in ",.;:!?"]] |= _MARK
_CLASS[0x20] |= _BLANK
_CLASS[0x0A] |= _LINE
_CLASS[0x80:0xC0] |= _TAIL


def cuts(raw: np.ndarray, offs: np.ndarray, lines: bool) -> np.ndarray:
    """Sorted positions at which a piece begins: the starts of the texts that aren't empty, and cuts inside them.

    lines: also cut before single line ends, and before , . ; : ! ? after an ASCII letter.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _CLASS[raw]
    seen_before = kind & _VISIBLE  # bit 1: the character that ends here is visible
    seen_before[1:] |= (kind[:-1] >> 1) & (kind[1:] >> 6) & 1
    seen_after = (kind | (kind >> 1)) & 1  # the character that starts here is visible
    cut = np.zeros(n, bool)
    blank = (kind[1:-1] & (_BLANK | _LINE if lines else _BLANK)) != 0
    cut[1:-1] = blank & (seen_before[:-2] & seen_after[2:]).view(bool)
    if lines:
        cut[1:] |= ((kind[1:] & _MARK) != 0) & ((kind[:-1] & _LETTER) != 0)
    filled = offs[1:] > offs[:-1]
    ends = offs[1:][filled] - 1
    cut[ends[(kind[ends] & (_BLANK | _LINE)) != 0]] = False  # what follows it is another text
    cut[offs[:-1][filled]] = True
    return np.flatnonzero(cut)


def pieces(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each piece, its place among the different pieces; and those."""
    offs = np.append(begins, len(raw)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def stretches(raw: np.ndarray, lines: bool, most: int = STRETCH):
    """One long text in parts that begin at its start or at a cut."""
    at = 0
    view = most
    while len(raw) - at > view:
        last = int(cuts(raw[at : at + view], np.array([0, view]), lines)[-1])
        if last == 0:
            view *= 2
            continue
        yield raw[at : at + last]
        at, view = at + last, most
    yield raw[at:]


class Cache:
    """What pieces were encoded to, in two generations: full, the younger becomes the older. Pieces over KEPT bytes, which seldom repeat
    (texts without spaces are one piece each), are encoded anew."""

    def __init__(self, most: int = CACHED):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def look_up(self, keys: list[bytes], encode) -> list:
        """Values of the keys; encode(missing keys) gives the values of those that aren't here."""
        young, old = self.young, self.old
        found = [young.get(k) for k in keys]
        missing = []
        for i, v in enumerate(found):
            if v is None:
                v = old.get(keys[i])
                if v is None:
                    missing.append(i)
                else:
                    found[i] = young[keys[i]] = v
                    self.size += len(keys[i])
        if missing:
            for i, v in zip(missing, encode([keys[i] for i in missing]), strict=True):
                found[i] = v
                if len(keys[i]) <= KEPT:
                    young[keys[i]] = v
                    self.size += len(keys[i])
        if self.size > self.most:
            self.old, self.young, self.size = young, {}, 0
        return found
