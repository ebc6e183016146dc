"""Words of Arrow texts as arrays: spans, 64-bit hashes and rolling n-grams, without a Python loop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)
#: bytes 0x20 and 0x09 to 0x0D stand between words
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = _BYTES.copy()
_LOWER[ord("A"):ord("Z") + 1] = _BYTES[ord("a"):ord("z") + 1]


class Words:
    """Words of a column of texts: ``first``/``last`` byte, ``doc`` row and ``hash`` each.

    ``begin[d]`` is the first word of row d. Nulls have no words. With ``lower``,
    A-Z hash as a-z."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset:]
        start = int(offsets[0])
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, dtype=np.uint8, count=int(offsets[-1]))[start:] if data is not None and offsets[-1] > start else np.zeros(0, np.uint8)
        at = offsets - start
        inside = _IN_WORD[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[at] = True
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        self.first = np.flatnonzero(inside & (~before | edge[:-1]))
        self.last = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.begin = np.searchsorted(self.first, at, "left")
        self.count = np.diff(self.begin)
        self.doc = np.repeat(np.arange(n), self.count)
        self.hash = self._hashes(_LOWER if lower else _BYTES, inside)

    def _hashes(self, values: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0, np.uint64)
        length = self.last - self.first
        powers = np.cumprod(np.full(int(length.max()), _STEP, dtype=np.uint64))
        lead = int(self.first[0])
        place = np.arange(lead, len(self.data)) - np.repeat(self.first, np.diff(np.append(self.first, len(self.data))))
        keyed = values[self.data[lead:]]
        keyed *= powers[np.minimum(place, len(powers) - 1)]
        keyed[~inside[lead:]] = 0
        return mix(np.add.reduceat(keyed, self.first - lead) + length.astype(np.uint64) * _BASE)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; the last n-1 of the column have none."""
        h = self.hash
        m = len(h) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        g = h[:m].copy()
        for j in range(1, n):
            g *= _STEP
            g += h[j:j + m]
            g ^= g >> _U(29)
        return mix(g)

    def starts(self, n: int) -> np.ndarray:
        """Whether the n words from each gram on are of one text."""
        m = len(self.hash) - n + 1
        return self.doc[:m] == self.doc[n - 1:] if m > 0 else np.zeros(0, bool)


def run_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
