"""Content anchors: a short list of meeting points for all windows of a length.

Two documents that share a window of `width` symbols must meet somewhere without
every window being shuffled. Each window names its *anchor*, the k-gram in it with
the smallest hash (leftmost on ties). The choice depends on the window's content
alone, so equal windows have equal anchors at equal offsets, wherever they stand.
Consecutive windows mostly share their anchor; such a run is a *segment*, and about
2 / (width - k + 2) segments cover a text. Segments with the same anchor key are all
that must come together to compare every pair of equal windows.

Everything here is per-task numpy on bounded slices; Spark does the grouping.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 20
_POSITION = np.uint64(SLICE - 1)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


_NONE = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer with good avalanche."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def byte_grams(data: bytes, k: int = 24) -> np.ndarray:
    """Hashes of all k-byte grams of `data`, k a multiple of 8 (little-endian loads)."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for at in range(0, k, 8):
        out = mix(out * _GOLD + np.ndarray((n,), "<u8", data, at, strides=(1,)))
    return out


def symbol_grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring 64-bit symbols."""
    n = max(0, len(symbols) - k + 1)
    out = symbols[:n]
    for i in range(1, k):
        out = mix(out * _GOLD + symbols[i : i + n])
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    if reach < width:
        out = np.minimum(out[: len(values) - width + 1], out[width - reach : width - reach + len(values) - width + 1])
    return out


def segments(grams: np.ndarray, ends: np.ndarray, width: int, k: int):
    """Segments of concatenated texts.

    `grams` are k-gram hashes over the concatenation (at most SLICE symbols), `ends`
    the exclusive end of each text. Returns (text number, first window start in the
    concatenation, number of windows, anchor key, anchor offset from the start), one
    entry per segment. Windows that cross a text's end belong to no segment.
    """
    reach = width - k + 1
    if len(grams) < reach:
        return _NONE
    ranked = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(ranked, reach) & _POSITION).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(ends, starts, side="right")
    valid = starts + width <= ends[np.minimum(text, len(ends) - 1)]
    starts, anchor, text = starts[valid], anchor[valid], text[valid]
    if not len(starts):
        return _NONE
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    runs = np.diff(np.r_[first, len(starts)])
    # Least hashes crowd near zero; mixed again, keys spread evenly over shards.
    return text[first], starts[first], runs, mix(grams[anchor[first]] + _GOLD), anchor[first] - starts[first]


class Prefix:
    """Prefix polynomial hashes of bytes, modulo 2^64 with an odd base.

    hash(start, end) takes arrays and costs two reads and one product a range. Equal
    bytes have equal hashes; callers verify where unequal bytes must not pass as equal.
    """

    _base = 0x9E3779B97F4A7C15
    _table = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
    #: The power of a position is that of its multiple of 4,096 times that of the rest, so
    #: the tables stay small however long the data are.
    _bits = 12
    _low = None

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    @classmethod
    def _fixed(cls):
        if cls._low is None:
            size, inverse = 1 << cls._bits, pow(cls._base, -1, 1 << 64)
            cls._low = cls._powers(cls._base, size), cls._powers(inverse, size)
        return cls._low

    def __init__(self, data: np.ndarray):
        n, size = len(data), 1 << self._bits
        blocks = n // size + 1
        low, self.low = self._fixed()
        high = self._powers(pow(self._base, size, 1 << 64), blocks)
        self.high = self._powers(pow(self._base, -size, 1 << 64), blocks)
        self.sums = np.zeros(n + 1, np.uint64)
        for i in range(blocks):
            part = self._table[data[i * size : (i + 1) * size]]
            self.sums[i * size + 1 : i * size + 1 + len(part)] = part * (low[: len(part)] * high[i])
        np.cumsum(self.sums, out=self.sums)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        power = self.low[start & ((1 << self._bits) - 1)] * self.high[start >> self._bits]
        return (self.sums[end] - self.sums[start]) * power
