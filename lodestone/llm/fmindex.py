"""Substring dedup by a compressed FM-index per shard.

A shard's distinct contents are joined, each behind a separator, and indexed: the
Burrows-Wheeler transform in a wavelet tree (a few packed bits a word; counts are 16 bits
per 64, on top of one full count per 65,536), and the lengths of common prefixes of
neighbouring suffixes in a byte each, or four where contents are longer than 255 words, with
their minima per 32: under five bytes a word where there are 65,536 different ones, beside a
count for each of these. The suffix
array that these are made from is dropped.

Contents are then streamed against the index, each once from right to left: a backward
search step extends the match by the word before it; where fewer than two places are left
the match is shortened to the next length at which more places share it, and the step is
tried again. This gives at each word its matching statistic: how many words from here also
stand elsewhere in the shard, with the suffix interval of those places. Where it reaches
the threshold of `width` words the interval is reported, widened to all suffixes that share
`width` words; the earliest document that reports an interval answers for all of it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lodestone.llm import repeats

#: Common prefixes whose least is kept together.
BLOCK = 32


class WaveletTree:
    """Rank over an integer sequence: one packed bit vector per level (level order)."""

    #: A full count for each 2^SPAN words of 64 bits, whose own counts fit 16 bits.
    SPAN = 10

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.words, self.base, self.ranks, self.zeros = [], [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]
            base = before[:: 1 << self.SPAN]
            self.words.append(words)
            self.base.append(base)
            self.ranks.append((before - np.repeat(base, 1 << self.SPAN)[: len(before)]).astype(np.uint16))
            self.zeros.append(int(self.n - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.base[level][word >> self.SPAN] + self.ranks[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def nbytes(self) -> int:
        return sum(a.nbytes for part in (self.words, self.base, self.ranks) for a in part)

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before `start` and before `at`."""
        low, high = start, at
        base = np.zeros(len(symbol), np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b, c = (self._ones(level, x) for x in (low, high, base))
            zero = self.zeros[level]
            low, high, base = np.where(one, zero + a, low - a), np.where(one, zero + b, high - b), np.where(one, zero + c, base - c)
        return low - base, high - base


def suffix_array(values: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols or more, by prefix doubling."""
    n = len(values)
    rank = values.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        both = rank * (int(after.max()) + 1) + after
        order = np.argsort(both, kind="stable")
        both = both[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[0, both[1:] != both[:-1]])
        rank, step = fresh, step * 2
        if rank.max() == n - 1:
            break
    return order


class FmIndex:
    """FM-index over contents (lists of symbols >= 1), each closed by the separator 0.

    Suffixes are ordered by more symbols than the longest content has, so the interval of
    any string without a separator is exact.
    """

    def __init__(self, values: np.ndarray, longest: int):
        order = suffix_array(values, longest + 1)
        self.n, self.size = len(values), int(values.max()) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(values, minlength=self.size))]
        self.tree = WaveletTree(values[order - 1], max(1, int(self.size - 1).bit_length()))
        # common[i]: how many symbols suffixes i - 1 and i share before a separator; 0 at both ends.
        kind = np.uint8 if longest < 256 else np.uint32
        common = np.zeros(self.n + 1, kind)
        same, a, b = np.arange(1, self.n), order[:-1], order[1:]
        for d in range(longest):
            x, y = values[a + d], values[b + d]
            on = (x == y) & (x > 0)
            same, a, b = same[on], a[on], b[on]
            if not len(same):
                break
            common[same] += 1
        self.common = common
        # least[j][i]: the least common prefix in blocks i .. i + 2^j - 1
        padded = np.zeros(-(-len(common) // BLOCK) * BLOCK, kind)
        padded[: len(common)] = common
        self.least = [padded.reshape(-1, BLOCK).min(axis=1)]
        while 2 << (len(self.least) - 1) <= len(self.least[0]):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def nbytes(self) -> int:
        return self.tree.nbytes() + self.common.nbytes + self.first.nbytes + sum(a.nbytes for a in self.least)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the matches with a symbol put before them."""
        a, b = self.tree.rank(symbol, high, low)
        return self.first[symbol] + a, self.first[symbol] + b

    def _reach(self, at: np.ndarray, length: np.ndarray, step: int) -> np.ndarray:
        """Moves each place by `step` (1 or -1) while its common prefix has `length` (1 or
        more): word by word within its block, over whole blocks by their minima, and word by
        word in the block that it ends in."""
        at, last = at.copy(), BLOCK - 1 if step < 0 else 0

        def walk(live, over):
            """Word by word; with `over`, those that come to the next block, which are left there."""
            out = []
            while len(live):
                at[live] += step
                live = live[self.common[at[live]] >= length[live]]
                if over:
                    edge = at[live] % BLOCK == last
                    out.append(live[edge])
                    live = live[~edge]
            return np.concatenate(out) if out else live

        far = walk(np.flatnonzero(self.common[at] >= length), True)
        if len(far):
            block, need = at[far] // BLOCK, length[far]
            for j in range(len(self.least) - 1, -1, -1):
                table, jump = self.least[j], 1 << j
                start = block - jump + 1 if step < 0 else block
                on = (start >= 0) & (start < len(table)) & (table[np.clip(start, 0, len(table) - 1)] >= need)
                block = np.where(on, block + step * jump, block)
            at[far] = block * BLOCK + last
            walk(far[self.common[at[far]] >= need], False)
        return at

    def widen(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all suffixes that share `length` symbols (1 or more) with these."""
        return self._reach(low, length, -1), self._reach(high, length, 1)

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider intervals, with the lengths of their matches."""
        length = np.maximum(self.common[low], self.common[high]).astype(np.int64)
        low, high = self.widen(low, high, np.maximum(length, 1))
        return np.where(length > 0, low, 0), np.where(length > 0, high, self.n), length

    def statistics(self, values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per position of the streamed contents: the greatest length that occurs twice or
        more in the index, and the lower end of its suffix interval."""
        longest, lower = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        low, high, length = np.zeros(len(begin), np.int64), np.full(len(begin), self.n), np.zeros(len(begin), np.int64)
        at, live = begin + sizes, np.flatnonzero(sizes > 0)
        while len(live):
            a, b = self.extend(values[at[live] - 1], low[live], high[live])
            on = b - a >= 2
            go, stay = live[on], live[~on]
            low[go], high[go] = a[on], b[on]
            length[go] += 1
            at[go] -= 1
            longest[at[go]], lower[at[go]] = length[go], low[go]
            lost, short = stay[length[stay] == 0], stay[length[stay] > 0]
            at[lost] -= 1  # not even the word alone occurs twice
            low[short], high[short], length[short] = self.shorten(low[short], high[short])
            live = live[at[live] > begin[live]]
        return longest, lower


def earliest(contents, key, anchor, runs, doc, start, width: int):
    """Earliest (document, start) of every window of every content of a shard.

    A content alone under its key can match no other; the rest is indexed and streamed.
    """
    owner, offset = repeats.window_places(runs)
    first_doc, first_start = doc[owner], start[owner] + offset
    indexed = repeats.meeting(key)
    if not len(indexed):
        return first_doc, first_start
    ids: dict[bytes, int] = {}
    lists = [[ids.setdefault(w, len(ids) + 1) for w in contents[i].split(b" ")] for i in indexed.tolist()]
    sizes = np.array([len(x) for x in lists])
    values = np.concatenate([np.array([*x, 0], np.int64) for x in lists])
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    local = np.full(len(contents), -1)
    local[indexed] = np.arange(len(indexed))
    asked = np.flatnonzero(local[owner] >= 0)
    index = FmIndex(values, int(sizes.max()))
    longest, lower = index.statistics(values, begin, sizes)
    place = begin[local[owner[asked]]] + offset[asked]
    hit = np.flatnonzero(longest[place] >= width)
    if len(hit):
        low, _ = index.widen(lower[place[hit]], lower[place[hit]] + 1, np.full(len(hit), width))
        window = asked[hit]
        group = np.unique(low, return_inverse=True)[1]
        by = np.argsort(group, kind="stable")
        window, group = window[by], group[by]
        best = repeats._earliest(group, first_doc[window], first_start[window])[group]
        first_doc[window], first_start[window] = first_doc[window[best]], first_start[window[best]]
    return first_doc, first_start


def substring_dedup(docs: DataFrame, width: int = 13, carry: tuple[str, ...] = (), part_bytes: int = repeats.PART_BYTES, **hot_options) -> DataFrame:
    """doc_id, n_units (words), n_removed, n_spans, kept (words joined by a space).

    Removes words inside windows of `width` words whose sequence also starts in a
    document of smaller id.
    """
    schema = ", ".join([repeats.SPAN_SCHEMA, *(f"{c} {dict(docs.dtypes)[c]}" for c in carry)])
    return repeats.covered_spans(docs, repeats.Words(width), earliest, repeats.finish_documents, schema, False, carry, part_bytes, **hot_options)
