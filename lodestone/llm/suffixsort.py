"""Suffix-array dedup by a hash-compared suffix sort.

Equal windows share their anchor at the same offset, so a shard's suffixes fall into
buckets by (anchor key, offset) and only suffixes of a bucket are sorted. Suffixes whose
head has the hash of no other in the bucket are in no repeat and left out. The sort is a
bottom-up mergesort over all buckets at once. Two suffixes are compared by the length
of their common extension, found by binary search over prefix polynomial hashes, and
the byte behind it: a logarithmic number of hash comparisons. Neighbours that compare
equal over the whole window are verified byte by byte; a bucket with a collision is
sorted again by its bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lodestone.llm import repeats
from lodestone.llm.anchors import _GOLD, Prefix, mix


class Comparer:
    """Three-way comparison of `width`-byte suffix heads at many positions at once."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width, self.prefix = data, width, Prefix(data)

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of positions."""
        out = np.zeros(len(a), np.int8)
        w = self.width
        open_ = np.flatnonzero(self.prefix.hash(a, a + w) != self.prefix.hash(b, b + w))
        a, b = a[open_], b[open_]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), w - 1)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.prefix.hash(a, a + middle) == self.prefix.hash(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[open_] = np.where(self.data[a + low] < self.data[b + low], -1, 1)
        return out


def merge_sort(positions: np.ndarray, first: np.ndarray, size: np.ndarray, compare) -> np.ndarray:
    """Sorts each bucket (contiguous; `first` and `size` per element) by `compare`.

    Each level merges runs of neighbours: an element's place is its rank in its own run
    plus its rank in the sibling run, found by binary search.
    """
    n = len(positions)
    index = np.arange(n)
    inside = index - first
    run = 1
    while n and run < size.max():
        base = inside // (2 * run) * (2 * run)
        right = inside - base >= run
        sibling = np.where(right, base, base + run)
        low = np.minimum(sibling, size)
        start = low.copy()
        high = np.minimum(sibling + run, size)
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            order = compare(positions[first[live] + middle], positions[live])
            before = (order < 0) | (right[live] & (order == 0))  # left runs win ties
            low[live] = np.where(before, middle + 1, low[live])
            high[live] = np.where(before, high[live], middle)
            live = live[low[live] < high[live]]
        own = np.where(right, inside - base - run, inside - base)
        out = np.empty_like(positions)
        out[first + base + own + (low - start)] = positions
        positions, run = out, run * 2
    return positions


def sort_buckets(positions: np.ndarray, heads: np.ndarray, sizes: np.ndarray, compare, limit: int = 1 << 18) -> np.ndarray:
    """Sorts whole buckets, about `limit` suffixes at a time, so that the sort's memory is
    small and only the neighbours of a large bucket go through its levels."""
    out = np.empty_like(positions)
    slab = heads // limit
    cuts = np.flatnonzero(np.r_[True, slab[1:] != slab[:-1], True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        low, size = int(heads[a]), sizes[a:b]
        high = int(heads[b - 1] + size[-1])
        out[low:high] = merge_sort(positions[low:high], np.repeat(heads[a:b] - low, size), np.repeat(size, size), compare)
    return out


def earliest(contents, key, anchor, runs, doc, start, width: int):
    """Earliest (document, start) of every window of every content of a shard."""
    owner, offset = repeats.window_places(runs)
    first_doc, first_start = doc[owner], start[owner] + offset
    shared = np.zeros(len(contents), bool)
    meet = repeats.meeting(key)  # a content alone under its key has nothing to be sorted against
    shared[meet] = True
    suffix = np.flatnonzero(shared[owner])
    if not len(suffix):
        return first_doc, first_start
    data = np.frombuffer(b"".join([contents[i] for i in meet.tolist()]), np.uint8)
    begin = np.zeros(len(contents), np.int64)
    begin[meet[1:]] = np.cumsum([len(contents[i]) for i in meet[:-1].tolist()])
    number = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    shift = anchor[owner[suffix]] - offset[suffix]  # from the suffix to its anchor
    bucket = number[owner[suffix]] * (int(shift.max()) + 1) + shift
    comparer = Comparer(data, width)
    place = begin[owner[suffix]] + offset[suffix]
    # A suffix whose head has a hash of its own in its bucket equals no other: the rest is sorted.
    heads_hash = mix(comparer.prefix.hash(place, place + width) + bucket.astype(np.uint64) * _GOLD)
    order = np.argsort(heads_hash)
    twin = heads_hash[order][1:] == heads_hash[order][:-1]
    order = order[np.r_[False, twin] | np.r_[twin, False]]
    order = order[np.argsort(bucket[order], kind="stable")]
    suffix, bucket, place = suffix[order], bucket[order], place[order]
    if not len(suffix):
        return first_doc, first_start
    new = np.r_[True, bucket[1:] != bucket[:-1]]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.r_[heads, len(bucket)])
    group = np.cumsum(new) - 1
    at = sort_buckets(place, heads, sizes, comparer.compare)
    by_place = np.argsort(place, kind="stable")
    suffix = suffix[by_place[np.searchsorted(place[by_place], at)]]
    same = np.zeros(len(at), bool)
    pairs = np.flatnonzero(group[1:] == group[:-1])
    pairs = pairs[comparer.prefix.hash(at[pairs], at[pairs] + width) == comparer.prefix.hash(at[pairs + 1], at[pairs + 1] + width)]
    reach = np.arange(width)
    for i in range(0, len(pairs), 1 << 14):
        part = pairs[i : i + (1 << 14)]
        equal = (data[at[part, None] + reach] == data[at[part + 1, None] + reach]).all(axis=1)
        same[part[equal] + 1] = True
        for g in np.unique(group[part[~equal]]).tolist():  # a collision: sort by bytes
            a, b = heads[g], heads[g] + sizes[g]
            again = sorted(range(a, b), key=lambda x: data[at[x] : at[x] + width].tobytes())
            at[a:b], suffix[a:b] = at[again], suffix[again]
            same[a + 1 : b] = [data[at[x] : at[x] + width].tobytes() == data[at[x - 1] : at[x - 1] + width].tobytes() for x in range(a + 1, b)]
    cluster = np.cumsum(~same) - 1
    least = repeats._earliest(cluster, first_doc[suffix], first_start[suffix])[cluster]
    best_doc, best_start = first_doc[suffix[least]], first_start[suffix[least]]
    first_doc[suffix], first_start[suffix] = best_doc, best_start
    return first_doc, first_start


def suffix_dedup(docs: DataFrame, width: int = 100, carry: tuple[str, ...] = (), as_text: bool = False, part_bytes: int = repeats.PART_BYTES, **hot_options) -> DataFrame:
    """doc_id, n_units (bytes), n_removed, n_spans, kept (the remaining bytes).

    Removes bytes covered by a string of `width` bytes that also starts earlier. With
    `as_text` kept is a string, without the characters of which a part was removed.
    """
    finish = repeats.finish_texts if as_text else repeats.finish_documents
    kind = repeats.SPAN_SCHEMA.replace("binary", "string") if as_text else repeats.SPAN_SCHEMA
    schema = ", ".join([kind, *(f"{c} {dict(docs.dtypes)[c]}" for c in carry)])
    return repeats.covered_spans(docs, repeats.Bytes(width), earliest, finish, schema, True, carry, part_bytes, **hot_options)
