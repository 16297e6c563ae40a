"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a
vocabulary entry is resolved by one probe and one comparison. Tier two, for misses,
merges a linked list of bytes, taking the pair of least rank from a heap.

Nulls encode as the empty text. Empty texts have no tokens and the digest of nothing.
Null or repeated doc_ids are carried through unchanged, one output row per input row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from lodestone.llm.arrowtools import map_texts
from lodestone.llm.pieces import Memo, pieces

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: base64 token and decimal rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash by displacement: n keys fill n slots, two array reads a probe."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = max(1, len(keys))
        self.buckets = max(1, -(-len(keys) // per_bucket))
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots: list[bytes | None] = [None] * self.n
        free = set(range(self.n))
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) > 1:
                shift = 0
                while True:
                    at = {self._place(hashes[i], shift) for i in own}
                    if len(at) == len(own) and at <= free:
                        break
                    shift += 1
                self.shift[b] = shift
                places = [self._place(hashes[i], shift) for i in own]
            elif own:
                places = [next(iter(free))]
                self.shift[b] = -1 - places[0]
            else:
                continue
            for i, slot in zip(own, places, strict=True):
                self.slots[slot] = keys[i]
                free.discard(slot)
        self.shift = self.shift.tolist()

    def _place(self, h: int, shift: int) -> int:
        x = (h + shift * _STEP) & _MASK
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
        return (x ^ (x >> 29)) % self.n

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 if it is no key."""
        h = xxhash.xxh64_intdigest(key)
        shift = self.shift[h % self.buckets]
        at = -1 - shift if shift < 0 else self._place(h, shift)
        return at if self.slots[at] == key else -1


class ByteBpe:
    """Encoder and decoder over one rank table and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.table = table or PerfectHash(list(ranks))
        self.slot_ids = [ranks.get(k, 0) for k in self.table.slots]
        self.tokens = {i: token for token, i in ranks.items()}
        self._memo = Memo(lambda piece: np.array(self._piece(piece), "<u4").tobytes())
        self._decimals, self._bytes = None, None
        self._pretokens = Memo(self._pretoken)

    def merge(self, data: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary.

        The heap holds rank and start of each pair as one number; `live` has the rank of
        the pair that starts at a symbol now, so older entries are told from it.
        """
        n, get = len(data), self.ranks.get
        stop = list(range(1, n + 1))  # end of the symbol that starts here
        before = list(range(-1, n - 1))
        live = [get(data[i : i + 2], -1) for i in range(n - 1)]
        live.append(-1)
        shift = n.bit_length()
        low = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(live) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i = x & low
            if live[i] != x >> shift:
                continue  # one side has been merged since
            middle = stop[i]
            end = stop[i] = stop[middle]
            live[middle] = live[i] = -1
            if end < n:
                before[end] = i
                if (r := get(data[i : stop[end]])) is not None:
                    live[i] = r
                    push(heap, r << shift | i)
            if (left := before[i]) >= 0:
                live[left] = r = get(data[left:end], -1)
                if r >= 0:
                    push(heap, r << shift | left)
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[data[i : stop[i]]])
            i = stop[i]
        return ids

    def _pretoken(self, pretoken: str) -> list[int]:
        data = pretoken.encode()
        at = self.table.slot(data)
        return [self.slot_ids[at]] if at >= 0 else self.merge(data)

    def _piece(self, piece: str) -> list[int]:
        found = self.find(piece)
        if len(found) == 1:
            return self._pretokens[found[0]]
        return [i for pretoken in found for i in self._pretokens[pretoken]]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._memo.__getitem__, pieces(text or ""))), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def written(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, bytes]]:
        """Per text: count of its ids, the ids as decimals joined by commas, and the bytes
        decoded from them. Decimals and bytes are spelled for all texts at once."""
        if self._decimals is None:
            n = max(self.tokens, default=-1) + 1
            self._decimals = Spelling([b",%d" % i for i in range(n)])
            self._bytes = Spelling([self.tokens.get(i, b"") for i in range(n)])
        parts = [b"".join(map(self._memo.__getitem__, pieces(t or ""))) for t in texts]
        cuts = np.cumsum([0, *(len(p) // 4 for p in parts)])
        ids = np.frombuffer(b"".join(parts), "<u4")
        (a, a_cuts), (b, b_cuts) = self._decimals.spell(ids, cuts), self._bytes.spell(ids, cuts)
        for i in range(len(texts)):
            yield int(cuts[i + 1] - cuts[i]), a[a_cuts[i] + 1 : a_cuts[i + 1]], b[b_cuts[i] : b_cuts[i + 1]]


class Spelling:
    """Byte strings by number, laid end to end, so that many are joined by one gather."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def spell(self, ids: np.ndarray, cuts: np.ndarray, slab: int = 1 << 18) -> tuple[bytes, list[int]]:
        """The strings of all ids, and where those of ids[cuts[i]] begin."""
        out, ends = [], np.concatenate([[0], np.cumsum(self.sizes[ids])])
        for i in range(0, len(ids), slab):
            part = ids[i : i + slab]
            sizes = self.sizes[part]
            shift = self.starts[part] - (np.cumsum(sizes) - sizes)
            out.append(self.data[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)].tobytes())
        return b"".join(out), ends[cuts].tolist()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and the bytes decoded from them, one row per document."""
    sent = _send(docs, ranks_path)

    def make():
        bpe = _codec(sent, ranks_path, pattern)

        def run(doc_ids, texts):
            ids = [bpe.encode(t) for t in texts]
            return {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
                "decoded": pa.array([bpe.decode(i.tolist()) for i in ids], pa.binary()),
            }

        return run

    return map_texts(docs, ["doc_id", "text"], "doc_id long, ids array<int>, decoded binary", make)


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them.

    The digests are taken where the ids are made, so ids are never shuffled or stored.
    """
    sent = _send(docs, ranks_path)

    def make():
        bpe = _codec(sent, ranks_path, pattern)

        def run(doc_ids, texts):
            counts, hashes, decoded = [], [], []
            for count, ids, back in bpe.written(texts):
                counts.append(count)
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
            return {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

        return run

    return map_texts(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def _send(docs: DataFrame, ranks_path: str):
    """Ranks and their perfect hash for the workers: one vocabulary file, a fixed size."""
    ranks = load_ranks(ranks_path)
    return docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(list(ranks))))


_CODECS: dict = {}


def _codec(sent, ranks_path: str, pattern: str) -> ByteBpe:
    """One codec per worker process; tables and memo outlive a task."""
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS.clear()
        ranks, table = sent.value
        _CODECS[key] = ByteBpe(ranks, pattern, table)
    return _CODECS[key]
