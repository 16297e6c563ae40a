"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) are cut into whole windows, which are sequences of
their own, and a rest that is cut into parts of at most `part` tokens. Parts meet in
groups of bounded size, in the order their task reads them. Within a group each part
is a partial partition with one loaded window; the two partial partitions of largest
spread are merged over and over, largest loads against smallest, until one partition
of near-equal windows is left. If its fullest window exceeds the capacity, the window
count rises by one and the group is split anew.

Everything happens in the pass that tokenizes: no shuffle, no group that grows with
the input. Null and empty texts are the end id alone. Repeated or null doc_ids are
packed like any other rows.
"""

from __future__ import annotations

import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.arrowtools import groups
from lodestone.llm.pieces import Memo, pieces

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Splits items into `windows` lists of near-equal load (multiway differencing)."""
    heap = []
    for i, n in enumerate(sizes):
        loads = np.zeros(windows, np.int64)
        loads[0] = n
        heap.append((-n, i, loads, [[i], *[[] for _ in range(windows - 1)]]))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, own = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        loads = a + b[::-1]  # both are sorted, heaviest first
        mixed = [x + y for x, y in zip(own, reversed(other), strict=True)]
        by = np.argsort(-loads, kind="stable")
        loads = loads[by]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), order, loads, [mixed[i] for i in by.tolist()]))
        order += 1
    return heap[0][3] if heap else [[] for _ in range(windows)]


def pack_parts(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`; their count starts at the least possible."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        out = difference(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return [w for w in out if w]
        windows += 1


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, part: int = 512, group: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `part` bounds a piece of a document's last, partial window; smaller parts balance
    better and cut more. A group closes at `group` parts or, later, where its windows
    leave between 0.2 and 1 percent of room, and at four times `group` in any case.
    """

    def run(batches):
        encoder = _encoder(tokenizer_path)
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 33
        end = np.array([end_id], "<u4").tobytes()
        waiting: list[tuple] = []
        held = 0
        out: list[tuple] = []

        def close():
            nonlocal serial, held
            for window in pack_parts([w[2] for w in waiting], capacity):
                at = 0
                for i in window:
                    out.append((*waiting[i], serial, at))
                    at += waiting[i][2]
                serial += 1
            waiting.clear()
            held = 0

        def full() -> bool:
            if len(waiting) < group:
                return False
            room = -held % capacity
            return len(waiting) >= 4 * group or 0.002 * held <= room <= 0.01 * held

        for batch in batches:
            for rows in groups(batch, 1):
                for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    start = 0
                    while start < n:
                        length = capacity if n - start >= capacity else min(part, n - start)
                        piece = (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)
                        if length == capacity:
                            out.append((*piece, serial, 0))
                            serial += 1
                        else:
                            waiting.append(piece)
                            held += length
                            if full():
                                close()
                        start += length
                yield _batch(out)
                out.clear()
        close()
        yield _batch(out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


#: Fixed value: how byte-level pre-tokenization cuts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def check_settings(path: str, data: dict) -> None:
    """Raises an error unless a tokenizers file is plain byte-level BPE."""
    pre, model = data.get("pre_tokenizer") or {}, data["model"]
    wrong = [
        name
        for name, bad in {
            "normalizer": data.get("normalizer") is not None, "truncation or padding": bool(data.get("truncation") or data.get("padding")),
            "pre-tokenizer": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True),
            "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
            "added tokens": any(t.get(k) for t in data["added_tokens"] for k in ("lstrip", "rstrip", "single_word")),
            "merges": len({tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]}) != len({"".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]}),
        }.items()
        if bad
    ]
    if wrong:
        raise ValueError(f"{path}: not plain byte-level BPE: {', '.join(wrong)}")


def load_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, as an encoder by ranks.

    It gives the ids that the tokenizers library gives, special tokens in a text
    included, at a fraction of the time. Files with settings under which that would not
    hold, or with merges out of the order of the ids, are refused.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    check_settings(path, data)
    # Files write printable bytes as themselves and the others as the next free characters.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    ranks = {bytes(map(letters.__getitem__, token)): i for token, i in data["model"]["vocab"].items() if token not in special}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"]]
    order = [data["model"]["vocab"][m] for m in merges]
    if order != sorted(order):
        raise ValueError(f"{path}: merges are not in the order of the ids")
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class PieceEncoder:
    """Texts to little-endian ids, with a memo of encoded pieces."""

    def __init__(self, path: str):
        encode = load_encoding(path).encode
        self.memo = Memo(lambda piece: np.array(encode(piece, allowed_special="all"), "<u4").tobytes(), bound=150_000)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(map(self.memo.__getitem__, pieces(t or ""))) for t in texts]


_ENCODERS: dict = {}


def _encoder(path: str) -> PieceEncoder:
    """One tokenizer and memo per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
