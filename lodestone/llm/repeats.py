"""The Spark plan that finds which windows of a text occurred earlier in the corpus.

Two operators share it: one over 13-word windows with an FM-index per shard, one over
100-byte windows with a suffix sort per shard. The steps, all on grouped Arrow tables:

0. Anchors with very many distinct contents (a line that a third of the documents have)
   are found by counting a share of all contents, by their digests. Segments under such
   an anchor are split by the distance of the window to the anchor and by the bytes that
   all windows of that distance have in common; equal windows still meet, and contents
   that keep a key differ in three bytes (one word) before and behind those at most.
1. Documents are dealt into parts by a hash; this is the only shuffle of texts, and the
   same exchange serves steps 1, 3 and 5. A part lists its distinct segments (see
   `anchors`): key, content hash, earliest (document, start). Lists go to shards by key.
2. A shard knows which keys occur more than once and asks one part for each distinct
   content of such a key.
3. Parts send the contents asked for.
4. A shard indexes its distinct contents and finds, for every window in them, the
   earliest place where it starts. Copies count once however many there are.
5. The answers go back to the parts, which mark the covered units of each document.

Nothing but the hot anchors (at most HOT_MOST) is collected to the driver. The number of
parts and of shards grows with the bytes of the texts, so that a part or a shard stays
small; a list from a part to a shard has one segment at least, so their number is never
above that of the segments. Null texts are empty. Null
doc_ids sort before all others and count as one document, as do rows that share a
doc_id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import anchors
from lodestone.llm.arrowtools import map_texts

PACK = 1 << 16
PART_BYTES = 4 << 20
#: An anchor with this many distinct contents is hot; one in HOT_SHARE of all contents is
#: counted (by digest), and at most HOT_MOST anchors, the hottest, are sent to the tasks.
HOT_CONTENTS, HOT_SHARE, HOT_MOST = 4096, 16, 100_000
NO_ID = -(1 << 63)


class Bytes:
    """Windows of `width` bytes; a unit is a byte."""

    #: Bytes of a gram; distances to a hot anchor that stay together.
    k, near = 24, 4

    def __init__(self, width: int = 100):
        self.width = width

    def units(self, text: str | None):
        """(data, unit starts or None if a unit is a byte, number of units)."""
        data = (text or "").encode()
        return data, None, len(data)

    def grams(self, data: bytes, prefix: anchors.Prefix, starts) -> np.ndarray:
        return anchors.byte_grams(data, self.k)


class Words:
    """Windows of `width` words, which are joined by one space; a unit is a word."""

    k, near = 4, 2

    def __init__(self, width: int = 13):
        self.width = width

    def units(self, text: str | None):
        words = (text or "").encode().split()
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return b" ".join(words), np.concatenate([[0], stops]), len(words)

    def grams(self, data: bytes, prefix: anchors.Prefix, starts) -> np.ndarray:
        return anchors.symbol_grams(anchors.mix(prefix.hash(starts[:-1], starts[1:] - 1)), self.k)


class Segments:
    """All segments of some texts, as arrays: text, start, runs, key, anchor, digest.

    Those under one of the `hot` keys (ascending) are split, see `_split`."""

    def __init__(self, scheme, texts: list[str | None], hot: np.ndarray | None = None):
        self.scheme, self.hot = scheme, np.empty(0, np.uint64) if hot is None else hot
        self.sources = [scheme.units(t) for t in texts]
        found, waiting, held = [], [], 0
        for i, (_, _, n) in enumerate(self.sources):
            if n < scheme.width:
                continue
            if held and held + n > PACK:
                found.append(self._scan(waiting))
                waiting, held = [], 0
            if n > PACK:  # windows that start in each slice
                for a in range(0, n - scheme.width + 1, PACK):
                    found.append(self._scan([(i, a, min(n, a + PACK + scheme.width - 1))]))
            else:
                waiting.append((i, 0, n))
                held += n
        found.append(self._scan(waiting))
        self.text, self.start, self.runs, self.key, self.anchor, self.digest = (np.concatenate(x) for x in zip(*found, strict=True))

    def _scan(self, slices):
        scheme, parts, marks, at = self.scheme, [], [], 0
        if not slices:
            return *anchors._NONE, np.empty(0, np.uint64)
        for i, a, b in slices:
            data, starts, _ = self.sources[i]
            if starts is None:
                parts.append(data[a:b])
            else:
                parts.append(data[starts[a] : starts[b] - 1])
                marks.append(starts[a:b] - starts[a] + at)
                at += int(starts[b] - starts[a])
        data = (b" " if marks else b"").join(parts)
        starts = np.concatenate([*marks, [at]]) if marks else None
        prefix = anchors.Prefix(np.frombuffer(data, np.uint8))
        sizes = np.array([b - a for _, a, b in slices])
        ends = np.cumsum(sizes)
        text, start, runs, key, anchor = anchors.segments(scheme.grams(data, prefix, starts), ends, scheme.width, scheme.k)

        def digest(a, b):
            """Of the units a to b, both arrays."""
            h = prefix.hash(a, b) if starts is None else prefix.hash(starts[a], starts[b] - 1)
            return anchors.mix(h + (b - a).astype(np.uint64) * anchors._GOLD)

        if len(self.hot) and len(key):
            text, start, runs, key, anchor = self._split(text, start, runs, key, anchor, digest)
        own = digest(start, start + runs + scheme.width - 1)
        number, first = np.array([i for i, _, _ in slices]), np.array([a for _, a, _ in slices])
        return number[text], start - (ends - sizes)[text] + first[text], runs, key, anchor, own

    def _split(self, text, start, runs, key, anchor, digest):
        """Cuts the segments under hot keys into runs of windows with nearly one distance to
        the anchor. The new key is made of the old one, the range of the distance and the
        units which all windows of the range have in common, so equal windows share it."""
        near, width = self.scheme.near, self.scheme.width
        is_hot = self.hot[np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)] == key
        cold, of = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
        if not len(of):
            return text, start, runs, key, anchor
        owner, offset = window_places(runs[of])
        owner = of[owner]
        reach = (anchor[owner] - offset) // near
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (reach[1:] != reach[:-1])]))
        owner, offset, reach, count = owner[new], offset[new], reach[new], np.diff(np.append(new, len(owner)))
        core = start[owner] + anchor[owner] - reach * near
        again = anchors.mix(key[owner] + anchors.mix(digest(core, core + width - near + 1) + reach.astype(np.uint64) * anchors._GOLD))
        pieces = text[owner], start[owner] + offset, count, again, anchor[owner] - offset
        return tuple(np.concatenate([whole[cold], piece]) for whole, piece in zip((text, start, runs, key, anchor), pieces, strict=True))

    def content(self, i: int) -> bytes:
        data, starts, _ = self.sources[self.text[i]]
        a = int(self.start[i])
        b = a + int(self.runs[i]) + self.scheme.width - 1
        return data[a:b] if starts is None else data[starts[a] : starts[b] - 1]

    def distinct(self, doc: np.ndarray, blocks: int):
        """Order and bounds of the distinct (shard, key, digest), the earliest first in each."""
        owner = doc[self.text] if len(self.text) else np.empty(0, np.int64)
        order = np.lexsort((self.start, owner, self.digest, self.key))
        key, digest = self.key[order], self.digest[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])] if len(key) else np.empty(0, bool)
        first = np.flatnonzero(new)
        block = ((key[first] >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(block, np.arange(blocks + 1))
        return order, new, first, owner, cut


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, which the shuffle's codec compresses well."""
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)


def _unpack(blob: bytes, n: int, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        size = np.dtype(t).itemsize * n
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, size, at).reshape(-1, n).T).view(t).ravel() if n else np.empty(0, t))
        at += size
    return out


_LIST = ("<u8", "<u8", "<i8", "<i4", "u1")
_BLOB = "block int, part long, n int, blob binary"


def _table(rows: list[tuple]) -> pa.Table:
    block, part, n, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"block": pa.array(block, pa.int32()), "part": pa.array(part, pa.int64()), "n": pa.array(n, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _documents(rows: pa.Table):
    doc = np.array([NO_ID if i is None else i for i in rows.column("doc_id").to_pylist()], np.int64)
    return doc, rows.column("text").to_pylist()


def _rows(table: pa.Table):
    return zip(*(table.column(c).to_pylist() for c in ("block", "part", "n", "blob")), strict=True)


def hot_keys(docs: DataFrame, scheme, contents: int = HOT_CONTENTS, share: int = HOT_SHARE, most: int = HOT_MOST) -> np.ndarray:
    """Keys, ascending, that at least about `contents` distinct contents have.

    All texts are read; of their contents one in `share`, by digest, is counted. What is
    found only moves work between tasks: results are the same for any list of keys.
    """

    def make():
        def run(texts):
            s = Segments(scheme, texts)
            pick = np.flatnonzero(s.digest % np.uint64(share) == 0)
            pair = np.unique(np.stack([s.key[pick], s.digest[pick]], axis=1), axis=0)
            return {"key": pa.array(pair[:, 0].view(np.int64)), "digest": pa.array(pair[:, 1].view(np.int64))}

        return run

    seen = map_texts(docs, ["text"], "key long, digest long", make).distinct()
    counted = seen.groupBy("key").count().where(F.col("count") * share >= contents)
    rows = counted.orderBy(F.desc("count"), "key").limit(most).collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def covered_spans(docs: DataFrame, scheme, index: Callable, finish: Callable, schema: str, same_document: bool, carry: tuple[str, ...] = (), part_bytes: int = PART_BYTES, **hot_options) -> DataFrame:
    """Runs the plan; `finish(units, spans)` makes the output columns of a document.

    `index(contents, key, anchor, runs, doc, start, width)` answers for a shard with, per
    content, the earliest document and start of each window (two arrays per content).
    With `same_document`, an earlier start in the same document counts as earlier.
    `carry` columns are copied to the output. `hot_options` go to `hot_keys`.
    """
    hot = docs.sparkSession.sparkContext.broadcast(hot_keys(docs, scheme, **hot_options))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // part_bytes))
    blocks = int(parts)
    width = scheme.width
    dealt = docs.select("doc_id", "text", *carry, F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("part")).repartition("part")

    def list_segments(key, rows):
        part = key[0].as_py()
        doc, texts = _documents(rows)
        s = Segments(scheme, texts, hot.value)
        order, new, first, owner, cut = s.distinct(doc, blocks)
        many = np.diff(np.r_[first, len(order)]) > 1
        lead = order[first]
        columns = (s.key[lead], s.digest[lead], owner[lead] if len(lead) else owner, s.start[lead].astype("<i4"), many.astype("u1"))
        return _table([(b, part, int(cut[b + 1] - cut[b]), _pack(*(c[cut[b] : cut[b + 1]] for c in columns))) for b in range(blocks) if cut[b + 1] > cut[b]])

    def read_lists(rows):
        got = list(_rows(rows))
        part = np.repeat(np.array([p for _, p, _, _ in got], np.int64), [n for _, _, n, _ in got])
        at = np.concatenate([np.arange(n) for _, _, n, _ in got]) if got else np.empty(0, np.int64)
        columns = [np.concatenate(c) for c in zip(*(_unpack(blob, n, *_LIST) for _, _, n, blob in got), strict=True)] if got else [np.empty(0, t) for t in _LIST]
        content, digest, doc, start, many = columns
        order = np.lexsort((part, digest, content))
        content, digest, doc, start, many, part, at = (c[order] for c in (content, digest, doc, start, many, part, at))
        new_key = np.r_[True, content[1:] != content[:-1]] if len(content) else np.empty(0, bool)
        new = new_key | np.r_[True, digest[1:] != digest[:-1]] if len(content) else new_key
        group = np.cumsum(new_key) - 1
        shared = (np.bincount(group) > 1) | (np.bincount(group, many) > 0) if len(group) else np.empty(0, bool)
        return content, doc, start, part, at, new, shared[group] if len(group) else np.empty(0, bool)

    def choose_owners(key, rows):
        _, _, _, part, at, new, shared = read_lists(rows)
        ask = new & shared
        block = key[0].as_py()
        part, at = part[ask], at[ask]
        order = np.lexsort((at, part))
        part, at = part[order], at[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else [0]
        return _table([(block, int(part[a]), int(b - a), at[a:b].astype("<i4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def send_contents(key, rows, asked):
        if not rows.num_rows or not asked.num_rows:
            return _table([])
        part = key[0].as_py()
        doc, texts = _documents(rows)
        s = Segments(scheme, texts, hot.value)
        order, _, first, _, cut = s.distinct(doc, blocks)
        out = []
        for block, _, n, blob in _rows(asked):
            at = np.frombuffer(blob, "<i4")
            lead = order[first[cut[block] + at]]
            contents = [s.content(i) for i in lead.tolist()]
            sizes = np.array([len(c) for c in contents], "<i4")
            out.append((block, part, n, _pack(at.astype("<i4"), sizes, s.runs[lead].astype("<i4"), s.anchor[lead].astype("<i4")) + b"".join(contents)))
        return _table(out)

    def answer(key, lists, sent):
        block = key[0].as_py()
        if not lists.num_rows or not sent.num_rows:
            return _table([])
        content, doc, start, part, at, new, shared = read_lists(lists)
        body = {}
        for _, p, n, blob in _rows(sent):
            spots, sizes, runs, anchor = _unpack(blob, n, "<i4", "<i4", "<i4", "<i4")
            offset = 16 * n
            for spot, size, r, a in zip(spots.tolist(), sizes.tolist(), runs.tolist(), anchor.tolist(), strict=True):
                body[p, spot] = (blob[offset : offset + size], r, a)
                offset += size
        number = np.cumsum(new) - 1
        lead = np.flatnonzero(new & shared)
        least = _earliest(number, doc, start)[number[lead]] if len(lead) else lead
        found = [body[p, i] for p, i in zip(part[lead].tolist(), at[lead].tolist(), strict=True)]
        runs = np.array([r for _, r, _ in found], np.int64)
        first_doc, first_start = index([c for c, _, _ in found], content[lead], np.array([a for _, _, a in found], np.int64), runs, doc[least], start[least].astype(np.int64), width)
        starts = np.r_[0, np.cumsum(runs)[:-1]].astype(np.int64)
        # Neighbouring windows whose earliest places are neighbours too form one run.
        split = np.ones(len(first_doc), bool)
        if len(split):
            split[1:] = (first_doc[1:] != first_doc[:-1]) | (first_start[1:] != first_start[:-1] + 1)
            split[starts] = True
        run = np.flatnonzero(split)
        run_owner = np.searchsorted(starts, run, side="right") - 1
        low = np.searchsorted(run_owner, np.arange(len(starts) + 1))
        offsets = run - starts[run_owner]
        place = np.full(int(number[-1]) + 1, -1)
        place[number[lead]] = np.arange(len(lead))
        rows = np.flatnonzero(shared)
        rows = rows[np.lexsort((at[rows], part[rows]))]
        cuts = np.flatnonzero(np.r_[True, part[rows][1:] != part[rows][:-1], True]) if len(rows) else [0]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = rows[a:b]
            c = place[number[own]]
            counts = low[c + 1] - low[c]
            take = np.repeat(low[c] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            blob = _pack(at[own].astype("<i4"), counts.astype("<i4")) + _pack(offsets[take].astype("<i4"), first_doc[run[take]].astype("<i8"), first_start[run[take]].astype("<i4"))
            out.append((block, int(part[own[0]]), len(own), blob))
        return _table(out)

    def mark(key, rows, answers):
        doc, texts = _documents(rows)
        if not rows.num_rows:
            return finish([], [], rows, carry)
        s = Segments(scheme, texts, hot.value)
        order, new, first, owner, cut = s.distinct(doc, blocks)
        number = np.cumsum(new) - 1
        last = np.r_[first[1:], len(order)] if len(first) else first
        hits: list[tuple[np.ndarray, ...]] = []
        for block, _, n, blob in _rows(answers):
            at, counts = _unpack(blob, n, "<i4", "<i4")
            m = int(counts.sum())
            offsets, first_doc, first_start = _unpack(blob[8 * n :], m, "<i4", "<i8", "<i4")
            g = np.repeat(cut[block] + at, counts)  # the distinct segment of each run
            ends = np.r_[offsets[1:], 0]
            final = np.cumsum(counts) - 1
            ends[final] = s.runs[order[first[cut[block] + at]]]
            copies = last[g] - first[g]
            each = np.repeat(np.arange(m), copies)
            member = order[np.repeat(first[g] - np.r_[0, np.cumsum(copies)[:-1]], copies) + np.arange(copies.sum())]
            own_start = s.start[member] + offsets[each]
            earlier = first_doc[each] < owner[member]
            if same_document:
                earlier |= (first_doc[each] == owner[member]) & (first_start[each] < own_start)
            hits.append((s.text[member][earlier], own_start[earlier], (own_start + ends[each] - offsets[each] + width - 1)[earlier]))
        text, a, b = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.empty(0, np.int64),) * 3
        order = np.lexsort((a, text))
        text, a, b = text[order], a[order], b[order]
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        spans = [_union(a[bounds[i] : bounds[i + 1]], b[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
        return finish(s.sources, spans, rows, carry)

    lists = dealt.select("doc_id", "text", *carry, "part").groupBy("part").applyInArrow(list_segments, _BLOB).repartition("block")
    asked = lists.groupBy("block").applyInArrow(choose_owners, _BLOB)
    contents = dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(send_contents, _BLOB)
    answers = lists.groupBy("block").cogroup(contents.groupBy("block")).applyInArrow(answer, _BLOB)
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(mark, schema)


def meeting(key: np.ndarray) -> np.ndarray:
    """Contents whose key (ascending) has another content, so that windows can meet."""
    same = key[1:] == key[:-1]
    return np.flatnonzero(np.r_[False, same] | np.r_[same, False]) if len(key) else np.empty(0, np.int64)


def window_places(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(content, offset) of every window of every content."""
    owner = np.repeat(np.arange(len(runs)), runs)
    return owner, np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(runs)[:-1]].astype(np.int64), runs)


def _earliest(number: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Row of the least (doc, start) of each number 0..; numbers ascend."""
    order = np.lexsort((start, doc, number))
    return order[np.flatnonzero(np.r_[True, number[order][1:] != number[order][:-1]])]


def _union(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans, sorted by start."""
    if not len(a):
        return []
    reach = np.maximum.accumulate(b)
    new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    stop = reach[np.r_[new[1:] - 1, len(a) - 1]]
    return list(zip(a[new].tolist(), stop.tolist(), strict=True))


def kept_pieces(units, spans):
    """(number of units, units removed, the kept data) of one document."""
    data, starts, n = units
    removed, out, at = 0, [], 0
    for a, b in [*spans, (n, n)]:
        if a > at:
            out.append(data[at:a] if starts is None else data[starts[at] : starts[a] - 1])
        removed += b - a
        at = b
    return n, removed, (b"" if starts is None else b" ").join(out)


def finish_documents(sources, spans, rows: pa.Table, carry) -> pa.Table:
    """doc_id, n_units, n_removed, n_spans, kept, then the carried columns."""
    done = [kept_pieces(u, s) for u, s in zip(sources, spans, strict=True)]
    n, removed, kept = zip(*done, strict=True) if done else ((), (), ())
    columns = {
        "doc_id": rows.column("doc_id"),
        "n_units": pa.array(n, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array([len(s) for s in spans], pa.int64()),
        "kept": pa.array(kept, pa.binary()),
    }
    return pa.table(columns | {c: rows.column(c) for c in carry})


def finish_texts(sources, spans, rows: pa.Table, carry) -> pa.Table:
    """As finish_documents, with the kept data as text; a character that was cut is gone."""
    table = finish_documents(sources, spans, rows, carry)
    texts = [b.decode("utf-8", "ignore") for b in table.column("kept").to_pylist()]
    return table.set_column(4, "kept", pa.array(texts, pa.string()))


SPAN_SCHEMA = "doc_id long, n_units long, n_removed long, n_spans long, kept binary"
