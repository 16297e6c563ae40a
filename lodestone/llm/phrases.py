"""Phrase collocation mining with a burst trie of word ids, level by level.

A task counts word paths in a shallow trie whose leaves are hash containers: a container
holds all paths of a range of first words, and bursts into two when it is full, between
first words where it has several and further down the path where it has one. When the trie
is full, whole subtrees leave as sorted runs, the largest first. Runs go to the partition
of their path's prefix, where they are merged by one sort and one sum.

Three passes count words, pairs by one hash each, and paths of two to four words (a path's
prefixes come with it, so one path a position is enough). A phrase can be frequent only if
all its parts are: each pass leaves out paths with a word or a pair that a bit filter, filled
with the frequent ones of the pass before, doesn't hold. The filters have a fixed size; what
they let through wrongly is counted like the rest and falls below `least` in the last pass.
So counts are exact, and what is shuffled is about as much as can matter.

Words travel as 64-bit hashes; the text of a word comes back from the table of frequent
words, so a phrase of rare words never needs one. Everything is per lang; a null lang is
'und'. Null texts have no words, an empty table gives no rows, repeated rows count each
time, and other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.anchors import mix
from lodestone.llm.arrowtools import GROUP_BYTES, groups, stored

LONGEST = 4
#: Bits of a word's id within a task (two fit a long, whatever one text holds), and of a bit filter's slots; bits of a filter a row.
ID_BITS, FILTER_BITS, CHUNK_BITS = 31, 26, 16
#: Paths of a container that bursts and of a trie that spills; words known to a task at most.
BURST, PATHS, WORDS = 1 << 14, 600_000, 400_000
#: Words of the corpus for each prefix partition.
PART_WORDS = 1 << 20
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in _BREAKS else 32 if b == 9 else b for b in range(256))
_MASK = (1 << ID_BITS) - 1
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[bytes]:
    """Words, a line feed for each break between pieces, and empty strings to be skipped."""
    return text.encode().translate(_BYTES).replace(b"\n", b" \n ").split(b" ")


class Words(dict):
    """word -> id within the task, from 1; a break has id 0, an empty string -1."""

    def __init__(self):
        self.names: list[bytes] = [b"\n"]
        self.update({b"\n": 0, b"": -1})

    def __missing__(self, word):
        self[word] = at = len(self.names)
        self.names.append(word)
        return at

    def sequence(self, texts: list[str | None]) -> np.ndarray:
        """Ids of all words of the texts in turn, with breaks between pieces and texts."""
        parts = [np.zeros(1, np.int64)]
        for text in texts:
            if text:
                words = tokens(text)
                parts += [np.fromiter(map(self.__getitem__, words), np.int64, len(words)), parts[0]]
        ids = np.concatenate(parts)
        return ids[ids >= 0]


class Hashes:
    """64-bit hashes of a task's words by id, computed once a word; a break's is 0."""

    def __init__(self, words: Words):
        self.words, self.known = words, np.zeros(1, np.uint64)

    def array(self) -> np.ndarray:
        fresh = self.words.names[len(self.known) :]
        if fresh:
            digest = xxhash.xxh64_intdigest
            self.known = np.concatenate([self.known, np.fromiter(map(digest, fresh), np.uint64, len(fresh))])
        return self.known


def path_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = mix(columns[0])
    for c in columns[1:]:
        out = mix(out * _TIMES + c)
    return out


class Trie:
    """Counts of paths, each packed in one integer of ID_BITS a word, first word highest.

    The shallow part is the sorted list of where the containers' ranges start.
    """

    def __init__(self, length: int, burst: int = BURST):
        self.length, self.burst, self.starts, self.boxes, self.size = length, burst, [0], [{}], 0

    def add(self, paths: list[int], counts: list[int]) -> None:
        """Ascending different paths, with what to add for each."""
        at = 0
        while at < len(paths):
            i = bisect_right(self.starts, paths[at]) - 1
            stop = bisect_left(paths, self.starts[i + 1], at) if i + 1 < len(self.starts) else len(paths)
            box = self.boxes[i]
            get, before = box.get, len(box)
            for p, n in zip(paths[at:stop], counts[at:stop], strict=True):
                box[p] = get(p, 0) + n
            self.size += len(box) - before
            if len(box) > self.burst:
                self._burst(i)
            at = stop

    def _burst(self, i: int) -> None:
        """Cuts a container near its middle, at the highest level of the path that differs."""
        todo = [(self.starts[i], self.boxes[i])]
        done = []
        while todo:
            start, box = todo.pop()
            if len(box) <= self.burst:
                done.append((start, box))
                continue
            paths = sorted(box)
            middle = paths[len(paths) // 2]
            for level in reversed(range(self.length)):
                cut = middle >> level * ID_BITS << level * ID_BITS
                if cut > paths[0]:
                    break
            low = {p: box[p] for p in paths[: bisect_left(paths, cut)]}
            high = {p: box[p] for p in paths[len(low) :]}
            todo += [(cut, high), (start, low)]
        self.starts[i : i + 1] = [s for s, _ in done]
        self.boxes[i : i + 1] = [b for _, b in done]

    def spill(self, keep: int) -> tuple[list[int], list[int]]:
        """Takes out whole subtrees, the largest first, until `keep` paths stay; one sorted run."""
        gone = []
        for i in sorted(range(len(self.boxes)), key=lambda i: -len(self.boxes[i])):
            if self.size <= keep:
                break
            gone.append(i)
            self.size -= len(self.boxes[i])
        paths, counts = [], []
        for i in sorted(gone):
            box, self.boxes[i] = self.boxes[i], {}
            run = sorted(box)
            paths += run
            counts += map(box.__getitem__, run)
        return paths, counts


class Filter:
    """A set of hashes with false positives but no false negatives, of a fixed size."""

    def __init__(self, chunks: dict[int, bytes]):
        size = 1 << CHUNK_BITS - 3
        self.bits = np.frombuffer(b"".join(chunks.get(i, bytes(size)) for i in range(1 << FILTER_BITS - CHUNK_BITS)), np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - FILTER_BITS)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_filter(hashes: DataFrame) -> Filter:
    """The filter of the longs in column x; a row of bits for each 2^CHUNK_BITS slots is collected."""
    slot = F.shiftrightunsigned("x", 64 - FILTER_BITS)
    slots = hashes.select(F.shiftright(slot, CHUNK_BITS).cast("int").alias("chunk"), slot.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int").alias("bit")).distinct()

    def pack(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << CHUNK_BITS, np.uint8)
        bits[rows.column("bit").to_numpy()] = 1
        return pa.table({"chunk": rows.column("chunk")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    return Filter({r.chunk: bytes(r.bits) for r in slots.groupBy("chunk").applyInArrow(pack, "chunk int, bits binary").collect()})


def _by_lang(batch: pa.RecordBatch):
    langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    found: dict[str, list] = {}
    for lang, text in zip(langs, texts, strict=True):
        found.setdefault(lang, []).append(text)
    return found.items()


def _packed(counts: np.ndarray) -> bytes:
    """A byte a count; those that don't fit are 0 there and follow in full."""
    return np.where(counts < 256, counts, 0).astype("u1").tobytes() + counts[counts >= 256].astype("<i8").tobytes()


def _unpacked(blob: bytes, n: int, start: int) -> np.ndarray:
    counts = np.frombuffer(blob, "u1", n, start).astype(np.int64)
    counts[counts == 0] = np.frombuffer(blob, "<i8", -1, start + n)
    return counts


def _runs(lang: str, columns: list[np.ndarray], counts: np.ndarray, prefix: int, parts: int):
    """lang, part, n, blob: a sorted run of paths (hashes, word by word) cut by its prefix's partition."""
    part = (path_hash(columns[:prefix]) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, columns, counts = part[order], [c[order] for c in columns], counts[order].astype(np.int64)
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist()
    blobs = [b"".join([*(c[a:b].tobytes() for c in columns), _packed(counts[a:b])]) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]
    sizes = np.diff([*cuts, len(part)]) if cuts else []
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(blobs), pa.string()), pa.array(part[cuts], pa.int32()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["lang", "part", "n", "blob"])


_RUN = "lang string, part int, n int, blob binary"


def word_counts(docs: DataFrame, parts: int) -> DataFrame:
    """lang, part, n, words, counts: each task's counts of words; part -1 has their sum."""

    def count(batches):
        words, counts = Words(), {}

        def flush():
            hashes = Hashes(words).array()
            for lang, c in counts.items():
                at = np.flatnonzero(c[1:]) + 1
                if not len(at):
                    continue
                part = (mix(hashes[at]) % np.uint64(parts)).astype(np.int64)
                at = at[np.argsort(part, kind="stable")]
                part.sort()
                cuts = np.flatnonzero(np.append(True, np.diff(part) != 0)).tolist()
                ranges = [at[a:b] for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(cuts) + 1), pa.string()), pa.array([-1, *part[cuts].tolist()], pa.int32()), pa.array([int(c[at].sum()), *map(len, ranges)], pa.int64()),
                     pa.array([b"", *(b" ".join([words.names[i] for i in r.tolist()]) for r in ranges)], pa.binary()), pa.array([b"", *(_packed(c[r]) for r in ranges)], pa.binary())],
                    names=["lang", "part", "n", "words", "counts"],
                )

        for batch in batches:
            for group in groups(batch, 1, GROUP_BYTES):
                for lang, texts in _by_lang(group):
                    found = np.bincount(words.sequence(texts), minlength=len(words.names))
                    have = counts.get(lang)
                    if have is not None:
                        found[: len(have)] += have
                    counts[lang] = found
                if len(words.names) > WORDS:
                    yield from flush()
                    words, counts = Words(), {}
        yield from flush()

    return docs.mapInArrow(count, "lang string, part int, n long, words binary, counts binary")


def frequent_words(counted: DataFrame, least: int) -> DataFrame:
    """lang, word, path, x, f of the words that occur at least `least` times; f of a null word
    is the number of all words."""

    def merge(rows: pa.Table) -> pa.Table:
        lang = rows.column("lang")[:1]
        if rows.column("part")[0].as_py() < 0:
            return pa.table({"lang": lang, "word": pa.array([None], pa.string()), "path": pa.array([None], pa.binary()), "x": pa.array([None], pa.int64()), "f": pa.array([pc.sum(rows.column("n")).as_py()])})
        total: dict[bytes, int] = {}
        get = total.get
        for words, counts in zip(rows.column("words").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            names = words.split(b" ")
            for w, n in zip(names, _unpacked(counts, len(names), 0).tolist(), strict=True):
                total[w] = get(w, 0) + n
        often = [w for w, n in total.items() if n >= least]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, often), np.uint64, len(often))
        return pa.table(
            {"lang": pa.array(lang.to_pylist() * len(often), pa.string()), "word": pa.array([w.decode() for w in often], pa.string()), "path": pa.array([h.tobytes() for h in hashes], pa.binary()),
             "x": pa.array(path_hash([hashes]).view(np.int64)), "f": pa.array([total[w] for w in often], pa.int64())}
        )

    return counted.groupBy("lang", "part").applyInArrow(merge, "lang string, word string, path binary, x long, f long")


def _count_paths(docs: DataFrame, prefix: int, parts: int, paths_of, as_pairs: bool = False) -> DataFrame:
    """Runs of the paths that `paths_of(ids, hashes)` finds in texts as (high, low): the packed
    ids of the path's first two words and of the two that follow, 0 for none. With `as_pairs`,
    a path of two words travels as one hash."""

    def count(batches):
        words = Words()
        hashes, tries = Hashes(words), {}

        def run(lang, keep):
            paths, counts = tries[lang].spill(keep)
            if paths:
                high = np.fromiter((p >> 2 * ID_BITS for p in paths), np.int64, len(paths))
                low = np.fromiter((p & (1 << 2 * ID_BITS) - 1 for p in paths), np.int64, len(paths))
                known = hashes.array()
                columns = [known[i] for i in (high >> ID_BITS, high & _MASK, low >> ID_BITS, low & _MASK)]
                yield _runs(lang, [path_hash(columns[:2])] if as_pairs else columns, np.array(counts), prefix, parts)

        for batch in batches:
            for group in groups(batch, 1, GROUP_BYTES):
                for lang, texts in _by_lang(group):
                    trie = tries.setdefault(lang, Trie(LONGEST))
                    ids = words.sequence(texts)
                    high, low = paths_of(ids, hashes.array())
                    order = np.lexsort((low, high)) if low.any() else np.argsort(high, kind="stable")
                    high, low = high[order], low[order]
                    at = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)])
                    trie.add([(h << 2 * ID_BITS) | l for h, l in zip(high[at].tolist(), low[at].tolist(), strict=True)], np.diff(at, append=len(high)).tolist())
                over = sum(t.size for t in tries.values()) - PATHS
                while over > 0:
                    lang = max(tries, key=lambda x: tries[x].size)
                    over -= tries[lang].size // 2 + 1
                    yield from run(lang, tries[lang].size // 2)
                if len(words.names) > WORDS:
                    for lang in tries:
                        yield from run(lang, 0)
                    words = Words()
                    hashes, tries = Hashes(words), {}
        for lang in tries:
            yield from run(lang, 0)

    return docs.mapInArrow(count, _RUN)


def _merged(rows: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """All runs of a partition in one order: columns of hashes, and counts."""
    blobs = list(zip(rows.column("n").to_pylist(), rows.column("blob").to_pylist(), strict=True))
    columns = [np.concatenate([np.frombuffer(b, "<u8", n, 8 * n * i) for n, b in blobs]) for i in range(width)]
    counts = np.concatenate([_unpacked(b, n, 8 * n * width) for n, b in blobs])
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns], counts[order]


def _frequent_pairs(runs: DataFrame, least: int) -> DataFrame:
    """x: the hashes of pairs that occur at least `least` times."""

    def merge(rows: pa.Table) -> pa.Table:
        (x,), counts = _merged(rows, 1)
        at = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
        return pa.table({"x": x[at][np.add.reduceat(counts, at) >= least].view(np.int64)})

    return runs.groupBy("lang", "part").applyInArrow(merge, "x long")


def _frequent_paths(runs: DataFrame, least: int) -> DataFrame:
    """lang, path (8 bytes a word), f: paths of two to LONGEST words in merged runs."""

    def merge(rows: pa.Table) -> pa.Table:
        columns, counts = _merged(rows, LONGEST)
        paths, often = [], []
        differs = np.append(True, columns[0][1:] != columns[0][:-1])
        for k in range(2, LONGEST + 1):
            differs[1:] |= columns[k - 1][1:] != columns[k - 1][:-1]
            at = np.flatnonzero(differs)
            total = np.add.reduceat(counts, at)
            keep = (total >= least) & (columns[k - 1][at] != 0)
            names = np.ascontiguousarray(np.stack([c[at[keep]] for c in columns[:k]], axis=1))
            paths += [row.tobytes() for row in names]
            often.append(total[keep])
        f = np.concatenate(often)
        return pa.table({"lang": pa.array(rows.column("lang")[:1].to_pylist() * len(f), pa.string()), "path": pa.array(paths, pa.binary()), "f": pa.array(f)})

    return runs.groupBy("lang", "part").applyInArrow(merge, "lang string, path binary, f long")


def _pair_paths(allowed):
    """Pairs of words that the filter of words holds."""

    def f(ids, hashes):
        ids = np.where(allowed.value.holds(path_hash([hashes]))[ids], ids, 0)
        high = (ids[:-1] << ID_BITS | ids[1:])[(ids[:-1] > 0) & (ids[1:] > 0)]
        return high, np.zeros(len(high), np.int64)

    return f


def _long_paths(allowed):
    """Paths of two words whose pair the filter holds, with the words that follow while it holds their pairs."""

    def f(ids, hashes):
        pair = (ids[:-1] > 0) & (ids[1:] > 0)
        pair[pair] = allowed.value.holds(path_hash([hashes[ids[:-1][pair]], hashes[ids[1:][pair]]]))
        start, ids, pair = np.flatnonzero(pair), np.append(ids, [0, 0]), np.append(pair, [False, False])
        third = np.where(pair[start + 1], ids[start + 2], 0)
        fourth = np.where(pair[start + 1] & pair[start + 2], ids[start + 3], 0)
        return ids[start] << ID_BITS | ids[start + 1], third << ID_BITS | fourth

    return f


def phrases(docs: DataFrame, least: int = 30, first: int = 2000, covered: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first phrases of 2 to 4 words.

    A phrase that occurs `a` times scores floor(2000000 a / (l + r)) at its weakest cut into
    two parts that occur l and r times. It goes where a longer frequent phrase that contains
    it has `covered` percent of its occurrences or more; one that is longer by a word is
    enough to look at, as what lies between is at least as frequent.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words_about = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, words_about // 6 // PART_WORDS)
    spark = docs.sparkSession

    counted = stored(frequent_words(word_counts(docs, parts), least))
    sizes, words = counted.where("word is null").select("lang", F.col("f").alias("n")), counted.where("word is not null")
    held = spark.sparkContext.broadcast(bit_filter(words))
    held = spark.sparkContext.broadcast(bit_filter(_frequent_pairs(_count_paths(docs, 1, parts, _pair_paths(held), as_pairs=True), least)))
    found = stored(_frequent_paths(_count_paths(docs, 2, parts, _long_paths(held)), least))

    known = found.unionByName(words.select("lang", "path", "f"))
    cuts = found.select("lang", "path", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), (F.length("path") / 8).cast("int") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring(path, 1, 8 * k)"), "right": F.expr("substring(path, 8 * k + 1)")})
    cuts = cuts.join(known.select("lang", F.col("path").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("path").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # Decimals, as a product may pass 64 bits.
    score = F.expr("cast((2000000 * cast(a as decimal(20, 0))) div (l + r) as bigint)")
    weakest = cuts.withColumn("score", score).groupBy("lang", "path").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = found.where("length(path) > 16").select("lang", "f", F.explode(F.array(F.expr("substring(path, 1, length(path) - 8)"), F.expr("substring(path, 9)"))).alias("path"))
    inner = inner.groupBy("lang", "path").agg(F.max("f").alias("most"))
    kept = weakest.join(inner, ["lang", "path"], "left").where(F.expr(f"most is null or 100 * cast(most as decimal(20, 0)) < {int(covered)} * cast(a as decimal(20, 0))"))

    spelled = kept.select("lang", "path", F.posexplode(F.sequence(F.lit(0), (F.length("path") / 8).cast("int") - 1)).alias("at", "i")).withColumn("one", F.expr("substring(path, 8 * i + 1, 8)"))
    return _ranked(kept, spelled.join(words.select("lang", F.col("path").alias("one"), "word"), ["lang", "one"]), sizes, first)


def _ranked(kept: DataFrame, spelled: DataFrame, sizes: DataFrame, first: int) -> DataFrame:
    text = spelled.groupBy("lang", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = kept.join(text, ["lang", "path"]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("path"), F.lit(64)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("own") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return rows.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
