"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards.

One pass over the texts keeps, for each document, its length and how often it holds each
term that is asked for; statistics are sums over all documents. Each task then indexes
what it has in shards of a bounded number of postings. A list is cut in blocks of BLOCK
postings, stored as byte-aligned gaps and counts, with the last document and the greatest
score of each block. The lists' bounds part them into essential and other lists: only
documents of essential lists are looked at, block maxima of the others turn most of them
away before anything is decompressed, and the rest is decompressed list by list as long as
the document can still reach the heap. Heaps of all tasks are merged by a window.

Terms are maximal runs of ASCII letters and digits and of all characters above ASCII; only
A-Z are lower-cased. Null texts have no terms, items and documents without terms give no
rows, and an empty table gives none. A document that is repeated takes a rank each time;
items that share both id and text are one item. Null doc_ids count as the smallest id.
"""

from __future__ import annotations

from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.arrowtools import map_texts, stored

BLOCK = 128
#: Postings and documents of a shard at most; documents looked at together.
SHARD_POSTINGS, SHARD_DOCS, WINDOW = 1 << 21, 1 << 14, 2048
#: Bytes of item texts that are searched for in one pass over the documents, on average.
ITEM_BYTES = 4 << 20
NO_ID = -(1 << 63)
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WIDTHS = ("u1", "<u2", "<u4")


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split() if text else []


def saturation(tf, m):
    """The part of a score that does not depend on the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:  # exact beyond 64 bits, too
        return np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)
    return 25 + (75 * n * documents) // max(1, total)


def weight(df: int, documents: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    width = 0 if values.max() < 1 << 8 else 1 if values.max() < 1 << 16 else 2
    return width, values.astype(_WIDTHS[width]).tobytes()


class Postings:
    """The list of one term in a shard: compressed blocks and their bounds."""

    def __init__(self, docs: np.ndarray, tf: np.ndarray, scores: np.ndarray):
        cuts = np.arange(0, len(docs), BLOCK)
        self.first, self.last = docs[cuts], docs[np.append(cuts[1:], len(docs)) - 1]
        self.block_max = np.maximum.reduceat(scores, cuts)
        self.bound = int(self.block_max.max())
        self.blocks = [(*_packed(np.diff(docs[a : a + BLOCK], prepend=docs[a])), *_packed(tf[a : a + BLOCK])) for a in cuts.tolist()]

    def read(self, blocks) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of these blocks, decompressed."""
        docs, tf = [], []
        for i in blocks:
            width, gaps, width_tf, counts = self.blocks[i]
            docs.append(self.first[i] + np.cumsum(np.frombuffer(gaps, _WIDTHS[width]), dtype=np.int64))
            tf.append(np.frombuffer(counts, _WIDTHS[width_tf]).astype(np.int64))
        return (np.concatenate(docs), np.concatenate(tf)) if docs else (np.empty(0, np.int64),) * 2


class Shard:
    """An index over some documents, for the terms that are asked for."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, held: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, total: int):
        """`held`: how many of the postings (`term`, `tf`) each document has, in turn."""
        self.ids, self.m, self.weights, self.decoded = ids, length_norm(n, documents, total), weights, 0
        docs = np.repeat(np.arange(len(ids)), held)
        order = np.argsort(term, kind="stable")
        docs, term, tf = docs[order], term[order], tf[order].astype(np.int64)
        scores = weights[term] * saturation(tf, self.m[docs])
        cuts = np.flatnonzero(np.append(True, np.diff(term) != 0)[: len(term)])
        ends = np.append(cuts[1:], len(term))[: len(cuts)]
        self.lists = {int(term[a]): Postings(docs[a:b], tf[a:b], scores[a:b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)}

    def scored(self, term: int, blocks) -> tuple[np.ndarray, np.ndarray]:
        self.decoded += len(blocks)
        docs, tf = self.lists[term].read(blocks)
        return docs, self.weights[term] * saturation(tf, self.m[docs])

    def search(self, asked: list[tuple[int, int]], heap: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The heap (scores, ids), best first, with this shard's documents for the terms
        `asked`, each with its number of occurrences in the item."""
        lists = sorted((self.lists[t].bound * times, t, times) for t, times in asked if t in self.lists)
        reach = np.cumsum([b for b, _, _ in lists])
        for start in range(0, len(self.ids) if lists else 0, WINDOW):
            # Ties may still win by a smaller id, so only what stays below the bar is turned away.
            bar = max(1, int(heap[0][k - 1]) if len(heap[0]) >= k else 1)
            essential = int(np.searchsorted(reach, bar))
            if essential == len(lists):
                break
            total, seen = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)
            for _, t, times in lists[essential:]:
                p = self.lists[t]
                docs, scores = self.scored(t, range(int(np.searchsorted(p.last, start)), int(np.searchsorted(p.first, start + WINDOW))))
                inside = (docs >= start) & (docs < start + WINDOW)
                at = docs[inside] - start
                total[at] += times * scores[inside]
                seen[at] = True
            docs = np.flatnonzero(seen) + start
            if essential:
                docs = docs[total[docs - start] + int(reach[essential - 1]) >= bar]
            score = total[docs - start]
            docs, score = self._completed(lists[:essential], docs, score, bar)
            take = score >= bar
            if take.any():
                score, ids = np.concatenate([heap[0], score[take]]), np.concatenate([heap[1], self.ids[docs[take]]])
                best = np.lexsort((ids, -score))[:k]
                heap = score[best], ids[best]
        return heap

    def _completed(self, lists, docs, score, bar):
        """Adds the other lists' scores to the documents that can still reach `bar`."""
        if not len(docs) or not lists:
            return docs, score
        block, most = np.empty((len(lists), len(docs)), np.int64), np.zeros((len(lists), len(docs)), np.int64)
        for i, (_, t, times) in enumerate(lists):
            p = self.lists[t]
            block[i] = np.minimum(np.searchsorted(p.last, docs), len(p.last) - 1)
            inside = (docs >= p.first[block[i]]) & (docs <= p.last[block[i]])
            most[i] = np.where(inside, times * p.block_max[block[i]], 0)
        left = most.sum(axis=0)
        for i in reversed(range(len(lists))):
            keep = score + left >= bar
            docs, score, left, block, most = docs[keep], score[keep], left[keep], block[:, keep], most[:, keep]
            if not len(docs):
                break
            _, t, times = lists[i]
            wanted = most[i] > 0
            held, scores = self.scored(t, np.unique(block[i][wanted]).tolist())
            if len(held):
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                score = score + np.where(held[at] == docs, times * scores[at], 0)
            left = left - most[i]
        return docs, score


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n, terms and tf (packed int32) of every document."""

    def make():
        known = vocabulary.value.get

        def f(doc_ids, texts):
            n, terms, counts = [], [], []
            for text in texts:
                words = terms_of(text)
                at = np.fromiter(map(known, words, [-1] * len(words)), np.int32, len(words))
                found, tf = np.unique(at[at >= 0], return_counts=True)
                n.append(len(words))
                terms.append(found.tobytes())
                counts.append(tf.astype(np.int32).tobytes())
            return {"doc_id": pa.array(doc_ids, pa.int64()), "n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.binary()), "tf": pa.array(counts, pa.binary())}

        return f

    return map_texts(docs, ["doc_id", "text"], "doc_id long, n long, terms binary, tf binary", make)


def _document_frequencies(counted: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term is; as many numbers as are asked for."""

    def add(batches):
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    df = np.zeros(terms, np.int64)
    for r in counted.select("terms").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    return df


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """item (its place in `items`), doc_id, score: the k best of each task and item."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    asked = [[(vocabulary.setdefault(t, len(vocabulary)), times) for t, times in Counter(terms_of(r.text)).items()] for r in items]
    counted = stored(_counted(docs, spark.sparkContext.broadcast(vocabulary)))
    documents, total = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _document_frequencies(counted, len(vocabulary))
    weights = np.array([weight(int(x), documents) for x in df], np.int64)
    given = spark.sparkContext.broadcast((asked, weights))

    def search(batches):
        asked, weights = given.value
        heaps = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(asked)
        held: list = []

        def shards():
            ids, n, size = [], [], 0
            for batch in batches:
                for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                    held.append(row[2:])
                    ids.append(NO_ID if row[0] is None else row[0])
                    n.append(row[1])
                    size += len(row[2]) // 4
                    if size >= SHARD_POSTINGS or len(ids) >= SHARD_DOCS:
                        yield np.array(ids, np.int64), np.array(n, np.int64)
                        ids, n, size = [], [], 0
            if ids:
                yield np.array(ids, np.int64), np.array(n, np.int64)

        for ids, n in shards():
            each = np.array([len(t) // 4 for t, _ in held], np.int64)
            term, tf = (np.frombuffer(b"".join(c), np.int32) for c in zip(*held, strict=True))
            held.clear()
            shard = Shard(ids, n, each, term, tf, weights, documents, total)
            heaps = [shard.search(a, heap, k) for a, heap in zip(asked, heaps, strict=True)]
        for item, (scores, ids) in enumerate(heaps):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int32()), pa.array(ids), pa.array(scores)], names=["item", "doc_id", "score"])

    return counted.mapInArrow(search, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring of all documents for each item.

    Items are searched for in blocks of about ITEM_BYTES of text, each with a pass over the
    documents; what is sent to tasks is a block's vocabulary. An item's text is kept whole.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").distinct()
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)
    found = None
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()
        if not rows:
            continue
        names = spark.createDataFrame([(at, r.item_id) for at, r in enumerate(rows)], f"item int, item_id {dict(items.dtypes)['item_id']}")
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        top = _block(docs, rows, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        found = top if found is None else found.unionByName(top)
    if found is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    return found
