"""Toxicity scores from a counterfactual-regularised classifier.

A logistic model over the presence of words is fitted to labelled documents. In every
sentence of theirs that names a group, the term is swapped for each other term of its
class, and the squared change of the sentence's score is penalised, so that a neutral
mention of a group does not carry weight by itself.

The fit takes a bounded sample of labelled rows (`sample_rows`, whole texts, chosen by a
hash of the id). Words are counted and swaps are added up by Spark; the driver gets at
most `features` words, the sample's rows cut down to those, and one row a pair of terms.
The scores cover every row and whole texts. Null and empty texts get the score of a text
without known words. Repeated labels count as they stand, equal word sets of one label
once; labels or texts that are null are left out of the fit. Without usable labels of both
kinds every score is about 2e-9. Null or repeated doc_ids are scored one by one. Columns
other than doc_id and text, or doc_id and toxic, are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrowtools import held_out, map_texts, stored

#: Words that name groups, by class; a term is swapped for the next ones of its class.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "turkish", "polish"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos"),
)
_SWAP = {t: [u for u in group if u != t] for group in IDENTITY_TERMS for t in group}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_id(word: str) -> int:
    return xxhash.xxh32_intdigest(word) >> 1


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swaps(text: str | None) -> list[tuple[str, str | None]]:
    """(term, other) for each sentence, term in it and other term of the class.

    Other is None where the sentence has it already: the swap then only takes the term away.
    """
    out = []
    for sentence in _SENTENCE.split((text or "").lower()):
        words = set(_WORD.findall(sentence))
        out += [(term, None if other in words else other) for term in sorted(words & _SWAP.keys()) for other in _SWAP[term]]
    return out


def training_texts(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id, text, toxic for a bounded hash sample of labelled documents."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", "toxic")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)  # at most sample_rows thin rows
    texts = docs.where(F.col("text").isNotNull() & ~held_out()).select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("toxic") != 0).cast("int").alias("toxic"))


def word_rows(texts: DataFrame) -> DataFrame:
    """toxic, words: the distinct word sets of each label, as sorted word ids."""

    def make():
        def run(toxic, rows):
            return {"toxic": pa.array(toxic, pa.int32()), "words": pa.array([sorted(map(word_id, text_words(t))) for t in rows], pa.list_(pa.int32()))}

        return run

    return map_texts(texts, ["toxic", "text"], "toxic int, words array<int>", make).distinct()


def swap_counts(texts: DataFrame) -> DataFrame:
    """gone, new (word ids, new may be null), n: how many labelled sentences give each swap."""

    def make():
        def run(rows):
            counts = Counter(x for t in rows for x in swaps(t))
            gone, new = zip(*counts, strict=True) if counts else ((), ())
            ids = [None if x is None else word_id(x) for x in new]
            return {"gone": pa.array(map(word_id, gone), pa.int32()), "new": pa.array(ids, pa.int32()), "n": pa.array(counts.values(), pa.int64())}

        return run

    return map_texts(texts, ["text"], "gone int, new int, n long", make).groupBy("gone", "new").agg(F.sum("n").alias("n"))


def telling_words(rows: DataFrame, good: int, bad: int, min_rows: int = 4, least_z: float = 4.0) -> DataFrame:
    """word: those whose rates under both labels (`good` and `bad` rows) differ by `least_z`
    standard errors or more, as many as the sampled rows have."""
    n = good + bad
    hits = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("hits"), F.sum("toxic").alias("toxic"))
    share = F.col("hits") / n
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / bad + 1 / good))
    certainty = F.abs(F.col("toxic") / bad - (F.col("hits") - F.col("toxic")) / good) / error
    told = hits.where(F.col("hits") >= min(min_rows, max(1, n // 50))).withColumn("certainty", certainty)
    return told.where(F.col("certainty") >= min(least_z, n**0.5 / 2)).select("word")


class Model(dict):
    """word id -> weight, with a bias."""

    bias = 0.0


def fit(rows: list[tuple[int, list[int]]], vocabulary: list[int], swapped: list[tuple[int, int | None, int]], penalty: float = 20.0, ridge: float = 2e-4, steps: int = 300) -> Model:
    """Fits the model by gradient steps with momentum.

    `rows` are (toxic, word ids), `swapped` (gone, new, count). Loss: mean logistic loss
    (both labels weigh alike) + ridge |w|^2 + penalty x mean squared score change over the
    swaps of all sentences.
    """
    model = Model()
    model.bias = -20.0
    y = np.array([t for t, _ in rows], float)
    if not len(y) or y.min() == y.max():
        return model
    index = {w: i for i, w in enumerate(sorted(vocabulary))}
    pairs = [(r, index[w]) for r, (_, words) in enumerate(rows) for w in words if w in index]
    owner, at = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    total = sum(n for _, _, n in swapped)
    gone, new, count = (np.array(x, np.int64) for x in zip(*[(index.get(g, -1), index.get(o, -1), n) for g, o, n in swapped], strict=True)) if swapped else (np.zeros(0, np.int64),) * 3
    part = 2 * penalty * count / max(1, total)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias, fast, fast_b = np.zeros(len(index) + 1), 0.0, np.zeros(len(index) + 1), 0.0  # the last weight stays 0
    second, second_b = np.zeros(len(w)), 0.0
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=w[at], minlength=len(y)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(at, weights=error[owner], minlength=len(w)) + 2 * ridge * w
        change = part * (w[new] - w[gone])
        np.add.at(grad, new, change)
        np.add.at(grad, gone, -change)
        grad[-1] = 0.0
        grad_b = error.sum()
        fast, fast_b = 0.9 * fast + 0.1 * grad, 0.9 * fast_b + 0.1 * grad_b
        second, second_b = 0.99 * second + 0.01 * grad**2, 0.99 * second_b + 0.01 * grad_b**2
        scale, scale2 = 1 - 0.9**step, 1 - 0.99**step
        w = w - 0.05 * (fast / scale) / (np.sqrt(second / scale2) + 1e-8)
        bias -= 0.05 * (fast_b / scale) / (np.sqrt(second_b / scale2) + 1e-8)
    model.update({word: float(w[i]) for word, i in index.items() if abs(w[i]) > 1e-4})
    model.bias = float(bias)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, **options) -> Model:
    """The model of a bounded sample of labelled rows; `options` go to `fit`."""
    texts = training_texts(docs, labels, sample_rows)
    rows = stored(word_rows(texts))
    sizes = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return fit([], [], [])
    vocabulary = [r["word"] for r in telling_words(rows, sizes[False], sizes[True]).collect()]
    known = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))  # words of sample_rows rows

    def cut(batches):
        for batch in batches:
            words = [[w for w in ws if w in known.value] for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int32()))], names=["toxic", "words"])

    examples = [(r["toxic"], r["words"]) for r in rows.mapInArrow(cut, "toxic int, words array<int>").collect()]  # at most sample_rows
    return fit(sorted(examples), vocabulary, [tuple(r) for r in swap_counts(texts).collect()], **options)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every document, then `carry`."""
    model = learn(docs, labels, sample_rows)
    sent, bias = docs.sparkSession.sparkContext.broadcast(dict(model)), model.bias

    def make():
        weights = sent.value
        memo: dict[str, float] = {}

        def weight(word):
            if word not in memo:
                if len(memo) > 300_000:
                    memo.clear()
                memo[word] = weights.get(word_id(word), 0.0)
            return memo[word]

        def run(doc_ids, texts, held):
            z = [bias + sum(map(weight, text_words(t))) for t in texts]
            score = [1 / (1 + np.exp(-max(-30.0, min(30.0, x)))) for x in z]
            return {"doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "score": pa.array(score, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in score], pa.int32())}

        return run

    read = docs.select("doc_id", "text", *(c for c in carry if c not in ("doc_id", "text")), held_out().alias("held_out"))
    return map_texts(read, ["doc_id", "text", "held_out"], "doc_id long, held_out boolean, score double, predicted int", make, carry=carry)
