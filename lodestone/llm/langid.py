"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one bit column per language: a slot is a mask of the
languages that set it, in words of 64 languages. The AND of an n-gram's slots is the set
of languages that may contain it, so one probe answers for all languages. A text's
language is the one with the most n-grams after each count is corrected for its column's
false positives.

The filters are fitted on a bounded hash sample of the training rows (`sample_rows`,
whole texts): Spark counts the n-grams and sets the bits, and the driver gets the slots,
a fixed number for each 64 languages. Null texts and texts without a letter get `und` and
score 0, as does everything where no language was learned. A text with letters of which no
n-gram is known gets the first language by name and score 0; so do ties, with their
score. Rows with null or repeated doc_ids are predicted one by one. Columns other than
doc_id, text and lang are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrowtools import held_out, map_texts, stored

N = 3
PROBES = 3
_WORD = re.compile(r"[^\W\d_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


def grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + N] for i in range(len(padded) - N + 1)]


def gram_hashes(items: list[str]) -> np.ndarray:
    """64-bit hashes of short strings: crc32 of the bytes and of the bytes reversed."""
    raw = [g.encode() for g in items]
    high = np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw))
    low = np.fromiter((zlib.crc32(g[::-1], 7) for g in raw), np.uint64, len(raw))
    return ((high << np.uint64(32)) | low) * _M


class MaskFilter:
    """Bit-sliced Bloom filter; `slots` has one row of masks per 64 languages."""

    def __init__(self, languages: list[str], slots: int = 1 << 17):
        self.languages, self.slots = languages, np.zeros((max(1, -(-len(languages) // 64)), slots), np.uint64)

    @staticmethod
    def places(items: list[str], slots: int) -> np.ndarray:
        """The PROBES slots of each n-gram."""
        h = gram_hashes(items)
        a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) % np.uint64(slots) for i in range(PROBES)]).astype(np.int64)

    def add(self, language: int, items: list[str]) -> None:
        if items:
            np.bitwise_or.at(self.slots[language // 64], self.places(items, self.slots.shape[1]).ravel(), np.uint64(1 << language % 64))

    def hits(self, items: list[str]) -> np.ndarray:
        """For each n-gram and language, 1 if the language may contain it."""
        if not items or not self.languages:
            return np.zeros((len(items), len(self.languages)), np.uint8)
        masks = np.bitwise_and.reduce(self.slots[:, self.places(items, self.slots.shape[1])], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(masks.T).view(np.uint8).reshape(len(items), -1), axis=1, bitorder="little")
        return bits[:, : len(self.languages)]

    def false_positive_rates(self) -> np.ndarray:
        bits = [(row >> np.uint64(b)) & np.uint64(1) for row in self.slots for b in range(64)]
        return np.array([x.mean() ** PROBES for x in bits[: len(self.languages)]])


def gram_counts(docs: DataFrame, sample_rows: int) -> DataFrame:
    """lang, gram, n over a bounded hash sample of the training rows, counted by Spark."""
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang")).distinct()
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang")), "left_semi")

    def make():
        def run(texts, langs):
            counts: dict = {}
            for text, lang in zip(texts, langs, strict=True):
                own = counts.setdefault(lang, {})
                for word in _WORD.findall(text.lower()):
                    for g in grams(word):
                        own[g] = own.get(g, 0) + 1
            out = [(lang, g, n) for lang, own in counts.items() for g, n in own.items()]
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            return {"lang": pa.array(a, pa.string()), "gram": pa.array(b, pa.string()), "n": pa.array(c, pa.int64())}

        return run

    return map_texts(rows, ["text", "lang"], "lang string, gram string, n long", make).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def telling_grams(counts: DataFrame, totals: DataFrame, min_count: int = 5, least_share: float = 0.3) -> DataFrame:
    """lang, gram: a language's column gets the n-grams it has at `least_share` or more of
    the rate of the language where they are commonest (languages of more text gain nothing)."""
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    return shares.where(F.col("n") >= min_count).join(best, "gram").where(F.col("share") >= least_share * F.col("best")).select("lang", "gram")


def fit(docs: DataFrame, sample_rows: int, slots: int = 1 << 17) -> MaskFilter:
    """The filter of a bounded sample of the training rows."""
    counts = stored(gram_counts(docs, sample_rows))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row a language
    table = MaskFilter(sorted(r["lang"] for r in totals.collect()), slots)
    number = {lang: i for i, lang in enumerate(table.languages)}

    def place(batches):
        for batch in batches:
            at = MaskFilter.places(batch.column(1).to_pylist(), slots) if batch.num_rows else np.zeros((PROBES, 0), np.int64)
            of = np.array([number[lang] for lang in batch.column(0).to_pylist()], np.int64)
            bit = (np.uint64(1) << (of % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(of // 64, PROBES)), pa.array(at.ravel()), pa.array(np.tile(bit, PROBES))], names=["row", "slot", "bit"])

    bits = telling_grams(counts, totals).mapInArrow(place, "row long, slot long, bit long")
    found = bits.groupBy("row", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()  # at most `slots` rows for 64 languages
    row, slot, mask = (found.column(c).to_numpy() for c in ("row", "slot", "mask"))
    table.slots[row, slot] = mask.view(np.uint64)
    return table


def identify(docs: DataFrame, sample_rows: int = 4_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document, then `carry`."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_rows))  # a fixed number of slots

    def make():
        table = sent.value
        count = len(table.languages)
        rates = table.false_positive_rates()
        memo: dict[str, int] = {}
        found = np.zeros((min(1 << 18, (1 << 22) // (count + 1)), count + 1), np.int32)

        def learn(words: list[str]) -> None:
            lists = [grams(w) for w in words]
            hits = table.hits([g for gs in lists for g in gs]).astype(np.int32)
            sizes = np.array([len(gs) for gs in lists])
            start = len(memo)
            found[start : start + len(words), :count] = np.add.reduceat(hits, np.r_[0, np.cumsum(sizes)[:-1]])
            found[start : start + len(words), count] = sizes
            memo.update(zip(words, range(start, start + len(words)), strict=True))

        def counts_of(words: list[str]) -> np.ndarray:
            total = np.zeros(count + 1, np.int64)
            for i in range(0, len(words), len(found) // 4):
                part = words[i : i + len(found) // 4]
                new = [w for w in dict.fromkeys(part) if w not in memo]
                if len(memo) + len(new) > len(found):
                    memo.clear()
                    new = list(dict.fromkeys(part))
                if new:
                    learn(new)
                total += found[np.fromiter(map(memo.__getitem__, part), np.int64, len(part))].sum(axis=0)
            return total

        def one(text):
            words = _WORD.findall(text.lower()) if text and count else []
            if not words or not any(map(str.isalpha, text)):
                return "und", 0.0
            total = counts_of(words)
            n = int(total[count])
            true = np.maximum(0.0, (total[:count] - n * rates) / np.maximum(1e-9, 1 - rates))
            best = int(true.argmax())
            return table.languages[best], float(min(1.0, true[best] / n))

        def run(doc_ids, texts, held):
            pred, score = zip(*map(one, texts), strict=True) if texts else ((), ())
            return {"doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}

        return run

    read = docs.select("doc_id", "text", *(c for c in carry if c not in ("doc_id", "text")), held_out().alias("held_out"))
    return map_texts(read, ["doc_id", "text", "held_out"], "doc_id long, held_out boolean, lang_pred string, score double", make, carry=carry)
