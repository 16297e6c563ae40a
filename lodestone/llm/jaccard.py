"""N-gram Jaccard join: a blocked sparse product of documents by shingles.

The work is that of `shinglesets`: equal sets are one row, rows meet in blocks of the
columns that two linked sets must share, and overlaps are counted over all columns of the
entries that remain. Here the bits of a row are the parities of its shingles alone: a pair
with more differing ones than its sizes allow cannot link, so the bound loses no link, and
the result is exact.

Words are maximal runs other than ASCII white space, only A-Z are lower-cased, and shingles
are told apart by 64-bit hashes. A text of fewer words than a shingle is one shingle; null
texts and those without words have the empty set, which links with nothing. Repeated rows
are linked like other equal sets; a null doc_id takes part, but names a component only where
nothing else does. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrowtools import map_texts, stored
from lodestone.llm.shinglesets import PARITY_WORDS, Bounds, connected, most_different, parities, set_key, shingles


def bounds(similarity: float) -> Bounds:
    """Parities alone; a pair of half the difference that is allowed is taken for close."""
    most = most_different(similarity)
    return Bounds(PARITY_WORDS, parities, most, lambda a, b: most(a, b) / 2)


def joined(docs: DataFrame, width: int = 5, similarity: float = 0.8, tile: int = 16_384) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable) of every document."""
    worded = docs.select("doc_id", "text").where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    found = stored(connected(worded, bounds(similarity), width, similarity, tile))
    named = found.select("k", "root").join(found.groupBy("root").agg(F.min("name").alias("component_id")), "root").select("k", "component_id")

    def make():
        def f(doc_ids, texts):
            sets = [shingles(t, width) for t in texts]
            return {"doc_id": pa.array(doc_ids, pa.int64()), "n_shingles": pa.array(map(len, sets), pa.int64()), "k": pa.array([set_key(h) if len(h) else None for h in sets], pa.int64())}

        return f

    rows = map_texts(docs, ["doc_id", "text"], "doc_id long, n_shingles long, k long", make)
    # Empty sets have no partner; they are spread by id.
    rows = rows.withColumn("k", F.coalesce("k", F.xxhash64("doc_id")))
    return rows.join(named, "k", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
