"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of `documents`; other columns are dropped, whatever
their names. `run` stores the rows between stages, so that none is computed twice.

All stages give no rows for an empty table. Null and empty texts have no language and go
in the first stage; very long texts are worked on whole. Rows that share a doc_id are
judged one by one by language and toxicity, stay or go together as near duplicates, and
are told apart by their texts when passages are cut (equal rows are all kept or all cut).
Null doc_ids count as the smallest id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, packing, simhash, suffixsort, toxicity
from lodestone.llm.arrowtools import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text with fewer of its n-grams in its best language than this is no known language.
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; ties go to the first by name."""
    found = langid.identify(docs, carry=("text", "lang", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic; without labels of both kinds, all."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, labels, carry=("text", "lang", "source", "n_chars")).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one of the least doc_id."""
    return simhash.first_of_copies(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes and more that stood earlier in the corpus; a document that
    is cut away wholly stays with an empty text."""
    found = suffixsort.suffix_dedup(docs, carry=("lang", "source"), as_text=True)
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining texts into training sequences; an empty text is the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("toxicity", clean),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: Learned models, fingerprints and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
