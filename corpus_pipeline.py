"""A training corpus from raw documents: language, exact copies, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, extra ones included. Long texts are handled as the operators say, and an empty
table goes through all stages empty. A language model's packing has no SQL form, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from molweave.llm import chosen_path, exact, langid, mixing, packing
from molweave.sources.scratch import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; null texts, texts without a letter and rejected ones go, all repeated rows of others stay."""
    return langid.keep_known(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the longest original and then the smallest id; null counts as empty."""
    return exact.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; texts without words are near to nothing and stay."""
    return chosen_path.keep_representatives(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; texts without words have size 0 and follow the rate too."""
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; an empty or null text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("exact copies", without_copies),
    ("near copies", without_near_copies),
    ("mix", mixed_sources),
    ("pack", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
