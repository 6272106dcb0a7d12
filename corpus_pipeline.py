"""From raw documents to packed training sequences: five stages, each over all that the last one kept.

A stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet in the
shared folder and read again as the next stage's documents. All but the last keep the columns
of ``documents``; where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopledger.llm import ngram_join, packing, pii, quality, suffix_dedup
from shopledger.llm.queries import table, vocabulary
from shopledger.llm.tables import keep


def _recounted(docs: DataFrame, before: DataFrame) -> DataFrame:
    if "n_chars" not in before.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that lose too much."""
    return _recounted(quality.clean(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of 100 bytes or more that occur earlier go."""
    return _recounted(suffix_dedup.deduplicate(docs), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return _recounted(pii.redact(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2048."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Neither the groups of near copies nor the token ids can be had in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
