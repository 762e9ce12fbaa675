"""From documents to packed training batches: quality rules, near-duplicates, personal data, mixing, packing.

Edge cases, at every stage: an empty table stays empty; null ids, sources and languages are values of their own; rows of
equal id are rows of their own until they are near-duplicates; columns of any other name and type are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import mixing, packing, pii, quality, simhash
from gristmill.llm.common import saved


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and short texts go."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id stays, null ids last; texts without words are one group."""
    return simhash.one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their personal data masked; null texts stay null."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix in training order, a row per copy; documents without words stay out."""
    return mixing.curriculum(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the batch and place of each; a null or empty text is one piece of no words."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_duplicates", distinct),
    ("personal_data", private),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot express the near-duplicate and personal-data stages; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs
