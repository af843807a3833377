"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage works on all that the one before it kept. The first four return the columns of documents; the last one
returns the pieces of the packed sequences.

Defined cases, for every stage: a row is judged by its own text, so rows without a doc_id and different texts of one
doc_id stand for themselves; a null text is an empty one, which the first stage rejects; columns beside doc_id and text
may hold nulls and have any name, and come through as they are; an empty table gives an empty one. Of rows that are the
same altogether, the exact stage keeps one. Ties: the exact stage keeps the longest original, then the smallest doc_id
(rows without one last); the near stage the smallest doc_id, then the text of the smallest digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, jaccard_join, packing, quality_rules, toxicity
from tidemark.llm.common import save, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words to a shingle, a similarity of 0.8."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens. Behind the other stages an executor has less room for remembered words."""
    return packing.pack_documents(docs, memory=100_000)


STAGES = [("quality rules", quality), ("toxicity", clean), ("exact dedup", exact), ("near duplicates", near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage compresses texts, which SQL cannot express.
ORACLE_SQL = None
