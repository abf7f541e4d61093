"""A training corpus from raw documents: filter, deduplicate three ways, pack.

Each stage reads what the one before it wrote and works on all of it.  Tables of a
stage's own go when its result is written, and its result when the next one's is.

Defined cases, of every stage: null text counts as empty; rows of one id, rows without
one and repeated rows are judged by their texts, row by row; an empty table gives an
empty result; columns of any further names are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuespark.llm import exact_dedup, jaccard_join, packing, quality_rules, substring_dedup
from cuespark.llm.workspace import Workspace, collected, prepare

#: Passages that count as repeated: so many words, found by a number of bytes, and where they take fewer as such.
REPEAT_WORDS, REPEAT_BYTES = 51, 240


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality_rules.filtered(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the least doc_id."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    prepare(spark)
    return jaccard_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long passages that also stand elsewhere."""
    prepare(spark)
    return substring_dedup.without_repeats(docs, REPEAT_BYTES, REPEAT_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in as few sequences as can be."""
    prepare(spark)
    return packing.packed(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("jaccard_join", near), ("suffix_dedup", repeats), ("packing", pack)]

#: Tokenisation, EM and suffix arrays have no SQL; every stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with collected():
            docs = work.table(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
