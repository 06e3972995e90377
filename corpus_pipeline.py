"""The corpus pipeline: documents through quality rules, language ID, near-deduplication, pseudonyms and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written as Parquet and read
again; all but the last return the columns of documents. The last returns the pieces of the packed sequences.
Empty input gives empty output with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqmine.llm import stages
from seqmine.llm.common import documents, stored
from seqmine.llm.queries import KEY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.similar_dedup(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.pseudonyms(docs, KEY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.packing(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: SQL can't express language ID or the fingerprints; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
