"""Statistics of a sequence database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_histogram(sequences: DataFrame) -> DataFrame:
    """(length, n)"""
    return sequences.groupBy(F.size("items").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def distinct_items_histogram(sequences: DataFrame) -> DataFrame:
    """(distinct_items, n)"""
    return sequences.groupBy(F.size(F.array_distinct("items")).alias("distinct_items")).agg(F.count(F.lit(1)).alias("n"))
