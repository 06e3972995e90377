"""Encoded sequences and dictionaries as they were saved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY = "item string, cf long, df long, id long"


def load_encoded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positions, dictionary) of a folder that save_encoded wrote."""
    return spark.read.parquet(f"{path}/sequences"), load_dictionary(spark, f"{path}/dictionary")


def load_dictionary(spark: SparkSession, path: str, min_df: int = 0, min_cf: int = 0, columns: list[str] | None = None) -> DataFrame:
    """The tab-separated f-list; unread columns and infrequent rows are left out while reading."""
    rows = spark.read.csv(path, sep="\t", schema=DICTIONARY, quote="", escape="")
    if min_df > 0:
        rows = rows.where(F.col("df") >= min_df)
    if min_cf > 0:
        rows = rows.where(F.col("cf") >= min_cf)
    return rows.select(*columns) if columns else rows


def read_encoded_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines `id<TAB>[1, 2, 3]`: (sid, seq_id, items) with integer items."""
    from ..functions.sequences import tokenize
    from .text import read_lines

    t = read_lines(spark, paths).select(tokenize(F.trim(F.regexp_replace("value", r"[\[\],]", " "))).alias("t"))
    rows = t.select(F.monotonically_increasing_id().alias("sid"), F.get("t", F.lit(0)).alias("seq_id"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).cast("array<long>").alias("items"))
    return rows.where(F.size("items") > 0)
