"""Sequence databases out of the driver's tables: (sid, pos, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import positions
from ..sources.tables import from_table, from_text_column

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user in order of time."""
    return from_table(read(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities of each customer in order of date."""
    return from_table(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part brands of each order in order of lines."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER).join(part, "l_partkey")
    return from_table(lines, "l_orderkey", "p_brand", LINE_ORDER)


def document_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, items): the words of each document."""
    return from_text_column(read(spark, sf_dir, "documents"), "text", F.col("doc_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(document_sequences(spark, sf_dir))


def turn_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, items): the words of each turn of a conversation."""
    return from_text_column(read(spark, sf_dir, "conversations"), "text", F.struct("conv_id", "turn"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(turn_sequences(spark, sf_dir))


#: Databases that have a sequence in each row.
WHOLE = {documents: document_sequences, turns: turn_sequences}
