"""Text sources, one line a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import WHITE, sequence_id, tokenize, words


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """(value, file): lines of all files, folders included; compressed files by their ending."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def _with_sid(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(F.size("items") > 0).withColumn("sid", F.monotonically_increasing_id()).select("sid", *columns)


def read_sequences(spark: SparkSession, paths: str | list[str], sep: str = WHITE, pattern: str | None = None, with_file: bool = False) -> DataFrame:
    """Lines `id item item ...`: the first token is the id."""
    lines = read_lines(spark, paths, pattern=pattern).withColumn("t", tokenize("value", sep))
    rows = lines.select(F.get("t", F.lit(0)).alias("seq_id"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("items"), "file")
    return _with_sid(rows, "seq_id", "items", *["file"] * with_file)


def read_sentences(spark: SparkSession, paths: str | list[str], max_docs: int = 0, sep: str = WHITE) -> DataFrame:
    """Lines of items without an id; with max_docs the first so many lines of each file."""
    lines = read_lines(spark, paths).withColumn("line", F.monotonically_increasing_id())
    if max_docs > 0:
        lines = lines.withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("line"))).where(F.col("n") <= max_docs)
    rows = lines.select(words(F.trim("value"), sep).alias("items"), F.concat_ws(":", "file", "line").alias("seq_id"))
    return _with_sid(rows, "seq_id", "items")


def read_length_prefixed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines `id length item item ...`: a numeric id, a length that isn't used, the items."""
    t = read_lines(spark, paths).select(tokenize("value", r"\s").alias("t"))
    rows = t.select(F.get("t", F.lit(0)).try_cast("long").alias("seq_id"), F.slice("t", F.lit(3), F.greatest(F.size("t") - 2, F.lit(0))).alias("items"))
    return _with_sid(rows, "seq_id", "items")


def read_int_sequences(spark: SparkSession, paths: str | list[str], sep: str = "\t") -> DataFrame:
    """Lines of encoded items without an id, -n for n positions of gap: (sid, pos, item)."""
    values = read_lines(spark, paths).select(words(F.col("value"), sep).cast("array<long>").alias("items"))
    rows = _with_sid(values, "items").select("sid", F.posexplode("items").alias("at", "item"))
    before = W.partitionBy("sid").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    pos = F.coalesce(F.sum(F.when(F.col("item") < 0, -F.col("item")).otherwise(1)).over(before), F.lit(0))
    return rows.withColumn("pos", pos).where("item >= 0").select("sid", "pos", "item")


def numeric_ids(sequences: DataFrame) -> DataFrame:
    """sequences with long ids: as they are where numeric, hashed otherwise."""
    return sequences.withColumn("seq_id", sequence_id(F.col("seq_id").cast("string")))
