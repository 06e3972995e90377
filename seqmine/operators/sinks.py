"""Writers. Everything is validated before anything is overwritten."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.sequences import array_text, pattern_text


def as_text(patterns: DataFrame) -> DataFrame:
    """(pattern, length, support): items joined by blanks."""
    return patterns.select(pattern_text("seq").alias("pattern"), F.col("length").cast("int").alias("length"), F.col("support").cast("long").alias("support"))


def write_patterns(patterns: DataFrame, path: str, files: int | None = None) -> None:
    """Lines `item item ...<TAB>support`."""
    lines = patterns.select(F.concat_ws("\t", pattern_text("seq"), F.col("support").cast("string")).alias("value"))
    (lines.coalesce(files) if files else lines).write.mode("overwrite").text(path)


def write_encoded_patterns(patterns: DataFrame, path: str) -> None:
    """(seq, length, support) as Parquet, for later runs."""
    patterns.write.mode("overwrite").parquet(path)


def write_dictionary(dictionary: DataFrame, path: str, single_file: bool = False) -> None:
    """Lines `item<TAB>cf<TAB>df<TAB>id`, sorted by item."""
    rows = dictionary.select("item", "cf", "df", "id")
    rows = rows.coalesce(1).sortWithinPartitions("item") if single_file else rows.orderBy("item")
    rows.write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def save_encoded(positions: DataFrame, dictionary: DataFrame, path: str, codec: str = "snappy") -> None:
    """Encoded positions and their dictionary: what a later run resumes from."""
    positions.write.mode("overwrite").option("compression", codec).parquet(f"{path}/sequences")
    write_dictionary(dictionary, f"{path}/dictionary")


def write_encoded_text(sequences: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lines `id<TAB>[1, 2, 3]`."""
    sequences.select(F.concat_ws("\t", F.col("sid").cast("string"), array_text(F.col("items"))).alias("value")).write.mode(mode).text(path)


def each_pattern(patterns: DataFrame, write: Callable[[list[str], int], None]) -> None:
    """Calls write(items, support) for each pattern, on the executors and in no order: a sink of one's own."""

    def work(rows: Iterator[Row]) -> None:
        for r in rows:
            write(r["seq"], r["support"])

    patterns.select("seq", "support").foreachPartition(work)
