"""Time-stamped sequences: gaps are differences of time.

The items of one time stand at consecutive positions; the next time stands at least as many positions on as time
has passed, and never before the items of this one have had theirs: P(next) = P + max(items at t, t(next) - t).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import tokenize
from .text import read_lines


def timed_positions(df: DataFrame, sid: str, ts: Column, item: str, order_by: list[str], time_scale: int = 1) -> DataFrame:
    """(sid, pos, item) of rows with times in whole units; order_by orders the items of one time.

    One shuffle by sid: both windows have its partitioning. Rows without sid, time or item are dropped."""
    rows = df.select(F.col(sid).alias("sid"), (F.floor(ts) * time_scale).cast("long").alias("t"), F.col(item).cast("string").alias("item"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)))
    rows = rows.where(F.col("sid").isNotNull() & F.col("t").isNotNull() & F.col("item").isNotNull())
    inside = W.partitionBy("sid", "t").orderBy(*(f"o{i}" for i in range(len(order_by))), "item")
    by_time = W.partitionBy("sid").orderBy("t", "rank")
    rows = rows.repartition("sid").withColumns({"rank": F.row_number().over(inside), "n": F.count(F.lit(1)).over(W.partitionBy("sid", "t"))})
    # on the first item of each time: how far its position is from that of the time before
    before_t, before_n = F.lag("t").over(by_time), F.lag("n").over(by_time)
    step = F.when(F.col("rank") == 1, F.coalesce(F.greatest(before_n, F.col("t") - before_t), F.lit(0))).otherwise(F.lit(0))
    rows = rows.withColumn("step", step)
    start = F.sum("step").over(by_time.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("sid", (start + F.col("rank") - 1).cast("long").alias("pos"), "item")


def read_timed(spark: SparkSession, paths: str | list[str], time_scale: int = 1, strict: bool = False) -> DataFrame:
    """Lines `id t item t item ...` to (sid, pos, item). Times out of order are sorted, or an error if strict."""
    lines = read_lines(spark, paths).select(F.monotonically_increasing_id().alias("sid"), tokenize("value").alias("t"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor((F.size("t") - 1) / 2).cast("int")), lambda k: F.struct(F.get("t", 2 * k - 1).try_cast("long").alias("ts"), F.get("t", 2 * k).alias("item")))
    rows = lines.where(F.size("t") > 2).select("sid", F.posexplode(pairs).alias("ord", "x")).select("sid", "ord", "x.ts", "x.item")
    if strict:
        late = F.col("ts") < F.lag("ts").over(W.partitionBy("sid").orderBy("ord"))
        rows = rows.withColumn("ts", F.when(late, F.raise_error(F.concat(F.lit("time decreases in sequence "), F.col("sid")))).otherwise(F.col("ts")))
    return timed_positions(rows, "sid", F.col("ts"), "item", ["ord"], time_scale)
