"""Pivot partitions: each pattern is counted in the partition of its largest item.

Frequent items, ordered from the least frequent, are packed next-fit into ranges of ids with a budget of document
frequency. A sequence goes to each partition that one of its items falls into, reduced to what can matter there:
items up to the range's end, within reach of a pivot, in segments that hold two items and a pivot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import MiningParams
from .dictionary import with_ids
from .encode import decode, encode
from .tables import table


def pack_items(dictionary: DataFrame, sigma: int, budget: int) -> DataFrame:
    """(part, begin_item, end_item, total_df): next-fit over frequent items by falling id.

    A partition closes before the item that would exceed the budget; an item over the budget stands alone. Next-fit
    is sequential: the driver walks the frequent items, 16 bytes each, a task's share at a time, and keeps a row for
    each partition, of which there are less than 2 / budget of the total document frequency."""
    spark = dictionary.sparkSession
    rows, part, begin, end, total = [], 0, None, None, 0
    ordered = dictionary.where(F.col("df") >= sigma).select("id", "df").orderBy(F.desc("id"))
    for r in ordered.toLocalIterator(prefetchPartitions=True):
        if end is not None and total + r["df"] > budget:
            rows.append((part, begin, end, total))
            part, end, total = part + 1, None, 0
        if end is None:
            end = r["id"]
        begin, total = r["id"], total + r["df"]
    if end is not None:
        rows.append((part, begin, end, total))
    return spark.createDataFrame(rows, "part int, begin_item long, end_item long, total_df long")


def part_items(parts: DataFrame) -> DataFrame:
    """(item, part, begin_item, end_item): a row for each id of a partition's range, to join by equal items."""
    return parts.select(F.explode(F.sequence("begin_item", "end_item")).alias("item"), "part", "begin_item", "end_item")


def item_parts(encoded: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, begin_item, end_item, sid): the partitions that a sequence touches, once each."""
    touched = encoded.select("sid", "item").join(part_items(parts), "item")
    return touched.select("part", "begin_item", "end_item", "sid").distinct()


def rewrite(encoded: DataFrame, parts: DataFrame, params: MiningParams) -> DataFrame:
    """(part, sid, pos, item, is_pivot): what of a sequence its partitions need. encoded: (sid, pos, item as id).

    1. items up to the range's end; others become gaps by their absence;
    2. segments, cut where a gap is longer than gamma, with two items and a pivot;
    3. items that a chain of lam - 1 steps can connect to a pivot: within (gamma + 1)(lam - 1) positions of one."""
    weight = ["weight"] if "weight" in encoded.columns else []
    rows = item_parts(encoded, parts).join(encoded, "sid").where(F.col("item") <= F.col("end_item"))
    rows = rows.select("part", "sid", "pos", "item", *weight, (F.col("item") >= F.col("begin_item")).alias("is_pivot"))
    order = W.partitionBy("part", "sid").orderBy("pos")
    rows = rows.withColumn("cut", F.coalesce((F.col("pos") - F.lag("pos").over(order) - 1 > params.gamma).cast("int"), F.lit(0)))
    rows = rows.withColumn("segment", F.sum("cut").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy("part", "sid", "segment")
    pivot_at = F.when(F.col("is_pivot"), F.col("pos"))
    reach = (params.gamma + 1) * (params.lam - 1)
    by_pos = whole.orderBy("pos")
    rows = rows.withColumns(
        {
            "n": F.count(F.lit(1)).over(whole),
            "left": F.last(pivot_at, ignorenulls=True).over(by_pos.rowsBetween(W.unboundedPreceding, 0)),
            "right": F.first(pivot_at, ignorenulls=True).over(by_pos.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    near = (F.col("pos") - F.col("left") <= reach) | (F.col("right") - F.col("pos") <= reach)
    return rows.where((F.col("n") >= 2) & near).select("part", "sid", "pos", "item", "is_pivot", *weight)


def pivot_offsets(encoded: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, sid, first_pos, last_pos): where the pivots of a sequence begin and end in each of its partitions."""
    rows = encoded.join(part_items(parts), "item")
    return rows.groupBy("part", "sid").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def pivot_intervals(encoded: DataFrame, parts: DataFrame, params: MiningParams) -> DataFrame:
    """(part, sid, start, stop): the neighbourhoods of pivots, overlapping ones merged."""
    reach = (params.gamma + 1) * (params.lam - 1)
    rows = encoded.join(part_items(parts), "item").select("part", "sid", "pos").distinct()
    order = W.partitionBy("part", "sid").orderBy("pos")
    rows = rows.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(order) > 2 * reach).cast("int"), F.lit(0)))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("part", "sid", "island").agg(F.greatest(F.lit(0), F.min("pos") - reach).alias("start"), (F.max("pos") + reach).alias("stop")).drop("island")


def segments(positions: DataFrame, gamma: int) -> DataFrame:
    """(sid, segment, start, stop, n): runs of items with gaps of gamma at most."""
    order = W.partitionBy("sid").orderBy("pos")
    rows = positions.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(order) - 1 > gamma).cast("int"), F.lit(0)))
    rows = rows.withColumn("segment", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("sid", "segment").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.count(F.lit(1)).alias("n"))


def by_partition(rewritten: DataFrame, n: int | None = None, only: int | None = None) -> DataFrame:
    """(part, sid, items) dealt by partition, within it from short to long; only: one partition, for debugging."""
    rows = rewritten.where(F.col("part") == only) if only is not None else rewritten
    rows = rows.groupBy("part", "sid").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("x")).select("part", "sid", F.col("x.item").alias("items"))
    dealt = rows.repartition(n, "part") if n else rows.repartition("part")
    return dealt.sortWithinPartitions("part", F.size("items"), "items")


def mine_pivot(positions: DataFrame, params: MiningParams) -> DataFrame:
    """(seq, length, support) of all frequent sequences of 1 to lam items, by pivot partitions."""
    from .mine import frequent_single, mine_levels

    positions = table(positions, "positions")  # counted, listed and encoded
    counts = positions.groupBy("item", "sid").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("df"))
    single = frequent_single(positions, params.sigma)
    # the f-list keeps what is frequent by weight; its document frequency is the budget's unit
    flist = table(with_ids(counts.join(single.select("item"), "item", "left_semi")), "flist")
    parts = pack_items(flist, 1, params.partition_size)
    inside = table(rewrite(encode(positions, flist), parts, params), "rewritten")
    weight = ["weight"] if "weight" in positions.columns else []
    local = mine_levels(inside.select("part", "sid", "pos", "item", *weight), params, ["part", "sid"])
    own = local.join(parts.select("part", "begin_item"), "part").where((F.col("length") >= 2) & (F.array_max("seq") >= F.col("begin_item")))
    named = decode(table(own.select("seq", "length", "support"), "patterns"), flist).select("seq", "length", "support")
    return single.select(F.array("item").alias("seq"), F.lit(1).alias("length"), "support").unionByName(named)
