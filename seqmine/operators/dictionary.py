"""The f-list: collection frequency, document frequency and id of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import table


def repeated(sequences: DataFrame, keys: list[str]) -> bool:
    """Whether sequences have more than one row for an id."""
    return not sequences.where(F.col("sid").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def item_counts(sequences: DataFrame, unique: bool = False) -> DataFrame:
    """(item, cf, df). sequences: (sid, items); unique says that no sid repeats, which is looked up otherwise.

    Items are counted within their row, where equal ones stand together, so that only sums are dealt."""
    if not unique and repeated(sequences, ["sid"]):
        known = sequences.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.flatten(F.collect_list("items")).alias("items"))
        sequences = known.unionByName(sequences.where(F.col("sid").isNull()).select("sid", "items"))
    rows = sequences.select(F.col("sid").isNotNull().alias("known"), F.sort_array("items").alias("items"))
    none = F.lit(None).cast(sequences.schema["items"].dataType.elementType)
    pairs = F.arrays_zip(F.col("items").alias("item"), F.concat(F.array(none), "items").alias("before"))
    rows = rows.select("known", F.inline(pairs).alias("item", "before")).where("item IS NOT NULL")
    first = F.col("before").isNull() | (F.col("before") != F.col("item"))
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("cf"), F.count_if(first & F.col("known")).alias("df"))


def with_ids(counts: DataFrame) -> DataFrame:
    """(item, cf, df, id): ids from 1 by falling cf, ties by item.

    Items are sorted over all tasks and written; an id is the number of items in the tasks before and the place in its
    own. The table of tasks has a row for each and is all that is gathered."""
    ordered = counts.select("item", "cf", "df").repartitionByRange(F.desc("cf"), "item").sortWithinPartitions(F.desc("cf"), "item")
    # the task's number stands above the place in it
    placed = table(ordered.withColumn("at", F.monotonically_increasing_id()), "ranked").withColumn("task", F.shiftright("at", 33))
    sizes = placed.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("task", F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "task").select("item", "cf", "df", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("id"))


def dictionary(sequences: DataFrame, unique: bool = False) -> DataFrame:
    """(item, cf, df, id) of (sid, items)."""
    return with_ids(item_counts(sequences, unique))


def frequent_items(dictionary_: DataFrame, sigma: int) -> DataFrame:
    """Items in at least sigma sequences, the least frequent first when shown."""
    return dictionary_.where(F.col("df") >= sigma)


def word_count(sequences: DataFrame, min_support: int = 1) -> DataFrame:
    """(item, n): occurrences, of items with enough of them."""
    rows = sequences.select(F.explode("items").alias("item"))
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)


def lookup(dictionary_: DataFrame, *, item: str | None = None, id: int | None = None) -> DataFrame:
    """The entry of an item or an id."""
    if (item is None) == (id is None):
        raise ValueError("give an item or an id")
    return dictionary_.where(F.col("item") == item) if item is not None else dictionary_.where(F.col("id") == id)
