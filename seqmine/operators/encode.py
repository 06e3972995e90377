"""Between item names and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a dictionary that are broadcast, by id, if they have no more bytes than this.
HEAD, HEAD_BYTES = 100_000, 8 << 20


def positions(sequences: DataFrame, *carry: str) -> DataFrame:
    """(sid, pos, item) of (sid, items), positions from 0."""
    return sequences.select("sid", *carry, F.posexplode("items").alias("pos", "item")).withColumn("pos", F.col("pos").cast("long"))


def collect(positions_: DataFrame, item: str = "item") -> DataFrame:
    """(sid, items) of (sid, pos, item): the inverse of positions, gaps closed."""
    rows = positions_.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", item))).alias("x"))
    return rows.select("sid", F.col(f"x.{item}").alias("items"))


def _head(dictionary: DataFrame) -> tuple[int, bool]:
    """The ids up to which a dictionary is broadcast, and whether there are others."""
    inside = F.col("id") <= HEAD
    others, size = dictionary.agg(F.count_if(~inside), F.sum(F.when(inside, F.octet_length(F.col("item").cast("string"))))).first()
    return (HEAD, others > 0) if (size or 0) <= HEAD_BYTES else (0, True)


def encode(positions_: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Items replaced by ids. Items outside the dictionary go, positions stay as they are.

    The HEAD most frequent items, most of a text, are looked up where they stand; only the rows of others are dealt."""
    top, more = _head(dictionary)
    ids = dictionary.select("item", "id")
    columns = [*[c for c in positions_.columns if c != "item"], F.col("id").alias("item")]
    head = F.broadcast(ids.where(F.col("id") <= top))
    near = positions_.join(head, "item").select(*columns)
    if not more:
        return near
    rest = positions_.join(head.select("item"), "item", "left_anti") if top else positions_
    far = rest.join(ids.where(F.col("id") > top).hint("merge"), "item").select(*columns)
    return near.unionByName(far) if top else far


def names(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ids replaced by items: the inverse of encode."""
    top, more = _head(dictionary)
    items = dictionary.select(F.col("id").alias("item"), F.col("item").alias("name"))
    columns = [*[c for c in encoded.columns if c != "item"], F.col("name").alias("item")]
    near = encoded.where(F.col("item") <= top).join(F.broadcast(items.where(F.col("item") <= top)), "item").select(*columns)
    if not more:
        return near
    far = encoded.where(F.col("item") > top).join(items.where(F.col("item") > top).hint("merge"), "item").select(*columns)
    return near.unionByName(far) if top else far


def decode(patterns: DataFrame, dictionary: DataFrame, column: str = "seq") -> DataFrame:
    """Arrays of ids to arrays of names, in order. patterns is told apart by the array itself."""
    rows = patterns.select(F.col(column).alias("key"), F.posexplode(column).alias("at", "id")).distinct()
    named = rows.join(dictionary.select("id", "item"), "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("x"))
    return patterns.join(named, patterns[column] == named["key"]).drop("key", column).withColumn(column, F.col("x.item")).drop("x")


def pack_duplicates(sequences: DataFrame) -> DataFrame:
    """(items, weight): equal sequences once, with how many (or how much weight) there were."""
    weight = F.col("weight") if "weight" in sequences.columns else F.lit(1)
    return sequences.groupBy("items").agg(F.sum(weight.cast("long")).alias("weight"))


def total_support(sequences: DataFrame) -> DataFrame:
    """One row: the weight of the whole database."""
    weight = F.col("weight") if "weight" in sequences.columns else F.lit(1)
    return sequences.agg(F.coalesce(F.sum(weight.cast("long")), F.lit(0)).alias("total"))
