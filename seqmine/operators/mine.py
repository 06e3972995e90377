"""Level-wise mining, sequence by sequence.

Sequences come as (sid, pos, item), or as (sid, items) where a row holds one. The first form is gathered once: a row for
each UNIT positions of a sequence and what can be reached from them, so that no row grows with its sequence. Each level
walks all rows, extends the frequent chains of the level before by what follows within gamma + 1 positions, and counts
the chains of a sequence once; positions are explicit, so pruned items leave their gap behind. Occurrences are never
stored, and only counts are dealt. What goes on is looked up in a mask of bits that has a bounded size; counts alone
decide what is frequent.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import ALL, CLOSED, MAXIMAL, MiningParams
from .chains import CANDIDATES, counted_chains
from .condense import condense
from .dictionary import repeated
from .encode import positions as spread
from .tables import table

#: Positions of a sequence that a row begins in; a sequence within them is one row.
UNIT = 1 << 17
#: Bits of a mask for each entry, and at most (8 MB). Rows of a table that joins may broadcast.
MASK_BITS, MOST_BITS, SMALL = 16, 1 << 26, 20_000


def _weighted(df: DataFrame) -> bool:
    return "weight" in df.columns


def _support(df: DataFrame) -> Column:
    """Of rows that are distinct by (sequence, sid)."""
    return (F.sum("weight") if _weighted(df) else F.count(F.lit(1))).cast("long").alias("support")


def frequent_single(positions: DataFrame, sigma: int, group: list[str] | None = None) -> DataFrame:
    """(item, support) of items in at least sigma sequences; with group, within each group."""
    group = group or []
    extra = ["weight"] if _weighted(positions) else []
    once = positions.select(*group, "sid", "item", *extra).dropDuplicates([*group, "sid", "item"])
    return once.groupBy(*group, "item").agg(_support(once)).where(F.col("support") >= sigma)


def _slotted(positions: DataFrame, gamma: int) -> DataFrame:
    return positions.withColumn("slot", F.floor(F.col("pos") / (gamma + 1)).cast("long"))


def _reach(gamma: int) -> Column:
    """The slots of the positions within reach of an end."""
    first, last = (F.floor((F.col("end") + k) / (gamma + 1)).cast("long") for k in (1, gamma + 1))
    return F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last)))


def _units(positions: DataFrame, params: MiningParams, keys: list[str]) -> DataFrame:
    """(group, poss, items[, n][, seq]): sequences by rows, seq where one has several. positions: (keys, pos, item[, weight]).

    A row holds UNIT positions and as many more as a sequence of lam items can reach."""
    reach = (params.gamma + 1) * (params.lam - 1)
    size = max(UNIT, 4 * reach)
    first, last = (F.greatest(F.lit(0), F.floor((F.col("pos") - k) / size)).cast("long") for k in (reach, 0))
    weight = ["weight"] if _weighted(positions) else []
    rows = positions.where(F.col("sid").isNotNull() & F.col("item").isNotNull()).select(*keys, "pos", "item", *weight, first.alias("first"), last.alias("last"))
    whole = W.partitionBy(*keys)
    rows = rows.withColumn("parts", F.max("last").over(whole) - F.min("first").over(whole))
    rows = rows.withColumn("unit", F.explode(F.sequence("first", "last")))
    n = [F.first("weight").cast("long").alias("n") for _ in weight]
    units = rows.groupBy(*keys, "unit").agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("x"), F.max("parts").alias("parts"), *n)
    seq = F.when(F.col("parts") > 0, F.xxhash64(*keys)).alias("seq")
    return units.select(*keys[:-1], seq, F.col("x.pos").cast("array<long>").alias("poss"), F.col("x.item").alias("items"), *(["n"] if n else []))


def _counted(rows: DataFrame, by: list[str], sigma: int) -> DataFrame:
    """(by, support) of rows (by, n[, seq]); those of one seq count once."""
    if "seq" in rows.columns:
        rows = rows.groupBy("seq", *by).agg(F.when(F.col("seq").isNull(), F.sum("n")).otherwise(F.max("n")).alias("n"))
    return rows.groupBy(*by).agg(F.sum("n").cast("long").alias("support")).where(F.col("support") >= sigma)


def _mask(codes: DataFrame, n: int) -> np.ndarray:
    """Words of bits, one set for each of n codes by its remainder. All that is gathered is MOST_BITS / 8 bytes and as much for keys."""
    bits = 64
    while bits < min(MASK_BITS * n, MOST_BITS):
        bits *= 2
    bit = F.col("code").bitwiseAND(F.lit(bits - 1))
    words = codes.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got, out = words.toArrow(), np.zeros(bits // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _joinable(df: DataFrame, n: int) -> DataFrame:
    """A side of a join that has n rows: its files say little about its size in memory."""
    return F.broadcast(df) if n <= SMALL else df.hint("merge")


def mine_levels(positions: DataFrame, params: MiningParams, keys: list[str] | None = None) -> DataFrame:
    """(seq, length, support) of all frequent sequences of 1 to lam items. positions: (sid, pos, item[, weight]), or
    (sid, items[, weight]), which is walked as it is.

    keys names the columns that bound a sequence, ("sid",) as a rule; all but the last are groups that are mined
    apart and stay in the result."""
    keys = keys or ["sid"]
    group = keys[:-1]
    if keys[-1] != "sid":
        raise ValueError("the last key is sid")
    if "items" in positions.columns:
        positions = positions.where(F.col("sid").isNotNull())
        if repeated(positions, keys):
            positions = spread(positions, *group, *(["weight"] if _weighted(positions) else []))
    if "items" in positions.columns:
        units = positions.select(*group, "items", *([F.col("weight").cast("long").alias("n")] if _weighted(positions) else []))
    else:
        units = table(_units(positions, params, keys), "units")
        if units.where("seq IS NOT NULL").isEmpty():
            units = units.drop("seq")
    carried = [c for c in ("seq", "n") if c in units.columns]
    each = units.select(*group, *carried, F.explode(F.array_distinct("items")).alias("item")).where("item IS NOT NULL")
    each = each if "n" in carried else each.withColumn("n", F.lit(1).cast("long"))
    # code: the id of a frequent sequence, its item's hash or that of its prefix's id and its last item's
    singles = table(_counted(each, [*group, "item"], params.sigma).withColumn("code", F.xxhash64(*group, "item")), "f1")
    n_items = n = singles.count()
    names = _joinable(singles.select(F.col("code").alias("item"), F.col("item").alias("name")), n_items)
    level = singles.select(*group, "code", F.array("item").alias("seq"), "support")
    found, masks = [level.select(*group, "seq", "support")], []
    one = F.arrays_zip("poss", "items") if "poss" in units.columns else F.col("items")
    rows = units.select(*group, *carried, F.posexplode(one).alias("at", "x"))
    item = F.col("x.items") if "poss" in units.columns else F.col("x")
    rows = rows.select("at", F.xxhash64(*group, item).alias("code"), *([F.col("x.poss").alias("pos")] if "poss" in units.columns else []), *carried)
    for k in range(2, params.lam + 1):
        if not n:
            break
        masks.append(_mask(level, n))
        work = counted_chains(k, params.gamma, units.sparkSession.sparkContext.broadcast(masks))
        cand = rows.mapInArrow(work, CANDIDATES)
        frequent = _counted(cand if "seq" in carried else cand.drop("seq"), ["pre", "item"], params.sigma)
        heads = _joinable(level.select(*group, F.col("code").alias("pre"), F.col("seq").alias("head")), n)
        named = frequent.join(heads, "pre").join(names, "item")
        level = table(named.select(*group, F.xxhash64("pre", "item").alias("code"), F.concat("head", F.array("name")).alias("seq"), "support"), "level")
        n = level.count()
        found.append(level.select(*group, "seq", "support"))
    every = reduce(DataFrame.unionByName, found)
    return every.select(*group, "seq", F.size("seq").alias("length"), "support")


def mine(positions: DataFrame, params: MiningParams) -> DataFrame:
    """(seq, length, support): all, maximal or closed frequent sequences. positions: as mine_levels takes them.

    All sequences have two items at least; maximal and closed ones may be single items."""
    if params.strategy == "pivot":
        from .pivot import mine_pivot

        every = mine_pivot(positions, params)
    else:
        every = mine_levels(positions, params)
    if params.type == ALL:
        return every.where(F.col("length") >= 2)
    if params.type not in (MAXIMAL, CLOSED):
        raise ValueError(params.type)
    return condense(table(every, "patterns"), params.type)


def two_sequence_postings(positions: DataFrame, params: MiningParams) -> DataFrame:
    """(seq, support, sid, starts): for each frequent 2-sequence and each sequence it occurs in where it begins, in order.

    A row for each pair: the postings of a frequent pattern are as many as the sequences and never meet in one row."""
    left = positions.select("sid", F.col("pos").alias("end"), F.col("item").alias("a")).withColumn("slot", _reach(params.gamma))
    right = _slotted(positions, params.gamma)
    near = (F.col("pos") > F.col("end")) & (F.col("pos") <= F.col("end") + params.gamma + 1)
    pairs = left.join(right, ["sid", "slot"]).where(near).select("sid", F.array("a", "item").alias("seq"), F.col("end").alias("start")).distinct()
    inside = table(pairs.groupBy("seq", "sid").agg(F.array_sort(F.collect_set("start")).alias("starts")), "postings")
    support = inside.groupBy("seq").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= params.sigma)
    return inside.join(support, "seq").select("seq", "support", "sid", "starts")


def max_support_by_left(patterns: DataFrame) -> DataFrame:
    """(item, support): for each left item the greatest support of a 2-sequence that begins with it."""
    return patterns.where("length = 2").groupBy(F.get("seq", F.lit(0)).alias("item")).agg(F.max("support").alias("support"))
