"""Column functions over item arrays: the scalar vocabulary of the engine. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space as Java's \s has it.
WHITE = r"[ \t\n\x0B\f\r]+"
BLANKS = " \t\n\x0b\f\r"


def tokenize(text: Column | str, sep: str = WHITE) -> Column:
    """Split at a separator; a leading empty token stays (it is the id of a line that starts with white space),
    trailing empty ones go. Null gives an empty array."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if sep == WHITE:  # one empty string at the end at most, which needs no look at each token
        text = F.rtrim(text, F.lit(BLANKS))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, sep))
    parts = F.split(text, sep)
    # drop the longest run of empty strings at the end: reversed, everything from the first token that isn't empty
    back = F.reverse(parts)
    first = F.array_position(F.transform(back, lambda t: t != ""), True)
    return F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(1), F.size(parts) - first.cast("int") + 1))


def words(text: Column, sep: str = WHITE) -> Column:
    """The tokens that aren't empty."""
    if sep == WHITE:
        return tokenize(F.ltrim(text, F.lit(BLANKS)), sep)
    return F.filter(tokenize(text, sep), lambda t: t != "")


def sequence_id(token: Column) -> Column:
    """A numeric id as it is, any other hashed; only carried along, never a key."""
    return F.coalesce(token.try_cast("long"), F.xxhash64(token))


def pattern_text(items: Column | str) -> Column:
    """Items joined by blanks."""
    return F.concat_ws(" ", items)


def gap_between(left: Column, right: Column) -> Column:
    """How many positions lie between two positions."""
    return right - left - 1


def common_prefix_length(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first = F.array_position(equal, False)
    return F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")


def by_length_then_items(a: Column) -> Column:
    """Sort key: shorter arrays first, then item by item."""
    return F.struct(F.size(a).alias("n"), a.alias("items"))


def ordering(a: Column, kind: str = "descending") -> list[Column]:
    """How arrays of ids sort: `descending` or `ascending` item by item, a beginning before (ascending) or after
    (descending) what goes on, or `by_length`, shorter ones first."""
    if kind == "descending":
        return [a.desc()]
    if kind == "ascending":
        return [a.asc()]
    if kind == "by_length":
        return [by_length_then_items(a).asc()]
    raise ValueError(kind)


def partition_key(a: Column, kind: str = "complete") -> Column:
    """What arrays of ids are dealt by: their `first` item, `first_two`, `all_but_last`, or `complete`."""
    n = {"first": F.lit(1), "first_two": F.lit(2), "all_but_last": F.greatest(F.size(a) - 1, F.lit(0)), "complete": F.size(a)}
    return F.slice(a, F.lit(1), n[kind])


def array_text(a: Column) -> Column:
    """[a, b, c]"""
    return F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]"))


def pivot(items: Column) -> Column:
    """The largest item id of a sequence."""
    return F.array_max(items)


def has_pivot(items: Column, begin: Column | int, end: Column | int) -> Column:
    """Whether an item lies in the range."""
    return F.exists(items, lambda x: (x >= begin) & (x <= end))


def pair_key(left: Column, right: Column) -> Column:
    """Two ints in one long, ordered by left, then right (both from 0)."""
    return F.shiftleft(left.cast("long"), 32).bitwiseOR(right.cast("long"))


def pair_left(key: Column) -> Column:
    return F.shiftright(key, 32).cast("int")


def pair_right(key: Column) -> Column:
    return key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def delta_encode(values: Column) -> Column:
    """First value, then differences."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, F.greatest(i - 1, F.lit(0)))))


def delta_decode(deltas: Column) -> Column:
    """The values again. For arrays within a row, since it takes the square of their length; posting lists are rows."""
    return F.transform(deltas, lambda _, i: F.aggregate(F.slice(deltas, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b))


def drop_equal_neighbours(segments: Column) -> Column:
    """Equal segments of one transaction once, in order of first occurrence."""
    return F.array_distinct(segments)
