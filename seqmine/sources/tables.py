"""Sequence databases out of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import BLANKS, WHITE, words


def from_table(df: DataFrame, sid: str, item: str, order_by: list[str]) -> DataFrame:
    """(sid, pos, item) of rows that are the items of sequences. One shuffle by sid, which later steps reuse.

    order_by should be total, since ties are broken by the item alone. Rows without an item or a sid are dropped."""
    from pyspark.sql import Window as W

    rows = df.where(F.col(item).isNotNull() & F.col(sid).isNotNull())
    order = W.partitionBy(sid).orderBy(*order_by, item)
    return rows.select(F.col(sid).alias("sid"), (F.row_number().over(order) - 1).alias("pos"), F.col(item).cast("string").alias("item"))


def from_text_column(df: DataFrame, text: str, sid: Column | None = None, sep: str = WHITE) -> DataFrame:
    """(sid, items) of a column of running text; without sid each row gets one. Texts without words are dropped."""
    if sep == WHITE:  # told by the text, so that it is split once
        df = df.where(F.trim(F.col(text), F.lit(BLANKS)) != "")
    rows = df.select((sid if sid is not None else F.monotonically_increasing_id()).alias("sid"), words(F.col(text), sep).alias("items"))
    return rows if sep == WHITE else rows.where(F.size("items") > 0)
