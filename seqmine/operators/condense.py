"""Maximal and closed patterns: an anti-join against the extensions by one item.

A sequence goes if a frequent sequence that is one item longer begins or ends with it, for closed patterns only if
that one has the same support. With downward closure this means contiguous containment: `a c` stays beside `a b c`.
Extensions longer than the mined length don't exist, so all sequences of that length stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import CLOSED


def condense(patterns: DataFrame, type_: str, group: list[str] | None = None) -> DataFrame:
    """The maximal or closed ones of (seq, length, support), single items included."""
    group = group or []
    longer = patterns.where("length > 1")
    n = F.size("seq") - 1
    parts = longer.select(*group, F.explode(F.array(F.slice("seq", F.lit(1), n), F.slice("seq", F.lit(2), n))).alias("seq"), "support").distinct()
    if type_ == CLOSED:
        return patterns.join(parts, [*group, "seq", "support"], "left_anti").select(patterns.columns)
    return patterns.join(parts.select(*group, "seq").distinct(), [*group, "seq"], "left_anti").select(patterns.columns)
