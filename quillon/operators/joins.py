"""Joins on keys that may be null, and names that a table does not have yet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(label: str, *tables: DataFrame) -> str:
    """label, with as many underscores after it as no column of the tables has (in any case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while label.lower() in taken:
        label += "_"
    return label


def on_equal(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right where all keys are equal, nulls being equal to nulls. The keys are left's; a key that is null
    in all rows of both meets in one task, as any hot key does, and is split by AQE's skew join."""
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    names = {k: fresh(f"{k}_right", left, right) for k in keys}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())
