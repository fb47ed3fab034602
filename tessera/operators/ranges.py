"""Scans in order over a long group, such as a chromosome, of which a task holds one range.

Rows of a group are dealt to ranges of ``span`` units of their position. What a range passes on is one row of it; only those rows,
one a range, are put in order by group. Positions are unique in their group, and neither they nor the group are null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a range's own value and that of all ranges before it make one.
_JOINED: dict[Callable, Callable[[Column, Column], Column]] = {F.sum: lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)), F.max: F.greatest, F.min: F.least}


def _dealt(rows: DataFrame, order: str, span: int) -> DataFrame:
    return rows.withColumn("range_", F.floor(F.col(order) / F.lit(span)))


def neighbours(rows: DataFrame, by: Sequence[str], order: str, span: int, *, before: Sequence[str] = (), after: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``before_x`` of each column x of ``before``, its value in the row before in the group, and ``after_x`` likewise; null where there is none."""
    dealt, key = _dealt(rows, order, span), [*by, "range_"]
    inside, across = Window.partitionBy(*key).orderBy(order), Window.partitionBy(*by).orderBy("range_")
    sides = [(side, of, row, end) for side, of, row, end in (("before", before, F.lag, F.max_by), ("after", after, F.lead, F.min_by)) if of]
    ends = dealt.groupBy(*key).agg(*(end(F.struct(*of), order).alias(f"{side}_end_") for side, of, _, end in sides))
    ends = ends.select(*key, *(row(f"{side}_end_").over(across).alias(f"{side}_far_") for side, _, row, _ in sides))
    own = dealt.withColumns({f"{side}_near_": row(F.struct(*of)).over(inside) for side, of, row, _ in sides}).join(ends, key)
    found = {f"{side}_{c}": F.coalesce(f"{side}_near_", f"{side}_far_")[c] for side, of, _, _ in sides for c in of}
    return own.select(*rows.columns, *(v.alias(n) for n, v in found.items()))


def running(rows: DataFrame, by: Sequence[str], order: str, span: int, value: Column, how: Callable, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum, maximum or minimum (``how``: ``F.sum``, ``F.max``, ``F.min``) of ``value`` over the group's rows up to this one."""
    dealt, key = _dealt(rows, order, span).withColumn("value_", value), [*by, "range_"]
    inside = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy(*key).agg(how("value_").alias("whole_")).select(*key, how("whole_").over(across).alias("carried_"))
    own = dealt.withColumn("own_", how("value_").over(inside)).join(carried, key)
    return own.select(*rows.columns, _JOINED[how](F.col("carried_"), F.col("own_")).alias(name))
