"""First arrivals: one row per key out of repeated deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_arrival(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key: its ``order`` and ``values`` at the smallest ``order``.

    A partial aggregate runs before the shuffle, so a key that holds a third of
    all rows costs one row a task. Null ``order`` sorts last; at a tie the
    smallest values win (nulls first), so the result does not depend on row
    order. An empty input gives no rows. Columns named neither in ``keys`` nor
    in ``values`` are ignored.
    """
    pick = F.min(F.struct(F.col(order).isNull().alias("_late"), F.col(order), *values)).alias("_first")
    return df.groupBy(*keys).agg(pick).select(*keys, *(F.col("_first")[c].alias(c) for c in (order, *values)))


def by_first(value: Column | str, order: Column | str) -> Column:
    """Aggregate: ``value`` at the smallest ``order``, nulls last, ties to the smallest value."""
    o, v = (F.col(x) if isinstance(x, str) else x for x in (order, value))
    return F.min(F.struct(o.isNull().alias("n"), o.alias("o"), v.alias("v")))["v"]
