"""Ranks over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_rank(df: DataFrame, value: str) -> DataFrame:
    """``df`` with rank: 1 for the greatest value, equal values alike, gaps after them.

    The values are counted first; only their distinct ones (few for counts and
    rounded numbers) are put in order, and joined back.
    """
    seen = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(seen.select(value, (F.coalesce(before, F.lit(0)) + 1).alias("rank")), value)
