"""Range joins and as-of joins: composed of equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of the buckets over which intervals are joined.
BUCKET = 256


def overlapping(df: DataFrame, group: str, id_column: str, start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """(group, id_a, id_b) of half-open intervals of a group that overlap, id_a < id_b.

    Intervals meet in the buckets that they touch, so the join is on equal
    keys; a pair is kept in the first bucket that both touch, hence once. Empty
    intervals and nulls overlap nothing.
    """
    s = df.select(F.col(group).alias("g"), F.col(id_column).alias("id"), F.col(start).alias("a"), F.col(end).alias("b")).where("a < b")
    s = s.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor((F.col("b") - 1) / bucket))))
    x, y = s.alias("x"), s.alias("y")
    on = (F.col("x.g") == F.col("y.g")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id"))
    hit = (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b")) & (F.col("x.k") == F.floor(F.greatest("x.a", "y.a") / bucket))
    return x.join(y, on).where(hit).select(F.col("x.g").alias(group), F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))


def inner(df: DataFrame, group: str, id_column: str, start: str, end: str) -> DataFrame:
    """Intervals that lie inside a longer one of their group; a running maximum, no self-join."""
    earlier = F.max(end).over(Window.partitionBy(group).orderBy(start).rangeBetween(Window.unboundedPreceding, -1))
    longest = F.max(end).over(Window.partitionBy(group, start))
    return df.withColumn("_e", earlier).withColumn("_l", longest).where((F.col("_e") >= F.col(end)) | (F.col("_l") > F.col(end))).drop("_e", "_l")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, id_column: str) -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    One shuffle by key: the union of both sides, in time order, right rows
    before left ones of the same moment, with the last right row carried
    forward. At a tie of right rows the greatest id wins. Left rows without a
    match keep nulls; rows without a key or time match nothing.
    """
    r = right.select(key, at, F.col(id_column).alias("_rid"), F.lit(None).cast(left.schema[id_column].dataType).alias("_lid"), F.lit(0).alias("_side"))
    lft = left.select(key, at, F.lit(None).cast(right.schema[id_column].dataType).alias("_rid"), F.col(id_column).alias("_lid"), F.lit(1).alias("_side"))
    w = Window.partitionBy(key).orderBy(at, "_side", "_rid").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("_side") == 0, F.struct(F.col("_rid").alias("id"), F.col(at).alias("at")))
    both = r.unionByName(lft).withColumn("_m", F.last(mark, ignorenulls=True).over(w)).where("_side = 1")
    return both.select(F.col("_lid").alias(id_column), key, at, F.col("_m.id").alias("before_id"), F.col("_m.at").alias("before_ts"))
