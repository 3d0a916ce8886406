"""Samples that are the same on every run: ranks by hash within strata, sizes by largest remainder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def allocation(strata: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """(key, n, take): ``total`` shared over strata in proportion, floors first, then the largest remainders.

    Ties of remainders go to the smaller key. ``strata`` has one row per
    stratum; no stratum gives more than it has.
    """
    whole = F.sum(count).over(Window.partitionBy())
    wanted = F.least(F.lit(total), whole)
    share = F.col(count) * wanted / whole
    s = strata.select(key, F.col(count).alias("n"), F.floor(share).alias("base"), (share - F.floor(share)).alias("frac"), wanted.alias("wanted"))
    rest = F.col("wanted") - F.sum("base").over(Window.partitionBy())
    order = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("frac", 9)), F.asc(key)))
    return s.withColumn("rest", rest).withColumn("ord", order).select(key, "n", (F.col("base") + F.when(F.col("ord") <= F.col("rest"), 1).otherwise(0)).alias("take"))


def stratified(df: DataFrame, id_column: str, key: str, total: int, seed: str) -> DataFrame:
    """A sample of ``total`` rows by strata: within each, the smallest hashes of seed:id.

    A histogram over the first three signs of the hash says in which of its
    4,096 cells a stratum's share ends; smaller cells are taken whole and only
    the rows of that cell are put in order, so no stratum is sorted.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    takes = allocation(counts, key, "n", total).select(key, "take")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column)), 256)
    hashed = df.withColumn("_h", h).withColumn("_cell", F.substring("_h", 1, 3))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = hashed.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    cells = cells.join(takes, key).where("_before < take").select(key, "_cell", (F.col("take") - F.col("_before")).alias("_room"), (F.col("_before") + F.col("_n") <= F.col("take")).alias("_whole"))
    held = hashed.join(cells, [key, "_cell"])
    edge = held.where(~F.col("_whole")).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h"))).where("_r <= _room").drop("_r")
    return held.where("_whole").unionByName(edge).drop("_h", "_cell", "_room", "_whole")
