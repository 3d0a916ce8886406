"""Parent chains of any depth by pointer jumping: as many joins as the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import cut


def roots(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root, depth) for every node of ``edges`` (node, parent; null parent at a root).

    Each round doubles how far every node looks, so a chain of n takes about
    log2(n) rounds, each kept in the shared folder. A parent that is no node is
    the root of its chain. Nodes on a cycle have no root and are left out.
    Repeated nodes keep their smallest parent.
    """
    known = edges.groupBy("node").agg(F.min("parent").alias("parent"))
    parents = known.select(F.col("node").alias("_p"), F.lit(True).alias("_known"))
    at = known.join(parents, known.parent == parents._p, "left").select(
        "node", F.coalesce("parent", "node").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), (F.col("parent").isNull() | F.col("_known").isNull()).alias("done")
    )
    at = cut(at)
    open_before = None
    for _ in range(most_rounds):
        left = at.where("NOT done").count()
        if not left or left == open_before:
            break
        open_before = left
        hop = at.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("done").alias("_done"))
        moved = at.where("NOT done").join(hop, F.col("up") == F.col("_n")).select("node", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_done").alias("done"))
        at = cut(at.where("done").unionByName(moved))
    return at.where("done").select("node", F.col("up").alias("root"), F.col("depth").cast("bigint").alias("depth"))
