"""References to records that do not exist, were removed or arrived later.

Parent keys, removals and child keys are put into one long table of tagged
keys and grouped by parent table and key. The group's flags say whether the
key is an orphan for all of its children (no parent, or an open removal) or
for some (children that arrived before their parent). The aggregation is
partial before the shuffle, so a hot key costs one row a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import strip_white, utc_month
from scholia.operators.dedupe import by_first
from scholia.session import cut

#: A key is hot with more than this part of all children; so many keys at most are broadcast.
HOT_SHARE = 1000


@dataclass(frozen=True)
class Reference:
    """A field that names parents. ``parent_table`` is a column, so one field may refer to several tables."""

    table: str
    field: str
    id_column: str
    parent_table: Column
    many: bool = False


@dataclass(frozen=True)
class Parent:
    table: str
    id_column: str


def references(df: DataFrame, ref: Reference, arrival: str = "ingested_at") -> DataFrame:
    """First arrival of each child, one row per trimmed, distinct, non-blank reference.

    Children without an id are kept, one per distinct content. A null array,
    null elements and blank references give no rows.
    """
    kind = ref.parent_table
    src = df.select(F.col(ref.id_column).cast("string").alias("child_id"), F.col(arrival).alias("child_at"), F.col(ref.field).alias("_ref"), kind.alias("_parent"))
    unnamed = F.when(F.col("child_id").isNull(), F.to_json(F.struct("_ref", "_parent")))
    first = src.groupBy("child_id", unnamed.alias("_unnamed")).agg(
        by_first(F.struct(F.col("_parent"), F.col("_ref")), "child_at").alias("_v"), F.min("child_at").alias("child_at")
    )
    value = F.explode(F.array_distinct(F.transform("_v._ref", strip_white))) if ref.many else strip_white(F.col("_v._ref"))
    rows = first.select(
        F.lit(ref.table).alias("child_table"), F.lit(ref.field).alias("child_field"), "child_id", "child_at", F.col("_v._parent").alias("parent_table"), value.alias("parent_id")
    )
    return rows.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != ""))


def tagged_parents(df: DataFrame, p: Parent, arrival: str = "ingested_at") -> DataFrame:
    return df.select(F.lit(p.table).alias("parent_table"), F.col(p.id_column).cast("string").alias("parent_id"), F.lit(True).alias("is_parent"), F.col(arrival).alias("at"), F.lit(False).alias("removed"))


def tagged_removals(df: DataFrame) -> DataFrame:
    """Open removals only: a removal with a restoring time no longer holds."""
    return df.where(F.col("restored_at").isNull()).select(
        F.col("record_table").alias("parent_table"), F.col("record_id").alias("parent_id"), F.lit(False).alias("is_parent"), F.lit(None).cast("timestamp").alias("at"), F.lit(True).alias("removed")
    )


def key_states(children: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """One row per referenced (parent_table, parent_id) with the flags of its group.

    Columns: has_parent, removed, parent_at (first arrival), n_children, suspect
    (an orphan for at least one of its children).
    """
    none, no = F.lit(None).cast("timestamp"), F.lit(False)
    tagged = children.select("parent_table", "parent_id", no.alias("is_parent"), none.alias("at"), no.alias("removed"), "child_at", F.lit(1).alias("n"))
    nothing = [none.alias("child_at"), F.lit(0).alias("n")]
    long = tagged.unionByName(parents.select("*", *nothing)).unionByName(removals.select("*", *nothing))
    flags = long.groupBy("parent_table", "parent_id").agg(
        F.max("is_parent").alias("has_parent"), F.max("removed").alias("removed"), F.min("at").alias("parent_at"),
        F.min("child_at").alias("_first_child"), F.sum("n").alias("n_children"),
    )
    late = F.coalesce(F.col("_first_child") < F.col("parent_at"), F.lit(False))
    return flags.where("n_children > 0").withColumn("suspect", ~F.col("has_parent") | F.col("removed") | late).drop("_first_child")


def orphans(children: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """Every orphan reference with its reason and the month of the referring row.

    Columns: child_table, child_field, child_id, parent_table, parent_id,
    period, reason (missing, removed or late; the first that holds). A child
    without an arrival time has a null period and is never late.

    The children are kept once in the shared folder, as they are counted,
    grouped and listed. Keys with more than 1/HOT_SHARE of all children, of
    which there can be no more than HOT_SHARE, are broadcast; the others are
    joined by a shuffle in which no key is large.
    """
    children = cut(children)
    most = max(1, children.count() // HOT_SHARE)
    key = ["parent_table", "parent_id"]
    states = key_states(children, parents, removals)
    hot, cold = states.where(F.col("n_children") > most), states.where((F.col("n_children") <= most) & F.col("suspect"))
    rows = children.join(F.broadcast(hot.where("suspect")), key).unionByName(
        children.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key)
    )
    reason = F.when(~F.col("has_parent"), "missing").when(F.col("removed"), "removed").when(F.col("child_at") < F.col("parent_at"), "late")
    return rows.select("child_table", "child_field", "child_id", "parent_table", "parent_id", utc_month(F.col("child_at")).alias("period"), reason.alias("reason")).where("reason IS NOT NULL")


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphan references per table, field, period and reason."""
    return found.groupBy("child_table", "child_field", "parent_table", "period", "reason").agg(F.count(F.lit(1)).alias("n_references"))
