from datetime import datetime

from pyspark.sql import functions as F

from scholia.operators import orphans as O

T1, T2, T3 = datetime(2025, 1, 31, 23, 59), datetime(2025, 2, 1), datetime(2025, 3, 1)


def _found(spark, children, parents, removals, many=False):
    c = spark.createDataFrame(children, f"id string, ref {'array<string>' if many else 'string'}, ingested_at timestamp, removed boolean")
    p = spark.createDataFrame(parents, "pid string, ingested_at timestamp, at int")
    r = spark.createDataFrame(removals, "record_table string, record_id string, restored_at timestamp")
    refs = O.references(c, O.Reference("kids", "ref", "id", F.lit("folk"), many))
    return {(x.child_id, x.parent_id, x.period, x.reason) for x in O.orphans(refs, O.tagged_parents(p, O.Parent("folk", "pid")), O.tagged_removals(r)).collect()}


def test_each_reason(spark):
    children = [("a", "p1", T2, True), ("b", " p1 ", T1, None), ("c", "gone", T1, None), ("d", "P1", T2, None), ("e", "off", T2, None), ("f", "back", T2, None), ("g", None, T2, None), ("h", " \t", T2, None)]
    parents = [("p1", T2, 1), ("p1", T3, 1), ("off", T1, 1), ("back", T1, 1), (None, T1, 1)]
    removals = [("folk", "off", None), ("folk", "off", T1), ("folk", "back", T3), ("other", "p1", None), ("folk", "nobody", None)]
    assert _found(spark, children, parents, removals) == {("b", "p1", "2025-01", "late"), ("c", "gone", "2025-01", "missing"), ("d", "P1", "2025-02", "missing"), ("e", "off", "2025-02", "removed")}


def test_first_delivery_counts_and_ties(spark):
    children = [("a", "p1", T3, None), ("a", "nope", T1, None), ("b", "x", T1, None), ("b", "w", T1, None), (None, "y", T1, None), (None, "y", T1, None), ("n", "z", None, None)]
    got = _found(spark, children, [("p1", T1, 0)], [])
    assert got == {("a", "nope", "2025-01", "missing"), ("b", "w", "2025-01", "missing"), (None, "y", "2025-01", "missing"), ("n", "z", None, "missing")}


def test_arrays_and_empty_tables(spark):
    got = _found(spark, [("a", ["x", None, " x ", "", "p1"], T1, None), ("b", None, T1, None), ("c", [], T1, None)], [("p1", T1, 0)], [], many=True)
    assert got == {("a", "x", "2025-01", "missing")}
    assert _found(spark, [], [], []) == set()


def test_hot_key_is_whole(spark):
    children = [(str(i), "hot" if i % 3 else f"k{i}", T1, None) for i in range(6000)]
    got = _found(spark, children, [(f"k{i}", T1, 0) for i in range(0, 6000, 6)], [])
    assert len(got) == 5000 and sum(p == "hot" for _, p, _, _ in got) == 4000
