import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.operators import nested as N

CARD = {"card_id": "c1", "edits": [{"edit_id": "e1"}, None, {"edit_id": None}, {"edit_id": "e4"}], "precedents": {"items": [{"work_id": "w1"}]}}
BODY = {"card_id": "c1", **{k: CARD[k] for k in ("edits", "precedents")}}


def _rows(spark, payloads, revision=(), cards=()):
    raw = spark.createDataFrame([(str(i), p) for i, p in enumerate(payloads)], "raw_id string, payload string")
    rev = spark.createDataFrame(list(revision), "revision_id string, card_id string, edits array<struct<edit_id:string,n:int>>, precedents struct<items:array<struct<work_id:string>>>")
    crd = spark.createDataFrame(list(cards), "card_id string, why_applies struct<text:string,plan_lines:array<int>>")
    return {tuple(r) for r in N.found(rev, raw, crd).collect()}


SHAPES = [
    {"revisions": [CARD]}, {"revisions": CARD}, {"revisions": {"c1": {k: v for k, v in CARD.items() if k != "card_id"}}}, {"result": {"revision": {"revisions": [CARD]}}}, {"result": {"session_id": "s"}, "revision": {"revisions": [CARD]}},
    [{"revisions": [CARD]}], {"revisions": [CARD | {"edits": json.dumps(CARD["edits"])}]}, {"revisions": [CARD | {"precedents": CARD["precedents"]["items"]}]}, {"revisions": [CARD | {"precedents": json.dumps(CARD["precedents"])}]},
    {"revisions": [CARD | {"precedents": {"items": {"work_id": "w1"}}}]},
]


def test_every_shape_gives_the_same_rows(spark):
    texts = [json.dumps(s) for s in SHAPES] + ["﻿" + json.dumps(SHAPES[0]), json.dumps(json.dumps(SHAPES[0])), json.dumps(SHAPES[0], indent=2)]
    got = _rows(spark, texts)
    for i in range(len(texts)):
        mine = {r[:1] + r[2:] for r in got if r[1] == str(i)}
        assert mine == {("edits", "c1", 1, "e1"), ("edits", "c1", 4, "e4"), ("precedent_items", "c1", 1, "w1")}, texts[i]


def test_unreadable_and_odd(spark):
    bad = [None, "", "null", '{"revisions": [', json.dumps(SHAPES[0])[:-3], "[]", "3", '{"revisions": null}', '{"revisions": [null, 3, "x"]}', '{"revisions": [{"card_id": "c", "edits": {"edit_id": "lone"}}]}', "[" * 100_000]
    assert _rows(spark, bad) == {("edits", "9", "c", 1, "lone")}


def test_stored_tables(spark):
    rev = [("r1", "c1", [("e1", 1), None, (None, 2), ("e1", 1)], ([("w",), None, (None,)],)), ("r1", "c1", [("e1", 1), None, (None, 2), ("e1", 1)], ([("w",), None, (None,)],)), ("r2", None, [("e", 1)], None), ("r3", "c", None, (None,))]
    cards = [("k", ("t", [5, None, 5])), ("k2", None), ("k3", ("t", None)), ("k4", ("t", []))]
    assert _rows(spark, [], rev, cards) == {("edits", "r1", "c1", 1, "e1"), ("edits", "r1", "c1", 4, "e1"), ("precedent_items", "r1", "c1", 1, "w"), ("edits", "r2", None, 1, "e"), ("plan_lines", "k", "k", 1, "5"), ("plan_lines", "k", "k", 3, "5")}
    assert _rows(spark, []) == set()


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", max_size=2), x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(JSON, JSON)
def test_identities_are_equal_exactly_for_equal_values(a, b):
    same = json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    assert (N.Shredder().identity(a) == N.Shredder().identity(b)) == same


@settings(max_examples=150, deadline=None)
@given(JSON)
def test_records_are_rebuilt(value):
    s, record = N.Shredder(), {"whole": value}
    own = s.identity(record)
    edges: dict = {}
    for r in s.rows:
        if r[0] == "edge":
            edges.setdefault(r[3], []).append((r[4], r[5], r[6]))
    objects = {r[6]: (r[7], dict(r[8])) for r in s.rows if r[0] == "object"}
    assert json.dumps(N.rebuilt(own, edges, objects), sort_keys=True) == json.dumps(record, sort_keys=True)


def test_equal_objects_are_stored_once(spark):
    doc = json.dumps({"a": [{"x": 1}, {"x": 1}, {"x": 2}], "b": {"x": 1}})
    df = spark.createDataFrame([("t", "1", doc), ("t", "2", doc)], "record_table string, root_id string, doc string")
    roots, bridge, objects = N.flat_tables(N.shred(df, N.plain_document))
    assert roots.count() == 2 and roots.select("object_id").distinct().count() == 1
    assert bridge.count() == 4 and objects.where("scalars['x'] IS NOT NULL").count() == 2
    back = N.attribute(N.follow(roots, bridge, "a", "pos"), objects, "x", "x")
    assert {(r.root_id, r.pos, r.x) for r in back.collect()} == {(i, p, v) for i in "12" for p, v in ((1, "1"), (2, "1"), (3, "2"))}


@pytest.mark.parametrize("name", ["scalars", "object_id", "kind"])
def test_clashing_names(spark, name):
    rev = spark.createDataFrame([("r", "c", [("e",)], "z")], f"revision_id string, card_id string, edits array<struct<edit_id:string>>, {name} string")
    raw = spark.createDataFrame([("x", None, 1)], f"raw_id string, payload string, {name} int")
    crd = spark.createDataFrame([("k", None, 1)], f"card_id string, why_applies struct<plan_lines:array<int>>, {name} int")
    assert N.found(rev, raw, crd).count() == 1


def test_any_depth_and_lists_of_revisions():
    card = {"card_id": "c", "edits": [], "precedents": {"items": []}}
    deep, text = {"revisions": [card]}, json.dumps({"revisions": [card]})
    for _ in range(30):
        deep = {"payload": deep}
    for _ in range(7):
        text = json.dumps(text)
    assert N.revision_document(json.dumps(deep))["revisions"] == N.revision_document(text)["revisions"] == [card]
    by_id = {"revisions": {"a": [{"edits": []}, {"edits": [{"x": 1}]}], "b": {"edits": []}}}
    assert [(c["card_id"], len(c["edits"])) for c in N.revision_document(json.dumps(by_id))["revisions"]] == [("a", 0), ("a", 1), ("b", 0)]


def test_nesting_beyond_the_recursion_limit(spark):
    for n in (9, 50, 5_000):
        text = '{"w": ' * n + json.dumps(SHAPES[0]) + "}" * n
        mine = {r[:1] + r[2:] for r in _rows(spark, [text])}
        assert mine == {("edits", "c1", 1, "e1"), ("edits", "c1", 4, "e4"), ("precedent_items", "c1", 1, "w1")}
    within = json.dumps(CARD["edits"])
    for _ in range(10):
        within = json.dumps(within)
    assert ("edits", "0", "c1", 4, "e4") in _rows(spark, [json.dumps({"revisions": [CARD | {"edits": json.loads(within)}]})])


@settings(max_examples=200, deadline=None)
@given(JSON, st.integers(0, 12))
def test_the_stack_reads_as_the_library(value, cut):
    text = json.dumps(value, indent=1)
    assert N._stacked(text) == value
    short = text[: max(0, len(text) - cut)]
    try:
        want = json.loads(short)
    except ValueError:
        with pytest.raises(ValueError):
            N._stacked(short)
    else:
        assert N._stacked(short) == want


def test_faults_and_odd_text(spark):
    df = spark.createDataFrame([("t", "1", None), ("t", "2", '{"a":'), ("t", "3", '{"a": "\\ud800 x", "": 5, "b": [[1, []], null]}')], "record_table string, root_id string, doc string")
    nodes = N.shred(df, N.plain_document)
    assert {r.root_id for r in N.faults(nodes).collect()} == {"1", "2"}
    roots, bridge, objects = N.flat_tables(nodes)
    edges: dict = {}
    for r in bridge.collect():
        edges.setdefault(bytes(r.parent_id), []).append((r.field, r.ordinal, bytes(r.child_id)))
    held = {bytes(r.object_id): (r.types, r.scalars) for r in objects.collect()}
    assert N.rebuilt(bytes(roots.first().object_id), edges, held) == {"a": "\\ud800 x", "": 5, "b": [[1, []], None]}
