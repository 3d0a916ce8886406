import random
from collections import defaultdict

import pytest

from scholia.operators import hybrid as H
from scholia.operators import retrieval as S


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(3)
    rows = [(q, a, f"d{d:02d}", round(r.random(), 2)) for q in ("p", "q") for a in ("data", "evaluation", "full") for d in range(30) if r.random() < 0.7]
    df = spark.createDataFrame(rows, "request string, axis string, doc_id string, score double")
    cov = spark.createDataFrame([(q, a, 0.5) for q in ("p", "q") for a in ("data", "evaluation", "full")], "request string, axis string, coverage double")
    return rows, df, cov


def test_blend_and_floor(spark, scored):
    rows, df, cov = scored
    dense = spark.createDataFrame([("p", "data", "d99", 0.9), ("p", "data", rows[0][2], 1.7)], "request string, axis string, doc_id string, score double")
    got = {(r.request, r.axis, r.doc_id): r for r in H.combined(df, dense, cov, H.Knobs()).collect()}
    a = 1 - 0.4 * 0.5
    assert got["p", "data", "d99"].score == pytest.approx(a * 0.9) and got["p", "data", "d99"].relevance == pytest.approx(0.9)
    assert got["p", "data", rows[0][2]].dense == 1.0
    fixed = {(r.request, r.axis, r.doc_id): r for r in H.combined(df, dense, cov, H.Knobs(adaptive=False)).collect()}
    assert fixed["p", "data", "d99"].score == pytest.approx(0.6 * 0.9)
    passing = H.ranked(H.combined(df, None, cov, H.Knobs(floor=0.5)), H.Knobs(floor=0.5))
    assert passing.count() == sum(s >= 0.5 for *_, s in rows)
    assert H.ranked(H.combined(df.limit(0), None, cov, H.Knobs()), H.Knobs()).count() == 0


@pytest.mark.parametrize("quota", [1, 2])
def test_reserved_places_equal_a_plain_loop(spark, scored, quota):
    rows, df, cov = scored
    knobs = H.Knobs(k=6, quota=quota)
    passing = H.ranked(H.combined(df, None, cov, knobs), knobs)
    got = defaultdict(list)
    for r in H.with_quota(passing, H.fused(passing, knobs), knobs).orderBy("request", "place").collect():
        got[r.request].append((r.doc_id, r.reserved))
    for request in ("p", "q"):
        lists = {a: [d for s, d in sorted((-s, d) for q, x, d, s in rows if q == request and x == a and s > 0)] for a in ("data", "evaluation", "full")}
        w = lambda a: 0.5 if a == "evaluation" else 1.0
        score, best = defaultdict(float), defaultdict(float)
        for a, ds in lists.items():
            for k, d in enumerate(ds, 1):
                score[d] += w(a) / (60 + k)
        for q, _, d, s in rows:
            if q == request:
                best[d] = max(best[d], s)
        order = sorted(score, key=lambda d: (-round(score[d], 9), -best[d], d))
        chosen = {}
        for _ in range(quota):
            for a in sorted(lists, key=lambda a: (-w(a), a)):
                if len(chosen) < 3 and (d := next((d for d in lists[a] if d not in chosen), None)):
                    chosen[d] = True
        for d in order:
            if len(chosen) < 6:
                chosen.setdefault(d, False)
        assert got[request] == [(d, chosen[d]) for d in order if d in chosen]


def test_block_search_equals_all_pairs(spark):
    r = random.Random(9)
    terms = [f"t{i}" for i in range(25)]
    docs = [(f"d{i:03d}", t, float(r.randint(1, 3))) for i in range(60) for t in r.sample(terms, r.randint(1, 8))]
    asked = [(f"q{i}", t, float(r.randint(1, 2))) for i in range(9) for t in r.sample([*terms, "unknown"], 5)]
    d, q = spark.createDataFrame(docs, "doc_id string, term string, w double"), spark.createDataFrame(asked, "query_id string, term string, w double")
    score = defaultdict(float)
    for i, t, w in asked:
        for j, u, v in docs:
            if t == u:
                score[i, j] += w * v
    want = {(i, j) for i in {a[0] for a in asked} for j in [x for x, _ in sorted(((j, s) for (k, j), s in score.items() if k == i), key=lambda x: (-x[1], x[0]))][:4]}
    d, q = S.packed(d, "doc_id"), S.packed(q, "query_id")
    for blocks in ((1000, 1000), (7, 2)):
        got = S.sparse_top_k(d, q, 4, *blocks).collect()
        assert {(x.query_id, x.doc_id) for x in got} == want
        assert all(x.score == pytest.approx(score[x.query_id, x.doc_id]) for x in got)
    assert S.sparse_top_k(d.limit(0), q, 4).count() == 0 and S.sparse_top_k(d, q.limit(0), 4).count() == 0
