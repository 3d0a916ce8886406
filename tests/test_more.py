import inspect
import random

from scholia.operators import containment
from scholia.plans import aggregates_q, more_q


def test_containment_against_brute_force(spark):
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "a-very-long-single-word"]
    hay = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))) for i in range(60)] + [(100, None), (101, "alpha  beta\n gamma   delta alpha")]
    needles = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 7)))) for i in range(80)] + [(200, None), (201, ""), (202, "alpha beta gamma delta alpha"), (203, "pha beta gamma delta al")]
    got = {(x.needle_id, x.hay_id) for x in containment.contained(spark.createDataFrame(needles, "needle_id int, text string"), spark.createDataFrame(hay, "hay_id int, text string")).collect()}
    sq = lambda t: " ".join((t or "").split())
    assert got == {(i, j) for i, n in needles for j, h in hay if len(sq(n)) >= 20 and f" {sq(n)} " in f" {sq(h)} "}


def test_grouped_thousands(spark, tmp_path):
    said = "from 84,414 points to 1,234,567.5 points, 99954 points; 2,3 points; 12345,678 epochs; 0.5,200 epochs"
    spark.createDataFrame([("r", said, "2026-01-01")], "review_id string, text string, ingested_at string").write.parquet(f"{tmp_path}/reviews.parquet")
    assert {tuple(r) for r in more_q.h_quantities(spark, str(tmp_path)).select("unit", "n", "least", "greatest").collect()} == {("points", 4, 3.0, 1234567.5), ("epochs", 2, 200.0, 678.0)}
    spark.createDataFrame([("e", "18 of 179, and 5,000", "2026-01-01")], "excerpt_id string, text string, ingested_at string").write.parquet(f"{tmp_path}/excerpts.parquet")
    edits = "array<struct<proposed_text:string,rationale:struct<excerpt_ids:array<string>>>>"
    rows = [("v1", [("18,179 and 5000", (["e"],))], "2026-01-01"), ("v2", [("18,179,5", (["e"],))], "2026-01-01")]
    spark.createDataFrame(rows, f"revision_id string, edits {edits}, ingested_at string").write.parquet(f"{tmp_path}/revision.parquet")
    assert {tuple(r) for r in more_q.b_unsupported_numbers(spark, str(tmp_path)).select("revision_id", "n_unsupported").collect()} == {("v1", 1), ("v2", 2)}


def test_bootstrap_resamples_as_often_as_the_reference(spark, sf):
    assert inspect.signature(aggregates_q.d_bootstrap).parameters["rounds"].default == 2000
    got, want = (q.toPandas().sort_values("risk_code", ignore_index=True) for q in (aggregates_q.d_bootstrap(spark, sf), aggregates_q.d_bootstrap(spark, sf, rounds=2000)))
    assert got.equals(want) and (got["low"] <= got["mean"]).all() and (got["mean"] <= got["high"]).all()


def test_bootstrap_is_near_the_normal_interval(spark, sf):
    """Resampled means of a code lie within about two standard errors of its mean."""
    import numpy as np

    from scholia.plans.aggregates_q import d_bootstrap
    from scholia.plans.common import first

    held = {}
    for r in first(spark, sf, "risk_tags", "risk_code", "confidence").where("confidence IS NOT NULL").collect():
        held.setdefault(r.risk_code, []).append(r.confidence)
    rows = d_bootstrap(spark, sf).collect()
    assert {r.risk_code for r in rows} == set(held)
    for r in rows:
        x = np.array(held[r.risk_code])
        error = x.std() / np.sqrt(len(x))
        assert abs(r.mean - x.mean()) < 1e-4
        if len(x) > 20:
            assert abs(r.low - (r.mean - 1.96 * error)) < 0.5 * error + 1e-4 and abs(r.high - (r.mean + 1.96 * error)) < 0.5 * error + 1e-4
