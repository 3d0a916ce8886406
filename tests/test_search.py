import math

from scholia.operators import retrieval
from scholia.plans import more_q, search_q
from scholia.plans.records_q import AXES, plan_queries


def test_plans_ask_with_full_text_and_axes(spark, tmp_path):
    text = "# A title\n\n## Aim\n\nthe aim of it\n\n## Methods\n\nfirst way\r\n\r\n## Outlook\n\nzebra\n\n## Model #\n\nsecond way\n\n## Data\n\nshort\n"
    rows = [("p1", text, "2026-01-01"), ("p1", "later delivery", "2026-01-02"), ("p2", "no headings at all", "2026-01-01"), ("p3", " \n", "2026-01-01"), ("p4", "## Evaluation\nby hand only\n# Late\nx", "2026-01-01")]
    spark.createDataFrame(rows, "plan_id string, plan_text string, ingested_at string").write.parquet(f"{tmp_path}/assemble_live_smoke3.parquet")
    got = {(r.query_id, r.axis): r.text for r in plan_queries(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k[1] != "full"} == {("p1", "topic"): "A title\nthe aim of it", ("p1", "method"): "first way\nsecond way", ("p4", "evaluation"): "by hand only"}
    assert sorted(k[0] for k in got if k[1] == "full") == ["p1", "p2", "p4"] and "zebra" in got["p1", "full"]


def test_a_work_that_only_the_body_names_is_found(spark, tmp_path):
    spark.createDataFrame([("p", "# Cats\n\n## Outlook\n\nzebra", "2026-01-01")], "plan_id string, plan_text string, ingested_at string").write.parquet(f"{tmp_path}/assemble_live_smoke3.parquet")
    spark.createDataFrame([("w1", "zebra", None, "2026-01-01"), ("w2", "dog", None, "2026-01-01")], "work_id string, title string, abstract string, ingested_at string").write.parquet(f"{tmp_path}/works.parquet")
    for q in (search_q.i_bm25, search_q.i_term_overlap, search_q.i_cosine, search_q.i_hybrid):
        assert [(r.query_id, r["rank"], r.doc_id) for r in q(spark, str(tmp_path)).collect()] == [("p", 1, "w1")], q.__name__
    assert {r.axis for r in search_q.i_coverage(spark, str(tmp_path)).collect()} <= {"full", *(a for a, _ in AXES)}


def test_hybrid_sums_over_all_works(spark, tmp_path):
    # Works of one term each rank by their length; 130 of them stand in both lists.
    words = " ".join(f"w{i}x" for i in range(200))
    spark.createDataFrame([("p", "needle " + words, "2026-01-01")], "plan_id string, plan_text string, ingested_at string").write.parquet(f"{tmp_path}/assemble_live_smoke3.parquet")
    works = [(f"d{i:03}", "needle " + "filler " * i, None, "2026-01-01") for i in range(130)]
    spark.createDataFrame(works, "work_id string, title string, abstract string, ingested_at string").write.parquet(f"{tmp_path}/works.parquet")
    # All scores are below 0.05 for most works, yet each list counts.
    got = [(r["rank"], r.doc_id, r.fused) for r in search_q.i_hybrid(spark, str(tmp_path)).collect()]
    assert [x[:2] for x in sorted(got)] == [(i + 1, f"d{i:03}") for i in range(10)]
    assert all(abs(f - 2 / (60 + rank)) < 2e-8 for rank, _, f in got)


def test_ranked_goes_past_a_hundred(spark):
    rows = [("q", i, 1.0 / (1 + i)) for i in range(150)] + [("q", 999, 0.0)]
    got = retrieval.ranked(spark.createDataFrame(rows, "query_id string, doc_id int, score double"), "query_id", "score", "doc_id")
    assert {(r.doc_id, r["rank"]) for r in got.collect()} == {(i, i + 1) for i in range(150)}


def test_a_query_is_not_its_own_neighbour(spark, tmp_path):
    # Vector 0 is the one query; the three nearest others have its label, the rest do not.
    rows = [(i, [math.cos(i / 20), math.sin(i / 20)], "a" if i < 4 else "b") for i in range(15)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in more_q.d_hits_at_three(spark, str(tmp_path)).select("query_id", "precision_at_3", "hit_at_3").collect()] == [(0, 1.0, True)]
    assert [tuple(r) for r in search_q.i_dense_labels(spark, str(tmp_path)).select("own", "n", "n_same").collect()] == [("a", 10, 3)]
