import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from scholia.operators import blocks, containment, hybrid, retrieval
from scholia.plans import catalog


@pytest.mark.parametrize("segment, dense", [(1 << 16, 1 << 24), (1, 300), (1, 0)])
def test_index_equals_sums_over_all_pairs(monkeypatch, segment, dense):
    monkeypatch.setattr(blocks, "SEGMENT", segment)
    monkeypatch.setattr(blocks, "DENSE", dense)
    r = random.Random(5)
    docs = [Counter(r.choices(range(-20, 20), k=r.randint(1, 30))) for _ in range(50)]
    asked = [Counter(r.choices(range(-20, 30), k=k)) for k in (1, 4, 60)] + [Counter([99])]
    index = blocks.Index(("bm25", "cosine"))
    for at in range(0, 50, 20):
        part = docs[at : at + 20]
        index.add(pa.array([f"d{at + i:02}" for i in range(len(part))]), pa.array([list(d) for d in part], pa.list_(pa.int64())), pa.array([list(d.values()) for d in part], pa.list_(pa.int32())))
    index.close()
    assert index.ids.to_pylist() == [f"d{i:02}" for i in range(50)]
    mean = sum(sum(d.values()) for d in docs) / 50
    idf = lambda t: (lambda df: math.log(1 + (50 - df + 0.5) / (df + 0.5)))(sum(t in d for d in docs))
    norm = lambda c: math.sqrt(sum(v * v for v in c.values()))
    queries = [index.asked(np.array(list(q)), np.array(list(q.values()))) for q in asked]
    for w in ("bm25", "cosine"):
        got = index.scores([(t, ws[w]) for t, ws, _ in queries], w)
        for q, row in zip(asked, got):
            most = sum(map(idf, q))
            for d, s in zip(docs, row):
                if w == "bm25":
                    want = sum(idf(t) / most * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * sum(d.values()) / mean)) for t in q if t in d)
                else:
                    want = sum(q[t] * d[t] for t in q) / norm(q) / norm(d)
                assert s == pytest.approx(want, abs=1e-12)
    assert [c for _, _, c in queries] == [pytest.approx(sum(idf(t) for t in q if any(t in d for d in docs)) / sum(map(idf, q)), abs=1e-6) for q in asked]


def shuffled(spark, run):
    """Rows that the jobs of ``run`` wrote to shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    total = lambda: sum(s.shuffleWriteRecords() for s in iter_(store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)))
    iter_ = lambda seq: (seq.apply(i) for i in range(seq.size()))
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """120 plans and 300 works that all share a word: 36,000 pairs."""
    path, r = tmp_path_factory.mktemp("crowded"), random.Random(2)
    words = lambda: "common " + " ".join(r.choices("alpha beta gamma delta kappa sigma".split(), k=3))
    spark.createDataFrame([(f"p{i}", words(), "2026-01-01") for i in range(120)], "plan_id string, plan_text string, ingested_at string").write.parquet(f"{path}/assemble_live_smoke3.parquet")
    spark.createDataFrame([(f"w{i}", words(), None, "2026-01-01") for i in range(300)], "work_id string, title string, abstract string, ingested_at string").write.parquet(f"{path}/works.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["c_top_k_compare", "i_axis_scores", "i_hybrid", "i_search", "i_search_quota", "i_calibration", "i_query_status", "i_verdict", "i_retry", "i_search_max"])
def test_pairs_of_plans_and_works_are_not_shuffled(spark, crowded, name):
    assert 0 < shuffled(spark, lambda: catalog.queries()[name](spark, crowded).collect()) < 10_000


def test_pairs_of_documents_are_not_shuffled(spark, tmp_path):
    r = random.Random(4)
    words = lambda: "common " + " ".join(r.choices("alpha beta gamma delta kappa sigma".split(), k=3))
    spark.createDataFrame([(i, words()) for i in range(1200)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert 0 < shuffled(spark, lambda: catalog.queries()["i_search_documents"](spark, str(tmp_path)).collect()) < 20_000


def test_blend_equals_the_join_of_all_pairs(spark):
    r = random.Random(8)
    rows = [(r.randint(0, 60), " ".join(r.choices("alpha beta gamma delta kappa sigma omega".split(), k=r.randint(1, 6)))) for _ in range(90)] + [(70, None), (80, "the"), (90, "lone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    v = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)]) for i in (*range(0, 40, 2), 75, 100, 105)] + [(41, None)], "doc_id bigint, embedding array<float>")
    asked = F.col("doc_id") % 5 == 0
    posts = retrieval.postings(docs, "doc_id", "text")
    stats = posts.groupBy("doc_id").agg(F.first("doc_len").alias("n")).agg(F.count("n").alias("docs"), F.avg("n").alias("avg")).first()
    lexical = retrieval.bm25_scores(posts, docs.where(asked).withColumnRenamed("doc_id", "query_id"), stats.docs, stats.avg).select(F.col("query_id").alias("request"), F.lit("full").alias("axis"), "doc_id", F.round("score", 9).alias("score"))
    dense = retrieval.dense_top_k(v, v.where(asked).where("doc_id > 0").withColumnRenamed("doc_id", "query_id"), 100).select(F.col("query_id").alias("request"), F.lit("full").alias("axis"), "doc_id", "score")
    coverage = lexical.select("request", "axis", F.lit(1.0).alias("coverage")).distinct()
    every = hybrid.combined(lexical, dense, coverage, hybrid.Knobs()).where("request <> doc_id")
    want = hybrid.ranked(every, hybrid.Knobs()).where("rank <= 7").select("request", "rank", "doc_id", "score")
    got = blocks.blend_top_k(docs, v, asked, 7, 0.6).select("request", "rank", "doc_id", "score")
    key = lambda df: sorted((x.request, x["rank"], x.doc_id, round(x.score, 8)) for x in df.collect())
    assert key(got) == key(want) and {75, 100, 105} <= {x.request for x in got.collect()}


def test_runs_of_words_are_not_shuffled(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    hays = [(f"h{i}", " ".join(r.choices(words, k=80))) for i in range(60)] + [("none", None), ("empty", "")]
    needles = [(f"n{i}", " ".join(r.choices(words, k=r.randint(1, 3)))) for i in range(40)] + [("long", hays[3][1][3:]), ("whole", hays[4][1]), ("null", None), ("cut", hays[5][1][1:40]), ("spaced", "  " + hays[6][1].replace(" ", "\n\t") + " ")]
    squeeze = lambda t: " ".join(t.split())
    want = {(a, b) for a, n in needles for b, h in hays if n and h and f" {squeeze(n)} " in f" {h} "}
    n, h = spark.createDataFrame(needles, "needle_id string, text string"), spark.createDataFrame(hays, "hay_id string, text string")
    got = []
    assert 0 < shuffled(spark, lambda: got.extend(containment.contained(n, h, 1).collect())) < 10_000
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(map(tuple, containment.contained(n, h, 1, block_needles=7).collect())) == sorted(want)
