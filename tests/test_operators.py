import json
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions import records as R
from scholia.functions.cues import DETECT, NEGATIVE, POSITIVE, REJECT, SECTION_POLARITY
from scholia.functions.tokens import tokens
from scholia.operators import intervals, ranking, retrieval, sampling, tagging, trees
from scholia.operators.dedupe import first_arrival
from scholia.sources import files
from scholia.streaming import windows as W


def one(spark, expr, *values):
    df = spark.createDataFrame([values], T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(values))]))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_records(spark):
    assert one(spark, R.normalized_doi, " https://doi.org/10.1234/AB%2Fc+d ") == "10.1234/ab/c+d"
    assert one(spark, R.normalized_doi, "doi: 10.12/x") is None and one(spark, R.normalized_doi, None) is None
    assert one(spark, R.decision_outcome, "Desk_Rejected_Submission") == "desk_reject" and one(spark, R.decision_rule, "hm") == "unmatched:hm"
    assert one(spark, R.rating_value, "8: strong accept") == 8.0 and one(spark, R.rating_value, "seven") is None
    assert one(spark, R.redacted, "a.b@c.org and ~Jo_Doe1, 0000-0001-2345-678X.") == "[EMAIL] and [PROFILE], [ORCID]."
    assert one(spark, R.split_values, "b; a;;b ;") == ["b", "a"] and one(spark, R.split_values, None) == []
    assert one(spark, R.native_key, "https://x.org/f?id=Ab&n=1") == "ab" and one(spark, R.native_key, "src:Xy") == "xy"
    assert one(spark, tokens, "The Studies of classes, bus 5 한글 a basis") == ["study", "class", "bus", "5", "한글", "basis"]


def test_first_arrival(spark):
    rows = [(1, datetime(2025, 1, 2), "b"), (1, datetime(2025, 1, 1), "z"), (1, datetime(2025, 1, 1), "a"), (2, None, "n"), (None, None, None)]
    got = first_arrival(spark.createDataFrame(rows, "k int, t timestamp, v string"), ["k"], "t", ["v"]).collect()
    assert {(r.k, r.v) for r in got} == {(1, "a"), (2, "n"), (None, None)}


def test_as_of_against_brute_force(spark):
    r = random.Random(1)
    left = [(i, r.randrange(4), r.randrange(50)) for i in range(120)]
    right = [(i, r.randrange(4), r.randrange(50)) for i in range(120)]
    s = "id int, k int, t int"
    got = {(x.id, x.before_id) for x in intervals.as_of(spark.createDataFrame(left, s), spark.createDataFrame(right, s), "k", "t", "id").collect()}
    want = {(i, max(((t2, j) for j, k2, t2 in right if k2 == k and t2 <= t), default=(None, None))[1]) for i, k, t in left}
    assert got == want


def test_overlaps_and_inner_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(3), a := r.randrange(900), a + r.randrange(0, 400)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, g int, a int, b int")
    got = {(x.id_a, x.id_b) for x in intervals.overlapping(df, "g", "id", "a", "b").collect()}
    assert got == {(i, j) for i, g, a, b in rows for j, h, c, d in rows if i < j and g == h and a < b and c < d and a < d and c < b}
    got = {x.id for x in intervals.inner(df, "g", "id", "a", "b").collect()}
    assert got == {i for i, g, a, b in rows if any(h == g and c <= a and d >= b and d - c > b - a for _, h, c, d in rows)}


def test_roots_of_chains_orphans_and_cycles(spark):
    edges = [(i, i - 1 if i else None) for i in range(100)] + [(200, 999), (300, 301), (301, 300)]
    got = {x.node: (x.root, x.depth) for x in trees.roots(spark.createDataFrame(edges, "node int, parent int")).collect()}
    assert got[99] == (0, 99) and got[0] == (0, 0) and got[200] == (999, 1) and 300 not in got and len(got) == 101


def test_allocation_and_ranks(spark):
    s = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3)], "k string, n int")
    assert {r.k: r.take for r in sampling.allocation(s, "k", "n", 6).collect()} == {"a": 3, "b": 2, "c": 1}
    assert sum(r.take for r in sampling.allocation(s, "k", "n", 100).collect()) == 11
    got = {r.k: r["rank"] for r in ranking.global_rank(s, "n").collect()}
    assert got == {"a": 1, "b": 2, "c": 2}


def test_dense_top_k_in_blocks_equals_one_block(spark):
    r = random.Random(3)
    v = spark.createDataFrame([(i, [r.random() for _ in range(8)]) for i in range(200)] + [(999, None)], "doc_id bigint, embedding array<double>")
    q = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    small, whole = (sorted((x.query_id, x["rank"], x.doc_id) for x in retrieval.dense_top_k(v, q, 5, n).collect()) for n in (7, 10_000))
    assert small == whole and len(whole) == 50


def test_tags_against_brute_force(spark):
    import re

    texts = ["The ablation study is missing and the baselines are weak.", "The code is available.", "The code is released but not documented; reproducibility suffers.", "Novelty is limited.", None, "", "No evidence of data leakage, grammar is poor."]
    df = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(texts)], "excerpt_id string, text string, section string")
    got = {(r.excerpt_id, r.risk_code, r.score, r.polarity, r.confidence) for r in tagging.tag_excerpts(df).collect()}
    want = set()
    for i, t in enumerate(texts):
        for code, ps in DETECT.items():
            s = sum(w for w, p in ps if t and re.search(p, t, re.I))
            s -= sum(w for w, p in REJECT.get(code, []) if s and re.search(p, t, re.I))
            if s >= 2:
                neg, pos = len(re.findall(NEGATIVE, t, re.I)), len(re.findall(POSITIVE, t, re.I))
                pol = "negative" if neg >= pos else "positive"
                base = min(0.9, 0.4 + 0.1 * s)
                want.add((str(i), code, s, pol, round(base if pol == "negative" else base * 0.5, 3)))
    assert got == want and SECTION_POLARITY["pros"] == "positive"


def test_limiter_batch_and_stream_agree_with_a_plain_loop(spark, tmp_path):
    r, t0 = random.Random(4), datetime(2025, 1, 1)
    rows = [(i, r.randrange(5), t0 + timedelta(seconds=r.randrange(4000))) for i in range(400)]
    want, held = set(), {}
    for i, u, t in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        recent = [h for h in held.get(u, []) if h > t - timedelta(seconds=600)]
        if len(recent) < 3:
            want.add(i)
            recent.append(t)
        held[u] = recent
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp")
    assert {x.event_id for x in W.limiter(df, 3, 600).where("admitted").collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = W.run_to_end(W.limiter_stream(W.stream_of(spark, str(tmp_path / "in"), df.schema), 3, 600), str(tmp_path / "limited"), str(tmp_path / "cp"), "append")
    assert {x.event_id for x in out.where("admitted").collect()} == want


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, event_type string, value double"
    import os
    import time

    (tmp_path / "in").mkdir()
    for n, hours in enumerate(([1, 2], [60], [61], [3])):
        day = [(h, datetime(2025, 1, 1) + timedelta(hours=h), "view", 1.0) for h in hours]
        spark.createDataFrame(day, schema).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        part = next(p for p in (tmp_path / f"part{n}").iterdir() if p.suffix == ".parquet")
        part.rename(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (time.time() - 100 + n, time.time() - 100 + n))
    src = W.stream_of(spark, str(tmp_path / "in"), T._parse_datatype_string(schema))
    out = W.run_to_end(W.tumbling(src), str(tmp_path / "late"), str(tmp_path / "cp"), "append")
    assert [(r.n) for r in out.where("started = timestamp'2025-01-01'").collect()] == [2]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "t": "a"}\n\n{"id": 2}\nnot json\n{"id": 3, "extra": 1}\n')
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("t", T.StringType())])
    ok, bad = files.json_lines(spark, str(tmp_path / "x.jsonl"), schema)
    assert sorted(r.id for r in ok.collect()) == [1, 2] and sorted(r.fault for r in bad.collect()) == ["not valid", "unknown keys: extra"]
    with pytest.raises(ValueError):
        files.assert_no_identity(T.StructType([T.StructField("x", T.ArrayType(T.StructType([T.StructField("author_id", T.StringType())])))]))


def test_csv_zip_text_and_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,Author,v\n1,me,\"x;y\"\n".encode())
    df = files.csv_table(spark, str(tmp_path / "a.csv"), ["id", "v"], ["Author"])
    assert df.columns == ["id", "v"] and df.first().v == "x;y"
    with pytest.raises(ValueError):
        files.csv_table(spark, str(tmp_path / "a.csv"), ["nope"], [])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/1.json", json.dumps({"a": 1}))
        z.writestr("d/readme", "no")
    assert [(r.member, r.content) for r in files.zip_members(spark, str(tmp_path / "z.zip"), r"\.json$").collect()] == [("d/1.json", '{"a": 1}')]
    (tmp_path / "k.txt").write_bytes("한글\r\n".encode("cp949"))
    assert files.text_files(spark, str(tmp_path / "k.txt")).first().text == "한글\n"
    out = str(tmp_path / "out")
    m = files.write_with_manifest(spark.range(50), out, ["id"], 2)
    assert m["rows"] == 50 and files.read_checked(spark, out).count() == 50
    name = m["files"][0]["file"]
    with open(f"{out}/{name}", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        files.read_checked(spark, out)
    assert one(spark, files.csv_safe, "=1+1") == "'=1+1" and one(spark, files.csv_safe, "a=1") == "a=1"
