"""Queries that write and read other formats (survey A): what comes back is what was given."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions import records as R
from scholia.operators import retrieval
from scholia.plans.common import first, first_sql
from scholia.plans.search_q import _works, sql_scores
from scholia.session import cut, scratch
from scholia.sources import files

WORK = T.StructType([T.StructField("work_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("pub_year", T.IntegerType())])


def a_json_lines(spark, sf):
    """Works as JSON lines with a manifest, read back with their schema, and validated line by line: rows by year."""
    w = first(spark, sf, "works", "title", "pub_year").select(*WORK.fieldNames())
    with scratch(spark) as folder:
        files.write_with_manifest(w, folder, ["work_id"], 4, "json")
        files.read_checked(spark, folder, "json", WORK)
        good, bad = files.json_lines(spark, f"{folder}/*.json", WORK)
        got = good.groupBy("pub_year").agg(F.count(F.lit(1)).alias("n_works"), F.sum(F.length("title")).alias("n_chars"))
        return cut(got.withColumn("n_faults", F.lit(bad.count())))


def a_csv_scan(spark, sf):
    """Works as CSV with an identity column, which is not read on: hash of each title."""
    w = first(spark, sf, "works", "title").select("work_id", "title", F.lit("someone").alias("Author"))
    with scratch(spark) as folder:
        w.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "\\N").csv(folder)
        back = files.csv_table(spark, folder, ["work_id", "title"], ["Author"])
        return cut(back.select("work_id", R.text_sha256(F.when(F.col("title") != "\\N", F.col("title"))).alias("sha256")))


def a_zip_scan(spark, sf):
    """Decisions packed into ZIP files of JSON members and read back by member name: their text lengths."""
    d = first(spark, sf, "decisions", "text").where("text IS NOT NULL AND decision_id IS NOT NULL")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for key, text in zip(pdf["decision_id"], pdf["text"]):
                z.writestr(f"d/{key}.json", json.dumps({"id": key, "text": text}))
            z.writestr("readme.txt", "no record")
        return pd.DataFrame({"content": [held.getvalue()]})

    # A ZIP of a few hundred members each.
    shard = F.pmod(F.xxhash64("decision_id"), F.lit(max(1, d.count() // 400)))
    zips = d.withColumn("shard", shard).groupBy("shard").applyInPandas(pack, "content binary")
    members = zips.mapInPandas(lambda batches: (files.members_of(pdf["content"], r"\.json$") for pdf in batches), "member string, content string")
    r = members.select(F.from_json("content", "id string, text string").alias("r")).select("r.*")
    return r.select(F.col("id").alias("decision_id"), F.length("text").alias("n_chars"))


def a_index_store(spark, sf):
    """The index of works saved with a manifest and loaded again: its statistics."""
    posts = retrieval.postings(_works(spark, sf), "doc_id", "text")
    with scratch(spark) as folder:
        files.write_with_manifest(posts, folder, ["term", "doc_id"], 4)
        back = files.read_checked(spark, folder)
        n = F.count_distinct("doc_id")
        return cut(back.agg(n.alias("n_docs"), F.round(F.sum("tf") / n, 6).alias("avg_len"), F.count_distinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings")))


def a_text_decoding(spark, sf):
    """Plans stored in several encodings and decoded by trying: those that come back as they were, by encoding."""
    p = first(spark, sf, "assemble_live_smoke3", "plan_text").where("plan_text IS NOT NULL")

    @F.pandas_udf("kind string, sha256 string")
    def through(texts: pd.Series) -> pd.DataFrame:
        import hashlib

        rows = []
        for i, t in enumerate(texts):
            try:
                kind = ("utf-8", "utf-8-sig", "utf-16")[len(t) % 3]
                rows.append((kind, hashlib.sha256(files.decoded_text(t.encode(kind)).encode()).hexdigest()))
            except UnicodeError:
                rows.append(("none", None))
        return pd.DataFrame(rows, columns=["kind", "sha256"])

    return p.select("plan_id", through("plan_text").alias("x")).select("plan_id", "x.kind", "x.sha256")


Q = (a_json_lines, a_csv_scan, a_zip_scan, a_index_store, a_text_decoding)


def queries():
    return {q.__name__: q for q in Q}


def oracle_sql():
    f = first_sql
    lf = "replace(replace(plan_text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return {
        "a_json_lines": f("works") + "SELECT pub_year, count(*) AS n_works, sum(length(title)) AS n_chars, 0 AS n_faults FROM works1 GROUP BY 1",
        "a_csv_scan": f("works") + "SELECT work_id, sha256(title) AS sha256 FROM works1",
        "a_zip_scan": f("decisions") + "SELECT decision_id, length(text) AS n_chars FROM decisions1 WHERE text IS NOT NULL AND decision_id IS NOT NULL",
        "a_index_store": sql_scores() + "SELECT n AS n_docs, round(a, 6) AS avg_len, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM p) AS n_postings FROM st",
        "a_text_decoding": f("assemble_live_smoke3") + f"SELECT plan_id, CASE length(plan_text) % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' ELSE 'utf-16' END AS kind, sha256({lf}) AS sha256 FROM assemble_live_smoke31 WHERE plan_text IS NOT NULL",
    }
