"""Retrieval queries (survey I) and rule tags (G, H7)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions.cues import DETECT, NEGATIVE, POSITIVE, REJECT, SECTION_POLARITY
from scholia.functions.tokens import token_rows
from scholia.operators import blocks, retrieval, tagging
from scholia.operators.hybrid import Knobs
from scholia.plans.common import first, first_sql
from scholia.plans.joins_q import c_section_carried
from scholia.plans.records_q import SECTION, SQL_TOKENS, plan_queries, sql_plan_queries
from scholia.session import cut
from scholia.sources.tables import table


def _works(spark, sf):
    w = first(spark, sf, "works", "title", "abstract")
    return w.select(F.col("work_id").alias("doc_id"), F.concat_ws("\n\n", "title", "abstract").alias("text"))


def _asked(spark, sf):
    """What plans ask: full text and axes, each a query of its own whose query_id holds the plan's id and the axis."""
    return plan_queries(spark, sf).select(F.struct("query_id", "axis").alias("query_id"), "text")


def i_index_statistics(spark, sf):
    """Of the index of works: documents, distinct terms, postings and mean length."""
    posts = retrieval.postings(_works(spark, sf), "doc_id", "text")
    n = F.count_distinct("doc_id")
    return posts.agg(n.alias("n_docs"), F.round(F.sum("tf") / n, 6).alias("avg_len"), F.count_distinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings"))


def _named(asked):
    """Queries under one text: the plan's id and the axis."""
    return asked.select(F.concat_ws("\u0001", "query_id.query_id", "query_id.axis").alias("query_id"), "text")


def _plan_top(found, k):
    """The k best works of each plan out of the k best of each of its queries: a work's score is its best."""
    s = found.groupBy(F.split("query_id", "\u0001")[0].alias("query_id"), "doc_id").agg(F.max("score").alias("score"))
    return retrieval.top_k(s, "query_id", "score", "doc_id", k).select("query_id", "rank", "doc_id", "score")


def i_bm25(spark, sf):
    """The ten works that match each plan best, by its full text or one of its axes."""
    posts = cut(retrieval.postings(_works(spark, sf), "doc_id", "text"))
    # Two numbers of the corpus come to the driver.
    stats = posts.groupBy("doc_id").agg(F.first("doc_len").alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg")).first()
    docs, asked = retrieval.bm25_weights(posts, _named(_asked(spark, sf)), stats.docs, stats.avg or 1.0)
    found = retrieval.sparse_top_k(cut(docs), cut(asked), 10)
    return _plan_top(found.withColumn("score", F.least(F.lit(1.0), "score")), 10)


def i_term_overlap(spark, sf):
    """Share of a query's distinct terms that a work has, the best over a plan's queries; the five best of each plan."""
    d = token_rows(_works(spark, sf), "doc_id", "text").distinct().withColumn("w", F.lit(1.0))
    q = token_rows(_named(_asked(spark, sf)), "query_id", "text").distinct()
    n = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = q.join(n, "query_id").select("query_id", "term", (1 / F.col("n")).alias("w"))
    found = retrieval.sparse_top_k(cut(retrieval.packed(d, "doc_id")), cut(retrieval.packed(asked, "query_id")), 5)
    return _plan_top(found.withColumn("score", F.round("score", 6)), 5)


def i_cosine(spark, sf):
    """Cosine of term counts, the best over a plan's queries; the five best works of each plan."""
    docs, asked = retrieval.cosine_weights(_works(spark, sf), _named(_asked(spark, sf)))
    return _plan_top(retrieval.sparse_top_k(cut(docs), cut(asked), 5), 5)


def _dense(spark, sf, k):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieval.dense_top_k(v, v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), k)


def _neighbours(spark, sf, k):
    """The k nearest vectors of each query other than itself."""
    near = _dense(spark, sf, k + 1).where("query_id <> doc_id").drop("rank")
    return retrieval.top_k(near, "query_id", "score", "doc_id", k)


def i_dense(spark, sf):
    """The ten nearest vectors by inner product of every vector whose id is divisible by 20."""
    return _dense(spark, sf, 10).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


def i_dense_labels(spark, sf):
    """How often the nearest ten, the query itself left out, share the label of their query."""
    lab = table(spark, sf, "embeddings").select("vec_id", "label")
    near = _neighbours(spark, sf, 10).join(lab.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return near.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("own")).cast("int")).alias("n_same"))


def _all_lists(spark, sf, answer, schema, weighings=("bm25",)):
    """What ``answer`` gives of each plan, of its lists over all works; by words alone: works have no vectors."""
    asked = _asked(spark, sf).select(F.col("query_id.query_id").alias("request"), F.col("query_id.axis").alias("axis"), "text")
    return blocks.search(_works(spark, sf), asked, answer, schema, weighings)


def i_hybrid(spark, sf):
    """BM25 and token cosine of plans' queries fused by reciprocal ranks over all works with a positive score; the ten best. Lexical only: works have no vectors."""
    knobs = Knobs(quota=0)

    def answer(request, lists, index):
        score, best = blocks.fused(lists, [blocks.passing(x, 1) for x in lists], knobs, index.n)
        for rank, d in enumerate(blocks.top(score, best, knobs.k, ties=False), 1):
            yield request, rank, index.ids[d].as_py(), score[d]

    return _all_lists(spark, sf, answer, "query_id string, rank int, doc_id string, fused double", ("bm25", "cosine"))


def i_coverage(spark, sf):
    """Share of each query's weight that the index knows, and the share of dense score that follows from it."""
    posts = cut(retrieval.postings(_works(spark, sf), "doc_id", "text"))
    n = posts.select("doc_id").distinct().count()
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    q = token_rows(_asked(spark, sf), "query_id", "text").distinct().join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    cov = F.sum(F.when(F.col("df") > 0, idf).otherwise(0.0)) / F.sum(idf)
    return q.groupBy("query_id").agg(F.round(cov, 6).alias("coverage"), F.round(1 - 0.4 * cov, 6).alias("alpha")).select("query_id.*", "coverage", "alpha")


def h_rule_tags(spark, sf):
    """Rule tags of all excerpts, with the section carried forward."""
    e = first(spark, sf, "excerpts", "text")
    secs = c_section_carried(spark, sf).withColumnRenamed("in_section", "section")
    return tagging.tag_excerpts(e.join(secs, "excerpt_id", "left"))


def h_rule_tag_counts(spark, sf):
    return h_rule_tags(spark, sf).groupBy("risk_code", "polarity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 3).alias("sum_confidence"))


Q = (i_index_statistics, i_bm25, i_term_overlap, i_cosine, i_dense, i_dense_labels, i_hybrid, i_coverage, h_rule_tags, h_rule_tag_counts)


def queries():
    return {q.__name__: q for q in Q}


def sql_scores() -> str:
    """CTEs of the plans' queries and their scores against works: bmq and coq by query (qk: plan and axis), bm and co by plan."""
    f = first_sql
    return f("works", "assemble_live_smoke3")[:-1] + f""", {sql_plan_queries()}, d AS (SELECT work_id AS doc_id, {SQL_TOKENS.format("concat_ws(chr(10) || chr(10), title, abstract)")} AS t FROM works1), q AS (SELECT query_id || chr(1) || axis AS qk, {SQL_TOKENS.format("text")} AS t FROM asked),
    p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(l) AS a FROM (SELECT doc_id, any_value(doc_len) AS l FROM p GROUP BY 1)),
    qt AS (SELECT DISTINCT qk, unnest(t) AS term FROM q), qi AS (SELECT qk, qt.term, coalesce(df, 0) AS df, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM qt LEFT JOIN df ON df.term = qt.term, st),
    bmq AS (SELECT qk, doc_id, round(least(1.0, raw / most), 9) AS score FROM (SELECT qk, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / a))) AS raw FROM qi JOIN p ON p.term = qi.term, st GROUP BY 1, 2) JOIN (SELECT qk, sum(idf) AS most FROM qi GROUP BY 1) USING (qk)),
    qf AS (SELECT qk, term, count(*) AS tf FROM (SELECT qk, unnest(t) AS term FROM q) GROUP BY 1, 2),
    coq AS (SELECT qk, doc_id, round(dot / (sqrt(dn) * sqrt(qn)), 9) AS score FROM (SELECT qk, doc_id, sum(p.tf * qf.tf) AS dot FROM p JOIN qf ON p.term = qf.term GROUP BY 1, 2) JOIN (SELECT doc_id, sum(tf * tf) AS dn FROM p GROUP BY 1) USING (doc_id) JOIN (SELECT qk, sum(tf * tf) AS qn FROM qf GROUP BY 1) USING (qk)),
    bm AS (SELECT split_part(qk, chr(1), 1) AS query_id, doc_id, max(score) AS score FROM bmq GROUP BY 1, 2), co AS (SELECT split_part(qk, chr(1), 1) AS query_id, doc_id, max(score) AS score FROM coq GROUP BY 1, 2) """


def oracle_sql():
    f = first_sql
    docs = sql_scores()
    near = "WITH n AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, v.label, q.label AS own, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM n QUALIFY rank <= 10), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM n WHERE query_id <> doc_id QUALIFY rank <= 10) "
    top = lambda t, k, s="score": f"SELECT query_id, rank, doc_id, {s} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {s} DESC, doc_id) AS rank FROM {t}) WHERE rank <= {k}"
    lists = lambda t: f"SELECT qk, doc_id, row_number() OVER (PARTITION BY qk ORDER BY score DESC, doc_id) AS k FROM {t} WHERE score > 0"
    look = r"(?![^.]{0,40}\bnot\b)"

    def weight(patterns):
        parts = []
        for w, p in patterns:
            if p.endswith(look):
                # No look-ahead here: all such phrases, less those with the word behind them.
                bare, tail = p.removesuffix(look), r"[^.]{0,40}\bnot\b"
                parts.append(f"CASE WHEN len(regexp_extract_all(text, '(?i){bare}')) > len(regexp_extract_all(text, '(?i){bare}{tail}')) THEN {w} ELSE 0 END")
            else:
                parts.append(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {w} ELSE 0 END")
        return " + ".join(parts) or "0"

    scores = " UNION ALL ".join(f"SELECT excerpt_id, '{c}' AS risk_code, CASE WHEN ({weight(ps)}) > 0 THEN ({weight(ps)}) - ({weight(REJECT.get(c, []))}) ELSE 0 END AS score FROM e" for c, ps in DETECT.items())
    own = "CASE " + " ".join(f"WHEN section = '{n}' THEN '{p}'" for n, p in SECTION_POLARITY.items() if p != "neutral") + " END"
    known = ", ".join(f"'{n}'" for n in SECTION_POLARITY)
    sec = f"nullif(regexp_extract(lower(text), '{SECTION}', 1), '')"
    tags = f("excerpts")[:-1] + f", e AS (SELECT excerpt_id, text, last_value({sec} IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY span_start NULLS FIRST, excerpt_id) AS section FROM excerpts1), s AS ({scores}), p AS (SELECT excerpt_id, coalesce({own}, CASE WHEN neg > pos THEN 'negative' WHEN pos > neg THEN 'positive' WHEN section IN ({known}) THEN 'neutral' ELSE 'negative' END) AS polarity FROM (SELECT excerpt_id, section, len(regexp_extract_all(text, '(?i){NEGATIVE}')) AS neg, len(regexp_extract_all(text, '(?i){POSITIVE}')) AS pos FROM e)), t AS (SELECT excerpt_id, risk_code, score, polarity, round(CASE WHEN polarity = 'negative' THEN least(0.9, 0.4 + 0.1 * score) ELSE least(0.9, 0.4 + 0.1 * score) * 0.5 END, 3) AS confidence FROM s JOIN p USING (excerpt_id) WHERE score >= 2) "
    return {
        "i_index_statistics": docs + "SELECT n AS n_docs, round(a, 6) AS avg_len, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM p) AS n_postings FROM st",
        "i_bm25": docs + top("bm", 10),
        "i_term_overlap": docs + ", ov AS (SELECT split_part(qk, chr(1), 1) AS query_id, doc_id, max(score) AS score FROM (SELECT qk, doc_id, round(count(*) / any_value(n), 6) AS score FROM (SELECT qk, term, count(*) OVER (PARTITION BY qk) AS n FROM qt) x JOIN p USING (term) GROUP BY 1, 2) GROUP BY 1, 2) " + top("ov", 5),
        "i_cosine": docs + top("co", 5),
        "i_dense": near + "SELECT query_id, rank, doc_id, round(s, 4) AS score FROM r",
        "i_dense_labels": near + "SELECT own, count(*) AS n, sum(CAST(label = own AS INT)) AS n_same FROM o GROUP BY 1",
        "i_hybrid": docs + f", fu AS (SELECT split_part(qk, chr(1), 1) AS query_id, doc_id, round(sum(CASE WHEN split_part(qk, chr(1), 2) = 'evaluation' THEN 0.5 ELSE 1.0 END / (60.0 + k)), 9) AS fused FROM ({lists('bmq')} UNION ALL {lists('coq')}) GROUP BY 1, 2) " + top("fu", 10, "fused"),
        "i_coverage": docs + "SELECT split_part(qk, chr(1), 1) AS query_id, split_part(qk, chr(1), 2) AS axis, round(sum(CASE WHEN df > 0 THEN idf ELSE 0 END) / sum(idf), 6) AS coverage, round(1 - 0.4 * sum(CASE WHEN df > 0 THEN idf ELSE 0 END) / sum(idf), 6) AS alpha FROM qi GROUP BY 1, 2",
        "h_rule_tags": tags + "SELECT excerpt_id, risk_code, score, polarity, confidence FROM t",
        "h_rule_tag_counts": tags + "SELECT risk_code, polarity, count(*) AS n, round(sum(confidence), 3) AS sum_confidence FROM t GROUP BY 1, 2",
    }
