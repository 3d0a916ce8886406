"""Queries of hybrid search (survey I, E1 to E7, C21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import blocks
from scholia.operators import hybrid as H
from scholia.plans.search_q import _all_lists, sql_scores
from scholia.sources.tables import table

RRF, MAX = H.Knobs(quota=0), H.Knobs(quota=0, fusion="max")
#: A floor as a search by words has it when one is set.
FLOOR = H.Knobs(floor=0.1, quota=0)


def _placed(lists, index, knobs, orders=None):
    """(documents of the k places, fused, best in units, orders) of one plan."""
    orders = [blocks.passing(x, blocks.least_units(knobs)) for x in lists] if orders is None else orders
    score, best = blocks.fused(lists, orders, knobs, index.n)
    return blocks.top(score, best, knobs.k), score, best, orders


def i_search(spark, sf):
    """The ten works of each plan over all its queries, by reciprocal ranks, with each work's best query."""

    def answer(request, lists, index):
        places, score, best, _ = _placed(lists, index, RRF)
        for place, d in enumerate(places, 1):
            axis = min((-x.units[d], x.axis) for x in lists if x.units[d] > 0)[1]
            yield request, place, index.ids[d].as_py(), score[d], best[d] / blocks.UNIT, axis

    return _all_lists(spark, sf, answer, "request string, place int, doc_id string, fused double, best double, best_axis string")


def i_search_max(spark, sf):
    """The same by the greatest weighted score."""

    def answer(request, lists, index):
        places, score, best, _ = _placed(lists, index, MAX, [None] * len(lists))
        for place, d in enumerate(places, 1):
            yield request, place, index.ids[d].as_py(), score[d], best[d] / blocks.UNIT

    return _all_lists(spark, sf, answer, "request string, place int, doc_id string, fused double, best double")


def i_search_quota(spark, sf):
    """The ten works of each plan, half of the places kept for its queries in turn."""
    knobs = H.Knobs()

    def answer(request, lists, index):
        places, score, best, orders = _placed(lists, index, knobs)
        chosen = blocks.with_quota(lists, orders, places, knobs)
        for place, d in enumerate(sorted(chosen, key=lambda d: (-score[d], -best[d], d)), 1):
            yield request, index.ids[d].as_py(), place, score[d], best[d] / blocks.UNIT, chosen[d]

    return _all_lists(spark, sf, answer, "request string, doc_id string, place int, fused double, best double, reserved boolean")


def i_axis_scores(spark, sf):
    """Of each of a plan's ten works its best score on each axis."""

    def answer(request, lists, index):
        for d in _placed(lists, index, RRF)[0]:
            yield from ((request, index.ids[d].as_py(), x.axis, x.units[d] / blocks.UNIT) for x in lists if x.units[d] > 0)

    return _all_lists(spark, sf, answer, "request string, doc_id string, axis string, score double")


def i_query_status(spark, sf):
    """How each query of a plan fared at the floor."""

    def answer(request, lists, index):
        places, _, _, orders = _placed(lists, index, FLOOR)
        least = blocks.least_units(FLOOR)
        for x, order in zip(lists, orders):
            yield request, x.axis, x.coverage, x.units.max(initial=0) / blocks.UNIT, len(order), int((x.units[places] >= least).sum())

    return _all_lists(spark, sf, answer, "request string, axis string, coverage double, top_score double, n_above bigint, n_in_results bigint")


def i_verdict(spark, sf):
    """Whether works related to a plan were found, by how much, and how many strong ones."""
    least = blocks.least_units(FLOOR)

    def answer(request, lists, index):
        if any(x.met for x in lists):
            best = blocks.best_units(lists)
            top = int(best.max())
            yield request, top / blocks.UNIT, (top - least) / blocks.UNIT, int((best >= round(0.3 * blocks.UNIT)).sum()), "related" if top >= least else "unrelated"

    return _all_lists(spark, sf, answer, "request string, top_relevance double, margin double, n_strong bigint, verdict string")


def i_retry(spark, sf):
    """Plans of which no work passes a high floor are searched again without one, and marked."""

    def answer(request, lists, index):
        best = blocks.best_units(lists)
        above, found = int((best >= round(0.3 * blocks.UNIT)).sum()), int((best > 0).sum())
        if found:
            yield request, above == 0, above or found

    return _all_lists(spark, sf, answer, "request string, low_similarity boolean, n_candidates bigint")


def i_calibration(spark, sf):
    """Spread of the plans' greatest scores, to set a floor by."""

    def answer(request, lists, index):
        if any(x.met for x in lists):
            yield request, int(blocks.best_units(lists).max()) / blocks.UNIT

    tops = _all_lists(spark, sf, answer, "request string, top double")
    p = lambda q: F.round(F.percentile("top", q), 6)
    return tops.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("top"), 6).alias("least"), p(0.1).alias("p10"), p(0.5).alias("median"), p(0.9).alias("p90"), F.round(F.max("top"), 6).alias("greatest"))


def c_top_k_compare(spark, sf):
    """The two fusions against each other: works in both, entered or dropped, and the greatest move, per plan."""

    def answer(request, lists, index):
        a, _, _, orders = _placed(lists, index, RRF)
        b = _placed(lists, index, MAX, orders)[0]
        a, b = ({d: place for place, d in enumerate(x, 1)} for x in (a.tolist(), b.tolist()))
        if a:
            yield request, len(a.keys() & b.keys()), len(b.keys() - a.keys()), len(a.keys() - b.keys()), max((abs(a[d] - b[d]) for d in a.keys() & b.keys()), default=0)

    return _all_lists(spark, sf, answer, "request string, n_both bigint, n_entered bigint, n_dropped bigint, greatest_move int")


def i_search_documents(spark, sf):
    """Words and vectors together: every document whose id is divisible by 20 asks all documents but itself; the ten best by the blend. The vector of a document is the one of its id; not all have one."""
    docs = table(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")
    # The blend may lift any vector, so all are kept, not the nearest only.
    v = table(spark, sf, "embeddings").where("vec_id IS NOT NULL").groupBy(F.col("vec_id").alias("doc_id")).agg(F.min("embedding").alias("embedding"))
    return blocks.blend_top_k(docs, v, F.col("doc_id") % 20 == 0, 10, RRF.alpha).select("request", "rank", "doc_id", "score")


Q = (i_search, i_search_max, i_search_quota, i_axis_scores, i_query_status, i_verdict, i_retry, i_calibration, c_top_k_compare, i_search_documents)


def queries():
    return {q.__name__: q for q in Q}


def oracle_sql():
    s = sql_scores() + """, sc AS (SELECT split_part(qk, chr(1), 1) AS request, split_part(qk, chr(1), 2) AS axis, doc_id, score FROM bmq),
    ra AS (SELECT *, CASE WHEN axis = 'evaluation' THEN 0.5 ELSE 1.0 END AS w, row_number() OVER (PARTITION BY request, axis ORDER BY score DESC, doc_id) AS k FROM sc WHERE score > 0),
    rf AS (SELECT *, CASE WHEN axis = 'evaluation' THEN 0.5 ELSE 1.0 END AS w, row_number() OVER (PARTITION BY request, axis ORDER BY score DESC, doc_id) AS k FROM sc WHERE score > 0 AND score >= 0.1),
    fu AS (SELECT request, doc_id, round(sum(w / (60.0 + k)), 9) AS fused, max(score) AS best, arg_min(axis, (-score, axis)) AS best_axis FROM ra GROUP BY 1, 2),
    fm AS (SELECT request, doc_id, round(max(w * score), 9) AS fused, max(score) AS best FROM ra GROUP BY 1, 2),
    ff AS (SELECT request, doc_id, round(sum(w / (60.0 + k)), 9) AS fused, max(score) AS best FROM rf GROUP BY 1, 2),
    tu AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY fused DESC, best DESC, doc_id) AS place FROM fu QUALIFY place <= 10),
    tm AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY fused DESC, best DESC, doc_id) AS place FROM fm QUALIFY place <= 10),
    tf AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY fused DESC, best DESC, doc_id) AS place FROM ff QUALIFY place <= 10),
    cv AS (SELECT split_part(qk, chr(1), 1) AS request, split_part(qk, chr(1), 2) AS axis, round(sum(CASE WHEN df > 0 THEN idf ELSE 0 END) / sum(idf), 6) AS coverage FROM qi GROUP BY 1, 2) """
    return {
        "i_search": s + "SELECT request, place, doc_id, fused, best, best_axis FROM tu",
        "i_search_max": s + "SELECT request, place, doc_id, fused, best FROM tm",
        "i_axis_scores": s + "SELECT ra.request, ra.doc_id, axis, max(score) AS score FROM ra JOIN tu USING (request, doc_id) GROUP BY 1, 2, 3",
        "i_query_status": s + "SELECT cv.request, cv.axis, coverage, coalesce(t, 0) AS top_score, coalesce(n, 0) AS n_above, coalesce(m, 0) AS n_in_results FROM cv LEFT JOIN (SELECT request, axis, max(score) AS t FROM sc GROUP BY 1, 2) a USING (request, axis) LEFT JOIN (SELECT request, axis, count(*) AS n FROM rf GROUP BY 1, 2) b USING (request, axis) LEFT JOIN (SELECT rf.request, axis, count(*) AS m FROM rf JOIN tf USING (request, doc_id) GROUP BY 1, 2) c USING (request, axis)",
        "i_verdict": s + "SELECT request, max(r) AS top_relevance, round(max(r) - 0.1, 9) AS margin, sum(CAST(r >= 0.3 AS INT)) AS n_strong, CASE WHEN max(r) >= 0.1 THEN 'related' ELSE 'unrelated' END AS verdict FROM (SELECT request, doc_id, max(score) AS r FROM sc GROUP BY 1, 2) GROUP BY 1",
        "i_retry": s + "SELECT request, a = 0 AS low_similarity, CASE WHEN a = 0 THEN n ELSE a END AS n_candidates FROM (SELECT request, count(DISTINCT CASE WHEN score >= 0.3 THEN doc_id END) AS a, count(DISTINCT doc_id) AS n FROM sc WHERE score > 0 GROUP BY 1)",
        "i_calibration": s + "SELECT count(*) AS n, round(min(t), 6) AS least, round(quantile_cont(t, 0.1), 6) AS p10, round(quantile_cont(t, 0.5), 6) AS median, round(quantile_cont(t, 0.9), 6) AS p90, round(max(t), 6) AS greatest FROM (SELECT request, max(score) AS t FROM sc GROUP BY 1)",
        "c_top_k_compare": s + "SELECT request, sum(CAST(a IS NOT NULL AND b IS NOT NULL AS INT)) AS n_both, sum(CAST(a IS NULL AS INT)) AS n_entered, sum(CAST(b IS NULL AS INT)) AS n_dropped, coalesce(max(abs(a - b)), 0) AS greatest_move FROM (SELECT request, doc_id, place AS a FROM tu) x FULL JOIN (SELECT request, doc_id, place AS b FROM tm) y USING (request, doc_id) GROUP BY 1",
    }
