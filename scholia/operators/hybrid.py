"""Hybrid search: lexical and dense scores of many queries to one ranked list per request.

A request asks by several queries, each on an axis. Scores are blended by how
much of a query the index knows, cut at a floor, ranked per query and fused over
the queries of a request. All of it is joins, windows and aggregates over the
pairs that have a score; the sequential choice of reserved places runs once per
request over its few best rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Knobs:
    """What a search may be set to; the axis weights of axes not named are 1."""

    alpha: float = 0.6
    adaptive: bool = True
    floor: float = 0.0
    fusion: str = "rrf"
    rrf_k: float = 60.0
    k: int = 10
    quota: int = 1
    weights: tuple[tuple[str, float], ...] = (("evaluation", 0.5),)


def weight(axis: Column, knobs: Knobs) -> Column:
    w = F.lit(1.0)
    for name, value in knobs.weights:
        w = F.when(axis == name, value).otherwise(w)
    return w


def combined(lexical: DataFrame, dense: DataFrame | None, coverage: DataFrame, knobs: Knobs) -> DataFrame:
    """(request, axis, doc_id, lexical, dense, score, relevance) of each pair with a lexical or a dense score.

    ``lexical`` (request, axis, doc_id, score), ``dense`` likewise or None, which
    is search by words alone: alpha is then 0. ``coverage`` (request, axis,
    coverage) is the share of a query's weight that the index knows; with
    ``adaptive`` the dense share is 1 - (1 - alpha) * coverage. Scores are clipped
    to 0..1; relevance is the greater of the dense score and the blend.
    """
    key = ["request", "axis", "doc_id"]
    both = lexical.select(*key, F.col("score").alias("lexical"))
    if dense is None:
        both = both.withColumn("dense", F.lit(0.0))
    else:
        both = both.join(dense.select(*key, F.col("score").alias("dense")), key, "full_outer")
    both = both.join(coverage, ["request", "axis"], "left")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0))))
    share = F.coalesce(F.col("coverage"), F.lit(0.0))
    a = F.lit(0.0) if dense is None else 1 - (1 - knobs.alpha) * share if knobs.adaptive else F.lit(knobs.alpha)
    rows = both.select(*key, clip("lexical").alias("lexical"), clip("dense").alias("dense"), a.alias("a"))
    rows = rows.withColumn("score", F.round(F.col("a") * F.col("dense") + (1 - F.col("a")) * F.col("lexical"), 9)).drop("a")
    return rows.withColumn("relevance", F.greatest("dense", "score"))


def ranked(rows: DataFrame, knobs: Knobs) -> DataFrame:
    """The rows that pass the floor and are above 0, with their rank in their query; ties to the smaller doc_id."""
    w = Window.partitionBy("request", "axis").orderBy(F.desc("score"), F.asc("doc_id"))
    return rows.where((F.col("relevance") >= knobs.floor) & (F.col("relevance") > 0)).withColumn("rank", F.row_number().over(w))


def fused(passing: DataFrame, knobs: Knobs) -> DataFrame:
    """(request, doc_id, fused, best, best_axis): by reciprocal ranks or by the greatest weighted score; the best query of a document, ties to the axis first in order."""
    w = weight(F.col("axis"), knobs)
    value = F.sum(w / (knobs.rrf_k + F.col("rank"))) if knobs.fusion == "rrf" else F.max(w * F.col("score"))
    first = F.min_by("axis", F.struct(-F.col("score"), "axis"))
    return passing.groupBy("request", "doc_id").agg(F.round(value, 9).alias("fused"), F.max("score").alias("best"), first.alias("best_axis"))


def _order(*by: str):
    return Window.partitionBy(*by).orderBy(F.desc("fused"), F.desc("best"), F.asc("doc_id"))


def top(found: DataFrame, k: int) -> DataFrame:
    """The k first of each request: fused, best, doc_id."""
    return found.withColumn("place", F.row_number().over(_order("request"))).where(F.col("place") <= k)


def with_quota(passing: DataFrame, found: DataFrame, knobs: Knobs) -> DataFrame:
    """The k of each request with places kept for its queries, in fused order.

    Up to half of the places (rounded up) are given in turn to the queries, the
    heavier first, each ``quota`` times: its best document that has no place yet;
    the rest goes by fused order. Only the k * (quota + 1) first of each query
    and the k first of each request can be chosen, so a request's task is small.
    """
    most = knobs.k * (knobs.quota + 1)
    own = passing.where(F.col("rank") <= most).select("request", "axis", "doc_id", "rank").join(found, ["request", "doc_id"])
    own = own.select("request", "axis", "doc_id", F.col("rank").cast("int").alias("rank"), "fused", "best", weight(F.col("axis"), knobs).alias("w"))
    whole = top(found, knobs.k).select("request", F.lit(None).cast("string").alias("axis"), "doc_id", F.lit(0).alias("rank"), "fused", "best", F.lit(0.0).alias("w"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = pdf[pdf["axis"].notna()].sort_values(["w", "axis", "rank"], ascending=[False, True, True], kind="stable")
        queues = [g["doc_id"].tolist() for _, g in lists.groupby("axis", sort=False)]
        chosen: dict = {}
        reserved = -(-knobs.k // 2)
        for _ in range(knobs.quota):
            for q in queues:
                if len(chosen) < reserved and (doc := next((d for d in q if d not in chosen), None)) is not None:
                    chosen[doc] = True
        rest = pdf[pdf["axis"].isna()].sort_values(["fused", "best", "doc_id"], ascending=[False, False, True], kind="stable")
        for doc in rest["doc_id"]:
            if len(chosen) < knobs.k:
                chosen.setdefault(doc, False)
        rows = pdf.drop_duplicates("doc_id").set_index("doc_id").loc[list(chosen)].reset_index()
        rows["reserved"] = [chosen[d] for d in rows["doc_id"]]
        rows = rows.sort_values(["fused", "best", "doc_id"], ascending=[False, False, True], kind="stable", ignore_index=True)
        return rows.assign(place=range(1, len(rows) + 1))[["request", "doc_id", "place", "fused", "best", "reserved"]]

    kinds = dict(found.dtypes)
    schema = f"request {kinds['request']}, doc_id {kinds['doc_id']}, place int, fused double, best double, reserved boolean"
    return own.unionByName(whole).groupBy("request").applyInPandas(choose, schema)


def axis_scores(passing: DataFrame, results: DataFrame) -> DataFrame:
    """(request, doc_id, axis, score): the best passing score of each result on each axis."""
    kept = passing.join(results.select("request", "doc_id"), ["request", "doc_id"], "left_semi")
    return kept.groupBy("request", "doc_id", "axis").agg(F.max("score").alias("score"))


def status(rows: DataFrame, passing: DataFrame, results: DataFrame, coverage: DataFrame, knobs: Knobs) -> DataFrame:
    """A row per query: coverage, greatest score, documents above the floor, and how many of the results it ranks."""
    tops = rows.groupBy("request", "axis").agg(F.max("score").alias("top_score"), F.max("relevance").alias("top_relevance"))
    n = passing.groupBy("request", "axis").agg(F.count(F.lit(1)).alias("n_above"))
    used = passing.join(results.select("request", "doc_id"), ["request", "doc_id"], "left_semi").groupBy("request", "axis").agg(F.count(F.lit(1)).alias("n_in_results"))
    key = ["request", "axis"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return coverage.join(tops, key, "left").join(n, key, "left").join(used, key, "left").select(*key, "coverage", zero("top_score"), zero("top_relevance"), zero("n_above"), zero("n_in_results"))


def verdict(rows: DataFrame, knobs: Knobs, strong: float = 0.5) -> DataFrame:
    """(request, top_relevance, margin, n_strong, verdict): related, unrelated, or unknown where there is no floor to judge by."""
    per_doc = rows.groupBy("request", "doc_id").agg(F.max("relevance").alias("relevance"))
    tops = per_doc.groupBy("request").agg(F.max("relevance").alias("top_relevance"), F.sum((F.col("relevance") >= strong).cast("int")).alias("n_strong"))
    said = F.lit("unknown") if knobs.floor <= 0 else F.when(F.col("top_relevance") >= knobs.floor, "related").otherwise("unrelated")
    return tops.select("request", "top_relevance", F.round(F.col("top_relevance") - knobs.floor, 9).alias("margin"), "n_strong", said.alias("verdict"))
