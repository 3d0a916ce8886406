"""Aggregations (survey D) and evaluation metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import records as R
from scholia.plans.common import first, first_sql
from scholia.sources.tables import table


def d_corpus_statistics(spark, sf):
    """Works per field, with those of several fields counted in each."""
    w = first(spark, sf, "works", "fields", "pub_year")
    each = w.select("work_id", "pub_year", F.explode(F.array_distinct("fields")).alias("field"))
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("n_works"), F.min("pub_year").alias("first_year"), F.max("pub_year").alias("last_year"))


def d_field_combinations(spark, sf):
    """Works by the combination of their fields."""
    w = first(spark, sf, "works", "fields")
    return w.groupBy(F.array_join(F.array_sort(F.array_distinct(F.coalesce("fields", F.array()))), "+").alias("fields")).agg(F.count(F.lit(1)).alias("n_works"))


def d_reject_ratio(spark, sf):
    """Share of rejecting decisions by source; null where there are none."""
    d = first(spark, sf, "decisions", "work_id", "outcome_raw").where("outcome_raw IS NOT NULL")
    out = R.decision_outcome(F.col("outcome_raw"))
    known = F.sum(F.when(out != "unknown", 1).otherwise(0))
    rejected = F.sum(F.when(out.isin("reject", "desk_reject"), 1).otherwise(0))
    return d.groupBy(R.source_of(F.trim("work_id")).alias("source")).agg(known.alias("n_known"), rejected.alias("n_rejected"), F.round(rejected / F.nullif(known, F.lit(0)), 4).alias("reject_ratio"))


def d_coverage_grains(spark, sf):
    """Works with reviews at several grains at once: total, by source, by year, by both (grouping sets)."""
    w = first(spark, sf, "works", "pub_year").withColumn("source", R.source_of(F.col("work_id")))
    r = first(spark, sf, "reviews", "work_id").select("work_id").distinct().withColumn("has", F.lit(1))
    j = w.join(r, "work_id", "left").select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("pub_year", F.lit(0)).alias("pub_year"), "has")
    c = j.cube("source", "pub_year").agg(F.grouping_id().alias("grain"), F.count(F.lit(1)).alias("n_works"), F.coalesce(F.sum("has"), F.lit(0)).alias("n_reviewed"))
    return c.select("grain", "source", "pub_year", "n_works", "n_reviewed", F.round(F.col("n_reviewed") / F.col("n_works"), 4).alias("coverage"))


def d_tag_counts(spark, sf):
    t = first(spark, sf, "risk_tags", "risk_code", "polarity").where("risk_code IS NOT NULL")
    return t.groupBy("risk_code").pivot("polarity", ["negative", "neutral", "positive"]).agg(F.count(F.lit(1))).na.fill(0)


def d_code_frequency(spark, sf):
    """Codes by the number of distinct sources with a negative tag of theirs, and distinct works."""
    t = first(spark, sf, "risk_tags", "risk_code", "polarity", "excerpt_id").where("polarity = 'negative'")
    e = first(spark, sf, "excerpts", "source_id", "source_kind")
    r = first(spark, sf, "reviews", "work_id").select(F.col("review_id").alias("source_id"), "work_id")
    j = t.join(e.where("source_kind = 'review'"), "excerpt_id").join(r, "source_id", "left")
    return j.groupBy("risk_code").agg(F.countDistinct("source_id").alias("n_sources"), F.countDistinct("work_id").alias("n_works"))


def d_score_parts(spark, sf):
    """Cards whose total is not the product of their parts, and sums of parts, by code."""
    c = first(spark, sf, "risk_cards", "risk_code", "score")
    parts = [F.col(f"score.{n}") for n in ("similarity", "frequency", "severity", "confidence")]
    product = parts[0] * parts[1] * parts[2] * parts[3]
    off = F.abs(F.round(product, 4) - F.col("score.total")) > 0.00011
    return c.groupBy("risk_code").agg(F.count(F.lit(1)).alias("n_cards"), F.sum(F.coalesce(off, F.lit(False)).cast("int")).alias("n_off"), F.round(F.sum("score.similarity"), 4).alias("similarity"), F.round(F.sum("score.total"), 4).alias("total"))


def _labels(spark, sf):
    """Long form of gold (rule) and predicted (other generators) labels of excerpts that both have tagged."""
    t = first(spark, sf, "risk_tags", "excerpt_id", "risk_code", "generator").where("excerpt_id IS NOT NULL AND risk_code IS NOT NULL")
    gold = t.where("generator = 'rule'").select("excerpt_id", "risk_code").distinct().withColumn("g", F.lit(1))
    pred = t.where("generator <> 'rule'").select("excerpt_id", "risk_code").distinct().withColumn("p", F.lit(1))
    units = gold.select("excerpt_id").distinct()
    # A unit without prediction has none; predictions for other units do not count.
    return gold.join(pred.join(units, "excerpt_id", "left_semi"), ["excerpt_id", "risk_code"], "full_outer").na.fill(0, ["g", "p"])


def d_multilabel_scores(spark, sf):
    """Precision, recall and F1 by code, over codes (macro, of supported ones) and over all labels (micro)."""
    per = _labels(spark, sf).groupBy("risk_code").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    def scored(df, name):
        p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
        f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
        return df.select(name.alias("risk_code"), "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))

    codes = scored(per, F.col("risk_code"))
    micro = scored(per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), F.lit("micro"))
    macro = codes.where("tp + fn > 0").agg(*[F.lit(None).cast("bigint").alias(c) for c in ("tp", "fp", "fn")], *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])
    return codes.unionByName(micro).unionByName(macro.withColumn("risk_code", F.lit("macro")))


def d_majority(spark, sf):
    """The polarity of excerpts that more than half of their tags agree on."""
    t = first(spark, sf, "risk_tags", "excerpt_id", "polarity").where("excerpt_id IS NOT NULL AND polarity IS NOT NULL")
    votes = t.groupBy("excerpt_id", "polarity").agg(F.count(F.lit(1)).alias("votes"))
    n = F.sum("votes").over(Window.partitionBy("excerpt_id"))
    return votes.withColumn("n", n).where("votes >= floor(n / 2) + 1 AND n > 1").select("excerpt_id", "polarity", "votes", "n")


def d_kappa(spark, sf):
    """Cohen's kappa of two taggers' polarities over excerpts that both have tagged; null where chance agrees fully."""
    t = first(spark, sf, "risk_tags", "excerpt_id", "polarity", "generator").where("excerpt_id IS NOT NULL AND polarity IS NOT NULL")
    one = t.groupBy("excerpt_id", F.when(F.col("generator") == "rule", "a").otherwise("b").alias("who")).agg(F.min("polarity").alias("label"))
    pairs = one.where("who = 'a'").select("excerpt_id", F.col("label").alias("a")).join(one.where("who = 'b'").select("excerpt_id", F.col("label").alias("b")), "excerpt_id")
    # One row per pair of labels: what is grouped after that is tiny.
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    seen = cells.select("n", F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same"), zero.alias("s"))
    sides = cells.select(F.col("a").alias("l"), F.col("n").alias("na"), zero.alias("nb")).unionByName(cells.select(F.col("b").alias("l"), zero.alias("na"), F.col("n").alias("nb")))
    chance = sides.groupBy("l").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).select(zero.alias("n"), zero.alias("same"), (F.col("na") * F.col("nb")).alias("s"))
    both = seen.unionByName(chance).agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("s").alias("s"))
    po, pe = F.col("same") / F.col("n"), F.col("s") / (F.col("n") * F.col("n"))
    return both.select("n", F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"))


def d_average_rating(spark, sf):
    r = first(spark, sf, "reviews", "work_id", "rating", "kind").withColumn("v", R.rating_value(F.col("rating"))).where("v IS NOT NULL AND kind = 'official_review'")
    return r.groupBy("work_id").agg(F.round(F.avg("v"), 6).alias("mean_rating"), F.count(F.lit(1)).alias("n_ratings"))


def d_percentiles(spark, sf):
    """Linear percentiles of tag confidence by code."""
    t = first(spark, sf, "risk_tags", "risk_code", "confidence").where("confidence IS NOT NULL")
    return t.groupBy("risk_code").agg(*[F.round(F.percentile("confidence", p), 9).alias(f"p{int(p * 1000)}") for p in (0.025, 0.5, 0.975)])


def d_gate_audit(spark, sf):
    """Items generated, passed and dropped by generator, with the ratio of sums."""
    r = first(spark, sf, "revision", "generator", "gate_audit")
    g, p, d = (F.sum(f"gate_audit.{c}") for c in ("n_generated", "n_passed", "n_dropped"))
    return r.groupBy("generator").agg(g.alias("n_generated"), p.alias("n_passed"), d.alias("n_dropped"), F.round(d / F.nullif(g, F.lit(0)), 6).alias("drop_rate"))


def d_never_round_to_one(spark, sf):
    """Passed over generated at four places that never reads 1 unless all passed, nor 0 unless none did."""
    r = first(spark, sf, "revision", "plan_id", "gate_audit")
    per = r.groupBy("plan_id").agg(F.sum("gate_audit.n_passed").alias("ok"), F.sum("gate_audit.n_generated").alias("total")).where("total > 0")
    x = F.round(F.col("ok") / F.col("total"), 4)
    return per.select("plan_id", F.when((x >= 1) & (F.col("ok") < F.col("total")), 0.9999).when((x <= 0) & (F.col("ok") > 0), 0.0001).otherwise(x).alias("ratio"))


def d_monthly(spark, sf):
    """Reviews by month of creation and kind, with running totals."""
    r = first(spark, sf, "reviews", "created", "kind").where("created IS NOT NULL")
    m = r.groupBy("kind", F.date_format("created", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("running", F.sum("n").over(Window.partitionBy("kind").orderBy("month")))


def d_moving_average(spark, sf):
    """Each user's values folded in order of time: 0.7 of the old and 0.3 of the new."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    kept = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return e.groupBy("user_id").agg(kept.alias("k")).select("user_id", F.round(F.aggregate(F.transform("k", lambda x: x["value"]), F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a * 0.7 + x * 0.3)), 6).alias("ema"))


def d_bootstrap(spark, sf, rounds: int = 2000, seed: int = 20260930):
    """Interval of the mean confidence by code over resamples of its distribution.

    The values are counted first (they have two to four places), so a group is
    the list of distinct values of a code and its resamples are multinomial.
    """
    t = first(spark, sf, "risk_tags", "risk_code", "confidence").where("confidence IS NOT NULL")
    counted = t.groupBy("risk_code", F.round("confidence", 4).alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("v")
        rng = np.random.default_rng([seed, *map(ord, pdf["risk_code"].iloc[0])])
        n = int(pdf["n"].sum())
        means = np.sort(rng.multinomial(n, pdf["n"].to_numpy() / n, size=rounds) @ pdf["v"].to_numpy() / n)
        return pd.DataFrame({"risk_code": [pdf["risk_code"].iloc[0]], "mean": [float((pdf["v"] * pdf["n"]).sum() / n)], "low": [means[int(0.025 * rounds)]], "high": [means[int(0.975 * rounds) - 1]]})

    return counted.groupBy("risk_code").applyInPandas(run, "risk_code string, mean double, low double, high double")


def d_shares_of_votes(spark, sf):
    """Counts and shares of polarities by generator, ignoring nulls."""
    t = first(spark, sf, "risk_tags", "polarity", "generator")
    each = [F.sum((F.col("polarity") == p).cast("int")).alias(f"n_{p}") for p in ("negative", "neutral", "positive")]
    n = F.count("polarity")
    return t.groupBy("generator").agg(n.alias("n"), *each, F.round(F.sum((F.col("polarity") == "negative").cast("int")) / F.nullif(n, F.lit(0)), 6).alias("share_negative"))


def d_code_matrix(spark, sf):
    """Works by the families of cards that cite them, as a 0/1 matrix."""
    c = first(spark, sf, "risk_cards", "risk_code", "works").select("risk_code", F.explode("works").alias("work_id")).where("work_id IS NOT NULL")
    codes = [f"R{i}" for i in range(10)]
    return c.groupBy("work_id").pivot("risk_code", codes).agg(F.max(F.lit(1))).na.fill(0)


Q = (d_corpus_statistics, d_field_combinations, d_reject_ratio, d_coverage_grains, d_tag_counts, d_code_frequency, d_score_parts, d_multilabel_scores, d_majority, d_kappa, d_average_rating, d_percentiles, d_gate_audit, d_never_round_to_one, d_monthly, d_moving_average, d_bootstrap, d_shares_of_votes, d_code_matrix)


def queries():
    return {q.__name__: q for q in Q}


def oracle_sql():
    f = first_sql
    from scholia.plans.records_q import _rules

    rating = r"try_cast(regexp_extract(rating, '^\s*(-?\d+(?:\.\d+)?)', 1) AS DOUBLE)"
    labels = f("risk_tags")[:-1] + ", t AS (SELECT DISTINCT excerpt_id, risk_code, generator = 'rule' AS g FROM risk_tags1 WHERE excerpt_id IS NOT NULL AND risk_code IS NOT NULL AND generator IS NOT NULL), l AS (SELECT excerpt_id, risk_code, max(CAST(g AS INT)) g, max(CAST(NOT g AS INT)) p FROM t WHERE excerpt_id IN (SELECT excerpt_id FROM t WHERE g) GROUP BY 1, 2), c AS (SELECT risk_code, sum(g * p) tp, sum((1 - g) * p) fp, sum(g * (1 - p)) fn FROM l GROUP BY 1), c2 AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(tp), sum(fp), sum(fn) FROM c), s AS (SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) pr, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1 FROM c2) "
    codes = ", ".join(f"max(CAST(risk_code = 'R{i}' AS INT)) AS R{i}" for i in range(10))
    return {
        "d_corpus_statistics": f("works") + "SELECT field, count(*) AS n_works, min(pub_year) AS first_year, max(pub_year) AS last_year FROM (SELECT pub_year, unnest(list_distinct(fields)) AS field FROM works1) GROUP BY 1",
        "d_field_combinations": f("works") + "SELECT coalesce(array_to_string(list_sort(list_distinct(fields)), '+'), '') AS fields, count(*) AS n_works FROM works1 GROUP BY 1",
        "d_reject_ratio": f("decisions") + f"SELECT CASE WHEN contains(trim(work_id), ':') THEN string_split(trim(work_id), ':')[1] END AS source, sum(CAST(o <> 'unknown' AS INT)) AS n_known, sum(CAST(o IN ('reject', 'desk_reject') AS INT)) AS n_rejected, round(sum(CAST(o IN ('reject', 'desk_reject') AS INT)) / nullif(sum(CAST(o <> 'unknown' AS INT)), 0), 4) AS reject_ratio FROM (SELECT *, {_rules(2)} AS o FROM decisions1 WHERE outcome_raw IS NOT NULL) GROUP BY 1",
        "d_coverage_grains": f("works", "reviews") + "SELECT grouping(source) * 2 + grouping(pub_year) AS grain, source, pub_year, count(*) AS n_works, count(h) AS n_reviewed, round(count(h) / count(*), 4) AS coverage FROM (SELECT coalesce(CASE WHEN contains(work_id, ':') THEN string_split(work_id, ':')[1] END, 'none') AS source, coalesce(pub_year, 0) AS pub_year, CASE WHEN work_id IN (SELECT work_id FROM reviews1) THEN 1 END AS h FROM works1) GROUP BY CUBE (source, pub_year)",
        "d_tag_counts": f("risk_tags") + "SELECT risk_code, sum(CAST(polarity = 'negative' AS INT)) AS negative, sum(CAST(polarity = 'neutral' AS INT)) AS neutral, sum(CAST(polarity = 'positive' AS INT)) AS positive FROM risk_tags1 WHERE risk_code IS NOT NULL GROUP BY 1",
        "d_code_frequency": f("risk_tags", "excerpts", "reviews") + "SELECT risk_code, count(DISTINCT e.source_id) AS n_sources, count(DISTINCT r.work_id) AS n_works FROM risk_tags1 t JOIN excerpts1 e ON e.excerpt_id = t.excerpt_id AND source_kind = 'review' LEFT JOIN reviews1 r ON r.review_id = e.source_id WHERE polarity = 'negative' GROUP BY 1",
        "d_score_parts": f("risk_cards") + "SELECT risk_code, count(*) AS n_cards, sum(CAST(coalesce(abs(round(score.similarity * score.frequency * score.severity * score.confidence, 4) - score.total) > 0.00011, false) AS INT)) AS n_off, round(sum(score.similarity), 4) AS similarity, round(sum(score.total), 4) AS total FROM risk_cards1 GROUP BY 1",
        "d_multilabel_scores": labels + "SELECT risk_code, tp, fp, fn, pr AS precision, recall, f1 FROM s UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(pr), 6), round(avg(recall), 6), round(avg(f1), 6) FROM s WHERE risk_code <> 'micro' AND tp + fn > 0",
        "d_majority": f("risk_tags")[:-1] + ", v AS (SELECT excerpt_id, polarity, count(*) votes FROM risk_tags1 WHERE excerpt_id IS NOT NULL AND polarity IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, sum(votes) OVER (PARTITION BY excerpt_id) n FROM v) SELECT excerpt_id, polarity, votes, n FROM s WHERE votes >= floor(n / 2) + 1 AND n > 1",
        "d_kappa": f("risk_tags")[:-1] + ", o AS (SELECT excerpt_id, CASE WHEN generator = 'rule' THEN 'a' ELSE 'b' END who, min(polarity) l FROM risk_tags1 WHERE excerpt_id IS NOT NULL AND polarity IS NOT NULL GROUP BY 1, 2), p AS (SELECT x.l a, y.l b FROM o x JOIN o y USING (excerpt_id) WHERE x.who = 'a' AND y.who = 'b'), m AS (SELECT count(*) n, avg(CAST(a = b AS INT)) po FROM p), e AS (SELECT sum(na * nb) / (SELECT n * n FROM m) pe FROM (SELECT a, count(*) na FROM p GROUP BY 1) x JOIN (SELECT b, count(*) nb FROM p GROUP BY 1) y ON x.a = y.b) SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM m, e",
        "d_average_rating": f("reviews") + f"SELECT work_id, round(avg({rating}), 6) AS mean_rating, count(*) AS n_ratings FROM reviews1 WHERE {rating} IS NOT NULL AND kind = 'official_review' GROUP BY 1",
        "d_percentiles": f("risk_tags") + "SELECT risk_code, round(quantile_cont(confidence, 0.025), 9) AS p25, round(quantile_cont(confidence, 0.5), 9) AS p500, round(quantile_cont(confidence, 0.975), 9) AS p975 FROM risk_tags1 WHERE confidence IS NOT NULL GROUP BY 1",
        "d_gate_audit": f("revision") + "SELECT generator, sum(gate_audit.n_generated) AS n_generated, sum(gate_audit.n_passed) AS n_passed, sum(gate_audit.n_dropped) AS n_dropped, round(sum(gate_audit.n_dropped) / nullif(sum(gate_audit.n_generated), 0), 6) AS drop_rate FROM revision1 GROUP BY 1",
        "d_never_round_to_one": f("revision") + "SELECT plan_id, CASE WHEN round(ok / total, 4) >= 1 AND ok < total THEN 0.9999 WHEN round(ok / total, 4) <= 0 AND ok > 0 THEN 0.0001 ELSE round(ok / total, 4) END AS ratio FROM (SELECT plan_id, sum(gate_audit.n_passed) ok, sum(gate_audit.n_generated) total FROM revision1 GROUP BY 1) WHERE total > 0",
        "d_monthly": f("reviews") + "SELECT kind, month, n, sum(n) OVER (PARTITION BY kind ORDER BY month) AS running FROM (SELECT kind, strftime(created, '%Y-%m') AS month, count(*) AS n FROM reviews1 WHERE created IS NOT NULL GROUP BY 1, 2)",
        "d_moving_average": "SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a * 0.7 + x * 0.3), 6) AS ema FROM events GROUP BY 1",
        "d_shares_of_votes": f("risk_tags") + "SELECT generator, count(polarity) AS n, sum(CAST(polarity = 'negative' AS INT)) AS n_negative, sum(CAST(polarity = 'neutral' AS INT)) AS n_neutral, sum(CAST(polarity = 'positive' AS INT)) AS n_positive, round(sum(CAST(polarity = 'negative' AS INT)) / nullif(count(polarity), 0), 6) AS share_negative FROM risk_tags1 GROUP BY 1",
        "d_code_matrix": f("risk_cards") + f"SELECT work_id, {codes} FROM (SELECT risk_code, unnest(works) AS work_id FROM risk_cards1) WHERE work_id IS NOT NULL GROUP BY 1",
    }
