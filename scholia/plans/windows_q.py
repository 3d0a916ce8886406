"""Ranking, running and gap queries (survey E), set operations (F), samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import records as R
from scholia.operators import ranking, sampling
from scholia.plans.common import first, first_sql
from scholia.sources.tables import table


def e_top_reviews(spark, sf):
    """The three latest reviews of each work; reviews without a date come last."""
    r = first(spark, sf, "reviews", "work_id", "created").where("work_id IS NOT NULL")
    w = Window.partitionBy("work_id").orderBy(F.desc_nulls_last("created"), "review_id")
    return r.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("work_id", "rank", "review_id")


def e_review_orders(spark, sf):
    """The place of each review in its work in two orders: undated last, and undated first."""
    r = first(spark, sf, "reviews", "work_id", "created")
    last = F.row_number().over(Window.partitionBy("work_id").orderBy(F.asc_nulls_last("created"), "review_id"))
    lead = F.row_number().over(Window.partitionBy("work_id").orderBy(F.asc_nulls_first("created"), "review_id"))
    return r.select("review_id", last.alias("undated_last"), lead.alias("undated_first"))


def e_best_tag(spark, sf):
    """The surest tag of each excerpt; at a tie the smaller code."""
    t = first(spark, sf, "risk_tags", "excerpt_id", "risk_code", "confidence").where("excerpt_id IS NOT NULL AND confidence IS NOT NULL")
    return t.groupBy("excerpt_id").agg(F.max("confidence").alias("confidence"), F.max_by("risk_code", F.struct("confidence", -F.substring("risk_code", 2, 1).cast("int"))).alias("risk_code"))


def e_rank_fusion(spark, sf):
    """Works ranked by reviews and by mean rating, fused by reciprocal ranks (a top 50)."""
    r = first(spark, sf, "reviews", "work_id", "rating").where("work_id IS NOT NULL")
    per = r.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(R.rating_value(F.col("rating"))), 6).alias("m"))
    a = ranking.global_rank(per, "n").select("work_id", "rank")
    b = ranking.global_rank(per.where("m IS NOT NULL"), "m").select("work_id", "rank")
    both = a.unionByName(b).groupBy("work_id").agg(F.round(F.sum(1 / (60.0 + F.col("rank"))), 8).alias("fused"))
    return both.orderBy(F.desc("fused"), "work_id").limit(50)


def e_round_robin(spark, sf):
    """A pool of 240 tags taken in turns from the groups of source and code."""
    t = first(spark, sf, "risk_tags", "excerpt_id", "risk_code", "confidence").where("excerpt_id IS NOT NULL AND risk_code NOT IN ('R0', 'R9')")
    e = first(spark, sf, "excerpts", "source_id")
    j = t.join(e, "excerpt_id").withColumn("c", F.coalesce("confidence", F.lit(0.0)))
    turn = F.row_number().over(Window.partitionBy("source_id", "risk_code").orderBy(F.desc("c"), "tag_id"))
    return j.withColumn("turn", turn).orderBy("turn", "source_id", "risk_code").limit(240).select("tag_id", "source_id", "risk_code", "turn")


def e_allocation(spark, sf):
    """200 works shared over sources by largest remainder."""
    w = first(spark, sf, "works", "work_id").groupBy(R.source_of(F.col("work_id")).alias("source")).agg(F.count(F.lit(1)).alias("n_works"))
    return sampling.allocation(w, "source", "n_works", 200)


def e_hash_sample(spark, sf):
    """A stratified sample of 200 works by hash."""
    w = first(spark, sf, "works", "work_id").withColumn("source", R.source_of(F.col("work_id")))
    return sampling.stratified(w, "work_id", "source", 200, "7").select("source", "work_id")


def e_cumulative_coverage(spark, sf):
    """Works first reviewed by month of arrival, and the running number of works reviewed."""
    r = table(spark, sf, "reviews").where("work_id IS NOT NULL").groupBy("work_id").agg(F.date_format(F.min("ingested_at"), "yyyy-MM").alias("month"))
    m = r.groupBy("month").agg(F.count(F.lit(1)).alias("n_new"))
    return m.withColumn("n_so_far", F.sum("n_new").over(Window.orderBy("month")))


def e_sessions(spark, sf):
    """Users' events in runs with gaps of no more than a day: gaps and islands."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 1 DAY"), 0).otherwise(1)
    s = e.withColumn("new", fresh).withColumn("island", F.sum("new").over(w))
    return s.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def e_first_seen_numbers(spark, sf):
    """Evidence of each card numbered by first mention."""
    c = first(spark, sf, "risk_cards", "evidence").select("card_id", F.posexplode("evidence").alias("at", "excerpt_id")).where("excerpt_id IS NOT NULL")
    seen = c.groupBy("card_id", "excerpt_id").agg(F.min("at").alias("at"))
    return seen.select("card_id", "excerpt_id", F.dense_rank().over(Window.partitionBy("card_id").orderBy("at")).alias("no"))


def e_running_budget(spark, sf):
    """The lines of each plan that fit into 400 characters, up to the first that does not."""
    from scholia.plans.records_q import h_plan_lines

    w = Window.partitionBy("plan_id").orderBy("line_no")
    lines = h_plan_lines(spark, sf).withColumn("used", F.sum(F.length("line")).over(w)).where("used <= 400")
    return lines.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("used").alias("n_chars"))


def e_last_write(spark, sf):
    """The latest delivery of each card revision: status and time."""
    r = table(spark, sf, "revision").select("revision_id", "ingested_at", "status")
    last = r.groupBy("revision_id").agg(F.max(F.struct("ingested_at", "status")).alias("l"))
    return last.select("revision_id", F.col("l.status").alias("status"), F.col("l.ingested_at").alias("ingested_at"))


def e_numbering_gaps(spark, sf):
    """Line numbers missing below the greatest that the edits of a plan name."""
    r = first(spark, sf, "revision", "plan_id", "edits").select("plan_id", F.explode("edits").alias("e")).select("plan_id", F.col("e.plan_line").alias("line")).where("line > 0")
    s = r.groupBy("plan_id").agg(F.collect_set("line").alias("have"), F.max("line").alias("top"))
    return s.select("plan_id", F.explode(F.array_except(F.sequence(F.lit(1), F.col("top")), "have")).alias("missing"))


def e_rule_cards(spark, sf):
    """Five excerpts per code, in turns over works, by confidence."""
    t = first(spark, sf, "risk_tags", "excerpt_id", "risk_code", "polarity", "confidence").where("polarity = 'negative' AND excerpt_id IS NOT NULL")
    e = first(spark, sf, "excerpts", "source_id", "source_kind").where("source_kind = 'review'")
    r = first(spark, sf, "reviews", "work_id").select(F.col("review_id").alias("source_id"), "work_id")
    j = t.join(e, "excerpt_id").join(r, "source_id").where("work_id IS NOT NULL").withColumn("c", F.coalesce("confidence", F.lit(0.0)))
    turn = F.row_number().over(Window.partitionBy("risk_code", "work_id").orderBy(F.desc("c"), "tag_id"))
    place = F.row_number().over(Window.partitionBy("risk_code").orderBy("turn", F.desc("c"), "work_id", "tag_id"))
    return j.withColumn("turn", turn).withColumn("place", place).where("place <= 5").select("risk_code", "place", "tag_id", "work_id")


def e_daily_change(spark, sf):
    """Events by day and type with the change from the day before, and quartiles of the days."""
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy("day")
    q = F.ntile(4).over(Window.partitionBy("event_type").orderBy("n", "day"))
    return d.select("event_type", F.col("day").cast("string").alias("day"), "n", (F.col("n") - F.lag("n").over(w)).alias("change"), q.alias("quartile"))


def f_set_operations(spark, sf):
    """Works with reviews, with decisions, with either, both, or reviews only."""
    r = first(spark, sf, "reviews", "work_id").select("work_id").where("work_id IS NOT NULL").distinct()
    d = first(spark, sf, "decisions", "work_id").select(F.col("work_id")).where("work_id IS NOT NULL").distinct()
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(r.union(d).distinct(), "either").unionByName(n(r.intersect(d), "both")).unionByName(n(r.exceptAll(d), "reviews only")).unionByName(n(d.exceptAll(r), "decisions only"))


def f_equal_sets(spark, sf):
    """Cards whose sets of evidence are equal but for order and repeats."""
    c = first(spark, sf, "risk_cards", "evidence").where("evidence IS NOT NULL")
    ids = F.array_sort(F.array_distinct(F.filter("evidence", lambda x: x.isNotNull())))
    some = c.select("card_id", ids.alias("ids")).where("size(ids) > 0")
    return some.groupBy(F.array_join("ids", "|").alias("evidence_set")).agg(F.count(F.lit(1)).alias("n_cards"), F.min("card_id").alias("first_card"))


Q = (e_top_reviews, e_review_orders, e_best_tag, e_rank_fusion, e_round_robin, e_allocation, e_hash_sample, e_cumulative_coverage, e_sessions, e_first_seen_numbers, e_running_budget, e_last_write, e_numbering_gaps, e_rule_cards, e_daily_change, f_set_operations, f_equal_sets)


def queries():
    return {q.__name__: q for q in Q}


def oracle_sql():
    f = first_sql
    rating = r"try_cast(regexp_extract(rating, '^\s*(-?\d+(?:\.\d+)?)', 1) AS DOUBLE)"
    src = "CASE WHEN contains(work_id, ':') THEN string_split(work_id, ':')[1] END"
    alloc = f("works")[:-1] + f", s AS (SELECT {src} AS source, count(*) n FROM works1 GROUP BY 1), t AS (SELECT sum(n) w, least(200, sum(n)) k FROM s), b AS (SELECT source, n, floor(n * k / w) base, n * k / w - floor(n * k / w) frac, k FROM s, t), a AS (SELECT source, n, base + CASE WHEN row_number() OVER (ORDER BY round(frac, 9) DESC, source NULLS FIRST) <= k - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM b) "
    from scholia.plans.records_q import oracle_sql as records_sql

    lines = records_sql()["h_plan_lines"].rsplit(" SELECT ", 1)[0]
    return {
        "e_top_reviews": f("reviews") + "SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY created DESC NULLS LAST, review_id) AS rank, review_id FROM reviews1 WHERE work_id IS NOT NULL QUALIFY rank <= 3",
        "e_review_orders": f("reviews") + "SELECT review_id, row_number() OVER (PARTITION BY work_id ORDER BY created ASC NULLS LAST, review_id) AS undated_last, row_number() OVER (PARTITION BY work_id ORDER BY created ASC NULLS FIRST, review_id) AS undated_first FROM reviews1",
        "e_best_tag": f("risk_tags") + "SELECT excerpt_id, confidence, risk_code FROM risk_tags1 WHERE excerpt_id IS NOT NULL AND confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY excerpt_id ORDER BY confidence DESC, risk_code) = 1",
        "e_rank_fusion": f("reviews")[:-1] + f", p AS (SELECT work_id, count(*) n, round(avg({rating}), 6) m FROM reviews1 WHERE work_id IS NOT NULL GROUP BY 1), r AS (SELECT work_id, rank() OVER (ORDER BY n DESC) AS k FROM p UNION ALL SELECT work_id, rank() OVER (ORDER BY m DESC) FROM p WHERE m IS NOT NULL) SELECT work_id, round(sum(1 / (60.0 + k)), 8) AS fused FROM r GROUP BY 1 ORDER BY fused DESC, work_id LIMIT 50",
        "e_round_robin": f("risk_tags", "excerpts") + "SELECT tag_id, source_id, risk_code, row_number() OVER (PARTITION BY source_id, risk_code ORDER BY coalesce(confidence, 0) DESC, tag_id) AS turn FROM risk_tags1 t JOIN excerpts1 e USING (excerpt_id) WHERE risk_code NOT IN ('R0', 'R9') ORDER BY turn, source_id NULLS FIRST, risk_code LIMIT 240",
        "e_allocation": alloc + "SELECT source, n, take FROM a",
        "e_hash_sample": alloc + f", h AS (SELECT work_id, {src} AS source FROM works1) SELECT h.source AS source, work_id FROM h JOIN a ON a.source = h.source QUALIFY row_number() OVER (PARTITION BY h.source ORDER BY sha256('7:' || work_id)) <= take",
        "e_cumulative_coverage": "SELECT month, n_new, sum(n_new) OVER (ORDER BY month) AS n_so_far FROM (SELECT month, count(*) AS n_new FROM (SELECT work_id, strftime(min(ingested_at), '%Y-%m') AS month FROM reviews WHERE work_id IS NOT NULL GROUP BY 1) GROUP BY 1)",
        "e_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g) SELECT user_id, island, count(*) AS n_events, min(ts) AS started, max(ts) AS ended FROM i GROUP BY 1, 2",
        "e_first_seen_numbers": f("risk_cards") + "SELECT card_id, excerpt_id, dense_rank() OVER (PARTITION BY card_id ORDER BY min(pos)) AS no FROM (SELECT card_id, unnest(evidence) AS excerpt_id, generate_subscripts(evidence, 1) AS pos FROM risk_cards1) WHERE excerpt_id IS NOT NULL GROUP BY 1, 2",
        "e_running_budget": lines + " SELECT plan_id, count(*) AS n_lines, max(used) AS n_chars FROM (SELECT plan_id, sum(length(line)) OVER (PARTITION BY plan_id ORDER BY line_no) AS used FROM lines) WHERE used <= 400 GROUP BY 1",
        "e_last_write": "SELECT revision_id, status, ingested_at FROM revision QUALIFY row_number() OVER (PARTITION BY revision_id ORDER BY ingested_at DESC, status DESC) = 1",
        "e_numbering_gaps": f("revision")[:-1] + ", l AS (SELECT plan_id, e.plan_line AS line FROM (SELECT plan_id, unnest(edits) AS e FROM revision1) WHERE e.plan_line > 0), t AS (SELECT plan_id, unnest(generate_series(1, max(line))) AS missing FROM l GROUP BY 1) SELECT plan_id, missing FROM t WHERE NOT EXISTS (FROM l WHERE l.plan_id = t.plan_id AND l.line = t.missing)",
        "e_rule_cards": f("risk_tags", "excerpts", "reviews")[:-1] + ", j AS (SELECT risk_code, work_id, tag_id, coalesce(t.confidence, 0) AS c, row_number() OVER (PARTITION BY risk_code, work_id ORDER BY coalesce(t.confidence, 0) DESC, tag_id) AS turn FROM risk_tags1 t JOIN excerpts1 e ON e.excerpt_id = t.excerpt_id AND source_kind = 'review' JOIN reviews1 r ON r.review_id = e.source_id WHERE polarity = 'negative' AND work_id IS NOT NULL) SELECT risk_code, row_number() OVER (PARTITION BY risk_code ORDER BY turn, c DESC, work_id, tag_id) AS place, tag_id, work_id FROM j QUALIFY place <= 5",
        "e_daily_change": "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, CAST(day AS VARCHAR) AS day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS change, ntile(4) OVER (PARTITION BY event_type ORDER BY n, day) AS quartile FROM d",
        "f_set_operations": f("reviews", "decisions")[:-1] + ", r AS (SELECT DISTINCT work_id FROM reviews1 WHERE work_id IS NOT NULL), d AS (SELECT DISTINCT work_id FROM decisions1 WHERE work_id IS NOT NULL) SELECT 'either' AS what, count(*) AS n FROM (FROM r UNION FROM d) UNION ALL SELECT 'both', count(*) FROM (FROM r INTERSECT FROM d) UNION ALL SELECT 'reviews only', count(*) FROM (FROM r EXCEPT FROM d) UNION ALL SELECT 'decisions only', count(*) FROM (FROM d EXCEPT FROM r)",
        "f_equal_sets": f("risk_cards") + "SELECT array_to_string(list_sort(list_distinct(evidence)), '|') AS evidence_set, count(*) AS n_cards, min(card_id) AS first_card FROM risk_cards1 WHERE evidence IS NOT NULL AND len(list_distinct(evidence)) > 0 GROUP BY 1",
    }
