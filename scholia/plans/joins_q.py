"""Queries on joins (survey C and A): semi, anti, outer, as-of, range, recursive, set-valued."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import records as R
from scholia.operators import intervals, trees
from scholia.plans.common import first, first_sql
from scholia.plans.records_q import SECTION, section
from scholia.sources.tables import table


def c_semi_reviews(spark, sf):
    """Reviews of known works, counted by kind."""
    r = first(spark, sf, "reviews", "work_id", "kind")
    return r.join(first(spark, sf, "works", "work_id"), "work_id", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("n_reviews"))


def c_dangling(spark, sf):
    """Rows whose reference names no record at all, by table."""
    works, excerpts = first(spark, sf, "works", "work_id"), first(spark, sf, "excerpts", "excerpt_id")
    parts = [(n, first(spark, sf, n, c), c, p) for n, c, p in (("reviews", "work_id", works), ("decisions", "work_id", works), ("risk_tags", "excerpt_id", excerpts))]
    return reduce(DataFrame.unionByName, [df.where(F.col(c).isNotNull()).join(p, c, "left_anti").agg(F.count(F.lit(1)).alias("n_dangling")).select(F.lit(n).alias("child_table"), "n_dangling") for n, df, c, p in parts])


def _sources(spark, sf):
    """Texts that excerpts are cut from."""
    r = first(spark, sf, "reviews", "text", "work_id").select(F.lit("review").alias("source_kind"), F.col("review_id").alias("source_id"), F.col("text").alias("source_text"), "work_id")
    d = first(spark, sf, "decisions", "text", "work_id").select(F.lit("decision").alias("source_kind"), F.col("decision_id").alias("source_id"), F.col("text").alias("source_text"), "work_id")
    return r.unionByName(d)


def _excerpts(spark, sf):
    return first(spark, sf, "excerpts", "source_kind", "source_id", "span_start", "span_end", "text", "text_sha256", "source_sha256", "source_url")


def c_excerpt_check(spark, sf):
    """Excerpts against their sources: how many fail for each set of reasons."""
    e = _excerpts(spark, sf).join(_sources(spark, sf).drop("work_id"), ["source_kind", "source_id"], "left")
    cut = F.substring(F.col("source_text"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    bad_range = (F.col("span_start") < 0) | (F.col("span_end") <= F.col("span_start"))
    reasons = F.array_compact(F.array(
        F.when(F.col("source_url").isNull(), "url missing"),
        F.when(R.text_sha256(F.col("text")) != F.col("text_sha256"), "hash"),
        F.when(bad_range, "offset invalid"),
        F.when(F.col("source_text").isNull(), "source not found"),
        F.when(F.col("source_text").isNotNull() & (F.col("span_end") > F.length("source_text")), "out of range"),
        F.when(F.col("source_text").isNotNull() & ~bad_range & (cut != F.col("text")), "mismatch"),
    ))
    return e.groupBy(F.array_join(reasons, ";").alias("reasons")).agg(F.count(F.lit(1)).alias("n_excerpts"))


def c_verify_offsets(spark, sf):
    """Excerpts that are exactly the slice of their source that they claim to be."""
    e = _excerpts(spark, sf).join(_sources(spark, sf), ["source_kind", "source_id"])
    ok = F.substring(F.col("source_text"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) == F.col("text")
    return e.groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(ok, F.lit(False)).cast("int")).alias("n_verified"))


def c_excerpt_work(spark, sf):
    """The work of each excerpt, by way of its review or decision."""
    e = _excerpts(spark, sf).select("excerpt_id", "source_kind", "source_id")
    return e.join(_sources(spark, sf).drop("source_text"), ["source_kind", "source_id"], "left").select("excerpt_id", "work_id")


def c_section_carried(spark, sf):
    """Excerpts with the section heading last seen before them in their source."""
    e = _excerpts(spark, sf).select("excerpt_id", "source_id", "span_start", section(F.col("text")).alias("sec"))
    w = Window.partitionBy("source_id").orderBy("span_start", "excerpt_id")
    return e.withColumn("in_section", F.last("sec", ignorenulls=True).over(w)).where("in_section IS NOT NULL").select("excerpt_id", "in_section")


def c_chain_root(spark, sf):
    """Each excerpt's first excerpt in its source, found by chasing predecessors."""
    e = _excerpts(spark, sf).select("excerpt_id", "source_id", "span_start").where("source_id IS NOT NULL")
    before = F.lag("excerpt_id").over(Window.partitionBy("source_id").orderBy("span_start", "excerpt_id"))
    edges = e.select(F.col("excerpt_id").alias("node"), before.alias("parent"))
    return trees.roots(edges)


def c_overlaps(spark, sf):
    """Pairs of excerpts of one source that overlap."""
    e = _excerpts(spark, sf).where("span_end > span_start AND source_id IS NOT NULL").select("source_id", F.col("excerpt_id").alias("id"), "span_start", "span_end")
    return intervals.overlapping(e, "source_id", "id", "span_start", "span_end")


def c_contained(spark, sf):
    """Excerpts that lie inside a longer one of their source."""
    e = _excerpts(spark, sf).where("span_end > span_start AND source_id IS NOT NULL").select("source_id", F.col("excerpt_id").alias("id"), "span_start", "span_end")
    return intervals.inner(e, "source_id", "id", "span_start", "span_end").select("source_id", F.col("id").alias("excerpt_id"))


def c_asof_events(spark, sf):
    """Each purchase with the user's last view before or at it."""
    ev = table(spark, sf, "events").where("event_type IN ('purchase', 'view')").select("event_id", "ts", "user_id", "event_type")
    return intervals.as_of(ev.where("event_type = 'purchase'"), ev.where("event_type = 'view'"), "user_id", "ts", "event_id")


def c_same_work(spark, sf):
    """Pairs of works that are one by DOI, by title or by native id: three equi-joins, not an OR-join."""
    w = first(spark, sf, "works", "doi", "title", "native_id")
    keys = w.select("work_id", F.explode(F.array(
        F.struct(F.lit("doi").alias("reason"), R.normalized_doi(F.col("doi")).alias("value")),
        F.struct(F.lit("title").alias("reason"), R.title_key(F.col("title")).alias("value")),
        F.struct(F.lit("native").alias("reason"), F.lower("native_id").alias("value")),
    )).alias("k")).select("work_id", "k.*").where("value <> ''")
    least = keys.groupBy("reason", "value").agg(F.min("work_id").alias("first_work"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = keys.join(least, ["reason", "value"]).where("work_id <> first_work")
    return same.groupBy("first_work", "work_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def c_outer_compare(spark, sf):
    """Works with reviews against works with decisions: both, or one only."""
    r = first(spark, sf, "reviews", "work_id").where("work_id IS NOT NULL").groupBy("work_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    d = first(spark, sf, "decisions", "work_id").where("work_id IS NOT NULL").groupBy("work_id").agg(F.count(F.lit(1)).alias("n_decisions"))
    side = F.when(F.col("n_reviews").isNull(), "decisions only").when(F.col("n_decisions").isNull(), "reviews only").otherwise("both")
    return r.join(d, "work_id", "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n_works"), F.sum("n_reviews").alias("n_reviews"), F.sum("n_decisions").alias("n_decisions"))


def c_last_decision(spark, sf):
    """Works with their latest decision (last one wins), and how many there are."""
    d = first(spark, sf, "decisions", "work_id", "outcome_raw", "ingested_at").where("work_id IS NOT NULL")
    last = d.groupBy("work_id").agg(F.max(F.struct("ingested_at", "decision_id", "outcome_raw")).alias("l"), F.count(F.lit(1)).alias("n_decisions"))
    w = first(spark, sf, "works", "work_id")
    return w.join(last, "work_id", "left").select("work_id", F.col("l.decision_id").alias("decision_id"), F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"))


def c_enriched(spark, sf):
    """Works with the mean numeric rating of their reviews and their number of decisions."""
    rating = first(spark, sf, "reviews", "work_id", "rating").groupBy("work_id").agg(F.avg(R.rating_value(F.col("rating"))).alias("mean"), F.count(F.lit(1)).alias("n_reviews"))
    d = first(spark, sf, "decisions", "work_id").groupBy("work_id").agg(F.count(F.lit(1)).alias("n_decisions"))
    w = first(spark, sf, "works", "work_id").join(rating, "work_id", "left").join(d, "work_id", "left")
    return w.select("work_id", F.round("mean", 6).alias("mean_rating"), F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"), F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"))


def c_excluded(spark, sf):
    """Removed works left out, and removals that name no work: anti-joins both ways."""
    w = first(spark, sf, "works", "work_id")
    x = table(spark, sf, "removals").where("record_table = 'works' AND restored_at IS NULL").select(F.col("record_id").alias("work_id")).distinct()
    kept, unmatched = w.join(x, "work_id", "left_anti"), x.join(w, "work_id", "left_anti")
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("what"), "n").unionByName(unmatched.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unmatched").alias("what"), "n"))


def c_evidence_linkage(spark, sf):
    """Cards by how many of their distinct pieces of evidence exist."""
    c = first(spark, sf, "risk_cards", "evidence", "risk_code")
    ids = c.select("card_id", "risk_code", F.explode(F.array_distinct(F.filter("evidence", lambda x: x.isNotNull()))).alias("excerpt_id"))
    e = first(spark, sf, "excerpts", "source_id").select("excerpt_id", F.lit(1).alias("hit"))
    per = ids.join(e, "excerpt_id", "left").groupBy("card_id", "risk_code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_found"))
    return per.groupBy("risk_code").agg(F.count(F.lit(1)).alias("n_cards"), F.sum("n").alias("n_evidence"), F.sum("n_found").alias("n_found"), F.sum((F.col("n") == F.col("n_found")).cast("int")).alias("n_complete"))


def c_evidence_pack(spark, sf):
    """Cards with their found excerpts in order, as a tree, and excerpts no card uses."""
    c = first(spark, sf, "risk_cards", "evidence").select("card_id", F.posexplode("evidence").alias("at", "excerpt_id"))
    used = c.groupBy("card_id", "excerpt_id").agg(F.min("at").alias("at"))
    e = first(spark, sf, "excerpts", "source_id")
    linked = used.join(e, "excerpt_id").groupBy("card_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "excerpt_id"))), lambda x: x["excerpt_id"]), ",").alias("excerpts"))
    loose = e.join(used.select("excerpt_id").distinct(), "excerpt_id", "left_anti").agg(F.lit("").alias("card_id"), F.count(F.lit(1)).cast("string").alias("excerpts"))
    return linked.unionByName(loose)


def c_deliveries(spark, sf):
    """Repeated deliveries of reviews: identical to the first, or changed."""
    r = table(spark, sf, "reviews").select("review_id", R.text_sha256(F.concat_ws("\0", "work_id", "text", "kind", "rating")).alias("h"))
    per = r.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("forms"))
    state = F.when(F.col("n") == 1, "once").when(F.col("forms") == 1, "identical").otherwise("changed")
    return per.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n_reviews"))


def c_record_heads(spark, sf):
    """What a lookup by work shows: the head of each review, its length and whether it is cut."""
    r = first(spark, sf, "reviews", "work_id", "text").where("text IS NOT NULL")
    return r.select("work_id", "review_id", R.text_sha256(F.left("text", F.lit(600))).alias("head_sha256"), F.length("text").alias("n_chars"), (F.length("text") > 600).alias("truncated"))


def a_audit(spark, sf):
    """Rules that records break, with their number (a union of violations)."""
    w = first(spark, sf, "works", "work_id", "title", "url", "doi", "provenance")
    rules = [("works", "no title", w, "title IS NULL OR trim(title) = ''"), ("works", "url is no link", w, "url IS NOT NULL AND NOT url LIKE 'http%'"), ("works", "no hash", w, "provenance.content_sha256 IS NULL"), ("works", "id without source", w, "instr(work_id, ':') = 0")]
    r = first(spark, sf, "reviews", "text", "provenance", "created", "ingested_at")
    rules += [("reviews", "no text", r, "text IS NULL OR trim(text) = ''"), ("reviews", "no hash", r, "provenance.content_sha256 IS NULL"), ("reviews", "created after arrival", r, "created > ingested_at")]
    by = {}
    for name, rule, df, test in rules:
        by.setdefault((name, id(df)), (df, []))[1].append((rule, test))
    parts = []
    for (name, _), (df, tests) in by.items():
        # One scan per table; the counts are turned into rows afterwards.
        counts = df.agg(*[F.sum(F.when(F.expr(t), 1).otherwise(0)).alias(f"c{i}") for i, (_, t) in enumerate(tests)])
        stack = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"c{i}").alias("n")) for i, (rule, _) in enumerate(tests)])).alias("s")
        parts.append(counts.select(stack).select(F.lit(name).alias("record_table"), "s.rule", F.coalesce("s.n", F.lit(0)).alias("n_violations")))
    return reduce(DataFrame.unionByName, parts)


def a_duplicate_keys(spark, sf):
    """Keys delivered more than once, by table (a union of sources)."""
    parts = [table(spark, sf, n).groupBy(F.col(k).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(F.lit(n).alias("record_table"), "n_keys", "n_rows") for n, k in (("works", "work_id"), ("reviews", "review_id"), ("decisions", "decision_id"), ("excerpts", "excerpt_id"), ("risk_tags", "tag_id"))]
    return reduce(DataFrame.unionByName, parts)


Q = (c_semi_reviews, c_dangling, c_excerpt_check, c_verify_offsets, c_excerpt_work, c_section_carried, c_chain_root, c_overlaps, c_contained, c_asof_events, c_same_work, c_outer_compare, c_last_decision, c_enriched, c_excluded, c_evidence_linkage, c_evidence_pack, c_deliveries, c_record_heads, a_audit, a_duplicate_keys)


def queries():
    return {q.__name__: q for q in Q}


def oracle_sql():
    f = first_sql
    sources = "sources AS (SELECT 'review' source_kind, review_id source_id, text source_text, work_id FROM reviews1 UNION ALL SELECT 'decision', decision_id, text, work_id FROM decisions1)"
    base = f("excerpts", "reviews", "decisions")[:-1] + ", " + sources + " "
    cut = "substring(source_text, span_start + 1, span_end - span_start)"
    sec = f"nullif(regexp_extract(lower(text), '{SECTION}', 1), '')"
    from scholia.plans.records_q import _doi

    spans = f("excerpts")[:-1] + ", s AS (SELECT source_id, excerpt_id id, span_start a, span_end b FROM excerpts1 WHERE span_end > span_start AND source_id IS NOT NULL) "
    rating = r"try_cast(regexp_extract(rating, '^\s*(-?\d+(?:\.\d+)?)', 1) AS DOUBLE)"
    return {
        "c_semi_reviews": f("reviews", "works") + "SELECT kind, count(*) AS n_reviews FROM reviews1 WHERE work_id IN (SELECT work_id FROM works1) GROUP BY 1",
        "c_dangling": f("reviews", "works", "decisions", "excerpts", "risk_tags") + "SELECT 'reviews' AS child_table, count(*) AS n_dangling FROM reviews1 r WHERE work_id IS NOT NULL AND NOT EXISTS (FROM works1 w WHERE w.work_id = r.work_id) UNION ALL SELECT 'decisions', count(*) FROM decisions1 r WHERE work_id IS NOT NULL AND NOT EXISTS (FROM works1 w WHERE w.work_id = r.work_id) UNION ALL SELECT 'risk_tags', count(*) FROM risk_tags1 r WHERE excerpt_id IS NOT NULL AND NOT EXISTS (FROM excerpts1 e WHERE e.excerpt_id = r.excerpt_id)",
        "c_excerpt_check": base + f"SELECT array_to_string(list_filter([CASE WHEN source_url IS NULL THEN 'url missing' END, CASE WHEN sha256(e.text) <> text_sha256 THEN 'hash' END, CASE WHEN span_start < 0 OR span_end <= span_start THEN 'offset invalid' END, CASE WHEN source_text IS NULL THEN 'source not found' END, CASE WHEN span_end > length(source_text) THEN 'out of range' END, CASE WHEN source_text IS NOT NULL AND NOT (span_start < 0 OR span_end <= span_start) AND {cut} <> e.text THEN 'mismatch' END], lambda x: x IS NOT NULL), ';') AS reasons, count(*) AS n_excerpts FROM excerpts1 e LEFT JOIN sources USING (source_kind, source_id) GROUP BY 1",
        "c_verify_offsets": base + f"SELECT source_kind, count(*) AS n, sum(CAST(coalesce({cut} = e.text, false) AS INT)) AS n_verified FROM excerpts1 e JOIN sources USING (source_kind, source_id) GROUP BY 1",
        "c_excerpt_work": base + "SELECT excerpt_id, work_id FROM excerpts1 LEFT JOIN sources USING (source_kind, source_id)",
        "c_section_carried": f("excerpts") + f"SELECT excerpt_id, s AS in_section FROM (SELECT excerpt_id, last_value({sec} IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY span_start NULLS FIRST, excerpt_id) AS s FROM excerpts1) WHERE s IS NOT NULL",
        "c_chain_root": f("excerpts") + "SELECT excerpt_id AS node, first_value(excerpt_id) OVER w AS root, row_number() OVER w - 1 AS depth FROM excerpts1 WHERE source_id IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY span_start NULLS FIRST, excerpt_id)",
        "c_overlaps": spans + "SELECT x.source_id AS source_id, x.id AS id_a, y.id AS id_b FROM s x JOIN s y ON x.source_id = y.source_id AND x.id < y.id AND x.a < y.b AND y.a < x.b",
        "c_contained": spans + "SELECT DISTINCT x.source_id AS source_id, x.id AS excerpt_id FROM s x JOIN s y ON x.source_id = y.source_id AND x.id <> y.id AND y.a <= x.a AND y.b >= x.b AND (y.b - y.a) > (x.b - x.a)",
        "c_asof_events": "SELECT l.event_id, l.user_id, l.ts, r.event_id AS before_id, r.ts AS before_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts",
        "c_same_work": f("works")[:-1] + f", k AS (SELECT work_id, 'doi' reason, {_doi('doi')} v FROM works1 UNION ALL SELECT work_id, 'title', trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) FROM works1 UNION ALL SELECT work_id, 'native', lower(native_id) FROM works1), l AS (SELECT reason, v, min(work_id) first_work FROM k WHERE v <> '' GROUP BY 1, 2 HAVING count(*) > 1) SELECT first_work, work_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM k JOIN l USING (reason, v) WHERE work_id <> first_work GROUP BY 1, 2",
        "c_outer_compare": f("reviews", "decisions")[:-1] + ", r AS (SELECT work_id, count(*) n FROM reviews1 WHERE work_id IS NOT NULL GROUP BY 1), d AS (SELECT work_id, count(*) m FROM decisions1 WHERE work_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'decisions only' WHEN m IS NULL THEN 'reviews only' ELSE 'both' END AS side, count(*) AS n_works, sum(n) AS n_reviews, sum(m) AS n_decisions FROM r FULL JOIN d USING (work_id) GROUP BY 1",
        "c_last_decision": f("works", "decisions")[:-1] + ", l AS (SELECT work_id, arg_max(decision_id, (ingested_at, decision_id)) d, count(*) n FROM decisions1 WHERE work_id IS NOT NULL GROUP BY 1) SELECT work_id, d AS decision_id, coalesce(n, 0) AS n_decisions FROM works1 LEFT JOIN l USING (work_id)",
        "c_enriched": f("works", "reviews", "decisions") + f"SELECT w.work_id, round(m, 6) AS mean_rating, coalesce(n, 0) AS n_reviews, coalesce(k, 0) AS n_decisions FROM works1 w LEFT JOIN (SELECT work_id, avg({rating}) m, count(*) n FROM reviews1 GROUP BY 1) r ON r.work_id = w.work_id LEFT JOIN (SELECT work_id, count(*) k FROM decisions1 GROUP BY 1) d ON d.work_id = w.work_id",
        "c_excluded": f("works")[:-1] + ", x AS (SELECT DISTINCT record_id FROM removals WHERE record_table = 'works' AND restored_at IS NULL) SELECT 'kept' AS what, count(*) AS n FROM works1 WHERE work_id NOT IN (SELECT record_id FROM x) UNION ALL SELECT 'unmatched', count(*) FROM x WHERE record_id NOT IN (SELECT work_id FROM works1)",
        "c_evidence_linkage": f("risk_cards", "excerpts")[:-1] + ", i AS (SELECT DISTINCT card_id, risk_code, unnest(evidence) excerpt_id FROM risk_cards1), p AS (SELECT card_id, risk_code, count(*) n, count(e.excerpt_id) m FROM i LEFT JOIN excerpts1 e USING (excerpt_id) WHERE i.excerpt_id IS NOT NULL GROUP BY 1, 2) SELECT risk_code, count(*) AS n_cards, sum(n) AS n_evidence, sum(m) AS n_found, sum(CAST(n = m AS INT)) AS n_complete FROM p GROUP BY 1",
        "c_evidence_pack": f("risk_cards", "excerpts")[:-1] + ", i AS (SELECT card_id, x AS excerpt_id, min(pos) AS pos FROM (SELECT card_id, unnest(evidence) AS x, generate_subscripts(evidence, 1) AS pos FROM risk_cards1) GROUP BY 1, 2) SELECT card_id, string_agg(excerpt_id, ',' ORDER BY pos) AS excerpts FROM i JOIN excerpts1 USING (excerpt_id) GROUP BY 1 UNION ALL SELECT '', CAST(count(*) AS VARCHAR) FROM excerpts1 WHERE excerpt_id NOT IN (SELECT excerpt_id FROM i WHERE excerpt_id IS NOT NULL)",
        "c_deliveries": "WITH p AS (SELECT review_id, count(*) n, count(DISTINCT concat_ws(chr(0), work_id, text, kind, rating)) k FROM reviews GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'once' WHEN k = 1 THEN 'identical' ELSE 'changed' END AS state, count(*) AS n_reviews FROM p GROUP BY 1",
        "c_record_heads": f("reviews") + "SELECT work_id, review_id, sha256(left(text, 600)) AS head_sha256, length(text) AS n_chars, length(text) > 600 AS truncated FROM reviews1 WHERE text IS NOT NULL",
        "a_audit": f("works", "reviews") + " UNION ALL ".join(f"SELECT '{t}' AS record_table, '{r}' AS rule, count(*) AS n_violations FROM {t}1 WHERE {q}" for t, r, q in (("works", "no title", "title IS NULL OR trim(title) = ''"), ("works", "url is no link", "url NOT LIKE 'http%'"), ("works", "no hash", "provenance.content_sha256 IS NULL"), ("works", "id without source", "NOT contains(work_id, ':')"), ("reviews", "no text", "text IS NULL OR trim(text) = ''"), ("reviews", "no hash", "provenance.content_sha256 IS NULL"), ("reviews", "created after arrival", "created > ingested_at"))),
        "a_duplicate_keys": " UNION ALL ".join(f"SELECT '{t}' AS record_table, count(*) AS n_keys, coalesce(sum(n), 0) AS n_rows FROM (SELECT {k}, count(*) n FROM {t} GROUP BY 1 HAVING count(*) > 1)" for t, k in (("works", "work_id"), ("reviews", "review_id"), ("decisions", "decision_id"), ("excerpts", "excerpt_id"), ("risk_tags", "tag_id"))),
    }
