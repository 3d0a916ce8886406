"""Further queries: extraction, containment, lifts, hits, chunks, exports (survey A, B, C, D, E, H, N)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import records as R
from scholia.operators import containment
from scholia.plans.common import first, first_sql
from scholia.plans.search_q import _neighbours, i_bm25
from scholia.sources.files import csv_safe
from scholia.sources.tables import table

REFERENCE = r"(Figs?|Tab|Table|Sec|Eq|App|Alg|Thm|No)\.? \(?([0-9]+(?:\.[0-9]+)?)"
UNITS = "%|percent|points|epochs|GPU hours|μm|Å"
QUOTE = "[\"“]([^\"“”]{3,200})[\"”]"
#: A number, its thousands grouped by commas or not; WRITTEN is the same without looking behind, which the oracle cannot.
GROUPED = r"(?:(?<![0-9])(?<![0-9]\.)[1-9][0-9]{0,2}(?:,[0-9]{3})+(?![0-9])|[0-9]+)(?:\.[0-9]+)?"
WRITTEN = r"(?:[1-9][0-9]{0,2}(?:,[0-9]{3})+(?:\.[0-9]+)?\b|[0-9]+(?:\.[0-9]+)?)"
GROUPED_QUANTITY = f"({GROUPED}) ?({UNITS})"


def _plain(number):
    return F.regexp_replace(number, ",", "")


def h_references(spark, sf):
    """References to figures, tables, sections and the like in reviews, by kind and number."""
    r = first(spark, sf, "reviews", "text")
    each = r.select(F.explode(F.regexp_extract_all("text", F.lit(f"({REFERENCE})"), 1)).alias("ref"))
    return each.groupBy(F.regexp_extract("ref", REFERENCE, 1).alias("kind"), F.regexp_extract("ref", REFERENCE, 2).alias("number")).agg(F.count(F.lit(1)).alias("n"))


def h_quantities(spark, sf):
    """Quantities with their unit in reviews: how many, least and greatest."""
    r = first(spark, sf, "reviews", "text")
    each = r.select(F.explode(F.regexp_extract_all("text", F.lit(f"({GROUPED_QUANTITY})"), 1)).alias("q"))
    v = _plain(F.regexp_extract("q", GROUPED_QUANTITY, 1)).cast("double")
    return each.groupBy(F.regexp_extract("q", GROUPED_QUANTITY, 2).alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def h_quotes(spark, sf):
    """What reviews quote, and how many reviews do."""
    r = first(spark, sf, "reviews", "text")
    each = r.select("review_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(QUOTE), 1))).alias("quote"))
    return each.groupBy("quote").agg(F.count(F.lit(1)).alias("n_reviews"))


def b_unsupported_numbers(spark, sf):
    """Numbers in the edits that their excerpts do not hold, per revision."""
    r = first(spark, sf, "revision", "edits").select("revision_id", F.posexplode("edits").alias("at", "e")).select("revision_id", "at", F.col("e.proposed_text").alias("text"), F.col("e.rationale.excerpt_ids").alias("ids"))
    said = r.select("revision_id", "at", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({GROUPED})"), 1), _plain))).alias("number"))
    ids = r.select("revision_id", "at", F.explode("ids").alias("excerpt_id"))
    e = first(spark, sf, "excerpts", "text")
    held = ids.join(e, "excerpt_id").select("revision_id", "at", F.explode(F.transform(F.regexp_extract_all("text", F.lit(f"({GROUPED})"), 1), _plain)).alias("number")).distinct()
    return said.join(held, ["revision_id", "at", "number"], "left_anti").groupBy("revision_id").agg(F.count(F.lit(1)).alias("n_unsupported"))


def c_text_contained(spark, sf):
    """Texts of excerpts that occur in plans, and in how many (a leak of reviews into plans)."""
    e = first(spark, sf, "excerpts", "text").where("text IS NOT NULL").select(F.sha2(containment.squeezed(F.col("text")), 256).alias("needle_id"), "text")
    one = e.groupBy("needle_id").agg(F.min("text").alias("text"))
    p = first(spark, sf, "assemble_live_smoke3", "plan_text").select(F.col("plan_id").alias("hay_id"), F.col("plan_text").alias("text"))
    return containment.contained(one, p).groupBy("needle_id").agg(F.count(F.lit(1)).alias("n_plans"))


def d_field_lift(spark, sf):
    """Share of rejections in each field against the share over all works with a decision."""
    d = first(spark, sf, "decisions", "work_id", "outcome_raw").where("outcome_raw IS NOT NULL AND work_id IS NOT NULL")
    one = d.withColumn("o", R.decision_outcome(F.col("outcome_raw"))).where("o <> 'unknown'").groupBy("work_id").agg(F.max(F.col("o").isin("reject", "desk_reject").cast("int")).alias("bad"))
    w = first(spark, sf, "works", "fields").join(one, "work_id")
    # Every work counts under each of its fields and under one that stands for all.
    each = w.select("bad", F.explode(F.array_union(F.coalesce("fields", F.array()), F.array(F.lit("\0all")))).alias("field"))
    per = each.groupBy("field").agg(F.count(F.lit(1)).alias("n_works"), F.round(F.avg("bad"), 4).alias("share"))
    base = F.max(F.when(F.col("field") == "\0all", F.col("share"))).over(Window.partitionBy())  # over the few fields
    return per.withColumn("base", base).where(F.col("field") != "\0all").select("field", "n_works", "share", F.round(F.col("share") / F.nullif("base", F.lit(0)), 3).alias("lift"))


def d_hits_at_three(spark, sf):
    """Of the three nearest vectors of each query other than itself: precision over three places, and whether any hits."""
    lab = table(spark, sf, "embeddings").select("vec_id", "label")
    near = _neighbours(spark, sf, 3).join(lab.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    hit = (F.col("label") == F.col("own")).cast("int")
    per = near.groupBy("query_id").agg(F.sum(hit).alias("hits"))
    return per.select("query_id", F.round(F.col("hits") / 3, 6).alias("precision_at_3"), (F.col("hits") > 0).alias("hit_at_3"))


def h_batches(spark, sf):
    """Excerpts of each source in batches of five, in order: their sizes and ends."""
    e = first(spark, sf, "excerpts", "source_id", "span_start", "span_end").where("source_id IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(F.asc_nulls_first("span_start"), "excerpt_id"))
    return e.withColumn("batch", F.floor((n - 1) / 5)).groupBy("source_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("span_end").alias("ends"))


def n_daily_budget(spark, sf):
    """Users' days with more purchases than one."""
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return e.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def a_csv_export(spark, sf):
    """Search results as text for a sheet: four decimals, formulas disarmed."""
    hits = i_bm25(spark, sf).where("rank <= 3")
    w = first(spark, sf, "works", "title").select(F.col("work_id").alias("doc_id"), csv_safe("title").alias("title"))
    return hits.join(w, "doc_id", "left").select("query_id", F.col("rank").cast("string").alias("rank"), "title", F.round(F.col("score").cast("decimal(12,9)"), 4).cast("decimal(10,4)").cast("string").alias("similarity"))


def e_order_violations(spark, sf):
    """Edits of a revision whose line breaks the order: outside a longest run that does not fall."""
    r = first(spark, sf, "revision", "edits").where("size(edits) > 1")
    lines = F.filter(F.transform("edits", lambda e: e["plan_line"]), lambda x: x.isNotNull())

    def longer(tails, x):
        """The least ends of runs of each length, after one more line."""
        at = F.size(F.filter(tails, lambda t: t <= x))
        return F.concat(F.slice(tails, F.lit(1), at), F.array(x), F.slice(tails, at + 2, F.size(tails)))

    kept = F.size(F.aggregate("lines", F.array().cast("array<int>"), longer))
    return r.select("revision_id", lines.alias("lines")).select("revision_id", (F.size("lines") - kept).alias("n_violations")).where("n_violations > 0")


Q = (h_references, h_quantities, h_quotes, b_unsupported_numbers, c_text_contained, d_field_lift, d_hits_at_three, h_batches, n_daily_budget, a_csv_export, e_order_violations)


def queries():
    return {q.__name__: q for q in Q}


def oracle_sql():
    f = first_sql
    from scholia.plans.records_q import _rules
    from scholia.plans.search_q import oracle_sql as search_sql

    bm25 = search_sql()["i_bm25"]
    near = search_sql()["i_dense"].split("SELECT query_id, rank, doc_id, round(s")[0]
    value = f"CAST(replace(regexp_extract(q, '^({WRITTEN})', 1), ',', '') AS DOUBLE)"
    sq = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return {
        "h_references": f("reviews") + f"SELECT regexp_extract(ref, '{REFERENCE}', 1) AS kind, regexp_extract(ref, '{REFERENCE}', 2) AS number, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{REFERENCE}')) AS ref FROM reviews1) GROUP BY 1, 2",
        # Without look-behind a number that is grouped is told from a decimal part by splitting off the sign before it.
        "h_quantities": f("reviews") + f"SELECT regexp_extract(q, '({UNITS})$', 1) AS unit, count(*) AS n, min({value}) AS least, max({value}) AS greatest FROM (SELECT unnest(regexp_extract_all(text, '{WRITTEN} ?(?:{UNITS})')) AS q FROM reviews1) GROUP BY 1",
        "h_quotes": f("reviews") + f"SELECT quote, count(*) AS n_reviews FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '{QUOTE}', 1))) AS quote FROM reviews1) GROUP BY 1",
        "b_unsupported_numbers": f("revision", "excerpts")[:-1] + f", r AS (SELECT revision_id, pos, e.proposed_text AS text, e.rationale.excerpt_ids AS ids FROM (SELECT revision_id, unnest(edits) AS e, generate_subscripts(edits, 1) AS pos FROM revision1)), s AS (SELECT DISTINCT revision_id, pos, replace(unnest(regexp_extract_all(text, '{WRITTEN}')), ',', '') AS x FROM r), h AS (SELECT DISTINCT revision_id, pos, replace(unnest(regexp_extract_all(e.text, '{WRITTEN}')), ',', '') AS x FROM (SELECT revision_id, pos, unnest(ids) AS excerpt_id FROM r) i JOIN excerpts1 e USING (excerpt_id)) SELECT revision_id, count(*) AS n_unsupported FROM (SELECT * FROM s EXCEPT SELECT * FROM h) GROUP BY 1",
        "c_text_contained": f("excerpts", "assemble_live_smoke3")[:-1] + f", n AS (SELECT DISTINCT {sq('text')} AS t FROM excerpts1 WHERE length({sq('text')}) >= 20) SELECT sha256(t) AS needle_id, count(*) AS n_plans FROM n JOIN assemble_live_smoke31 ON contains(' ' || {sq('plan_text')} || ' ', ' ' || t || ' ') GROUP BY 1",
        "d_field_lift": f("decisions", "works")[:-1] + f", o AS (SELECT work_id, max(CAST(o IN ('reject', 'desk_reject') AS INT)) AS bad FROM (SELECT work_id, {_rules(2)} AS o FROM decisions1 WHERE outcome_raw IS NOT NULL AND work_id IS NOT NULL) WHERE o <> 'unknown' GROUP BY 1), w AS (SELECT bad, fields FROM works1 JOIN o USING (work_id)), b AS (SELECT round(avg(bad), 4) AS base FROM w) SELECT field, n_works, share, round(share / nullif(base, 0), 3) AS lift FROM (SELECT field, count(*) AS n_works, round(avg(bad), 4) AS share FROM (SELECT bad, unnest(list_distinct(fields)) AS field FROM w) GROUP BY 1), b",
        "d_hits_at_three": near + "SELECT query_id, round(sum(CAST(label = own AS INT)) / 3, 6) AS precision_at_3, sum(CAST(label = own AS INT)) > 0 AS hit_at_3 FROM o WHERE rank <= 3 GROUP BY 1",
        "h_batches": f("excerpts") + "SELECT source_id, batch, count(*) AS n, max(span_end) AS ends FROM (SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY span_start NULLS FIRST, excerpt_id) - 1) // 5 AS batch FROM excerpts1 WHERE source_id IS NOT NULL) GROUP BY 1, 2",
        "e_order_violations": "WITH RECURSIVE revision1 AS (SELECT * FROM revision QUALIFY row_number() OVER (PARTITION BY revision_id ORDER BY ingested_at) = 1), l AS (SELECT revision_id, list_filter(list_transform(edits, lambda e: e.plan_line), lambda x: x IS NOT NULL) AS lines FROM revision1 WHERE len(edits) > 1), r AS (SELECT revision_id, lines, 0 AS i, CAST([] AS INT[]) AS tails FROM l UNION ALL SELECT revision_id, lines, i + 1, list_concat(list_concat(tails[1:p], [lines[i + 1]]), tails[p + 2:]) FROM (SELECT *, len(list_filter(tails, lambda t: t <= lines[i + 1])) AS p FROM r WHERE i < len(lines))) SELECT revision_id, len(lines) - len(tails) AS n_violations FROM r WHERE i = len(lines) AND len(lines) > len(tails)",
        "n_daily_budget": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2 HAVING count(*) > 1",
        "a_csv_export": f"WITH hits AS ({bm25}), w AS (SELECT * FROM works QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY ingested_at) = 1) SELECT query_id, CAST(rank AS VARCHAR) AS rank, CASE WHEN regexp_matches(title, '^[=+\\-@\\t\\r]') THEN '''' || title ELSE title END AS title, CAST(CAST(round(CAST(score AS DECIMAL(12,9)), 4) AS DECIMAL(10,4)) AS VARCHAR) AS similarity FROM hits LEFT JOIN w ON w.work_id = doc_id WHERE rank <= 3",
    }
