"""Queries on taggers, records, audits and leakage (survey A, C, D, E, G, I, SO)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import records as R
from scholia.functions.tokens import token_rows
from scholia.operators import retrieval
from scholia.plans.analysis_q import _count, _edged
from scholia.plans.common import first, first_sql
from scholia.plans.records_q import SQL_TOKENS, _doi
from scholia.plans.search_q import _works
from scholia.session import cut


def _n(c):
    return F.sum(F.coalesce(c, F.lit(False)).cast("int"))


def _codes(spark, sf):
    """One row per excerpt, tagger and code."""
    t = first(spark, sf, "risk_tags", "excerpt_id", "risk_code", "generator", "confidence").where("excerpt_id IS NOT NULL AND generator IS NOT NULL AND risk_code IS NOT NULL")
    return t.groupBy("excerpt_id", "generator", "risk_code").agg(F.avg("confidence").alias("confidence"))


def d_tagger_compare(spark, sf):
    """Rule tags against those of all other taggers, by code: in both, in one only."""
    c = _codes(spark, sf)
    side = lambda rule, name: c.where((F.col("generator") == "rule") == F.lit(rule)).select("excerpt_id", "risk_code").distinct().withColumn(name, F.lit(True))
    both = side(True, "a").join(side(False, "b"), ["excerpt_id", "risk_code"], "full_outer")
    return both.groupBy("risk_code").agg(_n(F.col("a") & F.col("b")).alias("n_both"), _n(F.col("b").isNull()).alias("n_rule_only"), _n(F.col("a").isNull()).alias("n_other_only"))


def d_tagger_pairs(spark, sf):
    """Each pair of taggers on the excerpts that both tagged: how often their first codes agree."""
    one = _codes(spark, sf).groupBy("excerpt_id", "generator").agg(F.min("risk_code").alias("code"))
    b = one.select("excerpt_id", F.col("generator").alias("other"), F.col("code").alias("other_code"))
    met = one.join(b, "excerpt_id").where("generator < other")
    return met.groupBy("generator", "other").agg(_count("n"), F.round(F.avg((F.col("code") == F.col("other_code")).cast("int")), 6).alias("agreement"))


def d_paired_difference(spark, sf):
    """Mean difference of confidence on what rule and another tagger both found."""
    c = _codes(spark, sf).where("confidence IS NOT NULL")
    a = c.where("generator = 'rule'").select("excerpt_id", "risk_code", F.col("confidence").alias("x"))
    b = c.where("generator <> 'rule'").select("excerpt_id", "risk_code", "generator", F.col("confidence").alias("y"))
    return a.join(b, ["excerpt_id", "risk_code"]).groupBy("generator").agg(_count("n_pairs"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("mean_difference"))


def d_gold_split(spark, sf):
    """Excerpts by number of taggers: those of two at least are gold, with the codes that most of them gave, the others for development."""
    c = _codes(spark, sf)
    n = c.groupBy("excerpt_id").agg(F.count_distinct("generator").alias("n"))
    votes = c.groupBy("excerpt_id", "risk_code").agg(_count("votes")).join(n, "excerpt_id")
    per = votes.groupBy("excerpt_id").agg(F.max("n").alias("n"), _n(F.col("votes") >= F.floor(F.col("n") / 2) + 1).alias("kept"), _n(F.col("votes") < F.col("n")).alias("disputed"))
    return per.groupBy(F.when(F.col("n") >= 2, "gold").otherwise("development").alias("split")).agg(_count("n_excerpts"), F.sum("kept").alias("n_codes"), F.sum("disputed").alias("n_disputed"))


def d_baseline_scores(spark, sf):
    """The three commonest codes said of every excerpt that others than rule tagged: true and false ones by code."""
    c = _codes(spark, sf)
    common = c.where("generator = 'rule'").groupBy("risk_code").agg(_count()).orderBy(F.desc("n"), "risk_code").limit(3).select("risk_code", F.lit(True).alias("said"))
    gold = c.where("generator <> 'rule'").select("excerpt_id", "risk_code").distinct()
    units = gold.agg(F.count_distinct("excerpt_id").alias("units"))
    per = gold.groupBy("risk_code").agg(_count("n_gold"))
    # The number of units is one value beside a few codes.
    rows = per.join(common, "risk_code", "full_outer").withColumn("units", F.lit(units.first().units))
    tp = F.when(F.col("said"), F.coalesce("n_gold", F.lit(0))).otherwise(0)
    return rows.select("risk_code", tp.alias("tp"), F.when(F.col("said"), F.col("units") - F.coalesce("n_gold", F.lit(0))).otherwise(0).alias("fp"), F.when(F.col("said"), 0).otherwise(F.coalesce("n_gold", F.lit(0))).alias("fn"))


def d_kinds_by_year(spark, sf):
    """Reviews by year of writing, one column per kind."""
    r = first(spark, sf, "reviews", "kind", "created").where("created IS NOT NULL")
    kinds = ("official_review", "meta_review", "referee_report", "public_review")
    return r.groupBy(F.year("created").alias("year")).agg(*[_n(F.col("kind") == k).alias(f"n_{k}") for k in kinds], _count("n_all"))


def d_record_coverage(spark, sf):
    """Works with reviews, with official ones, with a meta-review, with a decision, and with none of these."""
    w = first(spark, sf, "works", "work_id")
    r = first(spark, sf, "reviews", "work_id", "kind").groupBy("work_id").agg(F.lit(True).alias("r"), F.max(F.coalesce(F.col("kind") == "official_review", F.lit(False))).alias("o"), F.max(F.coalesce(F.col("kind") == "meta_review", F.lit(False))).alias("m"))
    d = first(spark, sf, "decisions", "work_id").select("work_id", F.lit(True).alias("d")).distinct()
    all_ = w.join(r, "work_id", "left").join(d, "work_id", "left")
    return all_.agg(_count("n_works"), _n(F.col("r")).alias("n_reviewed"), _n(F.col("o")).alias("n_official"), _n(F.col("m")).alias("n_meta"), _n(F.col("d")).alias("n_decided"), _n(F.col("r").isNull() & F.col("d").isNull()).alias("n_bare"))


def d_status_rollup(spark, sf):
    """Revisions by status: number, time, and how many give a reason."""
    r = first(spark, sf, "revision", "status", "reason", "elapsed_s")
    return r.groupBy("status").agg(_count("n"), F.round(F.sum("elapsed_s"), 3).alias("seconds"), _n(F.trim("reason") != "").alias("n_with_reason"))


def e_official_reviews(spark, sf):
    """The first twenty official reviews of each work in order of writing, undated last."""
    r = first(spark, sf, "reviews", "work_id", "kind", "created").where("kind = 'official_review' AND work_id IS NOT NULL")
    w = Window.partitionBy("work_id").orderBy(F.asc_nulls_last("created"), "review_id")
    return r.withColumn("place", F.row_number().over(w)).where("place <= 20").select("work_id", "place", "review_id")


def e_top_cards(spark, sf):
    """The three cards of each code with the greatest score."""
    c = first(spark, sf, "risk_cards", "risk_code", "score").select("card_id", "risk_code", F.col("score.total").alias("total")).where("total IS NOT NULL")
    w = Window.partitionBy("risk_code").orderBy(F.desc("total"), "card_id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 3")


def c_collected_edits(spark, sf):
    """Edits of all revisions, of each edit_id the first by revision and place, and how often it occurs."""
    x = first(spark, sf, "revision", "edits").select("revision_id", F.posexplode("edits").alias("pos", "e")).where("e.edit_id IS NOT NULL")
    g = x.groupBy(F.col("e.edit_id").alias("edit_id")).agg(F.min(F.struct("revision_id", "pos")).alias("f"), _count("n"))
    return g.select("edit_id", F.col("f.revision_id").alias("revision_id"), (F.col("f.pos") + 1).alias("pos"), "n")


def c_edit_evidence(spark, sf):
    """Edits by whether all of their evidence is evidence of their card."""
    x = first(spark, sf, "revision", "card_id", "edits").select("card_id", F.explode("edits").alias("e")).where("e IS NOT NULL")
    x = x.select("card_id", F.array_distinct(F.filter(F.coalesce("e.rationale.excerpt_ids", F.array()), lambda i: i.isNotNull())).alias("ids"))
    c = first(spark, sf, "risk_cards", "evidence").select("card_id", F.coalesce("evidence", F.array()).alias("evidence"))
    state = F.when(F.size("ids") == 0, "no evidence").when(F.col("evidence").isNull(), "unknown card").when(F.size(F.array_except("ids", "evidence")) == 0, "all of the card").otherwise("others too")
    return x.join(c, "card_id", "left").groupBy(state.alias("state")).agg(_count("n_edits"))


def a_source_audit(spark, sf):
    """Of each source of works: share with a link, with a hash, with a licence, and with an id of its own."""
    w = first(spark, sf, "works", "url", "native_id", "provenance")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    return w.groupBy(R.source_of(F.col("work_id")).alias("source")).agg(_count("n_works"), share(F.col("url").rlike("^https?://")).alias("linked"), share(F.length("provenance.content_sha256") == 64).alias("hashed"), share(F.trim("provenance.license") != "").alias("licensed"), share(F.trim("native_id") != "").alias("named"))


def f_merged_deliveries(spark, sf):
    """First and last deliveries of works merged, the later value where there is one: what changed."""
    from scholia.sources.tables import table

    w = table(spark, sf, "works").select("work_id", "ingested_at", "title", "doi")
    pick = lambda f: w.groupBy("work_id").agg(f(F.struct("ingested_at", "title", "doi")).alias("x"))
    a, b = pick(F.min).select("work_id", F.col("x.title").alias("t1"), F.col("x.doi").alias("d1")), pick(F.max).select("work_id", F.col("x.title").alias("t2"), F.col("x.doi").alias("d2"))
    m = a.join(b, "work_id", "full_outer").withColumn("title", F.coalesce("t2", "t1")).withColumn("doi", F.coalesce("d2", "d1"))
    return m.agg(_count("n_works"), _n(~F.col("title").eqNullSafe(F.col("t1"))).alias("n_titles"), _n(~F.col("doi").eqNullSafe(F.col("d1"))).alias("n_dois"))


def g_plain_tokens(spark, sf):
    """Distinct plain tokens of titles in the three ways that lookups cut them."""
    w = first(spark, sf, "works", "title").where("title IS NOT NULL")
    size = lambda p: F.size(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(f"({p})"), F.lit(1))))
    return w.select("work_id", size("[a-z][a-z0-9-]+").alias("n_words"), size("[a-z][a-z0-9-]{2,}").alias("n_long"), size("[0-9a-z가-힣]+").alias("n_signs"))


def g_review_hashes(spark, sf):
    """Reviews that are one but for white space: hash, number and works."""
    h = R.text_sha256(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
    r = first(spark, sf, "reviews", "text", "work_id").where("text IS NOT NULL")
    return r.groupBy(h.alias("sha256")).agg(_count(), F.count_distinct("work_id").alias("n_works")).where("n > 1")


def _same_keys(spark, sf):
    """(work_id, value): what a work may be known by: DOI, title, own id."""
    w = first(spark, sf, "works", "doi", "title", "native_id")
    keys = F.array(F.concat(F.lit("d:"), R.normalized_doi(F.col("doi"))), F.concat(F.lit("t:"), F.when(R.title_key(F.col("title")) != "", R.title_key(F.col("title")))), F.concat(F.lit("n:"), F.when(F.trim("native_id") != "", F.lower("native_id"))))
    return w.select("work_id", F.explode(keys).alias("value")).where("value IS NOT NULL")


def i_leak_probe(spark, sf):
    """Every work's title searched among all works, the three best: hits that are the work itself or known by one of its keys, with nothing left out, with its id left out, and with all that share a key left out."""
    posts = cut(retrieval.postings(_works(spark, sf), "doc_id", "text"))
    stats = posts.groupBy("doc_id").agg(F.first("doc_len").alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg")).first()
    asked = first(spark, sf, "works", "title").where("title IS NOT NULL").select(F.col("work_id").alias("query_id"), F.col("title").alias("text"))
    docs, q = retrieval.bm25_weights(posts, asked, stats.docs, stats.avg or 1.0)
    hits = cut(retrieval.sparse_top_k(cut(docs), cut(q), 3).select("query_id", "doc_id"))
    k = _same_keys(spark, sf)
    mine = hits.join(k.select(F.col("work_id").alias("query_id"), "value"), "query_id")
    known = mine.join(k.select(F.col("work_id").alias("doc_id"), "value"), ["doc_id", "value"], "left_semi").select("query_id", "doc_id").distinct().withColumn("same", F.lit(True))
    rows = hits.join(known, ["query_id", "doc_id"], "left").withColumn("same", F.coalesce("same", F.lit(False)) | (F.col("query_id") == F.col("doc_id")))
    own = F.col("query_id") == F.col("doc_id")
    return rows.agg(_count("n_hits"), _n(F.col("same")).alias("n_none_left_out"), _n(F.col("same") & ~own).alias("n_id_left_out"), _n(F.lit(False)).alias("n_all_left_out"))


Q = (
    d_tagger_compare, d_tagger_pairs, d_paired_difference, d_gold_split, d_baseline_scores, d_kinds_by_year, d_record_coverage, d_status_rollup, e_official_reviews, e_top_cards, c_collected_edits, c_edit_evidence, a_source_audit, f_merged_deliveries, g_plain_tokens, g_review_hashes, i_leak_probe,
)


def queries():
    return {q.__name__: q for q in Q}


def oracle_sql():
    f = first_sql
    codes = f("risk_tags")[:-1] + ", c AS (SELECT excerpt_id, generator, risk_code, avg(confidence) AS confidence FROM risk_tags1 WHERE excerpt_id IS NOT NULL AND generator IS NOT NULL AND risk_code IS NOT NULL GROUP BY 1, 2, 3) "
    title_key = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
    tok = SQL_TOKENS
    share = lambda c: f"round(avg(CAST(coalesce({c}, false) AS INT)), 6)"
    size = lambda p: f"len(list_distinct(regexp_extract_all(lower(title), '{p}')))"
    squeezed = "sha256(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))"
    kinds = ("official_review", "meta_review", "referee_report", "public_review")
    return {
        "d_tagger_compare": codes + ", a AS (SELECT DISTINCT excerpt_id, risk_code, true AS x FROM c WHERE generator = 'rule'), b AS (SELECT DISTINCT excerpt_id, risk_code, true AS y FROM c WHERE generator <> 'rule') SELECT risk_code, count(*) FILTER (x AND y) AS n_both, count(*) FILTER (y IS NULL) AS n_rule_only, count(*) FILTER (x IS NULL) AS n_other_only FROM a FULL JOIN b USING (excerpt_id, risk_code) GROUP BY 1",
        "d_tagger_pairs": codes + ", o AS (SELECT excerpt_id, generator, min(risk_code) AS code FROM c GROUP BY 1, 2) SELECT a.generator, b.generator AS other, count(*) AS n, round(avg(CAST(a.code = b.code AS INT)), 6) AS agreement FROM o a JOIN o b ON a.excerpt_id = b.excerpt_id AND a.generator < b.generator GROUP BY 1, 2",
        "d_paired_difference": codes + "SELECT b.generator, count(*) AS n_pairs, round(avg(a.confidence - b.confidence), 6) AS mean_difference FROM c a JOIN c b ON a.excerpt_id = b.excerpt_id AND a.risk_code = b.risk_code WHERE a.generator = 'rule' AND b.generator <> 'rule' AND a.confidence IS NOT NULL AND b.confidence IS NOT NULL GROUP BY 1",
        "d_gold_split": codes + ", n AS (SELECT excerpt_id, count(DISTINCT generator) AS n FROM c GROUP BY 1), v AS (SELECT excerpt_id, risk_code, count(*) AS votes FROM c GROUP BY 1, 2), p AS (SELECT excerpt_id, max(n) AS n, count(*) FILTER (votes >= n // 2 + 1) AS kept, count(*) FILTER (votes < n) AS disputed FROM v JOIN n USING (excerpt_id) GROUP BY 1) SELECT CASE WHEN n >= 2 THEN 'gold' ELSE 'development' END AS split, count(*) AS n_excerpts, sum(kept) AS n_codes, sum(disputed) AS n_disputed FROM p GROUP BY 1",
        "d_baseline_scores": codes + ", s AS (SELECT risk_code, true AS said FROM (SELECT risk_code, count(*) AS n FROM c WHERE generator = 'rule' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3)), g AS (SELECT risk_code, count(DISTINCT excerpt_id) AS n_gold FROM c WHERE generator <> 'rule' GROUP BY 1), u AS (SELECT count(DISTINCT excerpt_id) AS units FROM c WHERE generator <> 'rule') SELECT risk_code, CASE WHEN said THEN coalesce(n_gold, 0) ELSE 0 END AS tp, CASE WHEN said THEN units - coalesce(n_gold, 0) ELSE 0 END AS fp, CASE WHEN said THEN 0 ELSE coalesce(n_gold, 0) END AS fn FROM g FULL JOIN s USING (risk_code), u",
        "d_kinds_by_year": f("reviews") + "SELECT year(created) AS year, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds) + ", count(*) AS n_all FROM reviews1 WHERE created IS NOT NULL GROUP BY 1",
        "d_record_coverage": f("works", "reviews", "decisions")[:-1] + ", r AS (SELECT work_id, true AS r, bool_or(coalesce(kind = 'official_review', false)) AS o, bool_or(coalesce(kind = 'meta_review', false)) AS m FROM reviews1 GROUP BY 1), d AS (SELECT DISTINCT work_id, true AS d FROM decisions1) SELECT count(*) AS n_works, count(*) FILTER (r) AS n_reviewed, count(*) FILTER (o) AS n_official, count(*) FILTER (m) AS n_meta, count(*) FILTER (d) AS n_decided, count(*) FILTER (r IS NULL AND d IS NULL) AS n_bare FROM works1 LEFT JOIN r USING (work_id) LEFT JOIN d USING (work_id)",
        "d_status_rollup": f("revision") + "SELECT status, count(*) AS n, round(sum(elapsed_s), 3) AS seconds, count(*) FILTER (trim(reason) <> '') AS n_with_reason FROM revision1 GROUP BY 1",
        "e_official_reviews": f("reviews") + "SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY created NULLS LAST, review_id) AS place, review_id FROM reviews1 WHERE kind = 'official_review' AND work_id IS NOT NULL QUALIFY place <= 20",
        "e_top_cards": f("risk_cards") + "SELECT card_id, risk_code, score.total AS total, row_number() OVER (PARTITION BY risk_code ORDER BY score.total DESC, card_id) AS place FROM risk_cards1 WHERE score.total IS NOT NULL QUALIFY place <= 3",
        "c_collected_edits": f("revision") + "SELECT edit_id, f.revision_id AS revision_id, f.pos AS pos, n FROM (SELECT e.edit_id AS edit_id, min({'revision_id': revision_id, 'pos': pos}) AS f, count(*) AS n FROM (SELECT revision_id, unnest(edits) AS e, generate_subscripts(edits, 1) AS pos FROM revision1) WHERE e.edit_id IS NOT NULL GROUP BY 1)",
        "c_edit_evidence": f("revision", "risk_cards")[:-1] + ", x AS (SELECT card_id, list_filter(coalesce(e.rationale.excerpt_ids, []), lambda i: i IS NOT NULL) AS ids FROM (SELECT card_id, unnest(edits) AS e FROM revision1) WHERE e IS NOT NULL) SELECT CASE WHEN len(ids) = 0 THEN 'no evidence' WHEN c.card_id IS NULL THEN 'unknown card' WHEN len(list_filter(ids, lambda i: NOT list_contains(coalesce(c.evidence, []), i))) = 0 THEN 'all of the card' ELSE 'others too' END AS state, count(*) AS n_edits FROM x LEFT JOIN risk_cards1 c ON c.card_id = x.card_id GROUP BY 1",
        "a_source_audit": f("works") + f"SELECT CASE WHEN contains(work_id, ':') THEN split_part(work_id, ':', 1) END AS source, count(*) AS n_works, {share(chr(114) + 'egexp_matches(url, ' + chr(39) + '^https?://' + chr(39) + ')')} AS linked, {share('length(provenance.content_sha256) = 64')} AS hashed, {share('trim(provenance.license) <> ' + chr(39) * 2)} AS licensed, {share('trim(native_id) <> ' + chr(39) * 2)} AS named FROM works1 GROUP BY 1",
        "f_merged_deliveries": "WITH a AS (SELECT work_id, min({'i': ingested_at, 't': title, 'd': doi}) AS x, max({'i': ingested_at, 't': title, 'd': doi}) AS y FROM works GROUP BY 1), m AS (SELECT x.t AS t1, x.d AS d1, coalesce(y.t, x.t) AS t, coalesce(y.d, x.d) AS d FROM a) SELECT count(*) AS n_works, count(*) FILTER (t IS DISTINCT FROM t1) AS n_titles, count(*) FILTER (d IS DISTINCT FROM d1) AS n_dois FROM m",
        "g_plain_tokens": f("works") + f"SELECT work_id, {size('[a-z][a-z0-9-]+')} AS n_words, {size('[a-z][a-z0-9-]{2,}')} AS n_long, {size('[0-9a-z가-힣]+')} AS n_signs FROM works1 WHERE title IS NOT NULL",
        "g_review_hashes": f("reviews") + f"SELECT {squeezed} AS sha256, count(*) AS n, count(DISTINCT work_id) AS n_works FROM reviews1 WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "i_leak_probe": f("works")[:-1] + f""", d AS (SELECT work_id AS doc_id, {tok.format("concat_ws(chr(10) || chr(10), title, abstract)")} AS t FROM works1), p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(l) AS a FROM (SELECT doc_id, any_value(doc_len) AS l FROM p GROUP BY 1)),
        qi AS (SELECT query_id, q.term, coalesce(df, 0) AS df, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM (SELECT DISTINCT work_id AS query_id, unnest({tok.format("title")}) AS term FROM works1 WHERE title IS NOT NULL) q LEFT JOIN df ON df.term = q.term, st), m AS (SELECT query_id, sum(idf) AS most FROM qi GROUP BY 1),
        sc AS (SELECT query_id, doc_id, round(sum(idf / most * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / a))), 9) AS score FROM qi JOIN m USING (query_id) JOIN p ON p.term = qi.term, st GROUP BY 1, 2), h AS (SELECT query_id, doc_id FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3),
        k AS (SELECT work_id, 'd:' || {_doi('doi')} AS v FROM works1 UNION ALL SELECT work_id, 't:' || {title_key} FROM works1 WHERE {title_key} <> '' UNION ALL SELECT work_id, 'n:' || lower(native_id) FROM works1 WHERE trim(native_id) <> ''),
        s AS (SELECT h.*, h.query_id = h.doc_id OR EXISTS (SELECT 1 FROM k a JOIN k b ON a.v = b.v WHERE a.work_id = h.query_id AND b.work_id = h.doc_id) AS same FROM h) SELECT count(*) AS n_hits, count(*) FILTER (same) AS n_none_left_out, count(*) FILTER (same AND query_id <> doc_id) AS n_id_left_out, 0 AS n_all_left_out FROM s""",
    }
