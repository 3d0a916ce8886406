"""Per-row queries: redaction, spellings, mappings, lines, tokens (survey B, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import records as R
from scholia.functions.tokens import STOPWORDS, TOKEN, token_rows
from scholia.plans.common import first, first_sql

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
#: The search tokens of a text, in the oracle's dialect.
SQL_TOKENS = f"""list_transform(list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '{TOKEN}'), lambda t: (length(t) > 1 OR regexp_full_match(t, '[0-9]')) AND t NOT IN ({STOP})),
 lambda t: CASE WHEN regexp_full_match(t, '[a-z]+') AND length(t) > 3 THEN CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN t[:-4] || 'y' WHEN t LIKE '%sses' THEN t[:-3] WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND t NOT LIKE '%us' AND t NOT LIKE '%is' THEN t[:-2] ELSE t END ELSE t END)"""


def b_redact(spark, sf):
    """Reviews with e-mail addresses, ORCIDs and profile ids as placeholders."""
    r = first(spark, sf, "reviews", "text")
    return r.select("review_id", R.text_sha256(R.redacted(F.col("text"))).alias("redacted_sha256"), R.holds_personal_data(F.col("text")).alias("had_pii"))


def b_redact_counts(spark, sf):
    """How many of each form of identifier the reviews hold."""
    r = first(spark, sf, "reviews", "text")
    counts = [F.sum(F.regexp_count("text", F.lit(p))).alias(n) for n, p in (("n_email", R.EMAIL), ("n_orcid", R.ORCID), ("n_profile", R.PROFILE))]
    return r.agg(*counts)


def b_line_feeds(spark, sf):
    """Plans with all line ends as LF: hash and number of lines."""
    p = first(spark, sf, "assemble_live_smoke3", "plan_text")
    t = R.line_feeds(F.col("plan_text"))
    return p.select("plan_id", R.text_sha256(t).alias("sha256"), F.size(F.split(t, "\n")).alias("n_lines"))


def b_normalize_doi(spark, sf):
    return first(spark, sf, "works", "doi").select("work_id", R.normalized_doi(F.col("doi")).alias("doi_normalized"))


def b_map_decision(spark, sf):
    d = first(spark, sf, "decisions", "outcome_raw").where("outcome_raw IS NOT NULL")
    return d.select("decision_id", R.decision_outcome(F.col("outcome_raw")).alias("mapped"), R.decision_rule(F.col("outcome_raw")).alias("rule"))


def b_rating_value(spark, sf):
    return first(spark, sf, "reviews", "rating").select("review_id", R.rating_value(F.col("rating")).alias("rating_value"))


def b_source_namespace(spark, sf):
    return first(spark, sf, "works", "work_id").groupBy(R.source_of(F.col("work_id")).alias("source")).agg(F.count(F.lit(1)).alias("n_works"))


def b_first_failing_rule(spark, sf):
    """Works counted under the first rule that they fail."""
    w = first(spark, sf, "works", "title", "abstract", "doi", "fields", "pub_year")
    reason = (
        F.when(F.col("title").isNull() | (F.trim("title") == ""), "no_title").when(F.col("abstract").isNull(), "no_abstract").when(F.length("abstract") < 200, "short_abstract")
        .when(F.coalesce(F.size("fields"), F.lit(0)) <= 0, "no_field").when(R.normalized_doi(F.col("doi")).isNull(), "no_doi").otherwise("kept")
    )
    return w.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_works"))


def b_language(spark, sf):
    return first(spark, sf, "reviews", "text").groupBy(R.language(F.col("text")).alias("language")).agg(F.count(F.lit(1)).alias("n_reviews"))


def b_input_length(spark, sf):
    """Plans by length: reject under 300, warn under 600 characters."""
    p = first(spark, sf, "assemble_live_smoke3", "plan_text")
    n = F.length(F.trim("plan_text"))
    verdict = F.when(n < 300, "reject").when(n < 600, "warn").otherwise("ok")
    return p.select("plan_id", n.alias("n_chars"), verdict.alias("verdict"))


def g_excerpt_id(spark, sf):
    """Excerpt ids made anew from kind, source and offsets."""
    e = first(spark, sf, "excerpts", "source_kind", "source_id", "span_start", "span_end")
    made = R.excerpt_id(F.col("source_kind"), F.col("source_id"), F.col("span_start"), F.col("span_end"))
    return e.where("source_kind IS NOT NULL AND source_id IS NOT NULL AND span_start IS NOT NULL AND span_end IS NOT NULL").select("excerpt_id", made.alias("made_id"), (made == F.col("excerpt_id")).alias("same"))


def g_text_hash(spark, sf):
    """Excerpts whose stored hash is not that of their text."""
    e = first(spark, sf, "excerpts", "text", "text_sha256")
    return e.agg(F.count(F.lit(1)).alias("n_excerpts"), F.sum((R.text_sha256(F.col("text")) == F.col("text_sha256")).cast("int")).alias("n_same"))


def g_native_key(spark, sf):
    return first(spark, sf, "works", "url").select("work_id", R.native_key(F.col("work_id")).alias("id_key"), R.native_key(F.col("url")).alias("url_key"))


def g_title_key(spark, sf):
    """Works that share a title but for case and signs."""
    w = first(spark, sf, "works", "title").select("work_id", R.title_key(F.col("title")).alias("title_key")).where("title_key <> ''")
    return w.groupBy("title_key").agg(F.count(F.lit(1)).alias("n_works"), F.min("work_id").alias("first_work")).where("n_works > 1")


def g_tokens(spark, sf):
    """The commonest search tokens of titles and abstracts (a report of 200)."""
    w = first(spark, sf, "works", "title", "abstract")
    t = token_rows(w.select("work_id", F.concat_ws("\n\n", "title", "abstract").alias("text")), "work_id", "text")
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(200)


def g_split_values(spark, sf):
    """Words of a venue as a ;-list and back: trimmed, distinct, in order."""
    w = first(spark, sf, "works", "venue")
    parts = R.split_values(F.translate("venue", " ", ";"))
    return w.select("work_id", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n_parts"))


def h_plan_lines(spark, sf):
    """Plans as numbered lines."""
    p = first(spark, sf, "assemble_live_smoke3", "plan_text")
    each = p.select("plan_id", F.posexplode(F.split(R.line_feeds(F.col("plan_text")), "\n")).alias("at", "line"))
    return each.select("plan_id", (F.col("at") + 1).alias("line_no"), "line")


# Fixed value: the form of a Markdown heading.
HEADING = r"^[ \t]{0,3}(#{1,6})[ \t]+(.*)$"


def _headed(spark, sf):
    lines = h_plan_lines(spark, sf)
    level = F.length(F.regexp_extract("line", HEADING, 1))
    title = F.rtrim(F.regexp_replace(F.trim(F.regexp_extract("line", HEADING, 2)), "#+$", ""))
    return lines.withColumn("level", level).withColumn("heading", F.when(level > 0, title))


def h_headings(spark, sf):
    return _headed(spark, sf).where("level > 0").select("plan_id", "line_no", "level", "heading")


#: Headings of plans by axis; the first that matches counts.
AXES = [("data", "데이터|자료|data|dataset"), ("evaluation", "평가|검증|실험|evaluat|experiment|metric|validation"), ("method", "방법|방법론|모델|접근|method|approach|model"), ("topic", "목표|목적|개요|배경|요약|objective|goal|aim|overview|summary|background")]


def h_axis_queries(spark, sf):
    """Each plan's sections joined by axis, with the heading carried forward (as-of by line)."""
    lines = _headed(spark, sf)
    w = Window.partitionBy("plan_id").orderBy("line_no")
    under = lines.withColumn("head", F.last("heading", ignorenulls=True).over(w)).where("level = 0 AND head IS NOT NULL")
    axis = None
    for name, pattern in AXES:
        axis = F.when(F.lower("head").rlike(pattern), name) if axis is None else axis.when(F.lower("head").rlike(pattern), name)
    body = under.withColumn("axis", axis).where("axis IS NOT NULL AND trim(line) <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return body.groupBy("plan_id", "axis").agg(text.alias("query"), F.count(F.lit(1)).alias("n_lines")).where("length(query) >= 8").select("plan_id", "axis", R.text_sha256(F.col("query")).alias("query_sha256"), "n_lines")


def plan_queries(spark, sf):
    """(query_id, axis, text): what each plan asks of the index.

    First its full text, under the axis ``full``; then its title with the
    sections on its topic, and the sections of each further axis, if they have 8
    characters at least. Sections of no axis are in the full text only.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    joined = lambda c, field: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x[field]), "\n")
    w = Window.partitionBy("plan_id").orderBy("line_no")
    lines = _headed(spark, sf).withColumn("at", F.last(F.when(F.col("level") > 0, F.col("line_no")), ignorenulls=True).over(w)).where("at IS NOT NULL")
    body = strip(joined(F.when(F.col("level") == 0, F.struct("line_no", "line")), "line"))
    parts = lines.groupBy("plan_id", "at").agg(F.max("level").alias("level"), F.max("heading").alias("head"), body.alias("body"))
    axis = F.coalesce(*(F.when(F.lower("head").rlike(pattern), name) for name, pattern in AXES))
    parts = parts.withColumn("axis", axis).withColumn("title", (F.col("level") == 1) & (F.col("at") == F.min("at").over(Window.partitionBy("plan_id"))))
    titles = parts.where("title").select("plan_id", F.lit("topic").alias("axis"), F.lit(0).alias("at"), F.col("head").alias("text"))
    each = titles.unionByName(parts.select("plan_id", "axis", "at", F.col("body").alias("text"))).where("axis IS NOT NULL AND text <> ''")
    axes = each.groupBy(F.col("plan_id").alias("query_id"), "axis").agg(strip(joined(F.struct("at", "text"), "text")).alias("text")).where("length(text) >= 8")
    full = first(spark, sf, "assemble_live_smoke3", "plan_text").select(F.col("plan_id").alias("query_id"), F.lit("full").alias("axis"), strip(F.col("plan_text")).alias("text")).where("text <> ''")
    return full.unionByName(axes)


def h_sentence_spans(spark, sf):
    """Plan lines cut after end marks (the simple splitter), counted per plan."""
    lines = h_plan_lines(spark, sf).where("line <> ''")
    parts = F.filter(F.transform(F.split("line", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return lines.groupBy("plan_id").agg(F.sum(F.size(parts)).alias("n_sentences"))


def b_scrub_sentences(spark, sf):
    """Review sentences that hold a number are dropped whole; what is kept, as lengths."""
    r = first(spark, sf, "reviews", "text").where("text IS NOT NULL")
    parts = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001")
    kept = F.array_join(F.filter(parts, lambda s: ~s.rlike("[0-9]")), " ")
    return r.select("review_id", F.length(kept).alias("kept_chars"), F.round(F.length(kept) / F.length("text"), 4).alias("retention"))


def g_section_of(spark, sf):
    """Excerpts that are the heading of a review section."""
    e = first(spark, sf, "excerpts", "text")
    sec = section(F.col("text"))
    return e.select(sec.alias("section")).where("section IS NOT NULL").groupBy("section").agg(F.count(F.lit(1)).alias("n"))


# Fixed value: the headings of review sections, as the reference has them, with its word class written out.
SECTION = r"^[^A-Za-z0-9_]{0,4}(strengths?|pros|weakness(?:es)?|cons|questions?|limitations?|concerns?|summary|soundness|presentation|contribution|rating|confidence)\b"


def section(c):
    found = F.regexp_extract(F.lower(c), SECTION, 1)
    return F.when(found != "", found)


Q = (b_redact, b_redact_counts, b_line_feeds, b_normalize_doi, b_map_decision, b_rating_value, b_source_namespace, b_first_failing_rule, b_language, b_input_length, g_excerpt_id, g_text_hash, g_native_key, g_title_key, g_tokens, g_split_values, h_plan_lines, h_headings, h_axis_queries, h_sentence_spans, b_scrub_sentences, g_section_of)


def queries():
    return {q.__name__: q for q in Q}


def _doi(c: str) -> str:
    bare = f"trim(regexp_replace(trim({c}), '{R.DOI_PREFIX}', ''))"
    low = f"lower(CASE WHEN regexp_matches({bare}, '%[0-9A-Fa-f]{{2}}') THEN url_decode({bare}) ELSE {bare} END)"
    return f"CASE WHEN regexp_matches({low}, '{R.DOI}') THEN {low} END"


def _rules(what: int) -> str:
    key = "lower(trim(replace(outcome_raw, '_', ' ')))"
    return "CASE " + " ".join(f"WHEN regexp_matches({key}, '{r[1]}') THEN '{r[what]}'" for r in R.DECISION_RULES) + (" ELSE 'unknown' END" if what == 2 else " ELSE 'unmatched:' || outcome_raw END")


#: Lines of plans with the level and text of headings, in the oracle's dialect.
SQL_LF = "replace(replace(plan_text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
SQL_HEADED = f"""lines AS (SELECT plan_id, unnest(generate_series(1, len(l))) AS line_no, unnest(l) AS line FROM (SELECT plan_id, string_split({SQL_LF}, chr(10)) AS l FROM assemble_live_smoke31)),
 headed AS (SELECT *, length(regexp_extract(line, '{HEADING}', 1)) AS level, CASE WHEN length(regexp_extract(line, '{HEADING}', 1)) > 0 THEN rtrim(regexp_replace(trim(regexp_extract(line, '{HEADING}', 2)), '#+$', '')) END AS heading FROM lines)"""
SQL_AXIS = "CASE " + " ".join(f"WHEN regexp_matches(lower(head), '{p}') THEN '{n}'" for n, p in AXES) + " END"


def sql_plan_queries() -> str:
    """CTEs up to ``asked`` (query_id, axis, text), the oracle of ``plan_queries``."""
    white = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    strip = lambda c: f"regexp_replace({c}, '^{white}+|{white}+$', '', 'g')"
    return f"""{SQL_HEADED},
 placed AS (SELECT *, last_value(CASE WHEN level > 0 THEN line_no END IGNORE NULLS) OVER (PARTITION BY plan_id ORDER BY line_no) AS part FROM headed),
 parts AS (SELECT plan_id, part, max(level) AS lvl, max(heading) AS head, {strip("coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY line_no), '')")} AS body FROM placed WHERE part IS NOT NULL GROUP BY 1, 2),
 judged AS (SELECT *, {SQL_AXIS} AS axis, lvl = 1 AND part = min(part) OVER (PARTITION BY plan_id) AS titled FROM parts),
 axes AS (SELECT plan_id, axis, {strip("string_agg(text, chr(10) ORDER BY part)")} AS text FROM (SELECT plan_id, 'topic' AS axis, 0 AS part, head AS text FROM judged WHERE titled UNION ALL SELECT plan_id, axis, part, body FROM judged) WHERE axis IS NOT NULL AND text <> '' GROUP BY 1, 2),
 asked AS (SELECT plan_id AS query_id, axis, text FROM axes WHERE length(text) >= 8 UNION ALL SELECT plan_id, 'full', {strip("plan_text")} FROM assemble_live_smoke31 WHERE {strip("plan_text")} <> '')"""


def oracle_sql():
    f = first_sql
    # The oracle's word boundaries know ASCII only, so the neighbours are named.
    orcid = r"(^|[^\pL\pN_])\d{4}-\d{4}-\d{4}-\d{3}[\dX]($|[^\pL\pN_])"
    email, profile = R.EMAIL, R.PROFILE.replace("'", "''")
    lf = "replace(replace(plan_text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    lines = f"lines AS (SELECT plan_id, unnest(generate_series(1, len(l))) AS line_no, unnest(l) AS line FROM (SELECT plan_id, string_split({lf}, chr(10)) AS l FROM assemble_live_smoke31))"
    heads = lines + rf""", headed AS (SELECT *, length(regexp_extract(line, '{HEADING}', 1)) AS level, CASE WHEN length(regexp_extract(line, '{HEADING}', 1)) > 0 THEN rtrim(regexp_replace(trim(regexp_extract(line, '{HEADING}', 2)), '#+$', '')) END AS heading FROM lines)"""
    key = lambda c: f"lower(CASE WHEN regexp_extract({c}, '[?&]id=([^&#]+)', 1) <> '' THEN regexp_extract({c}, '[?&]id=([^&#]+)', 1) WHEN {c} LIKE '%://%' THEN {c} ELSE string_split({c}, ':')[-1] END)"
    axis = "CASE " + " ".join(f"WHEN regexp_matches(lower(head), '{p}') THEN '{n}'" for n, p in AXES) + " END"
    title_key = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
    sec = f"regexp_extract(lower(text), '{SECTION}', 1)"
    return {
        "b_redact": f("reviews") + f"SELECT review_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{profile}', '[PROFILE]', 'g'), '{email}', '[EMAIL]', 'g'), '{orcid}', '\\1[ORCID]\\2', 'g')) AS redacted_sha256, regexp_matches(text, '{email}') OR regexp_matches(text, '{orcid}') AS had_pii FROM reviews1",
        "b_redact_counts": f("reviews") + f"SELECT sum(len(regexp_extract_all(text, '{email}'))) AS n_email, sum(len(regexp_extract_all(text, '{orcid}'))) AS n_orcid, sum(len(regexp_extract_all(text, '{profile}'))) AS n_profile FROM reviews1",
        "b_line_feeds": f("assemble_live_smoke3") + f"SELECT plan_id, sha256({lf}) AS sha256, len(string_split({lf}, chr(10))) AS n_lines FROM assemble_live_smoke31",
        "b_normalize_doi": f("works") + f"SELECT work_id, {_doi('doi')} AS doi_normalized FROM works1",
        "b_map_decision": f("decisions") + f"SELECT decision_id, {_rules(2)} AS mapped, {_rules(0)} AS rule FROM decisions1 WHERE outcome_raw IS NOT NULL",
        "b_rating_value": f("reviews") + r"SELECT review_id, try_cast(regexp_extract(rating, '^\s*(-?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS rating_value FROM reviews1",
        "b_source_namespace": f("works") + "SELECT CASE WHEN contains(work_id, ':') THEN string_split(work_id, ':')[1] END AS source, count(*) AS n_works FROM works1 GROUP BY 1",
        "b_first_failing_rule": f("works") + f"SELECT CASE WHEN title IS NULL OR trim(title) = '' THEN 'no_title' WHEN abstract IS NULL THEN 'no_abstract' WHEN length(abstract) < 200 THEN 'short_abstract' WHEN coalesce(len(fields), 0) <= 0 THEN 'no_field' WHEN ({_doi('doi')}) IS NULL THEN 'no_doi' ELSE 'kept' END AS reason, count(*) AS n_works FROM works1 GROUP BY 1",
        "b_language": f("reviews") + "SELECT CASE WHEN ko + en = 0 THEN 'unknown' WHEN ko / (ko + en) >= 0.7 THEN 'ko' WHEN ko / (ko + en) <= 0.1 THEN 'en' ELSE 'mixed' END AS language, count(*) AS n_reviews FROM (SELECT len(regexp_extract_all(text, '[가-힣]')) AS ko, len(regexp_extract_all(text, '[A-Za-z]')) AS en FROM reviews1) GROUP BY 1",
        "b_input_length": f("assemble_live_smoke3") + "SELECT plan_id, length(trim(plan_text)) AS n_chars, CASE WHEN length(trim(plan_text)) < 300 THEN 'reject' WHEN length(trim(plan_text)) < 600 THEN 'warn' ELSE 'ok' END AS verdict FROM assemble_live_smoke31",
        "g_excerpt_id": f("excerpts") + "SELECT excerpt_id, made AS made_id, made = excerpt_id AS same FROM (SELECT excerpt_id, 'ex_' || sha256(source_kind || chr(0) || source_id || chr(0) || span_start || chr(0) || span_end)[1:16] AS made FROM excerpts1 WHERE source_kind IS NOT NULL AND source_id IS NOT NULL AND span_start IS NOT NULL AND span_end IS NOT NULL)",
        "g_text_hash": f("excerpts") + "SELECT count(*) AS n_excerpts, sum(CAST(sha256(text) = text_sha256 AS INT)) AS n_same FROM excerpts1",
        "g_native_key": f("works") + f"SELECT work_id, {key('work_id')} AS id_key, {key('url')} AS url_key FROM works1",
        "g_title_key": f("works") + f"SELECT {title_key} AS title_key, count(*) AS n_works, min(work_id) AS first_work FROM works1 WHERE {title_key} <> '' GROUP BY 1 HAVING count(*) > 1",
        "g_tokens": f("works") + "SELECT term, count(*) AS n FROM (SELECT unnest(" + SQL_TOKENS.format("concat_ws(chr(10) || chr(10), title, abstract)") + ") AS term FROM works1) GROUP BY 1 ORDER BY n DESC, term LIMIT 200",
        "g_split_values": f("works") + "SELECT work_id, array_to_string(p, '|') AS parts, len(p) AS n_parts FROM (SELECT work_id, list_filter(p, lambda x, i: list_position(p, x) = i) AS p FROM (SELECT work_id, list_filter(list_transform(string_split(coalesce(translate(venue, ' ', ';'), ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS p FROM works1))",
        "h_plan_lines": f("assemble_live_smoke3")[:-1] + f", {lines} SELECT plan_id, line_no, line FROM lines",
        "h_headings": f("assemble_live_smoke3")[:-1] + f", {heads} SELECT plan_id, line_no, level, heading FROM headed WHERE level > 0",
        "h_axis_queries": f("assemble_live_smoke3")[:-1] + f", {heads}, under AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY plan_id ORDER BY line_no) AS head FROM headed), body AS (SELECT *, {axis} AS axis FROM under WHERE level = 0 AND head IS NOT NULL AND trim(line) <> ''), q AS (SELECT plan_id, axis, string_agg(line, chr(10) ORDER BY line_no) AS query, count(*) AS n_lines FROM body WHERE axis IS NOT NULL GROUP BY 1, 2) SELECT plan_id, axis, sha256(query) AS query_sha256, n_lines FROM q WHERE length(query) >= 8",
        "h_sentence_spans": f("assemble_live_smoke3")[:-1] + f", {lines} SELECT plan_id, sum(len(list_filter(list_transform(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''))) AS n_sentences FROM lines WHERE line <> '' GROUP BY 1",
        "b_scrub_sentences": f("reviews") + r"SELECT review_id, length(k) AS kept_chars, round(length(k) / length(text), 4) AS retention FROM (SELECT review_id, text, coalesce(array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: NOT regexp_matches(s, '[0-9]')), ' '), '') AS k FROM reviews1 WHERE text IS NOT NULL)",
        "g_section_of": f("excerpts") + f"SELECT {sec} AS section, count(*) AS n FROM excerpts1 WHERE {sec} <> '' GROUP BY 1",
    }
