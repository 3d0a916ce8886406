"""Queries on cards, gates, votes, labels, plans and exports (survey A, B, C, D, E, F, G, H, SO)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import records as R
from scholia.plans.common import first, first_sql
from scholia.plans.more_q import GROUPED, WRITTEN, _plain
from scholia.plans.records_q import _headed, SQL_AXIS, SQL_HEADED, AXES, _doi, _rules
from scholia.sources.tables import table

# Severity of a risk code, as a share.
SEVERITY = {"R0": 0.2, "R1": 0.8, "R2": 0.8, "R3": 1.0, "R4": 0.6, "R5": 0.6, "R6": 0.8, "R7": 0.8, "R8": 0.8, "R9": 1.0}
CODES = sorted(SEVERITY)
#: Codes that never become cards.
SHOWN_ONLY = ("R0", "R9")
#: What an aggregation of tags may be set to: polarities, least confidence, least number of tags.
GRID = [(i, pol, conf, n) for i, (pol, conf, n) in enumerate((p, c, n) for p in ("negative", "negative+neutral") for c in (0.0, 0.3, 0.4, 0.5, 0.6, 0.7) for n in (1, 2))]
MAIL = R.EMAIL


def _edged(pattern):
    """A pattern whose word edges are those of ASCII words, as in the oracle: an ending in another script does not hide one."""
    return pattern.replace(r"\b", r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))")


def _severity(code):
    return F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[code]


def _count(name="n"):
    return F.count(F.lit(1)).alias(name)


def _issues(spark, sf):
    """Tags with the work that their excerpt speaks of."""
    t = first(spark, sf, "risk_tags", "excerpt_id", "risk_code", "polarity", "confidence", "generator").where("excerpt_id IS NOT NULL AND risk_code IS NOT NULL")
    e = first(spark, sf, "excerpts", "source_kind", "source_id")
    r = first(spark, sf, "reviews", "work_id").select(F.lit("review").alias("source_kind"), F.col("review_id").alias("source_id"), "work_id")
    d = first(spark, sf, "decisions", "work_id").select(F.lit("decision").alias("source_kind"), F.col("decision_id").alias("source_id"), "work_id")
    return t.join(e, "excerpt_id").join(r.unionByName(d).where("work_id IS NOT NULL"), ["source_kind", "source_id"])


def _by_field(spark, sf):
    w = first(spark, sf, "works", "fields").select("work_id", F.explode(F.array_distinct("fields")).alias("field")).where("field IS NOT NULL")
    return _issues(spark, sf).join(w, "work_id")


def e_final_cards(spark, sf):
    """Cards of each field: codes with evidence of three excerpts of two works at least, scored by frequency, severity and confidence; the eight best."""
    i = _by_field(spark, sf).where("polarity = 'negative'")
    whole = i.groupBy("field").agg(F.count_distinct("work_id").alias("n_field"))
    per = i.where(~F.col("risk_code").isin(*SHOWN_ONLY)).groupBy("field", "risk_code").agg(F.count_distinct("excerpt_id").alias("n_evidence"), F.count_distinct("work_id").alias("n_works"), F.avg("confidence").alias("confidence"))
    per = per.where("n_evidence >= 3 AND n_works >= 2").join(whole, "field")
    total = F.round(F.least(F.lit(1.0), F.col("n_works") / F.col("n_field")) * _severity(F.col("risk_code")) * F.coalesce("confidence", F.lit(0.0)), 4)
    w = Window.partitionBy("field").orderBy(F.desc("total"), "risk_code")
    return per.withColumn("total", total).withColumn("place", F.row_number().over(w)).where("place <= 8").select("field", "place", "risk_code", "n_evidence", "n_works", "total")


def e_field_codes(spark, sf):
    """The three codes of each field that most works have, ties by issues and code."""
    per = _by_field(spark, sf).where(~F.col("risk_code").isin(*SHOWN_ONLY)).groupBy("field", "risk_code").agg(F.count_distinct("work_id").alias("n_works"), _count("n_issues"))
    w = Window.partitionBy("field").orderBy(F.desc("n_works"), F.desc("n_issues"), "risk_code")
    return per.where("n_works >= 2").withColumn("place", F.row_number().over(w)).where("place <= 3")


def e_top_codes(spark, sf):
    """The three codes that most sources have."""
    per = _issues(spark, sf).groupBy("risk_code").agg(F.count_distinct("source_id").alias("n_sources"))
    return per.orderBy(F.desc("n_sources"), "risk_code").limit(3)


def c_usable_cards(spark, sf):
    """Cards by whether their evidence that exists is enough: three excerpts of two works."""
    ids = first(spark, sf, "risk_cards", "evidence", "risk_code").select("card_id", "risk_code", F.explode_outer(F.array_distinct("evidence")).alias("excerpt_id"))
    e = first(spark, sf, "excerpts", "source_kind", "source_id")
    r = first(spark, sf, "reviews", "work_id").select(F.lit("review").alias("source_kind"), F.col("review_id").alias("source_id"), "work_id")
    d = first(spark, sf, "decisions", "work_id").select(F.lit("decision").alias("source_kind"), F.col("decision_id").alias("source_id"), "work_id")
    known = ids.join(e, "excerpt_id", "left").join(r.unionByName(d), ["source_kind", "source_id"], "left")
    per = known.groupBy("card_id", "risk_code").agg(F.count_distinct(F.when(F.col("source_id").isNotNull(), F.col("excerpt_id"))).alias("n"), F.count_distinct("work_id").alias("w"))
    state = F.when(F.col("risk_code").isin(*SHOWN_ONLY), "shown only").when(F.col("n") < 3, "few excerpts").when(F.col("w") < 2, "one work").otherwise("kept")
    return per.groupBy(state.alias("state")).agg(_count("n_cards"))


def _gated(spark, sf):
    """Edits with the first rule that they fail."""
    x = first(spark, sf, "revision", "edits").select("revision_id", F.posexplode("edits").alias("pos", "e")).where("e IS NOT NULL")
    x = x.select("revision_id", "pos", F.col("e.proposed_text").alias("text"), F.col("e.plan_line").alias("line"), F.array_distinct(F.coalesce(F.filter("e.rationale.excerpt_ids", lambda i: i.isNotNull()), F.array())).alias("ids"))
    e = first(spark, sf, "excerpts", "text").select("excerpt_id", F.col("text").alias("said"))
    each = x.select("revision_id", "pos", "text", F.explode("ids").alias("excerpt_id")).join(e, "excerpt_id", "left")
    unknown = each.groupBy("revision_id", "pos").agg(F.max(F.col("said").isNull().cast("int")).alias("unknown"))
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"({GROUPED})"), F.lit(1)), _plain)
    wanted = x.select("revision_id", "pos", F.explode(F.array_distinct(numbers("text"))).alias("number"))
    held = each.where("said IS NOT NULL").select("revision_id", "pos", F.explode(numbers("said")).alias("number")).distinct()
    made_up = wanted.join(held, ["revision_id", "pos", "number"], "left_anti").select("revision_id", "pos").distinct().withColumn("made_up", F.lit(1))
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    again = F.row_number().over(Window.partitionBy("revision_id", key).orderBy("pos")) > 1
    rows = x.withColumn("again", again).join(unknown, ["revision_id", "pos"], "left").join(made_up, ["revision_id", "pos"], "left")
    reason = (
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(F.length("text") > 600, "too long").when(F.col("text").rlike(MAIL), "personal data")
        .when(F.size("ids") == 0, "no evidence").when(F.col("unknown") == 1, "unknown evidence").when(F.coalesce("line", F.lit(0)) < 1, "no line")
        .when(F.col("made_up").isNotNull(), "number without source").when(F.col("again"), "said before").otherwise("pass")
    )
    return rows.select("revision_id", (F.col("pos") + 1).alias("pos"), reason.alias("reason"))


def b_gate_edits(spark, sf):
    """Proposed edits by the first rule of the gate that they fail."""
    return _gated(spark, sf)


def d_gate_reasons(spark, sf):
    """How many edits each rule drops, the share that passes, and the drops for want of evidence."""
    g = _gated(spark, sf)
    return g.groupBy("reason").agg(_count("n"), F.max(F.col("reason").isin("no evidence", "unknown evidence")).alias("for_evidence"))


def d_grid(spark, sf):
    """Every setting of the aggregation of rule tags scored against the other taggers: macro F1 over the codes that these give."""
    t = _issues(spark, sf)
    gold = t.where("generator <> 'rule' AND polarity = 'negative'").select("source_id", "risk_code").distinct().withColumn("gold", F.lit(1))
    units = gold.select("source_id").distinct()
    configs = F.explode(F.array(*[F.struct(F.lit(i).alias("grid_no"), F.lit(pol).alias("pol"), F.lit(c).alias("least"), F.lit(n).alias("most")) for i, pol, c, n in GRID]))
    rule = t.where("generator = 'rule'").join(units, "source_id", "left_semi").select("source_id", "risk_code", "polarity", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), configs.alias("g"))
    ok = (F.col("confidence") >= F.col("g.least")) & ((F.col("polarity") == "negative") | ((F.col("g.pol") == "negative+neutral") & (F.col("polarity") == "neutral")))
    said = rule.where(ok).groupBy(F.col("g.grid_no").alias("grid_no"), "source_id", "risk_code").agg(_count("k"), F.max("g.most").alias("most")).where("k >= most").select("grid_no", "source_id", "risk_code", F.lit(1).alias("said"))
    truth = gold.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("grid_no"))
    both = truth.join(said, ["grid_no", "source_id", "risk_code"], "full_outer")
    n = lambda c: F.sum(c.cast("int"))
    g, s = F.col("gold").isNotNull(), F.col("said").isNotNull()
    per = both.groupBy("grid_no", "risk_code").agg(n(g & s).alias("tp"), n(~g & s).alias("fp"), n(g & ~s).alias("fn")).where("tp + fn > 0")
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    out = per.groupBy("grid_no").agg(F.round(F.avg(f1), 6).alias("macro_f1"), _count("n_codes"))
    best = F.row_number().over(Window.partitionBy().orderBy(F.desc("macro_f1"), "grid_no")) == 1  # over 24 rows
    return out.withColumn("best", best)


def d_vote_patterns(spark, sf):
    """Excerpts with tags of several taggers, by whether these agree."""
    t = first(spark, sf, "risk_tags", "excerpt_id", "risk_code", "generator").where("excerpt_id IS NOT NULL AND generator IS NOT NULL")
    one = t.groupBy("excerpt_id", "generator").agg(F.min("risk_code").alias("code"))
    per = one.groupBy("excerpt_id").agg(_count("n"), F.count_distinct("code").alias("k")).where("n > 1")
    return per.groupBy(F.when(F.col("k") == 1, "agree").when(F.col("k") == F.col("n"), "all differ").otherwise("split").alias("pattern")).agg(_count("n_excerpts"))


def d_label_support(spark, sf):
    """Tags of each code by rule, codes without any included."""
    t = first(spark, sf, "risk_tags", "risk_code", "generator").where("generator = 'rule'").select(F.col("risk_code").alias("code"), F.lit(1).alias("n"))
    every = first(spark, sf, "risk_tags", "tag_id").limit(0).select(F.lit("").alias("code"), F.lit(0).alias("n")).unionByName(spark.range(1).select(F.explode(F.array(*map(F.lit, CODES))).alias("code"), F.lit(0).alias("n")))
    return t.unionByName(every).where("code IS NOT NULL").groupBy(F.col("code").alias("risk_code")).agg(F.sum("n").alias("n"))


def d_polarity_table(spark, sf):
    """Tags by tagger and polarity, as a table."""
    t = first(spark, sf, "risk_tags", "polarity", "generator")
    return t.groupBy("generator").agg(*[F.sum((F.col("polarity") == p).cast("int")).alias(f"n_{p}") for p in ("negative", "neutral", "positive")])


def d_single_tagger(spark, sf):
    """Excerpts tagged by one tagger or by several."""
    t = first(spark, sf, "risk_tags", "excerpt_id", "generator").where("excerpt_id IS NOT NULL")
    return t.groupBy("excerpt_id").agg(F.count_distinct("generator").alias("k")).groupBy(F.when(F.col("k") > 1, "several").otherwise("one").alias("taggers")).agg(_count("n_excerpts"))


def d_plan_summary(spark, sf):
    """Plans: number, mean and total length, and how many are short."""
    n = F.length("plan_text")
    return first(spark, sf, "assemble_live_smoke3", "plan_text").agg(_count("n_plans"), F.round(F.avg(n), 4).alias("mean_chars"), F.sum(n).alias("n_chars"), F.sum((n < 400).cast("int")).alias("n_short"))


def d_source_counts(spark, sf):
    """Reviews and works of each source."""
    r = first(spark, sf, "reviews", "work_id").where("work_id IS NOT NULL")
    return r.groupBy(R.source_of(F.col("work_id")).alias("source")).agg(_count("n_reviews"), F.count_distinct("work_id").alias("n_works"))


def d_card_outcomes(spark, sf):
    """Of the works behind the cards of each code: how many, how many rejected, and of how many the decision is not known."""
    c = first(spark, sf, "risk_cards", "works", "risk_code").select("risk_code", F.explode("works").alias("work_id")).where("work_id IS NOT NULL").distinct()
    d = first(spark, sf, "decisions", "work_id", "outcome_raw").where("work_id IS NOT NULL").withColumn("o", R.decision_outcome(F.col("outcome_raw"))).where("o <> 'unknown'")
    per = d.groupBy("work_id").agg(F.max(F.col("o").isin("reject", "desk_reject").cast("int")).alias("bad"))
    return c.join(per, "work_id", "left").groupBy("risk_code").agg(_count("n_works"), F.sum(F.coalesce("bad", F.lit(0))).alias("n_rejected"), F.sum(F.col("bad").isNull().cast("int")).alias("n_unknown"))


def d_completeness(spark, sf):
    """Works by how complete they are: weighted share of the fields that are there, and whether all are."""
    w = first(spark, sf, "works", "title", "abstract", "doi", "venue", "pub_year", "fields")
    checks = [(3, F.coalesce(F.trim("title") != "", F.lit(False))), (3, F.coalesce(F.length("abstract") >= 200, F.lit(False))), (2, R.normalized_doi(F.col("doi")).isNotNull()), (1, F.col("venue").isNotNull()), (1, F.col("pub_year").isNotNull()), (1, F.coalesce(F.size("fields"), F.lit(0)) > 0)]
    got = reduce(lambda a, b: a + b, [F.when(c, k).otherwise(0) for k, c in checks])
    score = F.round(100 * got / sum(k for k, _ in checks), 2)
    return w.groupBy(score.alias("score")).agg(_count("n_works"), F.min(reduce(lambda a, b: a & b, [c for _, c in checks])).alias("eligible"))


def c_status_by_doi(spark, sf):
    """Works whose DOI a notice names: the kinds of notice and their number. Notices are the removals of works, named by their DOI."""
    w = first(spark, sf, "works", "doi").select("work_id", R.normalized_doi(F.col("doi")).alias("doi")).where("doi IS NOT NULL")
    n = table(spark, sf, "removals").where("record_table = 'works'").select(F.col("record_id").alias("work_id"), F.when(F.col("restored_at").isNull(), "removed").otherwise("restored").alias("kind"))
    notices = n.join(w, "work_id").select("doi", "kind")
    return w.join(notices, "doi").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), _count("n_notices"))


def c_edit_conflicts(spark, sf):
    """Lines that several edits of a revision change, with the edits in order."""
    x = first(spark, sf, "revision", "edits").select("revision_id", F.posexplode("edits").alias("pos", "e")).where("e.plan_line IS NOT NULL AND e.edit_id IS NOT NULL")
    per = x.groupBy("revision_id", F.col("e.plan_line").alias("plan_line")).agg(_count(), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("e.edit_id").alias("id")))), lambda s: s["id"]), ",").alias("edits"))
    return per.where("n > 1")


def e_first_headings(spark, sf):
    """The line of each plan's first heading on each axis."""
    h = _headed(spark, sf).where("level > 0")
    axis = F.coalesce(*(F.when(F.lower("heading").rlike(p), name) for name, p in AXES))
    return h.withColumn("axis", axis).where("axis IS NOT NULL").groupBy("plan_id", "axis").agg(F.min("line_no").alias("line_no"))


def f_exclusions(spark, sf):
    """Works to leave out, removed or without a title, once each with the reasons."""
    w = first(spark, sf, "works", "title")
    gone = table(spark, sf, "removals").where("record_table = 'works' AND restored_at IS NULL").select(F.col("record_id").alias("work_id"), F.lit("removed").alias("reason"))
    bare = w.where("title IS NULL OR trim(title) = ''").select("work_id", F.lit("no title").alias("reason"))
    return gone.unionByName(bare).distinct().groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def g_short_title(spark, sf):
    """Titles for lists: what stands before a colon if it has 3 to 40 characters, else at most 48."""
    t = F.trim("title")
    lead = F.trim(F.substring_index(t, ":", 1))
    short = F.when(t.contains(":") & F.length(lead).between(3, 40), lead).when(F.length(t) <= 48, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(47))), F.lit("…")))
    return first(spark, sf, "works", "title").where("title IS NOT NULL").select("work_id", short.alias("short_title"))


def g_unit(spark, sf):
    """Confidences brought to 0..1 with six decimals: how many, and their sum."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round("confidence", 6)))
    return first(spark, sf, "risk_tags", "confidence", "generator").where("confidence IS NOT NULL").groupBy("generator").agg(_count(), F.round(F.sum(x), 4).alias("total"))


def g_title_keys(spark, sf):
    """Cards whose titles are one but for case, signs and blanks, by code."""
    key = F.lower(F.regexp_replace("title", r"[^\p{L}\p{N}]+", ""))
    c = first(spark, sf, "risk_cards", "title", "risk_code").where("title IS NOT NULL")
    return c.groupBy("risk_code").agg(_count("n_cards"), F.count_distinct(key).alias("n_keys"))


def g_sorted_codes(spark, sf):
    """The codes of each work's negative tags, shorter ones first."""
    i = _issues(spark, sf).where("polarity = 'negative'").groupBy("work_id").agg(F.collect_set("risk_code").alias("codes"))
    order = F.array_sort(F.transform("codes", lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))
    return i.select("work_id", F.array_join(F.transform(order, lambda s: s["c"]), ",").alias("codes"))


def g_record_tokens(spark, sf):
    """Distinct words of three signs at least in decisions."""
    d = first(spark, sf, "decisions", "text").where("text IS NOT NULL")
    return d.select("decision_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9-]{2,})"), F.lit(1)))).alias("n_tokens"))


CITED = r"\b([A-Z][a-z]+) et al\.,? \(?([12][0-9]{3})"
PLACEHOLDER = r"\[[A-Z]{2,}\]"


def h_citations(spark, sf):
    """Works cited by first author and year in reviews."""
    r = first(spark, sf, "reviews", "text")
    each = r.select("review_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_edged(CITED)})"), F.lit(1))).alias("c"))
    return each.groupBy(F.regexp_extract("c", _edged(CITED), 1).alias("author"), F.regexp_extract("c", _edged(CITED), 2).alias("year")).agg(_count(), F.count_distinct("review_id").alias("n_reviews"))


def h_placeholders(spark, sf):
    """Placeholders that reviews already hold."""
    each = first(spark, sf, "reviews", "text").select(F.explode(F.regexp_extract_all("text", F.lit(f"({PLACEHOLDER})"), F.lit(1))).alias("placeholder"))
    return each.groupBy("placeholder").agg(_count())


def b_clean_text(spark, sf):
    """Plans with even line ends, without control signs, blanks at line ends and runs of blank lines: hash and length."""
    t = R.line_feeds(F.col("plan_text"))
    for pattern, to in ((r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^\n+|[ \t\n]+$", "")):
        t = F.regexp_replace(t, pattern, to)
    return first(spark, sf, "assemble_live_smoke3", "plan_text").select("plan_id", R.text_sha256(t).alias("sha256"), F.length(t).alias("n_chars"))


def b_limits(spark, sf):
    """Plans by the first limit that they break."""
    t = R.line_feeds(F.col("plan_text"))
    broken = F.when(F.length(t) > 1500, "characters").when(F.size(F.split(t, "\n")) > 40, "lines").otherwise("within")
    return first(spark, sf, "assemble_live_smoke3", "plan_text").where("plan_text IS NOT NULL").groupBy(broken.alias("limit_broken")).agg(_count("n_plans"))


SECRET, PATHS = r"\b[0-9a-f]{32,}\b", r"(^|[ (\"'])/(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+"


def b_safe_text(spark, sf):
    """Reviews of which paths and long keys are cut out: how many changed."""
    t = F.regexp_replace(F.regexp_replace("text", PATHS, "$1[PATH]"), _edged(SECRET), "[KEY]")
    return first(spark, sf, "reviews", "text").where("text IS NOT NULL").agg(_count(), F.sum((t != F.col("text")).cast("int")).alias("n_changed"), F.sum(F.length(t)).alias("n_chars"))


RESEARCH = r"(?i)\b(?:research|method|data|dataset|experiment|evaluation|hypothesis|baseline|analysis|model|metric)s?\b"


def b_research_like(spark, sf):
    """Plans with four words of research at least."""
    k = F.regexp_count("plan_text", F.lit(_edged(RESEARCH)))
    return first(spark, sf, "assemble_live_smoke3", "plan_text").where("plan_text IS NOT NULL").select("plan_id", k.alias("n_words"), (k >= 4).alias("like_research"))


def b_digits(spark, sf):
    """Reviews with digits of other widths brought to ASCII: how many, and the hash of each."""
    t = F.translate("text", "０１２３４５６７８９", "0123456789")
    return first(spark, sf, "reviews", "text").select("review_id", R.text_sha256(t).alias("sha256"), (t != F.col("text")).alias("changed")).where("changed")


def b_composed(spark, sf):
    """Works as named sections, those without text left out."""
    part = lambda c: F.when(F.trim(c) != "", F.concat(F.lit(c.capitalize() + ":\n"), F.trim(c)))
    t = F.concat_ws("\n\n", part("title"), part("abstract"), part("venue"))
    return first(spark, sf, "works", "title", "abstract", "venue").select("work_id", R.text_sha256(t).alias("sha256"))


def b_residual(spark, sf):
    """Identifiers that are left in reviews after redaction: there should be none."""
    t = R.redacted(F.col("text"))
    return first(spark, sf, "reviews", "text").agg(_count("n_reviews"), F.sum(F.coalesce(F.regexp_count(t, F.lit(R.EMAIL)), F.lit(0))).alias("n_email_left"))


# Topics and their words; a star stands for any ending.
TOPICS = {"vision": ["image*", "video", "satellite"], "language": ["language", "text", "question answering", "speech"], "chemistry": ["molecul*", "reaction", "battery"], "tabular": ["tabular", "time series", "forecast*"]}


def _word(w):
    return r"\b" + w.replace(" ", r"[\s-]+").replace("*", r"\w*") + r"\b"


def b_topics(spark, sf):
    """Works under each topic by how strongly they belong to it: in the title, by several words, by one."""
    w = first(spark, sf, "works", "title", "abstract")
    title, whole = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.concat_ws("\n", "title", "abstract"))
    rows = []
    for topic, words in TOPICS.items():
        hits = reduce(lambda a, b: a + b, [whole.rlike(_edged(_word(x))).cast("int") for x in words])
        head = reduce(lambda a, b: a | b, [title.rlike(_edged(_word(x))) for x in words])
        rows.append(F.struct(F.lit(topic).alias("topic"), F.when(head, "title").when(hits >= 2, "several").when(hits == 1, "one").otherwise("none").alias("strength")))
    return w.select(F.explode(F.array(*rows)).alias("t")).groupBy("t.topic", "t.strength").agg(_count("n_works"))


def b_masked_numbers(spark, sf):
    """Reviews with resident numbers and then phone numbers of one country masked: how many of each."""
    rrn, phone = r"\b[0-9]{6}-[1-8][0-9]{6}\b", r"\b01[016789][ -]?[0-9]{3,4}[ -]?[0-9]{4}\b"
    t = F.regexp_replace("text", _edged(rrn), "[ID]")
    return first(spark, sf, "reviews", "text").where("text IS NOT NULL").agg(F.sum(F.regexp_count("text", F.lit(_edged(rrn)))).alias("n_ids"), F.sum(F.regexp_count(t, F.lit(_edged(phone)))).alias("n_phones"))


Q = (
    e_final_cards, e_field_codes, e_top_codes, c_usable_cards, b_gate_edits, d_gate_reasons, d_grid, d_vote_patterns, d_label_support, d_polarity_table, d_single_tagger, d_plan_summary, d_source_counts, d_card_outcomes, d_completeness, c_status_by_doi, c_edit_conflicts, e_first_headings,
    f_exclusions, g_short_title, g_unit, g_title_keys, g_sorted_codes, g_record_tokens, h_citations, h_placeholders, b_clean_text, b_limits, b_safe_text, b_research_like, b_digits, b_composed, b_residual, b_topics, b_masked_numbers,
)


def queries():
    return {q.__name__: q for q in Q}


def oracle_sql():
    f = first_sql
    sources = "src AS (SELECT 'review' AS source_kind, review_id AS source_id, work_id FROM reviews1 UNION ALL SELECT 'decision', decision_id, work_id FROM decisions1)"
    issues = f("risk_tags", "excerpts", "reviews", "decisions", "works", "risk_cards")[:-1] + f", {sources}, issues AS (SELECT t.*, e.source_kind, e.source_id, s.work_id FROM risk_tags1 t JOIN excerpts1 e USING (excerpt_id) JOIN src s ON s.source_kind = e.source_kind AND s.source_id = e.source_id WHERE s.work_id IS NOT NULL AND t.risk_code IS NOT NULL), fields AS (SELECT DISTINCT work_id, unnest(fields) AS field FROM works1), bf AS (SELECT i.*, field FROM issues i JOIN fields USING (work_id) WHERE field IS NOT NULL) "
    severity = "CASE risk_code " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in SEVERITY.items()) + " END"
    hidden = ", ".join(f"'{c}'" for c in SHOWN_ONLY)
    lf = "replace(replace(plan_text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    gate = f("revision", "excerpts")[:-1] + f""", x AS (SELECT revision_id, pos, e.proposed_text AS text, e.plan_line AS line, list_filter(coalesce(e.rationale.excerpt_ids, []), lambda i: i IS NOT NULL) AS ids FROM (SELECT revision_id, unnest(edits) AS e, generate_subscripts(edits, 1) AS pos FROM revision1) WHERE e IS NOT NULL),
    each AS (SELECT revision_id, pos, e.text AS said FROM (SELECT revision_id, pos, unnest(ids) AS excerpt_id FROM x) i LEFT JOIN excerpts1 e USING (excerpt_id)), un AS (SELECT revision_id, pos, max(CAST(said IS NULL AS INT)) AS unknown FROM each GROUP BY 1, 2),
    mu AS (SELECT DISTINCT revision_id, pos, 1 AS made_up FROM (SELECT revision_id, pos, replace(unnest(regexp_extract_all(text, '{WRITTEN}')), ',', '') AS n FROM x EXCEPT SELECT revision_id, pos, replace(unnest(regexp_extract_all(said, '{WRITTEN}')), ',', '') FROM each)),
    g AS (SELECT x.revision_id, x.pos, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN length(text) > 600 THEN 'too long' WHEN regexp_matches(text, '{MAIL}') THEN 'personal data' WHEN len(ids) = 0 THEN 'no evidence' WHEN unknown = 1 THEN 'unknown evidence' WHEN coalesce(line, 0) < 1 THEN 'no line' WHEN made_up = 1 THEN 'number without source' WHEN row_number() OVER (PARTITION BY x.revision_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY x.pos) > 1 THEN 'said before' ELSE 'pass' END AS reason FROM x LEFT JOIN un USING (revision_id, pos) LEFT JOIN mu USING (revision_id, pos)) """
    configs = ", ".join(f"({i}, '{p}', {c}, {n})" for i, p, c, n in GRID)
    clean = lf
    for pattern, to in ((r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "''"), (r"[ \t]+\n", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\n+|[ \t\n]+$", "''")):
        clean = f"regexp_replace({clean}, '{pattern}', {to}, 'g')"
    checks = [(3, "coalesce(trim(title) <> '', false)"), (3, "coalesce(length(abstract) >= 200, false)"), (2, f"({_doi('doi')}) IS NOT NULL"), (1, "venue IS NOT NULL"), (1, "pub_year IS NOT NULL"), (1, "coalesce(len(fields), 0) > 0")]
    got = " + ".join(f"CASE WHEN {c} THEN {k} ELSE 0 END" for k, c in checks)
    part = lambda c: f"CASE WHEN trim({c}) <> '' THEN '{c.capitalize()}:' || chr(10) || trim({c}) END"
    profile = R.PROFILE.replace("'", "''")
    word = lambda w: _word(w)
    topic_rows = []
    for topic, words in TOPICS.items():
        head = " OR ".join(f"regexp_matches(lower(coalesce(title, '')), '{word(x)}')" for x in words)
        hits = " + ".join(f"CAST(regexp_matches(lower(concat_ws(chr(10), title, abstract)), '{word(x)}') AS INT)" for x in words)
        topic_rows.append(f"SELECT '{topic}' AS topic, CASE WHEN {head} THEN 'title' WHEN {hits} >= 2 THEN 'several' WHEN {hits} = 1 THEN 'one' ELSE 'none' END AS strength FROM works1")
    safe = f"regexp_replace(regexp_replace(text, '{PATHS.replace(chr(39), chr(39) * 2)}', '\\1[PATH]', 'g'), '{SECRET}', '[KEY]', 'g')"
    rrn, phone = r"\b[0-9]{6}-[1-8][0-9]{6}\b", r"\b01[016789][ -]?[0-9]{3,4}[ -]?[0-9]{4}\b"
    digits = "translate(text, '０１２３４５６７８９', '0123456789')"
    lead = "trim(split_part(trim(title), ':', 1))"
    return {
        "e_final_cards": issues + f", b AS (SELECT * FROM bf WHERE polarity = 'negative'), a AS (SELECT field, count(DISTINCT work_id) AS n_field FROM b GROUP BY 1), p AS (SELECT field, risk_code, count(DISTINCT excerpt_id) AS n_evidence, count(DISTINCT work_id) AS n_works, avg(confidence) AS c FROM b WHERE risk_code NOT IN ({hidden}) GROUP BY 1, 2), t AS (SELECT p.*, round(least(1.0, n_works / n_field) * {severity} * coalesce(c, 0), 4) AS total FROM p JOIN a USING (field) WHERE n_evidence >= 3 AND n_works >= 2) SELECT field, row_number() OVER (PARTITION BY field ORDER BY total DESC, risk_code) AS place, risk_code, n_evidence, n_works, total FROM t QUALIFY place <= 8",
        "e_field_codes": issues + f"SELECT field, risk_code, n_works, n_issues, row_number() OVER (PARTITION BY field ORDER BY n_works DESC, n_issues DESC, risk_code) AS place FROM (SELECT field, risk_code, count(DISTINCT work_id) AS n_works, count(*) AS n_issues FROM bf WHERE risk_code NOT IN ({hidden}) GROUP BY 1, 2) WHERE n_works >= 2 QUALIFY place <= 3",
        "e_top_codes": issues + "SELECT risk_code, count(DISTINCT source_id) AS n_sources FROM issues GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
        "c_usable_cards": issues + f"SELECT state, count(*) AS n_cards FROM (SELECT c.card_id, CASE WHEN risk_code IN ({hidden}) THEN 'shown only' WHEN coalesce(n, 0) < 3 THEN 'few excerpts' WHEN coalesce(w, 0) < 2 THEN 'one work' ELSE 'kept' END AS state FROM risk_cards1 c LEFT JOIN (SELECT card_id, count(DISTINCT excerpt_id) AS n, count(DISTINCT s.work_id) AS w FROM (SELECT card_id, unnest(evidence) AS excerpt_id FROM risk_cards1) i JOIN excerpts1 e USING (excerpt_id) LEFT JOIN src s ON s.source_kind = e.source_kind AND s.source_id = e.source_id WHERE e.source_id IS NOT NULL GROUP BY 1) USING (card_id) WHERE evidence IS NOT NULL OR true) GROUP BY 1",
        "b_gate_edits": gate + "SELECT revision_id, pos, reason FROM g",
        "d_gate_reasons": gate + "SELECT reason, count(*) AS n, reason IN ('no evidence', 'unknown evidence') AS for_evidence FROM g GROUP BY 1",
        "d_grid": issues + f", gr(grid_no, pol, least, most) AS (VALUES {configs}), gold AS (SELECT DISTINCT source_id, risk_code FROM issues WHERE generator <> 'rule' AND polarity = 'negative'), said AS (SELECT grid_no, source_id, risk_code FROM issues, gr WHERE generator = 'rule' AND source_id IN (SELECT source_id FROM gold) AND coalesce(confidence, 0) >= least AND (polarity = 'negative' OR (pol = 'negative+neutral' AND polarity = 'neutral')) GROUP BY 1, 2, 3, most HAVING count(*) >= most), b AS (SELECT coalesce(t.grid_no, s.grid_no) AS grid_no, coalesce(t.risk_code, s.risk_code) AS risk_code, t.source_id IS NOT NULL AS g, s.source_id IS NOT NULL AS s FROM (SELECT grid_no, source_id, risk_code FROM gold, gr) t FULL JOIN said s ON s.grid_no = t.grid_no AND s.source_id = t.source_id AND s.risk_code = t.risk_code), p AS (SELECT grid_no, risk_code, sum(CAST(g AND s AS INT)) AS tp, sum(CAST(NOT g AND s AS INT)) AS fp, sum(CAST(g AND NOT s AS INT)) AS fn FROM b GROUP BY 1, 2 HAVING tp + fn > 0), o AS (SELECT grid_no, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1, count(*) AS n_codes FROM p GROUP BY 1) SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, grid_no) = 1 AS best FROM o",
        "d_vote_patterns": f("risk_tags") + "SELECT CASE WHEN k = 1 THEN 'agree' WHEN k = n THEN 'all differ' ELSE 'split' END AS pattern, count(*) AS n_excerpts FROM (SELECT excerpt_id, count(*) AS n, count(DISTINCT code) AS k FROM (SELECT excerpt_id, generator, min(risk_code) AS code FROM risk_tags1 WHERE excerpt_id IS NOT NULL AND generator IS NOT NULL GROUP BY 1, 2) GROUP BY 1) WHERE n > 1 GROUP BY 1",
        "d_label_support": f("risk_tags")[:-1] + f", c(risk_code) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in CODES)}) SELECT risk_code, count(tag_id) AS n FROM c LEFT JOIN (SELECT * FROM risk_tags1 WHERE generator = 'rule') t USING (risk_code) GROUP BY 1",
        "d_polarity_table": f("risk_tags") + "SELECT generator, " + ", ".join(f"count(*) FILTER (polarity = '{p}') AS n_{p}" for p in ("negative", "neutral", "positive")) + " FROM risk_tags1 GROUP BY 1",
        "d_single_tagger": f("risk_tags") + "SELECT CASE WHEN k > 1 THEN 'several' ELSE 'one' END AS taggers, count(*) AS n_excerpts FROM (SELECT excerpt_id, count(DISTINCT generator) AS k FROM risk_tags1 WHERE excerpt_id IS NOT NULL GROUP BY 1) GROUP BY 1",
        "d_plan_summary": f("assemble_live_smoke3") + "SELECT count(*) AS n_plans, round(avg(length(plan_text)), 4) AS mean_chars, sum(length(plan_text)) AS n_chars, sum(CAST(length(plan_text) < 400 AS INT)) AS n_short FROM assemble_live_smoke31",
        "d_source_counts": f("reviews") + "SELECT CASE WHEN contains(work_id, ':') THEN split_part(work_id, ':', 1) END AS source, count(*) AS n_reviews, count(DISTINCT work_id) AS n_works FROM reviews1 WHERE work_id IS NOT NULL GROUP BY 1",
        "d_card_outcomes": f("risk_cards", "decisions")[:-1] + f", c AS (SELECT DISTINCT risk_code, unnest(works) AS work_id FROM risk_cards1), d AS (SELECT work_id, max(CAST(o IN ('reject', 'desk_reject') AS INT)) AS bad FROM (SELECT work_id, {_rules(2)} AS o FROM decisions1 WHERE work_id IS NOT NULL) WHERE o <> 'unknown' GROUP BY 1) SELECT risk_code, count(*) AS n_works, sum(coalesce(bad, 0)) AS n_rejected, sum(CAST(bad IS NULL AS INT)) AS n_unknown FROM c LEFT JOIN d USING (work_id) WHERE work_id IS NOT NULL GROUP BY 1",
        "d_completeness": f("works") + f"SELECT round(100 * ({got}) / {sum(k for k, _ in checks)}, 2) AS score, count(*) AS n_works, bool_and({' AND '.join(c for _, c in checks)}) AS eligible FROM works1 GROUP BY 1",
        "c_status_by_doi": f("works")[:-1] + f", w AS (SELECT work_id, {_doi('doi')} AS doi FROM works1), n AS (SELECT doi, CASE WHEN restored_at IS NULL THEN 'removed' ELSE 'restored' END AS kind FROM removals r JOIN w ON w.work_id = r.record_id WHERE record_table = 'works') SELECT work_id, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, count(*) AS n_notices FROM w JOIN n USING (doi) GROUP BY 1",
        "c_edit_conflicts": f("revision") + "SELECT revision_id, e.plan_line AS plan_line, count(*) AS n, string_agg(e.edit_id, ',' ORDER BY pos) AS edits FROM (SELECT revision_id, unnest(edits) AS e, generate_subscripts(edits, 1) AS pos FROM revision1) WHERE e.plan_line IS NOT NULL AND e.edit_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
        "e_first_headings": f("assemble_live_smoke3")[:-1] + f", {SQL_HEADED} SELECT plan_id, axis, min(line_no) AS line_no FROM (SELECT plan_id, line_no, {SQL_AXIS.replace('head', 'heading')} AS axis FROM headed WHERE level > 0) WHERE axis IS NOT NULL GROUP BY 1, 2",
        "f_exclusions": f("works") + "SELECT work_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT record_id AS work_id, 'removed' AS reason FROM removals WHERE record_table = 'works' AND restored_at IS NULL UNION SELECT work_id, 'no title' FROM works1 WHERE title IS NULL OR trim(title) = '') GROUP BY 1",
        "g_short_title": f("works") + f"SELECT work_id, CASE WHEN contains(trim(title), ':') AND length({lead}) BETWEEN 3 AND 40 THEN {lead} WHEN length(trim(title)) <= 48 THEN trim(title) ELSE rtrim(left(trim(title), 47)) || '…' END AS short_title FROM works1 WHERE title IS NOT NULL",
        "g_unit": f("risk_tags") + "SELECT generator, count(*) AS n, round(sum(least(1.0, greatest(0.0, round(confidence, 6)))), 4) AS total FROM risk_tags1 WHERE confidence IS NOT NULL GROUP BY 1",
        "g_title_keys": f("risk_cards") + r"SELECT risk_code, count(*) AS n_cards, count(DISTINCT lower(regexp_replace(title, '[^\pL\pN]+', '', 'g'))) AS n_keys FROM risk_cards1 WHERE title IS NOT NULL GROUP BY 1",
        "g_sorted_codes": issues + "SELECT work_id, string_agg(risk_code, ',' ORDER BY length(risk_code), risk_code) AS codes FROM (SELECT DISTINCT work_id, risk_code FROM issues WHERE polarity = 'negative') GROUP BY 1",
        "g_record_tokens": f("decisions") + "SELECT decision_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{2,}'))) AS n_tokens FROM decisions1 WHERE text IS NOT NULL",
        "h_citations": f("reviews") + f"SELECT regexp_extract(c, '{CITED}', 1) AS author, regexp_extract(c, '{CITED}', 2) AS year, count(*) AS n, count(DISTINCT review_id) AS n_reviews FROM (SELECT review_id, unnest(regexp_extract_all(text, '{CITED}')) AS c FROM reviews1) GROUP BY 1, 2",
        "h_placeholders": f("reviews") + f"SELECT placeholder, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{PLACEHOLDER}')) AS placeholder FROM reviews1) GROUP BY 1",
        "b_clean_text": f("assemble_live_smoke3") + f"SELECT plan_id, sha256({clean}) AS sha256, length({clean}) AS n_chars FROM assemble_live_smoke31",
        "b_limits": f("assemble_live_smoke3") + f"SELECT CASE WHEN length({lf}) > 1500 THEN 'characters' WHEN len(string_split({lf}, chr(10))) > 40 THEN 'lines' ELSE 'within' END AS limit_broken, count(*) AS n_plans FROM assemble_live_smoke31 WHERE plan_text IS NOT NULL GROUP BY 1",
        "b_safe_text": f("reviews") + f"SELECT count(*) AS n, sum(CAST({safe} <> text AS INT)) AS n_changed, sum(length({safe})) AS n_chars FROM reviews1 WHERE text IS NOT NULL",
        "b_research_like": f("assemble_live_smoke3") + f"SELECT plan_id, len(regexp_extract_all(plan_text, '{RESEARCH}')) AS n_words, len(regexp_extract_all(plan_text, '{RESEARCH}')) >= 4 AS like_research FROM assemble_live_smoke31 WHERE plan_text IS NOT NULL",
        "b_digits": f("reviews") + f"SELECT review_id, sha256({digits}) AS sha256, true AS changed FROM reviews1 WHERE {digits} <> text",
        "b_composed": f("works") + f"SELECT work_id, sha256(concat_ws(chr(10) || chr(10), {part('title')}, {part('abstract')}, {part('venue')})) AS sha256 FROM works1",
        "b_residual": f("reviews") + f"SELECT count(*) AS n_reviews, sum(coalesce(len(regexp_extract_all(regexp_replace(regexp_replace(text, '{profile}', '[PROFILE]', 'g'), '{R.EMAIL}', '[EMAIL]', 'g'), '{R.EMAIL}')), 0)) AS n_email_left FROM reviews1",
        "b_topics": f("works") + f"SELECT topic, strength, count(*) AS n_works FROM ({' UNION ALL '.join(topic_rows)}) GROUP BY 1, 2",
        "b_masked_numbers": f("reviews") + f"SELECT sum(len(regexp_extract_all(text, '{rrn}'))) AS n_ids, sum(len(regexp_extract_all(regexp_replace(text, '{rrn}', '[ID]', 'g'), '{phone}'))) AS n_phones FROM reviews1 WHERE text IS NOT NULL",
    }
