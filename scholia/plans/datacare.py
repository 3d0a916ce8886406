"""Problems 1 and 3: orphan references and flattened nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import nested as N
from scholia.operators import orphans as O
from scholia.sources.tables import table

WORKS, REVIEWS, DECISIONS, EXCERPTS = O.Parent("works", "work_id"), O.Parent("reviews", "review_id"), O.Parent("decisions", "decision_id"), O.Parent("excerpts", "excerpt_id")


def _references() -> list[O.Reference]:
    kind = F.col("source_kind")
    source = F.when(kind == "review", "reviews").when(kind == "decision", "decisions").otherwise(F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit(""))))
    return [
        O.Reference("decisions", "work_id", "decision_id", F.lit("works")),
        O.Reference("excerpts", "source_id", "excerpt_id", source),
        O.Reference("risk_tags", "excerpt_id", "tag_id", F.lit("excerpts")),
        O.Reference("risk_cards", "evidence", "card_id", F.lit("excerpts"), many=True),
    ]


def orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    children = union([O.references(table(spark, sf, r.table), r) for r in _references()])
    parents = union([O.tagged_parents(table(spark, sf, p.table), p) for p in (WORKS, REVIEWS, DECISIONS, EXCERPTS)])
    return O.orphans(children, parents, O.tagged_removals(table(spark, sf, "removals")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_rows(spark, sf).select("child_table", "child_field", "child_id", "parent_id", "period").distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return O.orphan_counts(orphan_rows(spark, sf))


_STRIP = r"regexp_replace({0}, '^[\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_ORPHANS = f"""
WITH child AS (
  SELECT 'decisions' child_table, 'work_id' child_field, decision_id child_id, 'works' parent_table, arg_min(work_id, ingested_at) ref, min(ingested_at) child_at FROM decisions GROUP BY decision_id
  UNION ALL
  SELECT 'excerpts', 'source_id', excerpt_id, arg_min(CASE source_kind WHEN 'review' THEN 'reviews' WHEN 'decision' THEN 'decisions' END, ingested_at), arg_min(source_id, ingested_at), min(ingested_at) FROM excerpts GROUP BY excerpt_id
  UNION ALL
  SELECT 'risk_tags', 'excerpt_id', CAST(tag_id AS VARCHAR), 'excerpts', arg_min(excerpt_id, ingested_at), min(ingested_at) FROM risk_tags GROUP BY tag_id
  UNION ALL
  SELECT 'risk_cards', 'evidence', card_id, 'excerpts', unnest(evidence), ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY ingested_at) n FROM risk_cards) WHERE n = 1
), trimmed AS (
  SELECT DISTINCT child_table, child_field, child_id, parent_table, {_STRIP.format("ref")} parent_id, child_at FROM child
), parent AS (
  SELECT 'works' parent_table, work_id parent_id, min(ingested_at) parent_at FROM works GROUP BY work_id
  UNION ALL SELECT 'reviews', review_id, min(ingested_at) FROM reviews GROUP BY review_id
  UNION ALL SELECT 'decisions', decision_id, min(ingested_at) FROM decisions GROUP BY decision_id
  UNION ALL SELECT 'excerpts', excerpt_id, min(ingested_at) FROM excerpts GROUP BY excerpt_id
), gone AS (SELECT DISTINCT record_table, record_id FROM removals WHERE restored_at IS NULL
), judged AS (
  SELECT c.*, strftime(c.child_at, '%Y-%m') AS period,
    CASE WHEN p.parent_id IS NULL THEN 'missing' WHEN g.record_id IS NOT NULL THEN 'removed' WHEN c.child_at < p.parent_at THEN 'late' END AS reason
  FROM trimmed c LEFT JOIN parent p USING (parent_table, parent_id) LEFT JOIN gone g ON g.record_table = c.parent_table AND g.record_id = c.parent_id
  WHERE c.parent_id IS NOT NULL AND c.parent_id <> '')
"""
P1_FOUND = _ORPHANS + "SELECT DISTINCT child_table, child_field, child_id, parent_id, period FROM judged WHERE reason IS NOT NULL"
P1_REPORT = _ORPHANS + "SELECT child_table, child_field, parent_table, period, reason, count(*) AS n_references FROM judged WHERE reason IS NOT NULL GROUP BY ALL"


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return N.found(table(spark, sf, "revision"), table(spark, sf, "revision_raw"), table(spark, sf, "risk_cards"))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return N.record_nodes(table(spark, sf, "revision"), table(spark, sf, "revision_raw"), table(spark, sf, "risk_cards"))


def p3_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Every nested record with its identity."""
    return N.flat_tables(_nodes(spark, sf))[0].withColumn("object_id", F.hex("object_id"))


def p3_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Every place where an object or list member occurs: parent, field, ordinal, child."""
    return N.flat_tables(_nodes(spark, sf))[1].select(F.hex("parent_id").alias("parent_id"), "field", "ordinal", F.hex("child_id").alias("child_id"))


def p3_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct object once, its own fields as one JSON text."""
    return N.flat_tables(_nodes(spark, sf))[2].select(F.hex("object_id").alias("object_id"), "types", F.to_json("scalars", {"ignoreNullFields": "false"}).alias("scalars"))


def p3_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Records that could not be read."""
    return N.faults(_nodes(spark, sf))


_READ = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0} ->> '$') AND left(ltrim({0} ->> '$'), 1) IN ('{{', '[') THEN CAST({0} ->> '$' AS JSON) ELSE {0} END"
_MEMBERS = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'NULL' THEN [] ELSE CASE WHEN {0} IS NULL THEN [] ELSE [{0}] END END"
_PAYLOADS = f"""
WITH RECURSIVE opened AS (
  SELECT DISTINCT raw_id, CAST(replace(payload, chr(65279), '') AS JSON) v FROM revision_raw WHERE json_valid(replace(payload, chr(65279), ''))
  UNION ALL
  SELECT raw_id, CAST(replace(v ->> '$', chr(65279), '') AS JSON) FROM opened WHERE json_type(v) = 'VARCHAR' AND json_valid(replace(v ->> '$', chr(65279), ''))
), held AS (
  SELECT raw_id, unnest(json_extract(v, ['$.revisions', '$.revision.revisions', '$.result.revision.revisions', '$[0].revisions', '$[1].revisions', '$[2].revisions'])) h FROM opened WHERE json_type(v) <> 'VARCHAR'
), read AS (SELECT raw_id, {_READ.format("h")} h FROM held WHERE h IS NOT NULL
), cards AS (
  SELECT raw_id, CAST(NULL AS VARCHAR) k, unnest(CAST(h AS JSON[])) c FROM read WHERE json_type(h) = 'ARRAY'
  UNION ALL SELECT raw_id, NULL, h FROM read WHERE json_type(h) = 'OBJECT' AND (json_exists(h, '$.card_id') OR json_exists(h, '$.edits') OR json_exists(h, '$.precedents'))
  UNION ALL SELECT raw_id, k, unnest({_MEMBERS.format("c")}) FROM (SELECT raw_id, k, json_extract(h, '$."' || k || '"') c FROM (SELECT raw_id, h, unnest(json_keys(h)) k FROM read WHERE json_type(h) = 'OBJECT' AND NOT (json_exists(h, '$.card_id') OR json_exists(h, '$.edits') OR json_exists(h, '$.precedents'))))
), card AS (
  SELECT raw_id, coalesce(c ->> '$.card_id', k) card_id, {_READ.format("(c -> '$.edits')")} e, {_READ.format("(c -> '$.precedents')")} p FROM cards WHERE json_type(c) = 'OBJECT'
), item AS (SELECT raw_id, card_id, CASE WHEN json_type(p) = 'OBJECT' AND (json_exists(p, '$.items') OR NOT json_exists(p, '$.work_id')) THEN {_READ.format("(p -> '$.items')")} ELSE p END p FROM card
), raw AS (
  SELECT 'edits' relation, raw_id root_id, card_id, unnest(e) x, generate_subscripts(e, 1) pos, '$.edit_id' f FROM (SELECT raw_id, card_id, {_MEMBERS.format("e")} e FROM card)
  UNION ALL
  SELECT 'precedent_items', raw_id, card_id, unnest(p), generate_subscripts(p, 1), '$.work_id' FROM (SELECT raw_id, card_id, {_MEMBERS.format("p")} p FROM item)
)
"""
P3_FOUND = _PAYLOADS + """
SELECT DISTINCT * FROM (
  SELECT relation, root_id, card_id, pos, x ->> f AS val FROM raw
  UNION ALL SELECT 'edits', revision_id, card_id, pos, e.edit_id FROM (SELECT revision_id, card_id, unnest(edits) e, generate_subscripts(edits, 1) pos FROM revision)
  UNION ALL SELECT 'precedent_items', revision_id, card_id, pos, e.work_id FROM (SELECT revision_id, card_id, unnest(precedents.items) e, generate_subscripts(precedents.items, 1) pos FROM revision)
  UNION ALL SELECT 'plan_lines', card_id, card_id, pos, CAST(e AS VARCHAR) FROM (SELECT card_id, unnest(why_applies.plan_lines) e, generate_subscripts(why_applies.plan_lines, 1) pos FROM risk_cards)
) WHERE val IS NOT NULL
"""
P3_FAULTS = "SELECT DISTINCT 'revision_raw' AS record_table, raw_id AS root_id FROM revision_raw WHERE payload IS NULL OR NOT json_valid(replace(payload, chr(65279), ''))"


def queries() -> dict:
    return {q.__name__: q for q in (p1_found, p1_report, p3_found, p3_roots, p3_bridge, p3_objects, p3_faults)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_report": P1_REPORT, "p3_found": P3_FOUND, "p3_faults": P3_FAULTS}
