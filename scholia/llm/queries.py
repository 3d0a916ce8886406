"""Queries on text for training data, by problem, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import confusables, mixing, outcomes, packing, pii, sentences, sizes
from scholia.operators.dedupe import first_arrival
from scholia.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.mapped_decisions(table(spark, sf, "decisions"), table(spark, sf, "outcomes")).select("decision_id", "outcome")


def p2_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Raw values that mean no canonical outcome, with their number of decisions."""
    found = outcomes.mapped_decisions(table(spark, sf, "decisions"), table(spark, sf, "outcomes"))
    return found.where(found.outcome == outcomes.UNKNOWN).groupBy("outcome_raw").count().withColumnRenamed("count", "n_decisions")


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    """How many decisions were decided by mentions, by similarity and not at all."""
    found = outcomes.mapped_decisions(table(spark, sf, "decisions"), table(spark, sf, "outcomes"))
    return found.groupBy("path").count().withColumnRenamed("count", "n_decisions")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.all_units([(table(spark, sf, "reviews"), "review_id", "text", "reviews"), (table(spark, sf, "excerpts"), "excerpt_id", "text", "excerpts")])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.all_spans([(table(spark, sf, "reviews"), "review_id", "text", "reviews"), (table(spark, sf, "assemble_live_smoke3"), "plan_id", "plan_text", "assemble_live_smoke3")])


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every review and plan with typed placeholders in place of personal data."""
    parts = [("reviews", "review_id", "text"), ("assemble_live_smoke3", "plan_id", "plan_text")]
    done = []
    for name, key, text in parts:
        first = first_arrival(table(spark, sf, name), [key], "ingested_at", [text])
        done.append(first.select(F.lit(name).alias("source_table"), F.col(key).alias("record_id"), pii.redacted(first, text).alias("text")))
    return done[0].unionByName(done[1])


def _capacities(spark: SparkSession, sf: str) -> list[tuple[str, int]]:
    """The list of capacities, of fixed size."""
    return sorted((r["pack_id"], int(r["capacity_tokens"])) for r in table(spark, sf, "pack_capacities").collect())


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(sizes.token_counts(table(spark, sf, "documents")), _capacities(spark, sf))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_report(p6_pack(spark, sf), _capacities(spark, sf))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").withColumn("weight", mixing.quality(F.col("text")))
    return mixing.mixed(sizes.token_counts(docs, keep=("source", "weight")), table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source of each mix."""
    return _mixed(spark, sf)[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return confusables.twins(table(spark, sf, "documents"))


def p8_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in its one form."""
    return confusables.forms(table(spark, sf, "documents"), with_text=True).select("doc_id", "form")


NAMES = (p2_found, p2_unmatched, p2_paths, p4_found, p5_found, p5_redacted, p6_pack, p6_fill, p7_mix, p7_report, p8_found, p8_forms)


def queries() -> dict:
    return {q.__name__: q for q in NAMES}


def oracle_sql() -> dict[str, str]:
    return {}
