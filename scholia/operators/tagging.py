"""Rule tags of sentences: weighted detecting and rejecting patterns by code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.cues import DETECT, NEGATIVE, POSITIVE, REJECT, SECTION_POLARITY


def _weight(c: Column, patterns: list[tuple[int, str]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c.rlike("(?iU)" + p), w).otherwise(0) for w, p in patterns], F.lit(0))


def polarity(c: Column, section: Column) -> Column:
    """That of the section where it has one, else by counts of cues; unknown sections lean to negative."""
    by_section = None
    for name, p in SECTION_POLARITY.items():
        if p != "neutral":
            by_section = F.when(section == name, p) if by_section is None else by_section.when(section == name, p)
    neg, pos = F.regexp_count(c, F.lit("(?iU)" + NEGATIVE)), F.regexp_count(c, F.lit("(?iU)" + POSITIVE))
    cues = F.when(neg > pos, "negative").when(pos > neg, "positive").when(section.isin(*SECTION_POLARITY), "neutral").otherwise("negative")
    return F.coalesce(by_section, cues)


def tag_excerpts(excerpts: DataFrame, least: int = 2) -> DataFrame:
    """(excerpt_id, risk_code, score, polarity, confidence) of ``excerpts`` (excerpt_id, text, section).

    One row per code that reaches ``least``; null texts have none. Every
    expression stays in the JVM, and the scan is the only stage.
    """
    weights = F.array(*[
        F.struct(F.lit(code).alias("risk_code"), _weight(F.col("text"), DETECT[code]).alias("found"), _weight(F.col("text"), REJECT.get(code, [])).alias("against"))
        for code in DETECT
    ])
    scores = F.transform(F.filter(weights, lambda x: (x["found"] > 0) & (x["found"] - x["against"] >= least)), lambda x: F.struct(x["risk_code"].alias("risk_code"), (x["found"] - x["against"]).cast("int").alias("score")))
    hit = excerpts.withColumn("_hit", F.explode(scores)).withColumn("polarity", polarity(F.col("text"), F.coalesce("section", F.lit(""))))
    base = F.least(F.lit(0.9), 0.4 + 0.1 * F.col("_hit.score"))
    return hit.select("excerpt_id", "_hit.risk_code", "_hit.score", "polarity", F.round(F.when(F.col("polarity") == "negative", base).otherwise(base * 0.5), 3).alias("confidence"))
