"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.sources.tables import table

KEYS = {"works": "work_id", "reviews": "review_id", "decisions": "decision_id", "excerpts": "excerpt_id", "risk_tags": "tag_id", "risk_cards": "card_id", "revision": "revision_id", "revision_raw": "raw_id", "assemble_live_smoke3": "plan_id"}


def first(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """The first arrival of each key of a table, with the given columns or all.

    The narrow rows (key, arrival) would have to be joined back to wide ones, so
    one window over the pruned columns is the single shuffle. Deliveries of one
    time that differ are told apart by the hash of their columns.
    """
    key = KEYS[name]
    wanted = list(dict.fromkeys([key, *columns])) if columns else None
    df = table(spark, sf, name)
    src = df.select(*wanted, *([] if "ingested_at" in wanted else ["ingested_at"])) if wanted else df
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col("ingested_at").asc_nulls_last(), F.xxhash64(*[c for c in src.columns if not c.startswith("_")])))
    out = src.withColumn("_n", n).where("_n = 1").drop("_n")
    return out.select(*wanted) if wanted else out


def first_sql(*names: str) -> str:
    """CTEs <name>1 with the first arrivals, for the oracle."""
    ctes = [f"{n}1 AS (SELECT * FROM {n} QUALIFY row_number() OVER (PARTITION BY {KEYS[n]} ORDER BY ingested_at) = 1)" for n in names]
    return "WITH " + ", ".join(ctes) + "\n"
