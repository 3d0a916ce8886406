"""Sources mixed to target shares of the total size.

Every source gets a budget of tokens. As many complete epochs as fit come
first; the rest is filled by Efraimidis-Spirakis sampling: each document draws
an exponential key scaled by its quality weight, and the smallest keys whose
sizes add up to the budget are taken. Prefix sums are made over a fixed grid of
keys; the cell in which a budget ends is divided again and again until few
documents are left in it, so no source is ever sorted as a whole and the
selection does not depend on the order or place of rows. What is left of a
budget then is offered to all later documents that are small enough for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scholia.session import cut

#: Cells into which a stretch of keys is divided, and documents of a cell that are put in order by one task.
CELLS, FEW = 256, 20_000


def quality(text: Column) -> Column:
    """A weight from 0.1 to 1 by what the text is made of: the share of letters among its signs, of distinct words among its words (counted against the root of their number, so that length alone changes nothing), and of lines that do not repeat; empty and null texts weigh 0.1."""
    signs = F.length(F.regexp_replace(text, r"\s+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))
    words = F.split(F.lower(F.trim(text)), r"\s+")
    lines = F.filter(F.split(text, r"[\r\n]+"), lambda x: F.trim(x) != "")
    varied = F.least(F.lit(1.0), F.size(F.array_distinct(words)) / F.greatest(F.lit(1.0), 2 * F.sqrt(F.size(words).cast("double"))))
    fresh = F.size(F.array_distinct(lines)) / F.greatest(F.lit(1), F.size(lines))
    made = F.when(signs > 0, letters / signs).otherwise(0.0)
    return F.coalesce(F.greatest(F.lit(0.1), made * varied * fresh), F.lit(0.1))


def sampling_key(seed: int, weight: Column, *ids: str) -> Column:
    """-ln(u) / weight with u in (0, 1) from the hash of the ids: the same on every run and executor."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def budgets(targets: list[dict], supply: dict[str, int], total: int | None = None) -> list[dict]:
    """Budget, epochs and rest of each target from the tokens that its source has.

    Without a ``total`` each mix is as large as its targets allow: the largest
    size at which every source that has documents can give its share within its
    repeats. A source without documents, or with less than its budget, is given
    what it can; the report then shows the share that was reached.
    """
    out = []
    for mix in sorted({t["mix_id"] for t in targets}):
        own = [t for t in targets if t["mix_id"] == mix and t["target_share"] > 0]
        able = [supply.get(t["source"], 0) * t["max_repeats"] / t["target_share"] for t in own if supply.get(t["source"], 0) * t["max_repeats"] > 0]
        size = total if total is not None else int(min(able, default=0))
        for t in own:
            has = supply.get(t["source"], 0)
            budget = int(size * t["target_share"] + 1e-9)
            epochs = min(t["max_repeats"], budget // has) if has else 0
            rest = budget - epochs * has if has and epochs < t["max_repeats"] else 0
            out.append(t | {"budget": budget, "epochs": int(epochs), "rest": int(rest), "supply": has})
    return out


_PLAN = T.StructType([T.StructField("mix_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), *(T.StructField(n, T.LongType()) for n in ("max_repeats", "budget", "epochs", "rest", "supply"))])


_KEPT = ("mix_id", "source", "doc_id", "n_tokens", "key")


def _fitting(docs: DataFrame) -> DataFrame:
    """Of each target's documents, in order of their keys, every one that fits in what those before it left of ``gap``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, left = None, 0
        for batch in batches:
            takes = []
            for mix, source, size, gap in zip(batch["mix_id"], batch["source"], batch["n_tokens"], batch["gap"], strict=True):
                if (mix, source) != target:
                    target, left = (mix, source), gap
                takes.append(size <= left)
                left -= size * takes[-1]
            yield batch.loc[takes, list(_KEPT)]

    inputs = docs.select(*_KEPT, "gap")
    ordered = inputs.repartition("mix_id", "source").sortWithinPartitions("mix_id", "source", "key", "doc_id")
    return ordered.mapInPandas(run, inputs.select(*_KEPT).schema)


def _each(spark: SparkSession, values: dict[tuple, tuple], names: str) -> DataFrame:
    """A small table of one row per target, for a broadcast."""
    return F.broadcast(spark.createDataFrame([(*k, *v) for k, v in values.items()], f"mix_id string, source string, {names}"))


def _edges(part: DataFrame, rests: dict[tuple, int]) -> dict[tuple, tuple[float, float, int]]:
    """For each target the stretch of keys [lo, hi) in which its budget ends, and the tokens of the smaller keys.

    Each round sums the documents of the open stretches over ``CELLS`` cells,
    which is that many rows per target at the driver, and keeps the cell in
    which the sum passes the budget, until it holds few documents or cannot be
    divided further. Budgets that are not reached have no stretch.
    """
    spark = part.sparkSession
    # Keys are positive; the first grid is over their logarithms, from e^-40 to e^24.
    open_, done = {t: (-40.0, 24.0, 0) for t in rests}, {}
    log = F.log("key")
    while open_:
        cells = part.join(_each(spark, {t: v[:2] for t, v in open_.items()}, "lo double, hi double"), ["mix_id", "source"])
        at = F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((log - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS)))
        first = F.col("lo") == -40.0
        cells = cells.where(first | (log >= F.col("lo"))).where((F.col("hi") == 24.0) | (log < F.col("hi"))).groupBy("mix_id", "source", at.cast("int").alias("at"))
        sums = cells.agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("n")).collect()
        following = {}
        for target, (lo, hi, before) in open_.items():
            mine = sorted((r["at"], int(r["held"]), r["n"]) for r in sums if (r["mix_id"], r["source"]) == target)
            for i, held, n in mine:
                if before + held > rests[target]:
                    a, b = lo + (hi - lo) * i / CELLS, lo + (hi - lo) * (i + 1) / CELLS
                    a, b = (lo if i == 0 else a), (hi if i == CELLS - 1 else b)
                    if n <= FEW or not lo < (a + b) / 2 < hi or (a, b) == (lo, hi) or (b - a) / CELLS < 1e-12:
                        done[target] = (a, b, before)
                    else:
                        following[target] = (a, b, before)
                    break
                before += held
        open_ = following
    return done


def _small(docs: DataFrame, salts: int = 16) -> DataFrame:
    """Of each target's documents those that could fit in its ``gap``: of each size the first by key, no more than fit beside each other."""
    fits = F.floor(F.col("gap") / F.col("n_tokens"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    some = docs.where("n_tokens <= gap")
    for keys in (("mix_id", "source", "n_tokens", salt), ("mix_id", "source", "n_tokens")):
        w = Window.partitionBy(*keys).orderBy("key", "doc_id")
        some = some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= fits).drop("_n")
    return some


def mixed(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of all mixes.

    ``docs`` has doc_id, source, n_tokens and weight; ``targets`` is the list of
    mixes, of fixed size. selection: mix_id, source, doc_id, n_tokens, times
    (from 1 to max_repeats). report: one row per target with target_share,
    actual_share, n_documents, used_tokens, budget_tokens, supply_tokens and met
    (what was used is 99.9 % of the budget at least). Documents of no source, of one that no mix names, or without
    tokens are not used; a null or non-positive weight counts as the least, 1e-3.
    From the cell where a budget ends, documents too large for what is left of
    it are passed over, so nothing that is left fits in what is left.
    """
    wanted = [r.asDict() for r in targets.where("source IS NOT NULL AND mix_id IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("mix_id", "source", "target_share", "max_repeats").distinct().collect()]
    names = sorted({t["source"] for t in wanted})
    spark = docs.sparkSession
    size = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    pool = cut(docs.where(F.col("source").isin(names or [""])).select("doc_id", "source", size.alias("n_tokens"), F.greatest(F.coalesce("weight", F.lit(1e-3)), F.lit(1e-3)).alias("weight")).where("n_tokens > 0"))
    supply = {r["source"]: int(r["t"] or 0) for r in pool.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    planned = budgets(wanted, supply, total)
    plan = spark.createDataFrame([tuple(p[f.name] if f.name != "max_repeats" else int(p[f.name]) for f in _PLAN) for p in planned], _PLAN)
    each = pool.join(F.broadcast(plan), "source").withColumn("key", sampling_key(seed, F.col("weight"), "mix_id", "doc_id"))
    rests = {(p["mix_id"], p["source"]): p["rest"] for p in planned if p["rest"] > 0}
    some: list[DataFrame] = []
    if rests:
        part = cut(each.where("rest > 0").select(*_KEPT))
        ends = _edges(part, rests)
        placed = part.join(_each(spark, {t: ends.get(t, (float("inf"), float("inf"), 0)) for t in rests}, "lo double, hi double, before bigint"), ["mix_id", "source"])
        log = F.log("key")
        inside = placed.where(log < F.col("lo")).select(*_KEPT)
        some.append(inside)
        if ends:
            gaps = {t: (rests[t] - before,) for t, (_, _, before) in ends.items()}
            within = placed.where((log >= F.col("lo")) & (log < F.col("hi"))).join(_each(spark, gaps, "gap bigint"), ["mix_id", "source"])
            edge = cut(_fitting(within))
            used = {(r["mix_id"], r["source"]): int(r["t"]) for r in edge.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("t")).collect()}
            left = {t: (g - used.get(t, 0),) for t, (g,) in gaps.items()}
            later = placed.where(log >= F.col("hi")).join(_each(spark, left, "gap bigint"), ["mix_id", "source"])
            some += [edge, _fitting(_small(later))]
    some = reduce(DataFrame.unionByName, (d.select("mix_id", "source", "doc_id", "n_tokens", F.lit(1).alias("times")) for d in some), each.limit(0).select("mix_id", "source", "doc_id", "n_tokens", F.lit(1).alias("times")))
    epochs = each.where("epochs > 0").select("mix_id", "source", "doc_id", "n_tokens", F.col("epochs").cast("int").alias("times"))
    selection = epochs.unionByName(some).groupBy("mix_id", "source", "doc_id", "n_tokens").agg(F.sum("times").cast("int").alias("times"))
    return selection, _report(selection, plan)


def _report(selection: DataFrame, plan: DataFrame) -> DataFrame:
    used = selection.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("used_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("n_tokens").alias("_largest"))
    rows = plan.join(used, ["mix_id", "source"], "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    whole = F.sum("used_tokens").over(Window.partitionBy("mix_id"))
    share = F.when(whole > 0, F.col("used_tokens") / whole).otherwise(0.0)
    met = (F.col("used_tokens") > 0) & (F.col("used_tokens") >= F.col("budget") * 0.999)
    return rows.select(
        "mix_id", "source", "target_share", share.alias("actual_share"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "used_tokens",
        F.col("budget").alias("budget_tokens"), F.col("supply").alias("supply_tokens"), F.col("max_repeats").cast("int").alias("max_repeats"), met.alias("met"),
    )
