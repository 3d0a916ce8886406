"""Texts that occur word for word inside others, by equal runs of words instead of comparing all with all."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Words of a run; shorter texts meet on runs of their own length.
RUN = 5


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def contained(needles: DataFrame, haystacks: DataFrame, least_chars: int = 20, block_needles: int = 500_000) -> DataFrame:
    """(needle_id, hay_id): a needle's text, white space squeezed, stands in a haystack's, from a word's start to a word's end.

    ``needles`` has needle_id and text, ``haystacks`` hay_id and text. Needles
    under ``least_chars`` are left out. Haystacks are dealt out over the cores
    and each block meets the needles, in parts of about ``block_needles``, held
    by their first words: no run of words leaves a task, only pairs that are
    found. Each pair is given once. Nulls match nothing.
    """
    n = needles.select("needle_id", squeezed(F.col("text")).alias("text")).where((F.length("text") >= least_chars) & F.col("needle_id").isNotNull())
    h = haystacks.select("hay_id", squeezed(F.col("text")).alias("text")).where("text IS NOT NULL AND hay_id IS NOT NULL")
    cores = needles.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n.count() // block_needles))
    each = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    of = lambda c, b: F.pmod(F.xxhash64(c), F.lit(b)).cast("int")
    left = n.select(F.lit(0).alias("kind"), "needle_id", "text", each(cores).alias("core"), of("needle_id", parts).alias("part"))
    right = h.select(F.lit(1).alias("kind"), "hay_id", "text", of("hay_id", cores).alias("core"), each(parts).alias("part"))
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("block", F.col("core") * parts + F.col("part")).drop("core", "part")
    dealt = rows.repartitionById(cores * parts, "block").sortWithinPartitions("kind")
    kinds = StructType([StructField(c, dealt.schema[c].dataType) for c in ("needle_id", "hay_id")])
    out = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = defaultdict(list)
        for b in batches:
            found: list[tuple] = []
            for kind, needle, text, hay in zip(*(b.column(c).to_pylist() for c in ("kind", "needle_id", "text", "hay_id"))):
                if kind == 0:
                    held[" ".join(text.split(" ", RUN)[:RUN])].append((needle, text + " "))
                else:
                    found += ((x, hay) for x in _standing(text, held))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

    return dealt.mapInArrow(run, kinds).distinct()


def _standing(text: str, held: dict[str, list[tuple]]) -> set:
    """The ids of the needles that stand in a text, by the runs of words that begin at each of its words."""
    padded, found = text + " ", set()
    starts = [0, *(i + 1 for i, c in enumerate(padded) if c == " ")]
    for i, at in enumerate(starts[:-1]):
        for end in starts[i + 1 : i + 1 + RUN]:
            for name, needle in held.get(padded[at : end - 1], ()):
                if padded.startswith(needle, at):
                    found.add(name)
    return found
