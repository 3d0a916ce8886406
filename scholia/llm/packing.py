"""Containers of fixed capacity filled with documents.

Documents are spread over blocks by their hash, each block just large enough
to fill ``WINDOWS`` containers, and each block is partitioned by Karmarkar-Karp
multiway differencing: partial partitions are merged, the largest parts of one
with the smallest of the other, which gives windows of nearly equal size. The
number of windows starts at the least that can hold the block and rises while
any window exceeds the capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import cut

#: Containers that a block is meant to fill; more fill better and take longer.
WINDOWS = 128


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, sum of each window) by multiway differencing, deterministic.

    A partial partition is its parts in falling order, empty ones left out; the
    heap gives the two of the widest spread.
    """
    n = len(sizes)
    heap: list = [(-int(s), i, [int(s)], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        if len(a) < len(b):
            a, ga, b, gb = b, gb, a, ga
        free = windows - len(a)
        # The largest of b go to empty windows, the rest, smallest first, upon the large of a.
        sums = a + b[:free] if free else list(a)
        groups = ga + gb[:free] if free else list(ga)
        rest = len(b) - free
        if rest > 0:
            # b's smallest meets the largest of those of a that have to take one.
            for j in range(rest):
                at = len(a) - rest + j
                sums[at] += b[len(b) - 1 - j]
                groups[at] = ga[at] + gb[len(b) - 1 - j]
        if len(sums) > 1:
            order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
            sums, groups = [sums[i] for i in order], [groups[i] for i in order]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, tick, sums, groups))
        tick += 1
    window = np.zeros(n, np.int64)
    _, _, sums, groups = heap[0] if heap else (0, 0, [], [])
    for w, g in enumerate(groups):
        window[g] = w
    return window, np.array(sums, np.int64)


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item so that none exceeds the capacity; items are no larger than it."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    total = int(sizes.sum())
    windows = max(1, -(-total // capacity), int((2 * sizes > capacity).sum()))
    while True:
        window, sums = differencing(sizes, windows)
        over = int(np.maximum(sums - capacity, 0).sum())
        if not over:
            return window
        windows += max(1, over // capacity)


PACKED = "pack_id string, container_id string, doc_id bigint, piece bigint, token_start bigint, n_tokens bigint"


def packed(sizes: DataFrame, capacities: list[tuple[str, int]], windows: int = WINDOWS) -> DataFrame:
    """Containers of each capacity with all documents of ``sizes`` (doc_id, n_tokens).

    One row per piece: pack_id, container_id, doc_id, piece (from 0), token_start
    and n_tokens. A document longer than the capacity is cut into pieces of
    exactly the capacity, each a container, and a rest that is packed as an item;
    no other document is cut. Documents without tokens are packed as items of
    size 0, a null doc_id as any other. ``capacities`` is a short list; a capacity
    below 1 is refused. Repeated doc_ids are packed as they come.
    """
    if any(c < 1 for _, c in capacities):
        raise ValueError("a capacity must be at least one token")
    # Null and repeated ids are told apart by a key of the row, which the checkpoint fixes.
    row = F.concat_ws(".", F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.monotonically_increasing_id().cast("string"))
    sizes = cut(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), row.alias("_row")))
    listed = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(int(c)).cast("bigint").alias("capacity")) for p, c in capacities]))
    each = sizes.withColumn("_p", listed).select("doc_id", "n_tokens", "_row", "_p.pack_id", "_p.capacity")
    whole = F.floor(F.col("n_tokens") / F.col("capacity"))
    rest = F.col("n_tokens") - whole * F.col("capacity")
    full = (
        each.where("n_tokens > capacity OR n_tokens = capacity")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)))
        .select("pack_id", F.concat_ws("-", "_row", "piece").alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"))
    )
    items = each.select("pack_id", "capacity", "doc_id", "_row", whole.alias("piece"), (whole * F.col("capacity")).alias("token_start"), rest.alias("n_tokens")).where("n_tokens > 0 OR token_start = 0")
    # One small row per capacity comes to the driver: how much there is to pack.
    totals = {r["pack_id"]: r["t"] for r in items.groupBy("pack_id").agg(F.sum("n_tokens").alias("t")).collect()}
    # By its hash an item finds its block; a block holds some windows' worth of tokens.
    blocks = F.lit(1)
    for p, c in capacities:
        blocks = F.when(F.col("pack_id") == p, F.lit(max(1, round((totals.get(p) or 0) / (c * windows))))).otherwise(blocks)
    block = F.pmod(F.xxhash64("_row", "pack_id"), blocks)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable", ignore_index=True)
        window = fill(pdf["n_tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]))
        name = f"{pdf['block'].iloc[0]}-"
        return pdf.assign(container_id=[f"{name}{w}" for w in window])[["pack_id", "container_id", "doc_id", "piece", "token_start", "n_tokens"]]

    return full.unionByName(items.withColumn("block", block).drop("_row").groupBy("pack_id", "block").applyInPandas(run, PACKED))


def fill_report(packs: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """Per pack: containers, tokens, and the share of room that is used."""
    capacity = F.lit(None).cast("bigint")
    for p, c in capacities:
        capacity = F.when(F.col("pack_id") == p, F.lit(int(c)).cast("bigint")).otherwise(capacity)
    held = packs.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    return held.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest")).withColumn("fill", F.col("n_tokens") / (F.col("n_containers") * capacity))
