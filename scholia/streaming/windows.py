"""Structured Streaming operators over events: windowed counts with late data, and a limiter by key.

The same transformations run over a batch DataFrame, so a stream and a batch
of the same rows give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = "2 hours") -> DataFrame:
    """Events and values by window and type; of a stream, rows later than ``late`` are dropped by the watermark."""
    df = events.withWatermark("ts", late) if events.isStreaming and late else events
    g = df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("started"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours", late: str | None = "2 hours") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming and late else events
    return df.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started"), "n")


def sessions(events: DataFrame, gap: str = "1 day", late: str | None = "2 hours") -> DataFrame:
    """Runs of a user's events with gaps under ``gap``."""
    df = events.withWatermark("ts", late) if events.isStreaming and late else events
    g = df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("started"), "n")


def admitted_times(held: list[float], times: list[float], limit: int, span: float) -> tuple[list[bool], list[float]]:
    """Which of a key's events are admitted: fewer than ``limit`` admitted ones in the ``span`` seconds before. Refused ones do not count."""
    out = []
    for t in times:
        held = [h for h in held if h > t - span]
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


LIMITED = "event_id bigint, user_id bigint, ts timestamp, admitted boolean"


def limiter(events: DataFrame, limit: int, span: float) -> DataFrame:
    """Each event with whether a sliding-window limiter admits it (batch).

    A key's events pass in order of time through one task, batch by batch; what
    is held is the key's admitted times within the span, at most ``limit``
    numbers, so a key of any size fits. Events without a key or time are left out.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, []
        for pdf in batches:
            ok: list[bool] = []
            ids = pdf["user_id"].to_numpy()
            times = [t.timestamp() for t in pdf["ts"]]
            at = 0
            while at < len(ids):
                stop = at
                while stop < len(ids) and ids[stop] == ids[at]:
                    stop += 1
                if ids[at] != user:
                    user, held = ids[at], []
                part, held = admitted_times(held, times[at:stop], limit, span)
                ok += part
                at = stop
            yield pdf.assign(admitted=ok)

    src = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return src.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, LIMITED)


def limiter_stream(events: DataFrame, limit: int, span: float, late: str = "1 hour") -> DataFrame:
    """The limiter over a stream: the admitted times of each key are its state, kept while they matter.

    Events that are older than the newest by more than ``late`` are dropped by the
    watermark; a key's state goes once the watermark has passed its last
    admitted time by ``span`` seconds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: list[float] = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ok, held = admitted_times(held, [t.timestamp() for t in rows["ts"]], limit, span)
        state.update((held,))
        state.setTimeoutTimestamp(max(int((max(held, default=0.0) + span) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(admitted=ok)[["event_id", "user_id", "ts", "admitted"]]

    src = events.select("event_id", "user_id", "ts").withWatermark("ts", late)
    return src.groupBy("user_id").applyInPandasWithState(step, LIMITED, "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """A bounded stream run until all that is there is read; its result as Parquet files in ``folder``.

    Each batch is written under its number, so one that is run again after a
    failure replaces itself; in complete mode the last batch is the result.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number if mode != 'complete' else 0}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/batch=*")


def stream_of(spark: SparkSession, folder: str, schema: Any, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)
