"""Event-time queries (survey N), as batch and as stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.session import cut, scratch
from scholia.sources.tables import table
from scholia.streaming import windows as S

FIELDS = ("event_id", "ts", "user_id", "event_type", "value")


def _events(spark, sf):
    return table(spark, sf, "events").select(*FIELDS)


def n_tumbling(spark, sf):
    return S.tumbling(_events(spark, sf))


def n_sliding(spark, sf):
    return S.sliding(_events(spark, sf))


def n_sessions(spark, sf):
    return S.sessions(_events(spark, sf))


def n_tumbling_stream(spark, sf):
    """The tumbling windows computed by a stream over the same files."""
    src = S.stream_of(spark, sf, table(spark, sf, "events").schema, "events.parquet").select(*FIELDS).withColumn("ts", F.col("ts").cast("timestamp"))
    with scratch(spark) as folder:
        found = cut(S.run_to_end(S.tumbling(src), f"{folder}/out", f"{folder}/checkpoint"))
    return found.withColumn("started", F.col("started").cast("timestamp_ntz"))


def n_limiter(spark, sf):
    """At most three events of a user in any six hours; refused ones do not count."""
    return S.limiter(_events(spark, sf), 3, 6 * 3600.0).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


Q = (n_tumbling, n_sliding, n_sessions, n_tumbling_stream, n_limiter)


def queries():
    return {q.__name__: q for q in Q}


def oracle_sql():
    tumbling = "SELECT date_trunc('day', ts) AS started, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
    return {
        "n_limiter": "WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), r AS (SELECT event_id, user_id, ts, n, true AS admitted, [ts] AS held FROM e WHERE n = 1 UNION ALL SELECT event_id, user_id, ts, n, len(h) < 3, CASE WHEN len(h) < 3 THEN list_append(h, ts) ELSE h END FROM (SELECT e.*, list_filter(r.held, lambda t: t > e.ts - INTERVAL 6 HOUR) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)) SELECT event_id, user_id, ts, admitted FROM r",
        "n_tumbling": tumbling,
        "n_tumbling_stream": tumbling,
        "n_sliding": "SELECT started, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * k AS started FROM events, generate_series(0, 3) g(k)) GROUP BY 1",
        "n_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM i GROUP BY user_id, k",
    }
