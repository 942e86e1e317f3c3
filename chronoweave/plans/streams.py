"""Queries that replay a table as a stream. Each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.sources.tables import shared_folder, table
from chronoweave.streaming.sessions import gap_sessions

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH_HOUR = 473_352  # 2024-01-01 in hours since 1970


def sessions_streamed(s, d):
    """W21 in event time: what is known of the sessions of users once the stream has come to the end of the table."""
    at, old = shared_folder(s, "sessions"), s.conf.get(STORE)
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a stream takes a file by a pattern alone
    out = gap_sessions(stream, "user_id", "ts", "event_id", "event_type", 3600, 5, "1 hour")
    s.conf.set(STORE, ROCKS)
    try:
        run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    finally:
        s.conf.set(STORE, old)
    run.awaitTermination()
    done = s.read.schema(out.schema).parquet(f"{at}/out")
    return done.select(F.col("key").alias("user_id"), "label", (F.col("start") - EPOCH_HOUR).alias("start"), "length")


SESSIONS = """
WITH f AS (SELECT user_id, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts))::BIGINT AS hour, arg_min(event_type, (ts, event_id)) AS label FROM events GROUP BY 1, 2),
a AS (SELECT *, lag(label) OVER w AS pl, lag(hour) OVER w AS ph FROM f WINDOW w AS (PARTITION BY user_id ORDER BY hour)),
b AS (SELECT *, sum((ph IS NULL OR pl <> label OR hour - ph > 5)::INT) OVER (PARTITION BY user_id ORDER BY hour) AS k FROM a),
r AS (SELECT user_id, label, k, min(hour) AS start, max(hour) AS last, count(*) AS length FROM b GROUP BY 1, 2, 3),
n AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS next FROM r),
e AS (SELECT epoch_ms(max(ts)) - 3600000 - epoch_ms(TIMESTAMP '2024-01-01') AS seen FROM events)
SELECT user_id, label, start, length FROM n, e WHERE least(coalesce(next, last + 5), last + 5) + 1 <= seen / 3600000.0"""

QUERIES = {"sessions_streamed": (sessions_streamed, SESSIONS)}
