"""Stream queries over events, run to the end of the present input, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import state as S

_NTZ = "timestamp_ntz"


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS start, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1, 2")
def stream_last_in_window(spark, d):
    rows = S.last_in_window(S.read_events(spark, f"{d}/events.parquet"), "user_id", "1 day", ["ts", "event_id"], ["event_type"], late="7 days")
    return S.run_now(rows, ["user_id", "start"], name="last").select("user_id", F.col("start").cast(_NTZ).alias("start"), "event_type")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NULL OR was <> event_type")
def stream_changes_only(spark, d):
    events = S.read_events(spark, f"{d}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    return S.changes_now(events, "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query(
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOURS)::INT AS new FROM events)) GROUP BY user_id, s"""
)
def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").cast(_NTZ).alias("start"), "n")


@query(
    """SELECT event_type, g::TIMESTAMP AS start, count(*) AS n, round(sum(value),3) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOURS]) AS g FROM events) GROUP BY 1, 2"""
)
def sliding_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("event_type", F.window("ts", "24 hours", "12 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return out.select("event_type", F.col("window.start").cast(_NTZ).alias("start"), "n", "total")
