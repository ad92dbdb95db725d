"""Streaming queries over events: an extension, no operator of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.shared import fresh_path
from weft.plans.fixtures import query, t
from weft.streaming import windows as W


def events(s, d):
    return W.read_events(s, d, "events.parquet", t(s, d, "events").schema)


@query("x01_tumbling_windows", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS a, event_type, count(*)::BIGINT AS n, sum(round(value * 1000)::BIGINT)::BIGINT AS v FROM events GROUP BY 1, 2)
SELECT strftime(a, '%Y-%m-%d %H:%M') AS start, event_type, n, v FROM w WHERE a + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def x01(s, d):
    df = W.windowed(events(s, d), "ts", ["event_type"], "1 hour", None, "10 minutes", n=F.count("*"), v=F.sum(F.round(F.col("value") * 1000).cast("long")))
    out = W.run_available(df, fresh_path(s, "stream"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "v")


@query("x02_lag_filter", None)
def x02(s, d):
    out = W.run_available(W.lag_filter(events(s, d), "event_type", "ts", "value", 0.25), fresh_path(s, "stream"), "update")
    return out.groupBy("event_type").agg(F.max_by("y", "n").alias("y"), F.max("n").alias("n")).withColumn("y", F.round("y", 6))


@query("x03_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
z AS (SELECT user_id, k, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*)::BIGINT AS n FROM k GROUP BY 1, 2) SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n FROM z WHERE b <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def x03(s, d):
    out = W.run_available(W.sessions(events(s, d), "ts", ["user_id"], "30 minutes", "10 minutes"), fresh_path(s, "stream"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
