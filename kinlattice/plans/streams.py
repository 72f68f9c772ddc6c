"""Stream operators in their batch form, which SQL can state; tests run the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as S
from .registry import query, table


@query(
    "t03_idempotent_dedup",
    """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
       k(user_id, event_type, rn, last, event_id, kept) AS (SELECT user_id, event_type, rn, ts, event_id, true FROM e WHERE rn = 1 UNION ALL
         SELECT e.user_id, e.event_type, e.rn, CASE WHEN e.ts >= k.last + INTERVAL 600 MINUTE THEN e.ts ELSE k.last END, e.event_id, e.ts >= k.last + INTERVAL 600 MINUTE
         FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.rn = k.rn + 1)
       SELECT user_id, event_type, event_id FROM k WHERE kept""",
)
def _(spark, d):
    return S.first_within_batch(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 600)


@query(
    "t04_hourly_jobs",
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
       k(user_id, rn, last, event_id, kept) AS (SELECT user_id, rn, ts, event_id, true FROM e WHERE rn = 1 UNION ALL
         SELECT e.user_id, e.rn, CASE WHEN e.ts >= k.last + INTERVAL 60 MINUTE THEN e.ts ELSE k.last END, e.event_id, e.ts >= k.last + INTERVAL 60 MINUTE FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
       SELECT user_id, event_id FROM k WHERE kept""",
)
def _(spark, d):
    return S.first_within_batch(table(spark, d, "events"), ["user_id"], "ts", "event_id", 60)


@query("t05_weekly_digest", "SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return S.weekly(table(spark, d, "events"), ["event_type"], "ts").select("event_type", F.date_format("week", "yyyy-MM-dd").alias("week"), "n")


@query("t06_daily_counters", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return S.daily(table(spark, d, "events"), ["user_id"], "ts").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query(
    "t02_until_terminal",
    """SELECT user_id, event_id FROM (SELECT *, coalesce(max((event_type = 'error' AND value > 200)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM events) WHERE over_ = 0""",
)
def _(spark, d):
    stage = F.when((F.col("event_type") == "error") & (F.col("value") > 200), "failed").otherwise("running")
    return S.until_terminal(table(spark, d, "events").withColumn("stage", stage), "user_id", "ts", "event_id", "stage").select("user_id", "event_id")
