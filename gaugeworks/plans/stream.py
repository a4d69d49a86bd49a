"""The streaming windows on the events table as it lies: the same plans, in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import frames
from ..status import q9 as Q9
from ..streaming import windows as W
from .evaluation import q9


def events(s, d):
    return frames.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def day(df):
    return df.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", Q9("mean").alias("mean"))


QUERIES = {
    "tumbling_windows": lambda s, d: day(W.tumbling(events(s, d))),
    "sliding_windows": lambda s, d: day(W.sliding(events(s, d))),
    "session_windows": lambda s, d: W.sessions(events(s, d), "1 hour").groupBy("n").agg(F.count("*").alias("sessions")),
}
SQL = {
    "tumbling_windows": f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, {q9('avg(value)')} AS mean FROM events GROUP BY 1, 2",
    "sliding_windows": f"SELECT strftime(date_trunc('day', ts) - to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS start, event_type, count(*) AS n, {q9('avg(value)')} AS mean FROM events, range(7) t(k) GROUP BY 1, 2",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT n, count(*) AS sessions FROM c GROUP BY n""",
}
