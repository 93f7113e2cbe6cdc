"""Queries that run as Structured Streaming jobs over what is available (family R); the windows are an extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.plans.point_in_time import r6
from pitwise.session import table
from pitwise.streaming import operators as st
from pitwise.streaming.run import drain, read_stream


def stream(spark, sf):
    return st.with_time(read_stream(spark, sf, "events"))


def r02(spark, sf):
    s = stream(spark, sf)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return drain(st.deduplicated(twice, ["event_id"]).select("event_id", "user_id", "event_type"))


R02 = "SELECT event_id, user_id, event_type FROM events"


def r03(spark, sf):
    return drain(st.open_close(stream(spark, sf), "user_id", "ts", "value", "event_id"), "complete")


R03 = "SELECT user_id, arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY user_id"


def r04(spark, sf):
    g = stream(spark, sf).groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("opening"))
    return drain(g, "complete")


R04 = "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS opening FROM events GROUP BY ALL"


def r05(spark, sf):
    """The stream settles what it can; the batch repair adds the predictions that stay open."""
    e = lambda kind: stream(spark, sf).where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    met = drain(st.settled(e("click"), e("purchase"), "user_id", "6 hours"))
    clicks = table(spark, sf, "events").where("event_type = 'click'").select(F.col("event_id").alias("prediction"))
    return clicks.join(met.groupBy("prediction").agg(F.min("result").alias("result")), "prediction", "left")


R05 = "SELECT p.event_id AS prediction, min(r.event_id) AS result FROM events p LEFT JOIN events r ON r.event_type = 'purchase' AND p.user_id = r.user_id AND r.ts >= p.ts AND r.ts <= p.ts + INTERVAL 6 HOUR WHERE p.event_type = 'click' GROUP BY 1"


def r06(spark, sf):
    return drain(st.reposts(stream(spark, sf), "ts", "3 days", ["user_id", "event_type"], "value", "event_id"), "complete")


R06 = """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 DAY THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS opened_by, arg_min(value, (ts, event_id)) AS opening, arg_max(value, (ts, event_id)) AS latest, count(*) AS posts FROM s GROUP BY user_id, event_type, s"""


def r07(spark, sf):
    return drain(st.windowed(stream(spark, sf), "ts", "1 day", None, ["user_id"]), "complete")


R07 = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def tumbling(spark, sf):
    return drain(st.windowed(stream(spark, sf), "ts", "1 hour", None, ["event_type"]), "complete")


TUMBLING = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def sliding(spark, sf):
    return drain(st.windowed(stream(spark, sf), "ts", "2 hours", "1 hour", ["event_type"]), "complete")


SLIDING = "SELECT strftime(date_trunc('hour', ts) - to_hours(b), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS b) GROUP BY ALL"


def session(spark, sf):
    return drain(st.sessions(stream(spark, sf), "ts", "3 hours", ["user_id"]), "complete")


SESSION = """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, s"""


def r10(spark, sf):
    """Health from the latest run of each source."""
    g = stream(spark, sf).groupBy("event_type").agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n"))
    rows = drain(g, "complete")
    age = F.timestamp_diff("MINUTE", F.col("latest"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return rows.select("event_type", age.alias("age_minutes"), F.when(age > 90, "stale").otherwise("healthy").alias("state"), "n")


R10 = "SELECT event_type, date_sub('minute', max(ts), TIMESTAMP '2024-01-31 00:00:00') AS age_minutes, CASE WHEN date_sub('minute', max(ts), TIMESTAMP '2024-01-31 00:00:00') > 90 THEN 'stale' ELSE 'healthy' END AS state, count(*) AS n FROM events GROUP BY 1"

QUERIES = {
    "r02_stream_dedup": (r02, R02), "r03_stream_open_close": (r03, R03), "r04_opening": (r04, R04), "r05_late_settlement": (r05, R05), "r06_reposts": (r06, R06), "r07_daily_flush": (r07, R07),
    "r_tumbling": (tumbling, TUMBLING), "r_sliding": (sliding, SLIDING), "r_session": (session, SESSION), "r10_freshness": (r10, R10),
}
