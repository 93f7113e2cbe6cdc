"""Streaming forms of the polling pipeline: de-duplication, first and last prices, late settlement, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_time(stream: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as a zoned timestamp with a watermark."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first delivery of each key; state goes once the watermark has passed."""
    return stream.dropDuplicatesWithinWatermark(keys)


def open_close(stream: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """Running first and last value of each key: two structs of state, whatever the number of observations."""
    first, last = F.min(F.struct(F.col(at), F.col(tie), F.col(value))), F.max(F.struct(F.col(at), F.col(tie), F.col(value)))
    return stream.groupBy(key).agg(first[value].alias("open"), last[value].alias("close"), F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, at: str, length: str, slide: str | None, keys: list[str]) -> DataFrame:
    """Counts and sums over tumbling or sliding windows."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    g = stream.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str]) -> DataFrame:
    """Runs of events with no gap as long as ``gap``: re-posts of one thing."""
    g = stream.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *keys, "n")


def reposts(stream: DataFrame, at: str, gap: str, keys: list[str], value: str, tie: str) -> DataFrame:
    """Observations of one thing that follow each other within ``gap``: the opening value stays, the latest is refreshed. State is two structs for each open run."""
    row = F.struct(F.col(at), F.col(tie), F.col(value))
    g = stream.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count(F.lit(1)).alias("posts"))
    return g.select(*keys, F.col(f"first.{tie}").alias("opened_by"), F.col(f"first.{value}").alias("opening"), F.col(f"last.{value}").alias("latest"), "posts")


def settled(predictions: DataFrame, results: DataFrame, key: str, within: str) -> DataFrame:
    """Predictions with results that come up to ``within`` later: a stream-stream join whose state the watermarks bound."""
    p, r = predictions.alias("p"), results.alias("r")
    near = (F.col(f"p.{key}") == F.col(f"r.{key}")) & (F.col("r.ts") >= F.col("p.ts")) & (F.col("r.ts") <= F.col("p.ts") + F.expr(f"interval {within}"))
    return p.join(r, near).select(F.col("p.event_id").alias("prediction"), F.col("r.event_id").alias("result"))
