"""One row of many: latest, first, best by evidence, and groups whose rows contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest ``order`` for each key, by an aggregation of structs (partial before the shuffle, so hot keys are cheap)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))).alias("_b"))
    return best.select(*keys, "_b.row.*").select(*df.columns)


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))).alias("_b"))
    return best.select(*keys, "_b.row.*").select(*df.columns)


def open_close(df: DataFrame, key: str, at: str, value: str, tie: str, until: Column) -> DataFrame:
    """First and last observation before ``until``, of one instant the last by ``tie``; keys with one instant are left out."""
    seen = df.where(F.col(at) < until)
    g = seen.groupBy(key).agg(F.min(F.struct(F.col(at), (-F.col(tie)).alias("t"), F.col(value).alias("v"))).alias("a"), F.max(F.struct(F.col(at), F.col(tie).alias("t"), F.col(value).alias("v"))).alias("z"), F.countDistinct(at).alias("instants"))
    return g.where("instants >= 2").select(key, F.col("a.v").alias("open"), F.col("z.v").alias("close"), "instants")


def one_if_agreed(df: DataFrame, keys: list[str], claim: str, rank: list[Column]) -> DataFrame:
    """The best row of each group by ``rank``; groups whose rows claim different things are dropped whole."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max(F.struct(*[r.alias(f"_r{i}") for i, r in enumerate(rank)], F.struct(*rest).alias("row"))).alias("_b"), F.countDistinct(claim).alias("_claims"))
    return g.where("_claims = 1").select(*keys, "_b.row.*")


def contradictions(df: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys that come with more than one digest."""
    return df.groupBy(key).agg(F.countDistinct(digest).alias("digests"), F.count(F.lit(1)).alias("rows")).where("digests > 1")


def merge_sources(first_source: DataFrame, second: DataFrame, keys: list[str], quality: Column, fresh: str, terminal: dict[str, Column]) -> DataFrame:
    """Of two sources the row of the best quality, then the freshest; fields in ``terminal`` come from the freshest row where their condition holds."""
    both = first_source.withColumn("_s", F.lit(1)).unionByName(second.withColumn("_s", F.lit(2)))
    rest = [c for c in first_source.columns if c not in keys]
    picks = [F.max(F.when(cond, F.struct(F.col(fresh).alias("f"), F.col("_s").alias("s"), F.col(c).alias("v"))))["v"].alias(f"_t_{c}") for c, cond in terminal.items()]
    g = both.groupBy(*keys).agg(F.max(F.struct(quality.alias("q"), F.col(fresh).alias("f"), F.col("_s").alias("s"), F.struct(*rest).alias("row"))).alias("_b"), *picks)
    return g.select(*keys, *[F.coalesce(f"_t_{c}", f"_b.row.{c}").alias(c) if c in terminal else F.col(f"_b.row.{c}").alias(c) for c in rest])


def work_queue(df: DataFrame, tracked: Column, day: str, tie: str, most: int) -> DataFrame:
    """Tracked rows from the oldest, then the backlog from the newest day, ``most`` in all (a bounded top-k)."""
    return df.withColumn("_t", F.when(tracked, 0).otherwise(1)).withColumn("_d", F.when(tracked, F.col(day)).otherwise(-F.col(day))).orderBy("_t", "_d", tie).limit(most).drop("_t", "_d")


def duplicate_groups(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Size of each row's group and its place in it."""
    return df.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
