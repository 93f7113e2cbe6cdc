"""Stakes, bankroll paths, resampling and risk measures.

Paths whose stakes do not depend on the bankroll are running sums; compounding
without floors is a running sum of logarithms; only paths with floors or bust
rules fold, one path at a time. Randomness is a hash of seed, simulation and
position, so every run and engine draws the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.rates import kelly
from pitwise.operators.prefix import running


def best_side(p: Column, odds1: Column, odds2: Column) -> dict[str, Column]:
    """The side with the greater raw edge (probability minus one over the odds), its edge, probability and odds."""
    e1, e2 = p - 1 / odds1, (1 - p) - 1 / odds2
    first = e1 >= e2
    return {"edge": F.greatest(e1, e2), "side": F.when(first, 1).otherwise(2), "side_p": F.when(first, p).otherwise(1 - p), "side_odds": F.when(first, odds1).otherwise(odds2)}


def replay(df: DataFrame, p: str, y: str, order: str, mode: str = "flat", threshold: float = 0.02, mult: float = 0.18, cap: float = 0.05, bankroll: float = 1000.0) -> DataFrame:
    """Bets of a non-compounding replay in the order of a numeric key, with stake, profit, running equity, peak and drawdown."""
    s = best_side(F.col(p), F.col("odds1"), F.col("odds2"))
    rows = df.select("*", *[v.alias(k) for k, v in s.items()]).where(F.col("edge") >= threshold)
    stake = F.lit(1.0) if mode == "flat" else F.least(mult * kelly(F.col("side_p"), F.col("side_odds")), F.lit(cap)) * bankroll
    won = (F.col("side") == 1) == (F.col(y) == 1)
    rows = rows.withColumn("stake", stake).withColumn("profit", F.when(won, F.col("stake") * (F.col("side_odds") - 1)).otherwise(-F.col("stake")))
    rows = running(running(rows, order, [], "equity", "profit", bankroll), order, [], "peak", "equity", kind="max")
    return rows.withColumn("drawdown", F.try_divide(F.col("peak") - F.col("equity"), F.col("peak")))


def replay_summary(df: DataFrame, p: str, y: str, mode: str = "flat", **kw) -> DataFrame:
    """Bets, staked, profit and return of a replay, without the path (one aggregation, no order)."""
    threshold, mult, cap, bankroll = kw.get("threshold", 0.02), kw.get("mult", 0.18), kw.get("cap", 0.05), kw.get("bankroll", 1000.0)
    s = best_side(F.col(p), F.col("odds1"), F.col("odds2"))
    rows = df.select("*", *[v.alias(k) for k, v in s.items()]).where(F.col("edge") >= threshold)
    stake = F.lit(1.0) if mode == "flat" else F.least(mult * kelly(F.col("side_p"), F.col("side_odds")), F.lit(cap)) * bankroll
    won = (F.col("side") == 1) == (F.col(y) == 1)
    rows = rows.withColumn("stake", stake).withColumn("profit", F.when(won, F.col("stake") * (F.col("side_odds") - 1)).otherwise(-F.col("stake")))
    return rows.groupBy(*kw.get("keys", [])).agg(F.count(F.lit(1)).alias("bets"), F.sum("stake").alias("staked"), F.sum("profit").alias("profit"), F.try_divide(F.sum("profit"), F.sum("stake")).alias("roi"))


def drawdown(df: DataFrame, equity: str, keys: list[str], order: list[str]) -> DataFrame:
    """``peak`` so far and ``drawdown`` below it, as a share of the peak."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("peak", F.max(equity).over(w)).withColumn("drawdown", F.try_divide(F.col("peak") - F.col(equity), F.col("peak")))


def fee_profit(price: Column, won: Column, fee: float = 0.07) -> Column:
    """Profit of one contract bought at ``price``, with a taker fee on wins."""
    return F.when(won, 1 - price - fee * price * (1 - price)).otherwise(-price)


def block_stakes(df: DataFrame, block: str, wish: str, budget: float, least: float = 0.0) -> DataFrame:
    """Stakes of blocks in order under one budget: a block gets what is left of it and is scaled down to that.

    What is left before a block is the budget less all earlier wishes, never
    below zero, so no block waits for the one before it.
    """
    totals = df.where(F.col(block).isNotNull()).groupBy(block).agg(F.sum(wish).alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    given = F.greatest(F.lit(0.0), F.least(F.col("_total"), budget - before))
    scale = totals.withColumn("_scale", F.when(given >= least, F.try_divide(given, F.col("_total"))).otherwise(0.0))
    return df.join(scale.select(block, "_scale"), block).withColumn("stake", F.col(wish) * F.coalesce("_scale", F.lit(0.0))).drop("_scale")


def proportional(df: DataFrame, block: list[str], weight: str, share: float = 1.0) -> DataFrame:
    """A block's stake divided by weight."""
    return df.withColumn("stake", F.coalesce(share * F.try_divide(F.col(weight), F.sum(weight).over(Window.partitionBy(*block))), F.lit(0.0)))


def compounded(df: DataFrame, keys: list[str], order: list[str], growth: str, start: float = 1000.0) -> DataFrame:
    """Equity of a compounding path without floors, and its logarithm: a running sum of logarithms of one plus each return.

    A long path's equity leaves the range of doubles (0 or infinity); ``log_equity`` does not. Logarithms are summed as
    decimals of 16 places, so a sum does not drift with the path's length.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.ln(1 + F.col(growth)).cast("decimal(28,16)")).over(w).cast("double")
    return df.withColumn("_total", total).withColumns({"equity": start * F.exp("_total"), "log_equity": math.log(start) + F.col("_total")}).drop("_total")


def compounded_with_floor(df: DataFrame, keys: list[str], order: list[str], fraction: str, odds: str, won: str, start: float = 1000.0, least: float = 1.0, bust: float = 10.0) -> DataFrame:
    """Final equity, bets placed and bust flag of paths with a minimum stake: a fold over each path's ordered bets."""
    bets = F.array_sort(F.collect_list(F.struct(*order, F.col(fraction).alias("_f"), F.col(odds).alias("_o"), F.col(won).cast("int").alias("_w"))))
    zero = F.struct(F.lit(start).alias("e"), F.lit(0).alias("n"), F.lit(False).alias("b"))

    def step(a, x):
        stake = a["e"] * x["_f"]
        play = ~a["b"] & (stake >= least)
        e = F.when(play, a["e"] + F.when(x["_w"] == 1, stake * (x["_o"] - 1)).otherwise(-stake)).otherwise(a["e"])
        return F.struct(e.alias("e"), (a["n"] + play.cast("int")).alias("n"), (a["b"] | (e <= bust)).alias("b"))

    g = df.groupBy(*keys).agg(F.aggregate(bets, zero, step).alias("r"))
    return g.select(*keys, F.col("r.e").alias("equity"), F.col("r.n").alias("bets"), F.col("r.b").alias("bust"))


def draw(seed: Column, n: Column) -> Column:
    """A whole number in 0..n-1 from the first eight hex digits of an MD5."""
    return F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint") % n


def bootstrap(df: DataFrame, number: str, size: int, sims: int, seed: int) -> DataFrame:
    """``sims`` samples of ``size`` rows with replacement: (sim, place) drawn by hash and joined to rows by their number 0..size-1."""
    spark = df.sparkSession
    drawn = spark.range(sims * size).select((F.col("id") / size).cast("bigint").alias("sim"), (F.col("id") % size).alias("place"))
    drawn = drawn.withColumn("_n", draw(F.concat_ws(":", F.lit(str(seed)), F.col("sim").cast("string"), F.col("place").cast("string")), F.lit(size)))
    # the rows, a share of them in each task, are the hashed side: the draws, many times as many, are neither sorted nor held
    return drawn.join(df.withColumnRenamed(number, "_n").hint("shuffle_hash"), "_n").drop("_n")


def risk(returns: Column, per_year: float = 365.0) -> dict[str, Column]:
    """Measures of a column of returns, to be aggregated by group."""
    down = F.sqrt(F.avg(F.pow(F.least(returns, F.lit(0.0)), 2)))
    return {
        "mean": F.avg(returns),
        "sharpe": F.try_divide(F.avg(returns), F.stddev_samp(returns)) * per_year**0.5,
        "sortino": F.try_divide(F.avg(returns), down) * per_year**0.5,
        "profit_factor": F.try_divide(F.sum(F.greatest(returns, F.lit(0.0))), -F.sum(F.least(returns, F.lit(0.0)))),
        "hit_rate": F.avg((returns > 0).cast("double")),
        "geometric_mean": F.exp(F.avg(F.log1p(returns))) - 1,
    }


def calendar(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """One row a day from each key's first to its last: the last known value carried forward, and its change against the day before."""
    ends = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_z"))
    spine = ends.select(*keys, F.explode(F.sequence("_a", "_z")).alias(day))
    w = Window.partitionBy(*keys).orderBy(day)
    filled = spine.join(df, [*keys, day], "left").withColumn(value, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("change", F.try_divide(F.col(value), F.lag(value).over(w)) - 1)
