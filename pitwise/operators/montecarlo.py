"""Simulated orders of a path of whole-number gains, by index permutations and mergeable path statistics.

A stretch of a path is four numbers: its sum, its lowest and highest running sum, and
its deepest fall from a high (each counted from the stretch's start, where the sum is
zero). Two stretches join into one, so bets are summed up by week, or by slot of a
permutation, once or once a simulation, and only stretches are put in order: no
simulation sorts its bets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.operators.simulate import draw

STRETCH = ("total", "low", "high", "fall")


def stretches(df: DataFrame, keys: list[str], order: list[str], gain: str) -> DataFrame:
    """One stretch for each key: its rows in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = df.select(*keys, *order, F.sum(gain).over(w).alias("_run"), F.col(gain).alias("_gain"))
    runs = runs.withColumn("_top", F.greatest(F.lit(0), F.max("_run").over(w)))
    return runs.groupBy(*keys).agg(F.sum("_gain").alias("total"), F.least(F.lit(0), F.min("_run")).alias("low"), F.greatest(F.lit(0), F.max("_run")).alias("high"), F.max(F.col("_top") - F.col("_run")).alias("fall"))


def joined(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The stretches of each key, in order, as one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("_at", before)
    top = F.greatest(F.lit(0), F.coalesce(F.max(F.col("_at") + F.col("high")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_top", top)
    return rows.groupBy(*keys).agg(
        F.sum("total").alias("total"), F.min(F.col("_at") + F.col("low")).alias("low"), F.max(F.col("_at") + F.col("high")).alias("high"),
        F.max(F.greatest(F.col("fall"), F.col("_top") - F.col("_at") - F.col("low"))).alias("fall"))


def prime_from(n: int) -> int:
    """The first prime that is ``n`` or more, by trial division."""
    p = max(2, n)
    while any(p % d == 0 for d in range(2, int(p**0.5) + 1)):
        p += 1
    return p


def permuted(number: Column, sim: Column, prime: int, seed: int) -> Column:
    """A place for every number below ``prime``, in another order in every simulation: a * number + b, modulo the prime."""
    part = lambda name, n: draw(F.concat_ws(":", F.lit(f"{seed}{name}"), sim.cast("string")), F.lit(n))
    return (number * (part("a", prime - 1) + 1) + part("b", prime)) % prime


def _simulated(df: DataFrame, sims: int) -> DataFrame:
    return df.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))


def numbered_blocks(df: DataFrame, block: str, order: list[str], gain: str) -> tuple[DataFrame, int]:
    """The stretch of every block with its number from 0, and how many there are (weeks or days: the calendar bounds them)."""
    blocks = stretches(df, [block], order, gain)
    return blocks.withColumn("number", (F.row_number().over(Window.orderBy(block)) - 1).cast("bigint")).drop(block), blocks.count()


def block_bootstrap(df: DataFrame, block: str, order: list[str], gain: str, sims: int, seed: int) -> DataFrame:
    """``sims`` paths of as many blocks as there are, drawn with replacement."""
    blocks, size = numbered_blocks(df, block, order, gain)
    if not size:
        return _simulated(blocks, sims).groupBy("sim").agg(*[F.sum(c).alias(c) for c in STRETCH])
    places = _simulated(df.sparkSession.range(size).select(F.col("id").alias("place")), sims)
    drawn = places.withColumn("number", draw(F.concat_ws(":", F.lit(str(seed)), F.col("sim").cast("string"), F.col("place").cast("string")), F.lit(size)))
    return joined(drawn.join(blocks, "number"), ["sim"], ["place"])


def block_permutation(df: DataFrame, block: str, order: list[str], gain: str, sims: int, seed: int) -> DataFrame:
    """``sims`` paths with the blocks in another order."""
    blocks, size = numbered_blocks(df, block, order, gain)
    place = permuted(F.col("number"), F.col("sim"), prime_from(size), seed)
    return joined(_simulated(blocks, sims).withColumn("place", place), ["sim"], ["place"])


def row_permutation(df: DataFrame, number: str, count: int, gain: str, sims: int, seed: int, slots: int = 256) -> DataFrame:
    """``sims`` paths with all rows in another order; ``number`` counts them from 0.

    Places are cut into ``slots`` runs, which are summed up beside each other; a simulation then joins its runs.
    """
    prime = prime_from(count)
    rows = _simulated(df.select(F.col(number).alias("_n"), F.col(gain).alias("_g")), sims)
    rows = rows.withColumn("place", permuted(F.col("_n"), F.col("sim"), prime, seed)).withColumn("slot", F.floor(F.col("place") * slots / prime))
    return joined(stretches(rows, ["sim", "slot"], ["place"], "_g"), ["sim"], ["slot"])


def union(parts: dict[str, DataFrame]) -> DataFrame:
    """All modes in one table, with ``mode``."""
    return reduce(DataFrame.unionByName, [df.withColumn("mode", F.lit(mode)) for mode, df in parts.items()])
