"""Point-in-time features over the history of an entity.

A row sees strictly earlier days only: windows are range frames over whole day
numbers that end the day before, so rows of one day never see each other and
the order of input rows cannot matter. All features that share a partition and
an order are computed over one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pitwise.functions.dates import monday_number
from pitwise.functions.rates import laplace

EVER = Window.unboundedPreceding


def before(keys: list[str], days: int | None = None, day: str = "day") -> WindowSpec:
    """The ``days`` days before the row's own, or all of them."""
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(EVER if days is None else -days, -1)


def sliding_sum(value: Column, keys: list[str], days: int | None, day: str = "day") -> Column:
    """Sum of whole numbers over the ``days`` days before: the difference of two growing frames, which Spark extends row by row, where it sums a moving frame anew for every row."""
    total = lambda last: F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(day).rangeBetween(EVER, last)), F.lit(0))
    return total(-1) if days is None else total(-1) - total(-days - 1)


def prior_count(keys: list[str], days: int | None = None) -> Column:
    return sliding_sum(F.lit(1).cast("bigint"), keys, days)


def prior_rate(keys: list[str], won: str = "won", days: int | None = None, only: Column | None = None) -> Column:
    """Smoothed rate of known outcomes (null ones do not count), of the rows where ``only`` holds."""
    value = F.col(won) if only is None else F.when(only, F.col(won))
    return laplace(sliding_sum(value.cast("bigint"), keys, days), sliding_sum(value.isNotNull().cast("bigint"), keys, days))


def form_trend(keys: list[str], won: str = "won", days: int = 30, constant: float = 15.0, day: str = "day") -> Column:
    """Outcomes weighted by exp(-age / constant); the row's own day cancels out of the ratio, so it is one range frame."""
    start = F.min(day).over(Window.partitionBy(*keys))
    weight = F.exp((F.col(day) - start) / constant)
    known, w = F.col(won).isNotNull(), before(keys, days, day)
    up, down = F.sum(F.when(known, weight * F.col(won))).over(w), F.sum(F.when(known, weight)).over(w)
    return F.coalesce(F.try_divide(up, down), F.lit(0.5))


def days_since_week(keys: list[str], day: str = "day") -> Column:
    """Days since the latest earlier Monday-week with a row."""
    monday = monday_number(F.col(day))
    w = Window.partitionBy(*keys).orderBy(monday).rangeBetween(EVER, -7)
    return F.col(day) - F.max(monday).over(w)


def volatility(keys: list[str], value: str, days: int, least: int = 3) -> Column:
    """Population deviation of the values seen, 0 below ``least`` of them."""
    w = before(keys, days)
    return F.when(F.count(value).over(w) >= least, F.stddev_pop(value).over(w)).otherwise(0.0)


def asof_last(keys: list[str], value: str, tie: str, days: int | None = None, lag: int = 1, day: str = "day") -> Column:
    """Last known value at least ``lag`` days before the row; of one day the greatest ``tie``."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(EVER if days is None else -days, -lag)
    return F.max(F.when(F.col(value).isNotNull(), F.struct(day, tie, value))).over(w)[value]


def change_since(keys: list[str], value: str, days: int, day: str = "day") -> Column:
    """Value ``days`` ago (found between half as long again before it and then) minus now; 0 if none or if its day has several values."""
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-(days + days // 2), -days)
    # every day keeps its least and greatest value; where they differ the day is ambiguous
    return_low = F.max(F.struct(day, "day_low", "day_high")).over(w)
    clear = return_low["day_low"] == return_low["day_high"]
    return F.coalesce(F.when(clear, return_low["day_low"] - F.col(value)), F.lit(0.0))


def with_day_bounds(df: DataFrame, keys: list[str], value: str, day: str = "day") -> DataFrame:
    """``day_low`` and ``day_high``: least and greatest value of the entity's day."""
    w = Window.partitionBy(*keys, day)
    return df.withColumn("day_low", F.min(value).over(w)).withColumn("day_high", F.max(value).over(w))


def last_clear(df: DataFrame, keys: list[str], value: str, day: str = "day") -> DataFrame:
    """``last_<value>``: the value of the last earlier day, null if that day has several."""
    df = with_day_bounds(df, keys, value, day)
    last = F.max(F.struct(day, "day_low", "day_high")).over(before(keys, None, day))
    return df.withColumn(f"last_{value}", F.when(last["day_low"] == last["day_high"], last["day_low"])).drop("day_low", "day_high")


def by_day(df: DataFrame, keys: list[str], won: str = "won", day: str = "day") -> DataFrame:
    """One row for each entity and day: rows, known outcomes and wins."""
    return df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("n"), F.count(won).alias("known"), F.sum(F.coalesce(F.col(won), F.lit(0))).cast("bigint").alias("wins"))


def recent_complete_days(df: DataFrame, keys: list[str], last: int = 10, days: int = 120, won: str = "won", day: str = "day") -> DataFrame:
    """``recent_n`` and ``recent_wins`` of the last ``last`` known rows in ``days`` days.

    A day counts whole or ends the walk: days are added from the newest back
    until one would make more than ``last`` rows. So ``last`` known days matter at
    most: each known day holds a list of these up to itself, and every day looks
    at the list of the latest known day before it.
    """
    order = Window.partitionBy(*keys).orderBy(day)
    daily = by_day(df.where(F.col(won).isNotNull()), keys, won, day).withColumn("total", F.sum("n").over(order))
    daily = daily.withColumn("held", F.collect_list(F.struct(F.col(day).alias("at"), "n", "wins", "total")).over(order.rowsBetween(1 - last, 0)))
    targets = df.select(*keys, day).distinct().withColumn("held", F.lit(None).cast(daily.schema["held"].dataType))
    both = targets.withColumn("target", F.lit(True)).unionByName(daily.select(*keys, day, "held", F.lit(False).alias("target")))
    both = both.withColumn("held", F.last("held", ignorenulls=True).over(before(keys, None, day))).where("target and held is not null")
    newest = F.element_at("held", -1)["total"]
    whole = F.filter("held", lambda x: (x["at"] >= F.col(day) - days) & (newest - x["total"] + x["n"] <= last))
    total = lambda k: F.aggregate(whole, F.lit(0).cast("bigint"), lambda a, x: a + x[k])
    found = both.select(*keys, day, total("n").alias("recent_n"), total("wins").alias("recent_wins"))
    return df.join(found, [*keys, day], "left").fillna(0, ["recent_n", "recent_wins"])


def streaks(df: DataFrame, keys: list[str], won: str = "won", day: str = "day") -> DataFrame:
    """``streak`` before the row's day: length of the run of wins (positive) or losses (negative); a mixed day breaks it."""
    daily = by_day(df.where(F.col(won).isNotNull()), keys, won, day)
    daily = daily.withColumn("result", F.when(F.col("wins") == F.col("n"), 1).when(F.col("wins") == 0, -1).otherwise(0))
    order = Window.partitionBy(*keys).orderBy(day)
    changed = F.when((F.col("result") == 0) | ~F.col("result").eqNullSafe(F.lag("result").over(order)), 1).otherwise(0)
    daily = daily.withColumn("island", F.sum(changed).over(order))
    run = Window.partitionBy(*keys, "island").orderBy(day)
    daily = daily.withColumn("length", F.sum("n").over(run) * F.col("result")).select(*keys, F.col(day), "length")
    both = df.select(*keys, day).distinct().withColumn("length", F.lit(None).cast("bigint")).unionByName(daily)
    last = F.max(F.when(F.col("length").isNotNull(), F.struct(day, "length"))).over(before(keys, None, day))["length"]
    asof = both.withColumn("streak", F.coalesce(last, F.lit(0))).groupBy(*keys, day).agg(F.max("streak").alias("streak"))
    return df.join(asof, [*keys, day])


def sides(matches: DataFrame, one: str, two: str, won: str) -> DataFrame:
    """Both perspectives of each match: entity, opponent, side and the outcome from its side."""
    pair = F.array(
        F.struct(F.col(one).alias("player"), F.col(two).alias("opponent"), F.lit(1).alias("side"), F.col(won).alias("won")),
        F.struct(F.col(two).alias("player"), F.col(one).alias("opponent"), F.lit(2).alias("side"), (1 - F.col(won)).alias("won")),
    )
    rest = [c for c in matches.columns if c not in (one, two, won)]
    return matches.select(*rest, F.explode(pair).alias("s")).select(*rest, "s.*")


def quarantine_shifted(df: DataFrame, signature: list[str], day: str, tie: str, within: int = 14) -> DataFrame:
    """Drop rows that repeat a signature within ``within`` days of the last row that was kept (a re-post with a shifted date).

    Which row is kept depends on the last kept one, so each signature's days are
    folded in order; a signature is one match's key and holds few rows.
    """
    rows = F.array_sort(F.collect_list(F.struct(day, tie)))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast(f"array<struct<{day}:bigint,{tie}:bigint>>").alias("kept"))

    def step(a, x):
        drop = a["last"].isNotNull() & (x[day] - a["last"] > 0) & (x[day] - a["last"] <= within)
        return F.when(drop, a).otherwise(F.struct(x[day].alias("last"), F.concat(a["kept"], F.array(x)).alias("kept")))

    packed = df.select(*signature, F.col(day).cast("bigint").alias(day), F.col(tie).cast("bigint").alias(tie)).groupBy(*signature).agg(F.aggregate(rows, start, step, lambda a: a["kept"]).alias("kept"))
    return packed.select(*signature, F.inline("kept"))
