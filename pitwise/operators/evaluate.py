"""Scores of probability forecasts: grouped aggregates, rank statistics, bins, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.rates import clip


def accuracy(y: str, p: str) -> Column:
    return F.avg(((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("double"))


def log_loss(y: str, p: str) -> Column:
    q = clip(F.col(p))
    return -F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))


def brier(y: str, p: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def bin_of(p: Column, bins: int = 10, closed: str = "left") -> Column:
    """Equal-width bin: ``[lo, hi)`` with 1.0 in the last, or ``(lo, hi]`` with 0.0 in the first."""
    if closed == "left":
        return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return F.greatest(F.ceil(p * bins) - 1, F.lit(0)).cast("int")


def metrics(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    hit, true, positive = (F.col(p) >= 0.5) & (F.col(y) == 1), F.col(y) == 1, F.col(p) >= 0.5
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), accuracy(y, p).alias("accuracy"), log_loss(y, p).alias("log_loss"), brier(y, p).alias("brier"), F.count_if(hit).alias("_tp"), F.count_if(true).alias("_pos"), F.count_if(positive).alias("_said"))
    precision, recall = F.try_divide(F.col("_tp").cast("double"), F.col("_said")), F.try_divide(F.col("_tp").cast("double"), F.col("_pos"))
    f1 = F.try_divide(2.0 * F.col("_tp"), F.col("_pos") + F.col("_said"))
    return out.select(*keys, "n", "accuracy", "log_loss", "brier", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def auc(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve, ties one half, null with one class.

    Counts by distinct score come first, so the running sum goes over scores
    of a group, not over rows.
    """
    by_score = df.groupBy(*keys, p).agg(F.sum(F.col(y)).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    below = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    by_score = by_score.withColumn("neg", F.col("n") - F.col("pos")).withColumn("neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    total = by_score.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.select(*keys, F.try_divide("u", F.col("pos") * F.col("neg")).alias("auc"))


def roc(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Threshold, false and true positive rates; points on a straight line between their neighbours are dropped."""
    by_score = df.groupBy(*keys, F.col(p).alias("threshold")).agg(F.sum(F.col(y)).alias("pos"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("threshold"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    pts = by_score.withColumn("tp", F.sum("pos").over(upto)).withColumn("fp", F.sum(F.col("n") - F.col("pos")).over(upto))
    dtp, dfp = F.col("tp") - F.coalesce(F.lag("tp").over(order), F.lit(0)), F.col("fp") - F.coalesce(F.lag("fp").over(order), F.lit(0))
    ntp, nfp = F.lead("tp").over(order) - F.col("tp"), F.lead("fp").over(order) - F.col("fp")
    whole = Window.partitionBy(*keys)
    pts = pts.withColumn("bent", F.coalesce(dtp * nfp != dfp * ntp, F.lit(True))).withColumn("P", F.sum("pos").over(whole)).withColumn("N", F.sum(F.col("n") - F.col("pos")).over(whole))
    return pts.where("bent and P > 0 and N > 0").select(*keys, "threshold", (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))


def ece(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", bins: int = 10, closed: str = "left") -> DataFrame:
    """Expected calibration error: the bins' distances between mean forecast and frequency, weighted by their rows."""
    by_bin = df.groupBy(*keys, bin_of(F.col(p), bins, closed).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
    return by_bin.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Count, mean forecast and frequency of every bin, empty ones included."""
    by_bin = df.groupBy(*keys, bin_of(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("frequency"))
    grid = by_bin.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(by_bin, [*keys, "bin"], "left").fillna(0, ["n"])


def calibration_line(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", rounds: int = 8) -> DataFrame:
    """Slope and intercept of a logistic fit of y on logit(p), by Newton steps of grouped sums (one aggregation a step).

    Rows of equal forecasts are counted once, before any step; a step's line is one row a key and is broadcast, so
    rows are not dealt out by key.
    """
    from pitwise.functions.rates import logit

    rows = df.groupBy(*keys, F.col(p).alias("p")).agg(F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("y")).where("n > 0").select(*keys, "n", "y", logit(F.col("p")).alias("x")).cache()
    fit = rows.select(*keys).distinct().withColumn("a", F.lit(0.0)).withColumn("b", F.lit(0.0))  # from zero the steps do not overshoot
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        at = rows.join(F.broadcast(fit), keys).withColumn("q", q).withColumn("w", F.col("n") * F.col("q") * (1 - F.col("q"))).withColumn("g", F.col("y") - F.col("n") * F.col("q"))
        sums = at.groupBy(*keys, "a", "b").agg(F.sum("g").alias("g0"), F.sum(F.col("g") * F.col("x")).alias("g1"), F.sum("w").alias("h00"), F.sum(F.col("w") * F.col("x")).alias("h01"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("h11"))
        det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        fit = sums.select(*keys, (F.col("a") + F.try_divide(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1"), det)).alias("a"), (F.col("b") + F.try_divide(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"), det)).alias("b"))
    return fit.select(*keys, F.col("b").alias("slope"), F.col("a").alias("intercept"))


def cohorts(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """Each row once for every cohort it belongs to, as ``tier``: one pass instead of one for each tier."""
    tiers = F.filter(F.array(*[F.when(c, name) for name, c in scopes.items()]), lambda x: x.isNotNull())
    return df.withColumn("tier", F.explode(tiers))


def in_every_model(df: DataFrame, uid: str = "uid", model: str = "model", models: int = 4) -> DataFrame:
    """Rows of the uids that have a forecast from each of ``models`` models (relational division)."""
    full = df.groupBy(uid).agg(F.countDistinct(model).alias("k")).where(F.col("k") == models).select(uid)
    return df.join(full, uid, "left_semi")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    share = hits / n
    middle, half = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """The value of the greatest summed weight, the smallest of equal ones."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*keys).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias("mode"), (-F.col("m.w")).alias("weight"))


def binomial_tail(hits: Column, n: Column, share: Column) -> Column:
    """P(X >= hits) of a binomial, exactly, for whole ``hits`` and ``n`` (logs of factorials summed once for each row)."""
    logs = lambda k: F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    first = F.exp(logs(n) - logs(hits) - logs(n - hits) + hits * F.ln(share) + (n - hits) * F.ln(1 - share))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(a, k):
        term = a["term"] * (n - k) / (k + 1) * share / (1 - share)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    later = F.when(hits < n, F.sequence(hits, n - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(later, start, step, lambda a: F.least(a["total"], F.lit(1.0)))


def bundle(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """n, accuracy, log loss, Brier score, AUC and calibration error of each key from counts by distinct score.

    Rows are read and shuffled once, as partial counts by score; every measure is a sum over scores. The AUC adds, for
    each score, the losses below it and half of those at it.
    """
    scores = df.groupBy(*keys, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("bigint")).alias("_w"))
    below = F.coalesce(F.sum(F.col("_n") - F.col("_w")).over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = scores.withColumns({"_lost": F.col("_n") - F.col("_w"), "_below": below, "_bin": F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1))})
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("_p")))
    part = rows.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("n"), F.sum("_w").alias("w"), F.sum(F.when(F.col("_p") >= 0.5, F.col("_w")).otherwise(F.col("_lost"))).alias("right"), F.sum(F.col("_w") * F.ln(q) + F.col("_lost") * F.ln(1 - q)).alias("likelihood"),
        F.sum(F.col("_w") * F.pow(1 - F.col("_p"), 2) + F.col("_lost") * F.pow("_p", 2)).alias("squares"), F.sum(F.col("_w") * (F.col("_below") + F.col("_lost") / 2)).alias("ahead"), F.sum(F.col("_n") * F.col("_p")).alias("expected"))
    g = part.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "w", "right", "likelihood", "squares", "ahead")], F.sum(F.abs(F.col("w") - F.col("expected"))).alias("gap"))
    n = F.col("n")
    return g.select(*keys, "n", (F.col("right") / n).alias("accuracy"), (-F.col("likelihood") / n).alias("log_loss"), (F.col("squares") / n).alias("brier"), F.try_divide(F.col("ahead"), F.col("w") * (n - F.col("w"))).alias("auc"), (F.col("gap") / n).alias("ece"))
