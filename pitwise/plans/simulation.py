"""Queries that replay stakes and resample results (family B)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwise.functions.rates import kelly
from pitwise.operators import simulate as sim
from pitwise.operators.prefix import running
from pitwise.plans.analogues import LOG, QUOTES, prediction_log, quotes
from pitwise.plans.point_in_time import r6
from pitwise.session import table

SIDE = LOG + """, b AS (SELECT *, greatest(p_nn - 1/odds1, (1-p_nn) - 1/odds2) AS edge, p_nn - 1/odds1 >= (1-p_nn) - 1/odds2 AS f FROM log),
s AS (SELECT *, CASE WHEN f THEN p_nn ELSE 1-p_nn END AS sp, CASE WHEN f THEN odds1 ELSE odds2 END AS so, f = (y = 1) AS w FROM b WHERE edge >= 0.02),
k AS (SELECT *, least(0.18::DOUBLE * greatest(0.0, ((so-1)*sp-(1-sp))/(so-1)), 0.05::DOUBLE) * 1000 AS ks FROM s)"""


def b01(spark, sf):
    return sim.replay_summary(prediction_log(spark, sf), "p_nn", "y", keys=["segment"]).select("segment", "bets", F.round("staked", 4).alias("staked"), F.round("profit", 4).alias("profit"), r6(F.col("roi")).alias("roi"))


B01 = f"WITH {SIDE} SELECT segment, count(*) AS bets, round(count(*)::DOUBLE, 4) AS staked, round(sum(CASE WHEN w THEN so - 1 ELSE -1.0 END), 4) AS profit, round(sum(CASE WHEN w THEN so - 1 ELSE -1.0 END) / count(*) + 1e-10, 6) AS roi FROM k GROUP BY segment"


def b01k(spark, sf):
    r = sim.replay(prediction_log(spark, sf), "p_nn", "y", "uid", mode="kelly")
    return r.select("uid", F.round("stake", 4).alias("stake"), F.round(F.col("equity") + 1e-7, 3).alias("equity"), F.round(F.col("drawdown") + 1e-8, 5).alias("drawdown"))


B01K = f"""WITH {SIDE}, e AS (SELECT uid, ks, 1000 + sum(CASE WHEN w THEN ks * (so - 1) ELSE -ks END) OVER (ORDER BY uid ROWS UNBOUNDED PRECEDING) AS equity FROM k), p AS (SELECT *, max(equity) OVER (ORDER BY uid ROWS UNBOUNDED PRECEDING) AS peak FROM e)
SELECT uid, round(ks, 4) AS stake, round(equity + 1e-7, 3) AS equity, round(CASE WHEN peak <> 0 THEN (peak - equity) / peak END + 1e-8, 5) AS drawdown FROM p"""


def b02(spark, sf):
    l = prediction_log(spark, sf)
    price = 1 / F.col("odds1")
    l = l.withColumn("profit", sim.fee_profit(price, F.col("y") == 1)).where(F.col("p_xgb") - price > 0.02)
    return l.groupBy("segment").agg(F.count(F.lit(1)).alias("bets"), F.round(F.sum("profit"), 4).alias("profit"))


B02 = f"WITH {LOG} SELECT segment, count(*) AS bets, round(sum(CASE WHEN y = 1 THEN 1 - 1/odds1 - 0.07::DOUBLE * (1/odds1) * (1 - 1/odds1) ELSE -1/odds1 END), 4) AS profit FROM log WHERE p_xgb - 1/odds1 > 0.02 GROUP BY segment"


def b03(spark, sf):
    l = prediction_log(spark, sf).withColumn("wish", F.least(0.18 * kelly(F.col("p_nn"), F.col("odds1")), F.lit(0.05)) * 1000.0).where("wish > 0")
    l = l.withColumn("block", F.date_format("d", "yyyy-MM"))
    return sim.block_stakes(l, "block", "wish", 20000.0, 5.0).select("uid", F.round(F.col("stake") + 1e-8, 4).alias("stake"))


B03 = f"""WITH {LOG}, w AS (SELECT uid, strftime(d, '%Y-%m') AS block, least(0.18::DOUBLE * greatest(0.0, ((odds1-1)*p_nn-(1-p_nn))/(odds1-1)), 0.05::DOUBLE) * 1000 AS wish FROM log), t AS (SELECT block, sum(wish) AS total FROM w WHERE wish > 0 GROUP BY 1),
g AS (SELECT block, total, greatest(0.0, least(total, 20000 - coalesce(sum(total) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS given FROM t)
SELECT uid, round(wish * CASE WHEN given >= 5 THEN given / total ELSE 0 END + 1e-8, 4) AS stake FROM w JOIN g USING (block) WHERE wish > 0"""


def b04(spark, sf):
    l = prediction_log(spark, sf).withColumn("k", kelly(F.col("p_nn"), F.col("odds1")))
    return sim.proportional(l, ["d"], "k").select("uid", r6(F.col("stake")).alias("stake"))


B04 = f"WITH {LOG}, k AS (SELECT uid, d, greatest(0.0, ((odds1-1)*p_nn-(1-p_nn))/(odds1-1)) AS k FROM log) SELECT uid, round(coalesce(CASE WHEN sum(k) OVER w <> 0 THEN k / sum(k) OVER w END, 0) + 1e-10, 6) AS stake FROM k WINDOW w AS (PARTITION BY d)"


def b05(spark, sf):
    l = prediction_log(spark, sf).withColumn("f", F.least(0.1 * kelly(F.col("p_nn"), F.col("odds1")), F.lit(0.02)))
    l = l.withColumn("growth", F.col("f") * F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    e = sim.compounded(l, ["player"], ["d", "uid"], "growth")
    return e.select("uid", F.round(F.col("equity") + 1e-8, 4).alias("equity"))


B05 = f"""WITH {LOG}, k AS (SELECT uid, player, d, least(0.1::DOUBLE * greatest(0.0, ((odds1-1)*p_nn-(1-p_nn))/(odds1-1)), 0.02::DOUBLE) * CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END AS g FROM log)
SELECT uid, round(1000 * exp(sum(ln(1 + g)) OVER (PARTITION BY player ORDER BY d, uid ROWS UNBOUNDED PRECEDING)) + 1e-8, 4) AS equity FROM k"""


def b05f(spark, sf):
    l = prediction_log(spark, sf).withColumn("f", F.least(kelly(F.col("p_nn"), F.col("odds1")), F.lit(0.5)))
    out = sim.compounded_with_floor(l, ["player"], ["d", "uid"], "f", "odds1", "y", start=100.0, least=2.0, bust=20.0)
    return out.select("player", F.round(F.col("equity") + 1e-8, 4).alias("equity"), "bets", "bust")


B05F = f"""WITH RECURSIVE {LOG}, r AS (SELECT player, row_number() OVER (PARTITION BY player ORDER BY d, uid) AS rn, least(greatest(0.0, ((odds1-1)*p_nn-(1-p_nn))/(odds1-1)), 0.5::DOUBLE) AS f, odds1 AS o, y FROM log),
p AS (SELECT player, 0::BIGINT AS rn, 100.0::DOUBLE AS e, 0 AS n, false AS b FROM (SELECT DISTINCT player FROM log) UNION ALL
  SELECT r.player, r.rn, CASE WHEN NOT p.b AND p.e * f >= 2.0 THEN p.e + CASE WHEN y = 1 THEN p.e * f * (o - 1) ELSE -(p.e * f) END ELSE p.e END, p.n + CAST(NOT p.b AND p.e * f >= 2.0 AS INTEGER), p.b OR CASE WHEN NOT p.b AND p.e * f >= 2.0 THEN p.e + CASE WHEN y = 1 THEN p.e * f * (o - 1) ELSE -(p.e * f) END ELSE p.e END <= 20.0 FROM p JOIN r ON r.player = p.player AND r.rn = p.rn + 1)
SELECT player, round(e + 1e-8, 4) AS equity, n AS bets, b AS bust FROM p QUALIFY row_number() OVER (PARTITION BY player ORDER BY rn DESC) = 1"""


def b06(spark, sf):
    """Bootstrap of all bets: each sample draws as many as there are."""
    l = prediction_log(spark, sf)
    size = l.count()
    numbered = running(l.withColumn("one", F.lit(1)), "uid", [], "number", "one").withColumn("number", (F.col("number") - 1).cast("bigint"))
    b = sim.bootstrap(numbered.select("number", F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0).alias("profit")), "number", size, 50, 11)
    return b.groupBy("sim").agg(F.round(F.sum("profit") + 1e-7, 3).alias("profit"), F.count(F.lit(1)).alias("n"))


B06 = f"""WITH {LOG}, r AS (SELECT row_number() OVER (ORDER BY uid) - 1 AS number, CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END AS profit FROM log), c AS (SELECT count(*) AS size FROM log),
p AS (SELECT s.range AS sim, r.number AS place, size FROM r, c, range(50) s), d AS (SELECT sim, CAST('0x' || substr(md5('11:' || sim || ':' || place), 1, 8) AS BIGINT) % size AS n FROM p)
SELECT sim, round(sum(profit) + 1e-7, 3) AS profit, count(*) AS n FROM d JOIN r ON r.number = d.n GROUP BY sim"""


def b09(spark, sf):
    """The whole grid of Kelly multipliers in one pass: each bet once for every multiplier."""
    l = prediction_log(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn("f", F.col("k") / 20 * kelly(F.col("p_nn"), F.col("odds1")))
    growth = F.ln(1 + F.col("f") * F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    return l.groupBy("k").agg(F.round(F.sum(growth), 5).alias("log_growth"))


B09 = f"WITH {LOG} SELECT CAST(range AS INTEGER) AS k, round(sum(ln(1 + range / 20.0::DOUBLE * greatest(0.0, ((odds1-1)*p_nn-(1-p_nn))/(odds1-1)) * CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END)), 5) AS log_growth FROM log, range(1, 11) GROUP BY 1"


def b10(spark, sf):
    """First period in which a player's running result crosses below -3 units."""
    l = prediction_log(spark, sf).withColumn("profit", F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    w = Window.partitionBy("player").orderBy("d", "uid").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("total", F.sum("profit").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return l.groupBy("player").agg(F.min(F.when(F.col("total") <= -3 + 1e-9, F.col("n"))).alias("bust_at"), F.bool_or(F.col("total") <= -3 + 1e-9).alias("bust"))


B10 = f"WITH {LOG}, t AS (SELECT player, sum(CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END) OVER w AS total, count(*) OVER w AS n FROM log WINDOW w AS (PARTITION BY player ORDER BY d, uid ROWS UNBOUNDED PRECEDING)) SELECT player, min(n) FILTER (WHERE total <= -3 + 1e-9) AS bust_at, bool_or(total <= -3 + 1e-9) AS bust FROM t GROUP BY player"


def b12(spark, sf):
    l = prediction_log(spark, sf).withColumn("edge", F.col("p_nn") - 1 / F.col("odds1")).withColumn("floor", F.explode(F.array(*[F.lit(x) for x in (0, 5, 10, 20)]))).where(F.col("edge") * 100 >= F.col("floor"))
    growth = F.log1p(0.1 * kelly(F.col("p_nn"), F.col("odds1")) * F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    return l.groupBy("floor").agg(F.count(F.lit(1)).alias("bets"), F.round(F.sum(growth), 5).alias("log_growth"))


B12 = f"WITH {LOG}, f AS (SELECT unnest([0, 5, 10, 20]) AS floor) SELECT floor, count(*) AS bets, round(sum(ln(1 + 0.1::DOUBLE * greatest(0.0, ((odds1-1)*p_nn-(1-p_nn))/(odds1-1)) * CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END)), 5) AS log_growth FROM log, f WHERE (p_nn - 1/odds1) * 100 >= floor GROUP BY 1"


def b15(spark, sf):
    """Balance after each settlement event: refunds of void bets, returns of won ones."""
    o = table(spark, sf, "orders")
    change = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 0.9).when(F.col("o_orderstatus") == "O", -F.col("o_totalprice")).otherwise(0.0)
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return o.select("o_orderkey", F.round(F.sum(change).over(w) + 1e-6, 2).alias("balance"), F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("before"))


B15 = """SELECT o_orderkey, round(sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice * 0.9::DOUBLE WHEN 'O' THEN -o_totalprice ELSE 0.0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) + 1e-6, 2) AS balance, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders"""


def f29(spark, sf):
    l = prediction_log(spark, sf).withColumn("r", 0.02 * F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    return l.groupBy("segment").agg(*[r6(v).alias(k) for k, v in sim.risk(F.col("r")).items()])


F29 = f"""WITH {LOG}, r AS (SELECT segment, 0.02::DOUBLE * CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END AS r FROM log) SELECT segment, round(avg(r) + 1e-10, 6) AS mean, round(avg(r) / stddev_samp(r) * sqrt(365) + 1e-10, 6) AS sharpe, round(avg(r) / sqrt(avg(least(r, 0) ** 2)) * sqrt(365) + 1e-10, 6) AS sortino,
round(sum(greatest(r, 0)) / -sum(least(r, 0)) + 1e-10, 6) AS profit_factor, round(avg(CAST(r > 0 AS INTEGER)) + 1e-10, 6) AS hit_rate, round(exp(avg(ln(1 + r))) - 1 + 1e-10, 6) AS geometric_mean FROM r GROUP BY segment"""


def f30(spark, sf):
    q = quotes(spark, sf)
    daily = q.groupBy("uid", "run").agg(F.max_by("prob", F.struct("ts", "event_id")).alias("prob")).where("prob > 0")
    return sim.calendar(daily, ["uid"], "run", "prob").select("uid", F.col("run").cast("string").alias("run"), r6(F.col("prob")).alias("prob"), r6(F.col("change")).alias("change"))


F30 = f"""WITH {QUOTES}, daily AS (SELECT uid, run, arg_max(prob, (ts, event_id)) AS prob FROM quotes GROUP BY ALL), pos AS (SELECT * FROM daily WHERE prob > 0), spine AS (SELECT uid, CAST(unnest(generate_series(min(run), max(run), INTERVAL 1 DAY)) AS DATE) AS run FROM pos GROUP BY uid),
f AS (SELECT s.uid, s.run, last_value(prob IGNORE NULLS) OVER (PARTITION BY s.uid ORDER BY s.run ROWS UNBOUNDED PRECEDING) AS prob FROM spine s LEFT JOIN pos USING (uid, run))
SELECT uid, CAST(run AS VARCHAR) AS run, round(prob + 1e-10, 6) AS prob, round(prob / lag(prob) OVER (PARTITION BY uid ORDER BY run) - 1 + 1e-10, 6) AS change FROM f"""


def w30(spark, sf):
    l = prediction_log(spark, sf).withColumn("profit", F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    w = Window.partitionBy("player").orderBy("d", "uid").rowsBetween(Window.unboundedPreceding, 0)
    e = sim.drawdown(l.withColumn("equity", 100 + F.sum("profit").over(w)), "equity", ["player"], ["d", "uid"])
    return e.groupBy("player").agg(r6(F.max("drawdown")).alias("max_drawdown"), F.round(F.max("peak"), 4).alias("peak"))


W30 = f"""WITH {LOG}, e AS (SELECT player, d, uid, 100 + sum(CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END) OVER (PARTITION BY player ORDER BY d, uid ROWS UNBOUNDED PRECEDING) AS equity FROM log), p AS (SELECT player, equity, max(equity) OVER (PARTITION BY player ORDER BY d, uid ROWS UNBOUNDED PRECEDING) AS peak FROM e)
SELECT player, round(max((peak - equity) / peak) + 1e-10, 6) AS max_drawdown, round(max(peak), 4) AS peak FROM p GROUP BY player"""

QUERIES = {
    "b01_flat_roi": (b01, B01), "b01_kelly_path": (b01k, B01K), "b02_exchange_roi": (b02, B02), "b03_block_stakes": (b03, B03), "b04_prop_alloc": (b04, B04), "b05_compound_path": (b05, B05), "b05_path_with_floor": (b05f, B05F),
    "b06_bootstrap": (b06, B06), "b09_kelly_grid": (b09, B09), "b10_bust_timing": (b10, B10), "b12_edge_floor": (b12, B12), "b15_settlement_balance": (b15, B15), "f29_risk_metrics": (f29, F29), "f30_calendar_resample": (f30, F30), "w30_drawdown": (w30, W30),
}
