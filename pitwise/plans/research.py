"""Queries of research runs: Monte-Carlo orders, compounding strategies, the bundle of metrics, feature lineage (A10, B08, B13, D13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwise.functions.rates import devig
from pitwise.operators import evaluate, fold, lineage, montecarlo
from pitwise.plans.analogues import LOG, LONG, MATCH_ORDER, prediction_log, scored
from pitwise.plans.point_in_time import r6
from pitwise.session import table

SIMS = 25


def _gains(spark, sf):
    """Bets of one unit at the first price, in hundredths, by week."""
    l = prediction_log(spark, sf)
    return l.select("d", "uid", F.date_trunc("week", F.col("d")).cast("date").alias("week"), F.when(F.col("y") == 1, F.round((F.col("odds1") - 1) * 100).cast("bigint")).otherwise(-100).alias("gain"))


def b08m(spark, sf):
    """Week bootstrap, week permutation and match permutation over all bets: final, lowest and highest result and deepest fall of each path."""
    g = _gains(spark, sf)
    # bets of a week are numbered within it, weeks by what came before them: no row passes through one task
    weeks = g.groupBy("week").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("week").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = g.withColumn("place", F.row_number().over(Window.partitionBy("week").orderBy("d", "uid")) - 1).join(weeks, "week").select((F.col("before") + F.col("place")).alias("number"), "gain")
    parts = {
        "week_bootstrap": montecarlo.block_bootstrap(g, "week", ["d", "uid"], "gain", SIMS, 5),
        "week_permutation": montecarlo.block_permutation(g, "week", ["d", "uid"], "gain", SIMS, 6),
        "match_permutation": montecarlo.row_permutation(numbered, "number", g.count(), "gain", SIMS, 7),
    }
    return montecarlo.union(parts)


_DRAW = lambda key, n: f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {n}"
_PRIME = lambda n: f"(SELECT min(x) FROM range(greatest(2, {n}), {n} + 1000) t(x) WHERE NOT EXISTS (SELECT 1 FROM range(2, CAST(sqrt(x) AS BIGINT) + 1) s(k) WHERE x % k = 0))"
B08M = f"""WITH {LOG}, g AS (SELECT d, uid, date_trunc('week', d) AS week, CASE WHEN y = 1 THEN CAST(round((odds1 - 1) * 100) AS BIGINT) ELSE -100 END AS gain FROM log),
b AS (SELECT *, row_number() OVER (ORDER BY d, uid) - 1 AS number, dense_rank() OVER (ORDER BY week) - 1 AS wn FROM g), c AS (SELECT count(*) AS n, max(wn) + 1 AS weeks FROM b), pw AS (SELECT {_PRIME('weeks')} AS p FROM c), pm AS (SELECT {_PRIME('n')} AS p FROM c),
placed AS (SELECT 'week_bootstrap' AS mode, sim, place AS major, number AS minor, gain FROM (SELECT s.range AS sim, w.range AS place, {_DRAW("'5:' || s.range || ':' || w.range", "weeks")} AS pick FROM c, range({SIMS}) s, range((SELECT weeks FROM c)) w) x JOIN b ON b.wn = x.pick
UNION ALL SELECT 'week_permutation', s.range, (wn * ({_DRAW("'6a:' || s.range", "(p - 1)")} + 1) + {_DRAW("'6b:' || s.range", "p")}) % p, number, gain FROM b, pw, range({SIMS}) s
UNION ALL SELECT 'match_permutation', s.range, (number * ({_DRAW("'7a:' || s.range", "(p - 1)")} + 1) + {_DRAW("'7b:' || s.range", "p")}) % p, 0, gain FROM b, pm, range({SIMS}) s),
r AS (SELECT mode, sim, major, minor, sum(gain) OVER (PARTITION BY mode, sim ORDER BY major, minor ROWS UNBOUNDED PRECEDING) AS run, gain FROM placed),
t AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY mode, sim ORDER BY major, minor ROWS UNBOUNDED PRECEDING)) AS top FROM r)
SELECT mode, CAST(sim AS INTEGER) AS sim, CAST(sum(gain) AS BIGINT) AS total, CAST(least(0, min(run)) AS BIGINT) AS low, CAST(greatest(0, max(run)) AS BIGINT) AS high, CAST(max(top - run) AS BIGINT) AS fall FROM t GROUP BY mode, sim"""

#: Rule, share of the Kelly fraction, and the most of the bankroll that a bet may take: full, half and quarter stakes, full ones under a limit, a small part of full ones of a size that is worth placing, and full ones of the first bankroll.
STRATEGIES = {"full": ("growing", 1.0, None), "half": ("growing", 0.5, None), "quarter": ("growing", 0.25, None), "capped": ("growing", 1.0, 0.01), "hybrid": ("raised", 0.02, None), "fixed": ("level", 1.0, None)}
START, LEAST = 1000.0, 0.1


def b13c(spark, sf):
    """Full, fractional, capped, hybrid and fixed stakes, a bankroll for each strategy and segment over all its bets: on either side, where the model is confident and has a fair edge."""
    l = prediction_log(spark, sf)
    p, o1, o2 = F.col("p_nn"), F.col("odds1"), F.col("odds2")
    edge = p - devig(o1, o2)  # of the first side; the second has the same with the other sign
    side = F.when((edge > 0.05) & (p >= 0.575), 1).when((-edge > 0.05) & (1 - p >= 0.575), 2)
    l = l.where(~p.between(0.47, 0.53) & (o1 > 1) & (o2 > 1)).withColumn("side", side).where("side is not null")
    first = F.col("side") == 1
    bets = l.select("segment", "d", "uid", F.when(first, p).otherwise(1 - p).alias("p"), F.when(first, o1).otherwise(o2).alias("odds"), (first == (F.col("y") == 1)).alias("won"))
    found = fold.strategy_paths(bets, ["segment"], ["d", "uid"], "uid", STRATEGIES, START, LEAST)
    return found.select("strategy", "uid", "placed", r6(F.col("log_equity")).alias("log_equity"), r6(F.col("equity")).alias("equity"))


_WHOLE = lambda x, size: f"CAST(floor(({x}) * {size}::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
_STAKES = ", ".join(f"('{n}', '{rule}', {share}::DOUBLE, {'NULL' if most is None else most}::DOUBLE)" for n, (rule, share, most) in STRATEGIES.items())
_LEFT = f"exp(s.total / {fold.LOGS}::DOUBLE) + {LEAST}::DOUBLE * r.gained"
_FLOOR = _WHOLE(f"ln({LEAST}::DOUBLE)", fold.LOGS)
B13C = f"""WITH RECURSIVE {LOG}, e AS (SELECT *, p_nn - (1/odds1)/(1/odds1+1/odds2) AS edge FROM log WHERE NOT p_nn BETWEEN 0.47 AND 0.53 AND odds1 > 1 AND odds2 > 1),
c AS (SELECT *, CASE WHEN edge > 0.05 AND p_nn >= 0.575 THEN 1 WHEN -edge > 0.05 AND 1 - p_nn >= 0.575 THEN 2 END AS side FROM e),
b AS (SELECT segment, d, uid, CASE WHEN side = 1 THEN p_nn ELSE 1 - p_nn END AS p, CASE WHEN side = 1 THEN odds1 ELSE odds2 END AS odds, (side = 1) = (y = 1) AS won FROM c WHERE side IS NOT NULL),
k AS (SELECT *, greatest(0.0, ((odds-1)*p-(1-p))/(odds-1)) AS k, CASE WHEN won THEN odds - 1 ELSE -1.0::DOUBLE END AS gained FROM b),
f AS (SELECT k.*, v.strategy, v.rule, least(v.most, v.share * k) AS f FROM k, (VALUES {_STAKES}) v(strategy, rule, share, most)),
r AS (SELECT strategy, rule, segment, uid, gained, row_number() OVER (PARTITION BY strategy, segment ORDER BY d, uid) AS rn, CASE WHEN k > 0 THEN CASE WHEN rule = 'level' THEN {_WHOLE(f"{START}::DOUBLE * f", fold.MONEY)} ELSE {_WHOLE("ln(f)", fold.LOGS)} END END AS asks,
  CASE WHEN rule = 'level' THEN {_WHOLE(f"{START}::DOUBLE * f * gained", fold.MONEY)} WHEN 1 + f * gained > 0 THEN {_WHOLE("ln(1 + f * gained)", fold.LOGS)} END AS gives FROM f),
s AS (SELECT DISTINCT strategy, segment, 0::BIGINT AS rn, rule, NULL::BIGINT AS uid, false AS placed, CASE WHEN rule = 'level' THEN {_WHOLE(f"{START}::DOUBLE", fold.MONEY)} ELSE {_WHOLE(f"ln({START}::DOUBLE)", fold.LOGS)} END AS total FROM r UNION ALL
  SELECT strategy, segment, rn, rule, uid, way <> 'none', CASE way WHEN 'none' THEN total WHEN 'asked' THEN total + gives WHEN 'raised' THEN CASE WHEN rest > 0 THEN {_WHOLE("ln(rest)", fold.LOGS)} END END FROM
  (SELECT r.*, s.total, CASE WHEN r.rule = 'raised' AND s.total + r.asks < {_FLOOR} THEN {_LEFT} END AS rest, CASE WHEN r.asks IS NULL OR s.total IS NULL THEN 'none' WHEN r.rule = 'level' THEN CASE WHEN r.asks >= {_WHOLE(f"{LEAST}::DOUBLE", fold.MONEY)} THEN 'asked' ELSE 'none' END
    WHEN s.total + r.asks >= {_FLOOR} THEN 'asked' WHEN r.rule = 'raised' AND s.total >= {_FLOOR} THEN 'raised' ELSE 'none' END AS way FROM s JOIN r ON r.strategy = s.strategy AND r.segment = s.segment AND r.rn = s.rn + 1))
SELECT strategy, uid, placed, CASE WHEN rule <> 'level' THEN round(total / {fold.LOGS}::DOUBLE + 1e-10, 6) END AS log_equity, CASE WHEN rule = 'level' THEN round(total / {fold.MONEY}::DOUBLE + 1e-10, 6) END AS equity FROM s WHERE rn > 0"""


def a10(spark, sf):
    """All scalar metrics of each model and segment from one table of counts by score."""
    m = evaluate.bundle(scored(spark, sf), ["model", "segment"])
    return m.select("model", "segment", "n", *[r6(F.col(c)).alias(c) for c in ("accuracy", "log_loss", "brier", "auc", "ece")])


A10 = f"""WITH {LONG}, r AS (SELECT *, rank() OVER (PARTITION BY model, segment ORDER BY p) + (count(*) OVER (PARTITION BY model, segment, p) - 1) / 2 AS mid FROM scored),
e AS (SELECT model, segment, sum(abs(sy - sp)) AS gap FROM (SELECT model, segment, least(floor(p * 10), 9) AS b, sum(y) AS sy, sum(p) AS sp FROM scored GROUP BY ALL) GROUP BY ALL),
m AS (SELECT model, segment, count(*) AS n, avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS accuracy, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss, avg((p - y) ** 2) AS brier, (sum(mid) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY ALL)
SELECT model, segment, n, round(accuracy + 1e-10, 6) AS accuracy, round(log_loss + 1e-10, 6) AS log_loss, round(brier + 1e-10, 6) AS brier, round(auc + 1e-10, 6) AS auc, round(gap / n + 1e-10, 6) AS ece FROM m JOIN e USING (model, segment)"""

#: A vector's canonical text: its values in units of 2**-44, which holds every value from 256 to 511 exactly.
UNIT = 2**44


def _hash(vector):
    return F.sha2(F.array_join(F.transform(vector, lambda x: (x * UNIT).cast("bigint").cast("string")), ","), 256)


def records(spark, sf):
    """Every line of an order as a record of the order's vector: some immutable, some off by rounding, some wrong."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    key, n, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    one = (256 + key % 200 + key % 7 / 8).cast("double") + F.when(n % 3 == 0, 1.0 / UNIT).otherwise(0.0)
    two = (256 + F.col("o_custkey") % 100 + key % 3 / 4).cast("double") + F.when(part % 29 == 0, 0.5).otherwise(0.0)
    three = F.when(F.col("l_suppkey") % 13 != 0, (400 + key % 11 / 16).cast("double"))
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*MATCH_ORDER))
    rows = l.select(key.alias("snapshot_id"), ((n <= 2) & (key % 3 != 0)).alias("immutable"), F.col("l_returnflag").alias("source"), row.alias("row"), F.when(part % 31 == 0, "other").otherwise("run").alias("run_id"), F.when(part % 43 == 0, "error").when(key % 7 == 0, "skip").otherwise("ok").alias("status"), F.array(one, two, three).alias("vector"), F.when(part % 37 == 0, "x").otherwise("3").alias("claimed_count"), (part % 23 == 0).alias("bad"))
    return rows.withColumn("claimed_hash", F.when(F.col("bad"), "bad").otherwise(_hash(F.col("vector")))).drop("bad")


def d13s(spark, sf):
    return lineage.resolved(records(spark, sf), _hash)


_CLOSE = lambda a, b: f"({a} IS NOT DISTINCT FROM {b} OR coalesce(abs({a} - {b}) <= 4 * 2.220446049250313e-16::DOUBLE * greatest(abs({a}), abs({b})), false))"
_ALL = lambda test: "(" + " AND ".join(test(f"x.v{i}", f"a.v{i}") for i in (1, 2, 3)) + ")"
D13S = f"""WITH l AS (SELECT l.*, o_custkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(MATCH_ORDER)}) AS row FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
v AS (SELECT l_orderkey AS k, l_linenumber <= 2 AND l_orderkey % 3 <> 0 AS im, l_returnflag AS source, row, CASE WHEN l_partkey % 31 = 0 THEN 'other' ELSE 'run' END AS run, CASE WHEN l_partkey % 43 = 0 THEN 'error' WHEN l_orderkey % 7 = 0 THEN 'skip' ELSE 'ok' END AS status,
  CAST(256 + l_orderkey % 200 + (l_orderkey % 7) / 8 AS DOUBLE) + CASE WHEN l_linenumber % 3 = 0 THEN 1.0::DOUBLE / {UNIT} ELSE 0 END AS v1, CAST(256 + o_custkey % 100 + (l_orderkey % 3) / 4 AS DOUBLE) + CASE WHEN l_partkey % 29 = 0 THEN 0.5 ELSE 0 END AS v2, CASE WHEN l_suppkey % 13 <> 0 THEN CAST(400 + (l_orderkey % 11) / 16 AS DOUBLE) END AS v3,
  l_partkey % 37 = 0 AS miscounted, l_partkey % 23 = 0 AS bad FROM l),
h AS (SELECT *, CASE WHEN v3 IS NOT NULL THEN sha256(CAST(v1 * {UNIT} AS BIGINT) || ',' || CAST(v2 * {UNIT} AS BIGINT) || ',' || CAST(v3 * {UNIT} AS BIGINT)) END AS proved FROM v),
f AS (SELECT *, list_filter([CASE WHEN miscounted THEN 'count' END, CASE WHEN status = 'ok' AND v3 IS NULL THEN 'incomplete' WHEN status = 'ok' AND bad THEN 'hash' END, CASE WHEN status <> 'ok' THEN 'status' END], lambda y: y IS NOT NULL) AS faults FROM h),
a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY NOT im, source, row) = 1),
p AS (SELECT x.k, x.proved, CASE WHEN x.im = a.im AND x.source = a.source AND x.row = a.row THEN [] ELSE [CASE WHEN x.run <> a.run THEN 'run' END, CASE WHEN x.status <> a.status THEN 'status' END,
  CASE WHEN x.im AND CASE WHEN a.status = 'ok' THEN NOT {_ALL(lambda u, w: f"{u} IS NOT DISTINCT FROM {w}")} ELSE NOT {_ALL(lambda u, w: f"({u} IS NULL OR {w} IS NULL OR {_CLOSE(u, w)})")} END THEN 'immutable' END,
  CASE WHEN NOT x.im AND a.im AND CASE WHEN a.status = 'ok' THEN NOT {_ALL(_CLOSE)} ELSE NOT {_ALL(lambda u, w: f"({u} IS NULL OR {w} IS NULL OR {_CLOSE(u, w)})")} END THEN 'derived' END,
  CASE WHEN NOT a.im AND (len(x.faults) > 0 OR len(a.faults) > 0 OR NOT {_ALL(_CLOSE)} OR x.proved IS DISTINCT FROM a.proved) THEN 'contradiction' END] END AS c FROM f x JOIN a USING (k)),
g AS (SELECT k, count(*) AS copies, count(DISTINCT proved) AS hashes, list_sort(list_distinct(list_filter(flatten(list(c)), lambda y: y IS NOT NULL))) AS cs FROM p GROUP BY k)
SELECT k AS snapshot_id, im AS immutable, source, CAST(row AS INTEGER) AS row, CASE WHEN len(cs) > 0 THEN 'conflict' WHEN len(faults) > 0 THEN 'invalid' ELSE 'verified' END AS state, array_to_string(CASE WHEN len(cs) > 0 THEN cs ELSE list_sort(faults) END, ',') AS reasons, copies, hashes, CASE WHEN len(cs) = 0 AND len(faults) = 0 THEN proved END AS vector_hash FROM g JOIN a USING (k)"""

QUERIES = {
    "a10_metrics_bundle": (a10, A10),
    "b08_monte_carlo": (b08m, B08M),
    "b13_compounding_strategies": (b13c, B13C),
    "d13_lineage_states": (d13s, D13S),
}
