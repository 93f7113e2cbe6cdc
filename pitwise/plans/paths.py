"""Queries of paths and plans that fold over ordered rows (B05, B13, B16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import fold
from pitwise.plans.analogues import LOG, prediction_log
from pitwise.session import table

PATH = dict(k=0.2, start=100.0, friction_bps=50.0, least=1.0)


def _bets(spark, sf):
    """Each year and segment of the log is a path."""
    l = prediction_log(spark, sf)
    return l.select("yr", "segment", "d", "uid", F.date_trunc("week", F.col("d")).cast("date").alias("week"), F.col("p_nn").alias("p"), F.col("odds1").alias("odds"), (F.col("y") == 1).alias("won"))


def _shown(df):
    return df.select("uid", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("stake", "profit", "equity")])


def sequential(spark, sf):
    return _shown(fold.staking_paths(_bets(spark, sf), ["yr", "segment"], ["d", "uid"], "uid", **PATH))


def by_day(spark, sf):
    return _shown(fold.staking_paths(_bets(spark, sf), ["yr", "segment"], ["uid"], "uid", block="d", shortfall="skip", **PATH))


def by_week(spark, sf):
    return _shown(fold.staking_paths(_bets(spark, sf), ["yr", "segment"], ["d", "uid"], "uid", block="week", shortfall="all-in", weights="edge", **(PATH | {"least": 4.0, "k": 0.6})))


_BETS = f"{LOG}, b AS (SELECT CAST(yr AS INTEGER) AS yr, segment, d, date_trunc('week', d) AS week, uid, p_nn AS p, odds1 AS odds, y = 1 AS won FROM log)"
_ROUND = "round({0} + 1e-7, 4) AS {0}"
_SHOW = ", ".join(_ROUND.format(c) for c in ("stake", "profit", "equity"))
SEQUENTIAL = f"""WITH RECURSIVE {_BETS}, r AS (SELECT *, row_number() OVER (PARTITION BY yr, segment ORDER BY d, uid) AS rn FROM b),
s AS (SELECT DISTINCT yr, segment, 0::BIGINT AS rn, NULL::BIGINT AS uid, 0.0::DOUBLE AS stake, 0.0::DOUBLE AS profit, 100.0::DOUBLE AS equity FROM b UNION ALL
  SELECT yr, segment, rn, uid, st, CASE WHEN won THEN st * (odds - 1) ELSE -st END - st * 0.005::DOUBLE, greatest(0.0, e + CASE WHEN won THEN st * (odds - 1) ELSE -st END - st * 0.005::DOUBLE) FROM
  (SELECT r.*, s.equity AS e, CASE WHEN p - 1 / odds > 0 AND s.equity > 1 THEN greatest(1.0::DOUBLE, least(s.equity, s.equity * least(1.0::DOUBLE, 0.2::DOUBLE * (p - 1 / odds) / greatest(odds - 1, 1e-9)))) ELSE 0 END AS st FROM s JOIN r ON r.yr = s.yr AND r.segment = s.segment AND r.rn = s.rn + 1))
SELECT uid, {_SHOW} FROM s WHERE rn > 0"""


def _blocks(block: str, weight: str, k: float, least: float, skip: bool) -> str:
    """Blocks as lists of their bets, stepped through one by one; a list of stakes each."""
    short = "0.0::DOUBLE" if skip else "y * e / total"
    gain = f"CASE WHEN z[2] THEN z[1] * (z[3] - 1) ELSE -z[1] END - z[1] * {PATH['friction_bps'] / 10000}::DOUBLE"
    return f"""WITH RECURSIVE {_BETS}, w AS (SELECT *, {weight} AS w FROM b), g AS (SELECT yr, segment, {block} AS blk, list({{'uid': uid, 'w': w, 'won': won, 'odds': odds}} ORDER BY d, uid) AS bets, sum(w) AS sw FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY yr, segment ORDER BY blk) AS rn FROM g),
s AS (SELECT DISTINCT yr, segment, 0::BIGINT AS rn, NULL::STRUCT(uid BIGINT, w DOUBLE, won BOOLEAN, odds DOUBLE)[] AS bets, []::DOUBLE[] AS stakes, 100.0::DOUBLE AS equity FROM b UNION ALL
  SELECT yr, segment, rn, bets, stakes, greatest(0.0, e + list_sum(list_transform(list_zip(stakes, list_transform(bets, lambda x: x.won), list_transform(bets, lambda x: x.odds)), lambda z: {gain}))) FROM
  (SELECT *, CASE WHEN total > e THEN list_transform(asked, lambda y: {short}) ELSE asked END AS stakes FROM
  (SELECT *, coalesce(list_sum(asked), 0) AS total FROM
  (SELECT r.*, s.equity AS e, list_transform(r.bets, lambda x: CASE WHEN r.sw > 0 AND s.equity > {least} AND x.w > 0 THEN greatest({least}::DOUBLE, {k}::DOUBLE * s.equity * x.w / r.sw) ELSE 0.0::DOUBLE END) AS asked FROM s JOIN r ON r.yr = s.yr AND r.segment = s.segment AND r.rn = s.rn + 1)))),
u AS (SELECT equity, unnest(bets) AS x, unnest(stakes) AS stake FROM s WHERE rn > 0)
SELECT x.uid AS uid, {_ROUND.format('stake')}, round((CASE WHEN x.won THEN stake * (x.odds - 1) ELSE -stake END - stake * 0.005::DOUBLE) + 1e-7, 4) AS profit, {_ROUND.format('equity')} FROM u"""


BY_DAY = _blocks("d", "greatest(0.0, (p * odds - 1) / greatest(odds - 1, 1e-9))", 0.2, 1.0, True)
BY_WEEK = _blocks("week", "greatest(0.0, p - 1 / odds)", 0.6, 4.0, False)


def bets(spark, sf):
    """Every order as a bet of its customer; those of status P are settled."""
    o = table(spark, sf, "orders")
    key, name = F.col("o_orderkey"), lambda c, n: F.concat(F.lit(c), (F.col("o_orderkey") % n).cast("string"))
    one, two = name("A", 50), name("B", 40)
    on = F.when(key % 37 == 0, "Q").when(F.col("o_custkey") % 2 == 0, one).otherwise(two)
    stake, odds = F.when(key % 41 != 0, F.floor("o_totalprice") % 20000 + 1).otherwise(0), 105 + key * 7 % 400
    settled = F.col("o_orderstatus") == "P"
    profit = F.when(key % 3 == 0, stake * (odds - 100)).otherwise(-stake * 100) + (key % 97 == 0).cast("int")
    first = (on == one) != (key % 13 == 0)
    return o.select(
        key.alias("source_row"), F.when((key % 32).isin(1, 2) & (F.col("o_custkey") % 5 == 0), key - key % 32).otherwise(key).alias("bet_id"), F.col("o_custkey").alias("account"), (key + (key % 53 == 0).cast("int") * 1_000_000_000).alias("match_id"),
        one.alias("p1"), two.alias("p2"), F.to_date("o_orderdate").alias("date"), on.alias("bet_on"), first.alias("on_first"), stake.cast("bigint").alias("stake"), odds.alias("odds"), F.when(settled, "settled").otherwise("pending").alias("status"), F.when(settled, profit).cast("bigint").alias("profit"))


def results(spark, sf):
    """Every line as a report of its order's match: sides in either order, some of them void, late, or of another pair."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    key, n = F.col("l_orderkey"), F.col("l_linenumber")
    one, two = F.concat(F.lit("A"), (key % 50).cast("string")), F.when((n == 7) & (key % 2 == 0), "Z").otherwise(F.concat(F.lit("B"), (key % 40).cast("string")))
    turned = n % 2 == 0
    first = (key % 4 < 2) != ((n == 6) & (key % 3 == 0))
    winner = F.when((n == 5) & (key % 4 == 0), -1).when(key % 11 == 0, -1).when(key % 7 == 0, None).when(first != turned, 1).otherwise(2)
    return l.select(key.alias("match_id"), F.when(turned, two).otherwise(one).alias("p1"), F.when(turned, one).otherwise(two).alias("p2"), F.date_add(F.to_date("o_orderdate"), ((n == 4) & (key % 9 == 0)).cast("int")).alias("date"), winner.alias("winner"))


def b16(spark, sf):
    return fold.settlement_plan(bets(spark, sf), results(spark, sf), 2_000_000).select("source_row", "bet_id", "account", "reasons", "result", "profit", "place", "after", "digest")


B16 = """WITH RECURSIVE b AS (SELECT o_orderkey AS source_row, CASE WHEN o_orderkey % 32 IN (1, 2) AND o_custkey % 5 = 0 THEN o_orderkey - o_orderkey % 32 ELSE o_orderkey END AS bet_id, o_custkey AS account, o_orderkey + CASE WHEN o_orderkey % 53 = 0 THEN 1000000000 ELSE 0 END AS match_id,
  'A' || (o_orderkey % 50) AS p1, 'B' || (o_orderkey % 40) AS p2, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 37 = 0 THEN 'Q' WHEN o_custkey % 2 = 0 THEN 'A' || (o_orderkey % 50) ELSE 'B' || (o_orderkey % 40) END AS bet_on,
  CASE WHEN o_orderkey % 41 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 20000 + 1 ELSE 0 END AS stake, 105 + o_orderkey * 7 % 400 AS odds, o_orderstatus = 'P' AS settled FROM orders),
c AS (SELECT *, (bet_on = p1) <> (source_row % 13 = 0) AS on_first, CASE WHEN settled THEN CASE WHEN source_row % 3 = 0 THEN stake * (odds - 100) ELSE -stake * 100 END + CASE WHEN source_row % 97 = 0 THEN 1 ELSE 0 END END AS profit FROM b),
acc AS (SELECT account, CAST(coalesce(sum(profit), 0) AS BIGINT) AS opening, coalesce(bool_or(settled AND profit NOT IN (stake * (odds - 100), -stake * 100)), false) AS blocked FROM c GROUP BY 1),
rep AS (SELECT bet_id, count(*) > 1 AS repeated FROM c GROUP BY 1),
l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(o_orderdate AS DATE) + CASE WHEN l_linenumber = 4 AND l_orderkey % 9 = 0 THEN 1 ELSE 0 END AS d, 'A' || (l_orderkey % 50) AS one, CASE WHEN l_linenumber = 7 AND l_orderkey % 2 = 0 THEN 'Z' ELSE 'B' || (l_orderkey % 40) END AS two FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT *, least(one, two) || '|' || greatest(one, two) AS pair, CASE WHEN n = 5 AND k % 4 = 0 OR k % 11 = 0 THEN 'void' WHEN k % 7 = 0 THEN NULL WHEN (k % 4 < 2) <> (n = 6 AND k % 3 = 0) THEN one ELSE two END AS who FROM l),
g AS (SELECT k, any_value(pair) AS pair, any_value(d) AS rd, count(DISTINCT pair) AS pairs, count(DISTINCT d) AS days, count(DISTINCT who) AS whos, max(CASE WHEN who <> 'void' THEN who END) AS winner FROM m GROUP BY k),
s AS (SELECT *, CASE WHEN pairs > 1 OR days > 1 THEN 'ambiguous_match' WHEN whos > 1 THEN 'conflicting_winners' WHEN whos = 1 AND winner IS NULL THEN 'void' WHEN winner IS NULL THEN 'unresolved' ELSE 'winner' END AS state FROM (SELECT * REPLACE (CASE WHEN pairs > 1 THEN (SELECT min(x.pair) FROM m x WHERE x.k = g.k) ELSE pair END AS pair, (SELECT min(x.d) FROM m x WHERE x.k = g.k) AS rd) FROM g)),
q AS (SELECT c.*, opening, bet_on = winner AS won, list_filter([CASE WHEN blocked THEN 'account_blocked' END, CASE WHEN repeated THEN 'nonunique_bet_id' END, CASE WHEN state IS NULL THEN 'no_result' WHEN state <> 'winner' THEN state END, CASE WHEN pair <> least(p1, p2) || '|' || greatest(p1, p2) THEN 'pair_mismatch' END, CASE WHEN rd <> c.d THEN 'date_mismatch' END,
  CASE WHEN bet_on NOT IN (p1, p2) THEN 'side_not_in_pair' WHEN on_first <> (bet_on = p1) THEN 'side_orientation' END, CASE WHEN stake <= 0 THEN 'invalid_stake' END, CASE WHEN odds <= 100 THEN 'invalid_odds' END], lambda x: x IS NOT NULL) AS faults FROM c JOIN acc USING (account) JOIN rep USING (bet_id) LEFT JOIN s ON s.k = c.match_id WHERE NOT settled),
e AS (SELECT *, CASE WHEN won THEN stake * (odds - 100) ELSE -stake * 100 END AS gain, row_number() OVER (PARTITION BY account ORDER BY d, match_id, bet_id) AS rn FROM q WHERE len(faults) = 0),
f AS (SELECT DISTINCT account, 0::BIGINT AS rn, 2000000 + opening AS capital, 0::BIGINT AS place, '' AS digest, NULL::BIGINT AS source_row, NULL::BIGINT AS bet_id, '' AS reasons, false AS won, NULL::BIGINT AS gain FROM e UNION ALL
  SELECT e.account, e.rn, CASE WHEN e.stake * 100 > capital THEN capital ELSE capital + e.gain END, CASE WHEN e.stake * 100 > capital THEN place ELSE place + 1 END, CASE WHEN e.stake * 100 > capital THEN digest ELSE sha256(digest || '|' || e.bet_id || ':' || e.gain || ':' || (capital + e.gain)) END, e.source_row, e.bet_id, CASE WHEN e.stake * 100 > capital THEN 'insufficient_capital' ELSE '' END, e.won, e.gain FROM f JOIN e ON e.account = f.account AND e.rn = f.rn + 1)
SELECT source_row, bet_id, account, reasons, CASE WHEN reasons = '' THEN CASE WHEN won THEN 'win' ELSE 'loss' END END AS result, CASE WHEN reasons = '' THEN gain END AS profit, CASE WHEN reasons = '' THEN place END AS place, CASE WHEN reasons = '' THEN capital END AS after, CASE WHEN reasons = '' THEN digest END AS digest FROM f WHERE rn > 0
UNION ALL SELECT source_row, bet_id, account, array_to_string(faults, ','), NULL, NULL, NULL, NULL, NULL FROM q WHERE len(faults) > 0"""

QUERIES = {
    "b05_sequential_path": (sequential, SEQUENTIAL),
    "b05_day_blocks": (by_day, BY_DAY),
    "b05_week_blocks": (by_week, BY_WEEK),
    "b16_settlement_refusals": (b16, B16),
}
