"""Queries over the history of an entity (families W and J of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwise.functions.dates import season_flags
from pitwise.functions.rates import laplace
from pitwise.operators import temporal as t
from pitwise.plans.analogues import MATCHES, OBS, WIDE, matches, observations
from pitwise.session import table

P, S = ["player"], ["player", "surface"]


def r6(x):
    """Six digits, with ties moved off the boundary so that every engine rounds them alike."""
    return F.round(x + 1e-10, 6)


def _frame(keys, lo, hi="1 PRECEDING", order="day"):
    return f"(PARTITION BY {keys} ORDER BY {order} RANGE BETWEEN {lo} PRECEDING AND {hi})"


def w01(spark, sf):
    return observations(spark, sf).select("id", *[t.prior_count(P, n).alias(f"n_{n}") for n in (90, 365, 730)])


W01 = f"WITH {OBS} SELECT id, " + ", ".join(f"count(*) OVER {_frame('player', n)} AS n_{n}" for n in (90, 365, 730)) + " FROM obs"


def w02(spark, sf):
    return observations(spark, sf).select("id", t.prior_count(S, 365).alias("surface_365"), t.prior_count(S).alias("surface_ever"))


W02 = f"WITH {OBS} SELECT id, count(*) OVER {_frame('player, surface', 365)} AS surface_365, count(*) OVER {_frame('player, surface', 'UNBOUNDED')} AS surface_ever FROM obs"


def w03(spark, sf):
    return observations(spark, sf).select("id", r6(t.prior_rate(S, days=730)).alias("surface_rate"))


W03 = f"WITH {OBS} SELECT id, round((coalesce(sum(won) OVER w, 0) + 1.5::DOUBLE) / (count(won) OVER w + 3.0::DOUBLE) + 1e-10, 6) AS surface_rate FROM obs WINDOW w AS {_frame('player, surface', 730)}"


def w04(spark, sf):
    found = t.recent_complete_days(observations(spark, sf), P, last=5, days=900)
    return found.select("id", "recent_n", "recent_wins", r6(laplace(F.col("recent_wins"), F.col("recent_n"))).alias("recent_rate"))


W04 = f"""WITH {OBS}, daily AS (SELECT player, day, count(*) AS n, sum(won) AS wins FROM obs WHERE won IS NOT NULL GROUP BY ALL),
pairs AS (SELECT t.player, t.day AS target, d.n, d.wins, sum(d.n) OVER (PARTITION BY t.player, t.day ORDER BY d.day DESC ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT DISTINCT player, day FROM obs) t JOIN daily d ON t.player = d.player AND d.day BETWEEN t.day - 900 AND t.day - 1),
found AS (SELECT player, target, sum(n) AS n, sum(wins) AS wins FROM pairs WHERE upto <= 5 GROUP BY ALL)
SELECT id, CAST(coalesce(n, 0) AS BIGINT) AS recent_n, CAST(coalesce(wins, 0) AS BIGINT) AS recent_wins, round((coalesce(wins, 0) + 1.5::DOUBLE) / (coalesce(n, 0) + 3.0::DOUBLE) + 1e-10, 6) AS recent_rate
FROM obs LEFT JOIN found ON obs.player = found.player AND obs.day = found.target"""


def w05(spark, sf):
    return t.streaks(observations(spark, sf), P).select("id", F.col("streak").cast("bigint").alias("streak"))


W05 = f"""WITH {OBS}, daily AS (SELECT player, day, count(*) AS n, CASE WHEN sum(won) = count(*) THEN 1 WHEN sum(won) = 0 THEN -1 ELSE 0 END AS r FROM obs WHERE won IS NOT NULL GROUP BY player, day),
marked AS (SELECT *, CASE WHEN r = 0 OR r IS DISTINCT FROM lag(r) OVER (PARTITION BY player ORDER BY day) THEN 1 ELSE 0 END AS c FROM daily),
isl AS (SELECT *, sum(c) OVER (PARTITION BY player ORDER BY day) AS island FROM marked),
runs AS (SELECT player, day, sum(n) OVER (PARTITION BY player, island ORDER BY day) * r AS streak FROM isl)
SELECT id, CAST(coalesce(streak, 0) AS BIGINT) AS streak FROM obs ASOF LEFT JOIN runs ON obs.player = runs.player AND obs.day > runs.day"""


def w06(spark, sf):
    return observations(spark, sf).select("id", F.round(t.form_trend(P, days=730, constant=365.0), 6).alias("trend"))


W06 = f"""WITH {OBS}, w AS (SELECT a.id, sum(exp(-(a.day - b.day) / 365.0::DOUBLE) * b.won) AS up, sum(exp(-(a.day - b.day) / 365.0::DOUBLE)) AS down
  FROM obs a JOIN obs b ON a.player = b.player AND b.day BETWEEN a.day - 730 AND a.day - 1 AND b.won IS NOT NULL GROUP BY a.id)
SELECT obs.id, round(coalesce(up / down, 0.5), 6) AS trend FROM obs LEFT JOIN w USING (id)"""


def w08(spark, sf):
    return observations(spark, sf).select("id", t.days_since_week(P).alias("days_since_week"))


W08 = f"WITH {OBS}, m AS (SELECT *, day - (day + 3) % 7 AS monday FROM obs) SELECT id, day - max(monday) OVER {_frame('player', 'UNBOUNDED', '7 PRECEDING', 'monday')} AS days_since_week FROM m"


def w09(spark, sf):
    since = t.days_since_week(P)
    return observations(spark, sf).select("id", F.coalesce(since, F.lit(60)).alias("days_off"), F.coalesce((since > 21).cast("int"), F.lit(0)).alias("rust"))


W09 = f"WITH {OBS}, m AS (SELECT *, day - (day + 3) % 7 AS monday FROM obs), s AS (SELECT id, day - max(monday) OVER {_frame('player', 'UNBOUNDED', '7 PRECEDING', 'monday')} AS d FROM m) SELECT id, coalesce(d, 60) AS days_off, CASE WHEN d > 21 THEN 1 ELSE 0 END AS rust FROM s"


def w11(spark, sf):
    return observations(spark, sf).select("id", F.round(t.volatility(P, "rank", 730), 3).alias("volatility"))


W11 = f"WITH {OBS} SELECT id, round(CASE WHEN count(rank) OVER w >= 3 THEN stddev_pop(rank) OVER w ELSE 0.0 END, 3) AS volatility FROM obs WINDOW w AS {_frame('player', 730)}"


def w12(spark, sf):
    found = t.last_clear(observations(spark, sf), P, "surface")
    return found.select("id", "last_surface", F.coalesce((F.col("last_surface") != F.col("surface")).cast("int"), F.lit(0)).alias("changed"))


W12 = f"""WITH {OBS}, days AS (SELECT player, day, CASE WHEN min(surface) = max(surface) THEN min(surface) END AS s FROM obs GROUP BY player, day)
SELECT id, s AS last_surface, CASE WHEN s <> surface THEN 1 ELSE 0 END AS changed FROM obs ASOF LEFT JOIN days ON obs.player = days.player AND obs.day > days.day"""


def w13(spark, sf):
    """Meetings so far, and the result of the last three of them within 60 days: each known row holds the latest three up to its day's end."""
    rows, pair = matches(spark, sf), ["p1", "p2"]
    ordered = Window.partitionBy(*pair).orderBy("day", "id")
    seen = F.when(F.col("won").isNotNull(), F.struct("day", "id", "won"))
    rows = rows.select("id", "day", "won", *pair, seen.alias("seen"))
    known = rows.where("won is not null").withColumn("held", F.collect_list("seen").over(ordered.rowsBetween(-2, 0)))
    known = known.groupBy(*pair, "day").agg(F.max(F.struct("id", "held"))["held"].alias("held")).withColumn("id", F.lit(None).cast("bigint")).withColumn("won", F.lit(None).cast("int"))
    both = rows.select("id", "day", "won", *pair, F.lit(None).cast(known.schema["held"].dataType).alias("held")).unionByName(known)
    met, wins = t.sliding_sum(F.col("won").isNotNull().cast("bigint"), pair, None), t.sliding_sum(F.col("won").cast("bigint"), pair, None)
    both = both.select("id", "day", met.alias("met"), wins.alias("p1_wins"), r6(t.prior_rate(pair)).alias("rate"), F.last("held", ignorenulls=True).over(t.before(pair)).alias("held")).where("id is not null")
    recent = F.filter("held", lambda x: x["day"] >= F.col("day") - 60)
    mean = F.try_divide(F.aggregate(recent, F.lit(0.0), lambda a, x: a + x["won"]), F.size(recent))
    return both.select("id", "met", "p1_wins", "rate", F.round(F.coalesce(mean - 0.5, F.lit(0.0)), 6).alias("recent_advantage"))


W13 = f"""WITH {MATCHES}, h AS (SELECT id, count(won) OVER w AS met, coalesce(sum(won) OVER w, 0) AS wins, list_sort(list((day, id, won)) FILTER (WHERE won IS NOT NULL) OVER (PARTITION BY p1, p2 ORDER BY day RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING)) AS r
  FROM matches WINDOW w AS {_frame('p1, p2', 'UNBOUNDED')})
SELECT id, met, CAST(wins AS BIGINT) AS p1_wins, round((wins + 1.5::DOUBLE) / (met + 3.0::DOUBLE) + 1e-10, 6) AS rate, round(coalesce(list_avg(list_transform(r[-3:], lambda x: x[3])) - 0.5, 0.0), 6) AS recent_advantage FROM h"""


def w14(spark, sf):
    rows = t.sides(matches(spark, sf, wide=True), "p1", "p2", "won")
    return rows.select("id", "side", t.prior_count(["player", "level"]).alias("level_n"), r6(t.prior_rate(["player", "level"])).alias("level_rate"))


BOTH = "sides AS (SELECT id, day, level, n, p1 AS player, p2 AS opponent, 1 AS side, won FROM matches UNION ALL SELECT id, day, level, n, p2, p1, 2, 1 - won FROM matches)"
W14 = f"WITH {WIDE}, {BOTH} SELECT id, side, count(*) OVER w AS level_n, round((coalesce(sum(won) OVER w, 0) + 1.5::DOUBLE) / (count(won) OVER w + 3.0::DOUBLE) + 1e-10, 6) AS level_rate FROM sides WINDOW w AS {_frame('player, level', 'UNBOUNDED')}"


def w15(spark, sf):
    rows = t.sides(matches(spark, sf, wide=True), "p1", "p2", "won")
    return rows.select("id", "side", r6(t.prior_rate(P, only=F.col("n").isin(1, 2))).alias("big_rate"))


W15 = f"WITH {WIDE}, {BOTH} SELECT id, side, round((coalesce(sum(CASE WHEN n IN (1, 2) THEN won END) OVER w, 0) + 1.5::DOUBLE) / (count(CASE WHEN n IN (1, 2) THEN won END) OVER w + 3.0::DOUBLE) + 1e-10, 6) AS big_rate FROM sides WINDOW w AS {_frame('player', 'UNBOUNDED')}"


def w16(spark, sf):
    rows = t.sides(matches(spark, sf, wide=True), "p1", "p2", "won")
    return rows.select("id", "side", r6(t.prior_rate(["player", "n"])).alias("round_rate"), r6(t.prior_rate(P, only=F.col("n") == 7)).alias("final_rate"))


W16 = f"WITH {WIDE}, {BOTH} SELECT id, side, round((coalesce(sum(won) OVER r, 0) + 1.5::DOUBLE) / (count(won) OVER r + 3.0::DOUBLE) + 1e-10, 6) AS round_rate, round((coalesce(sum(CASE WHEN n = 7 THEN won END) OVER w, 0) + 1.5::DOUBLE) / (count(CASE WHEN n = 7 THEN won END) OVER w + 3.0::DOUBLE) + 1e-10, 6) AS final_rate FROM sides WINDOW w AS {_frame('player', 'UNBOUNDED')}, r AS {_frame('player, n', 'UNBOUNDED')}"


def w17(spark, sf):
    rows = t.sides(matches(spark, sf, wide=True), "p1", "p2", "won")
    return rows.select("id", "side", r6(t.prior_rate(P, only=F.col("opponent") % 7 == 0)).alias("vs_group_rate"))


W17 = f"WITH {WIDE}, {BOTH} SELECT id, side, round((coalesce(sum(CASE WHEN opponent % 7 = 0 THEN won END) OVER w, 0) + 1.5::DOUBLE) / (count(CASE WHEN opponent % 7 = 0 THEN won END) OVER w + 3.0::DOUBLE) + 1e-10, 6) AS vs_group_rate FROM sides WINDOW w AS {_frame('player', 'UNBOUNDED')}"


def w18(spark, sf):
    """Momentum: the sides' changes against each other."""
    rows = t.sides(matches(spark, sf, wide=True).withColumn("rank", F.col("price")), "p1", "p2", "won")
    seen = rows.select("id", "side", F.avg("rank").over(t.before(P, 30)).alias("mean"))
    one, two = (seen.where(F.col("side") == s).select("id", F.col("mean").alias(f"m{s}")) for s in (1, 2))
    return one.join(two, "id").select("id", F.round(F.col("m1") - F.col("m2") + 1e-6, 2).alias("momentum"))


W18 = f"""WITH {WIDE}, s AS (SELECT id, day, price, p1 AS player, 1 AS side FROM matches UNION ALL SELECT id, day, price, p2, 2 FROM matches), d AS (SELECT player, day, sum(price) AS total, count(*) AS n FROM s GROUP BY player, day),
m AS (SELECT player, day, sum(total) OVER w / sum(n) OVER w AS mean FROM d WINDOW w AS {_frame('player', 30)})
SELECT s.id, round(max(CASE WHEN side = 1 THEN mean END) - max(CASE WHEN side = 2 THEN mean END) + 1e-6, 2) AS momentum FROM s JOIN m ON s.player = m.player AND s.day = m.day GROUP BY s.id"""


def w19(spark, sf):
    return observations(spark, sf).where("day < 10957").select("id", "player", "day")


W19 = f"WITH {OBS} SELECT id, player, day FROM obs WHERE day < 10957"


def w20(spark, sf):
    """The feature vector of every observation: one sort by player, one by player and surface."""
    o = t.with_day_bounds(observations(spark, sf), P, "rank")
    rows = o.select("id", "day", *[t.prior_count(P, n).alias(f"n_{n}") for n in (90, 365)], t.prior_count(S, 365).alias("surface_n"), r6(t.prior_rate(S, days=365)).alias("surface_rate"), F.round(t.form_trend(P, days=730, constant=365.0), 6).alias("trend"), t.days_since_week(P).alias("since_week"), F.round(t.volatility(P, "rank", 730), 3).alias("volatility"), F.round(t.change_since(P, "rank", 365), 2).alias("rank_change"))
    flags = season_flags(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")))
    return rows.select("*", *[v.alias(k) for k, v in flags.items()]).drop("day")


CHANGE = f"""chg AS (SELECT o.id, CASE WHEN d.lo = d.hi THEN d.lo - o.rank ELSE 0.0 END AS c FROM obs o ASOF LEFT JOIN (SELECT player, day, min(rank) AS lo, max(rank) AS hi FROM obs GROUP BY player, day) d ON o.player = d.player AND o.day - 365 >= d.day WHERE d.day >= o.day - 547)"""
W20 = f"""WITH {OBS}, {CHANGE}, m AS (SELECT *, day - (day + 3) % 7 AS monday, DATE '1970-01-01' + CAST(day AS INTEGER) AS d FROM obs),
tr AS (SELECT a.id, sum(exp(-(a.day - b.day) / 365.0::DOUBLE) * b.won) / sum(exp(-(a.day - b.day) / 365.0::DOUBLE)) AS v FROM obs a JOIN obs b ON a.player = b.player AND b.day BETWEEN a.day - 730 AND a.day - 1 AND b.won IS NOT NULL GROUP BY a.id),
f AS (SELECT id, d, count(*) OVER {_frame('player', 90)} AS n_90, count(*) OVER {_frame('player', 365)} AS n_365, count(*) OVER s AS surface_n, round((coalesce(sum(won) OVER s, 0) + 1.5::DOUBLE) / (count(won) OVER s + 3.0::DOUBLE) + 1e-10, 6) AS surface_rate,
  day - max(monday) OVER {_frame('player', 'UNBOUNDED', '7 PRECEDING', 'monday')} AS since_week, round(CASE WHEN count(rank) OVER v >= 3 THEN stddev_pop(rank) OVER v ELSE 0.0 END, 3) AS volatility
  FROM m WINDOW s AS {_frame('player, surface', 365)}, v AS {_frame('player', 730)})
SELECT f.id, n_90, n_365, surface_n, surface_rate, round(coalesce(tr.v, 0.5), 6) AS trend, since_week, volatility, round(coalesce(chg.c, 0.0), 2) AS rank_change,
  CAST(month(d) BETWEEN 4 AND 6 AS INTEGER) AS clay_season, CAST(month(d) BETWEEN 6 AND 7 AS INTEGER) AS grass_season, CAST(month(d) >= 10 OR month(d) <= 2 AS INTEGER) AS indoor_season
FROM f LEFT JOIN tr USING (id) LEFT JOIN chg USING (id)"""


def j05(spark, sf):
    o = observations(spark, sf).withColumn("known", F.when(F.col("won").isNotNull(), F.col("rank")))
    return o.select("id", t.asof_last(P, "known", "id").alias("asof_rank"))


J05 = f"""WITH {OBS}, k AS (SELECT player, day, arg_max(rank, id) AS r FROM obs WHERE won IS NOT NULL GROUP BY player, day)
SELECT id, r AS asof_rank FROM obs ASOF LEFT JOIN k ON obs.player = k.player AND obs.day > k.day"""


def j06(spark, sf):
    o = t.with_day_bounds(observations(spark, sf), P, "rank")
    return o.select("id", F.round(t.change_since(P, "rank", 365), 2).alias("rank_change"))


J06 = f"WITH {OBS}, {CHANGE} SELECT obs.id, round(coalesce(c, 0.0), 2) AS rank_change FROM obs LEFT JOIN chg USING (id)"


def j26(spark, sf):
    """As-of, the same day included, within 30 days: an order's rating is the customer's latest known total."""
    o = observations(spark, sf)
    rated = o.where(F.col("won").isNotNull())
    both = rated.select("player", "day", F.col("id").alias("rating_id"), "rank", F.lit(None).cast("bigint").alias("id")).unionByName(o.select("player", "day", F.lit(None).cast("bigint").alias("rating_id"), F.lit(None).cast("double").alias("rank"), "id"))
    w = Window.partitionBy("player").orderBy("day").rangeBetween(-30, 0)
    last = F.max(F.when(F.col("rating_id").isNotNull(), F.struct("day", "rating_id", "rank"))).over(w)
    return both.withColumn("last", last).where("id is not null").select("id", F.col("last.rank").alias("rating"), (F.col("day") - F.col("last.day")).alias("age"))


J26 = f"""WITH {OBS}, r AS (SELECT player, day, arg_max(rank, id) AS rank FROM obs WHERE won IS NOT NULL GROUP BY player, day)
SELECT id, CASE WHEN obs.day - r.day <= 30 THEN r.rank END AS rating, CASE WHEN obs.day - r.day <= 30 THEN obs.day - r.day END AS age FROM obs ASOF LEFT JOIN r ON obs.player = r.player AND obs.day >= r.day"""


def w31(spark, sf):
    rows = observations(spark, sf).withColumn("total", F.floor(F.col("rank") / 100000))
    return t.quarantine_shifted(rows, ["player", "total"], "day", "id", within=120).select("id", "player", "day")


W31 = f"""WITH RECURSIVE {OBS}, r AS (SELECT *, floor(rank / 100000) AS total, row_number() OVER (PARTITION BY player, floor(rank / 100000) ORDER BY day, id) AS rn FROM obs),
f AS (SELECT player, total, rn, id, day, day AS last, true AS keep FROM r WHERE rn = 1 UNION ALL SELECT r.player, r.total, r.rn, r.id, r.day, CASE WHEN r.day - f.last > 0 AND r.day - f.last <= 120 THEN f.last ELSE r.day END, NOT (r.day - f.last > 0 AND r.day - f.last <= 120) FROM f JOIN r ON r.player = f.player AND r.total = f.total AND r.rn = f.rn + 1)
SELECT id, player, day FROM f WHERE keep"""

QUERIES = {
    "w01_match_counts": (w01, W01),
    "w02_surface_counts": (w02, W02),
    "w03_surface_winrate": (w03, W03),
    "w04_recent_n_complete_day": (w04, W04),
    "w05_streak": (w05, W05),
    "w06_form_trend": (w06, W06),
    "w08_days_since_week": (w08, W08),
    "w09_rust": (w09, W09),
    "w11_rank_volatility": (w11, W11),
    "w12_last_surface": (w12, W12),
    "w13_h2h": (w13, W13),
    "w14_level_rate": (w14, W14),
    "w15_bigmatch_rate": (w15, W15),
    "w16_round_rate": (w16, W16),
    "w17_vs_group_rate": (w17, W17),
    "w18_momentum": (w18, W18),
    "w19_future_rows": (w19, W19),
    "w20_feature_vector": (w20, W20),
    "w31_shift_quarantine": (w31, W31),
    "j05_asof_rank": (j05, J05),
    "j06_rank_change": (j06, J06),
    "j26_asof_inclusive": (j26, J26),
}
