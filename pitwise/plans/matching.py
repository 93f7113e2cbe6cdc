"""Queries that match, resolve and deduplicate (families J, D and U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwise.functions import text as tx
from pitwise.operators import dedup, joins
from pitwise.operators.evaluate import in_every_model
from pitwise.operators.features import first_known
from pitwise.plans.analogues import LOG, LONG, MATCHES, OBS, QUOTES, matches, observations, prediction_log, quotes, scored
from pitwise.plans.point_in_time import r6
from pitwise.session import table


def j01(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", first_known(F.col("c_mktsegment"), F.col("o_orderpriority")).alias("segment"), F.greatest("c_acctbal", F.col("o_totalprice") / 100).alias("best"))


J01 = "SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS segment, greatest(c_acctbal, o_totalprice / 100) AS best FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


def j02(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.validated_left(o, table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"]).select("o_orderkey", "c_name")


J02 = "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


def j03(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.to_date("ts").cast("string"))
    a = e.where("event_type = 'error'").groupBy("d", "user_id").agg(F.count(F.lit(1)).alias("errors"))
    b = e.where("event_type = 'purchase'").groupBy("d", "user_id").agg(F.count(F.lit(1)).alias("purchases"))
    return a.join(b, ["d", "user_id"], "full").select("d", "user_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("purchases", F.lit(0)).alias("purchases"))


J03 = """WITH e AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events), a AS (SELECT d, user_id, count(*) AS errors FROM e WHERE event_type = 'error' GROUP BY ALL), b AS (SELECT d, user_id, count(*) AS purchases FROM e WHERE event_type = 'purchase' GROUP BY ALL)
SELECT d, user_id, coalesce(errors, 0) AS errors, coalesce(purchases, 0) AS purchases FROM a FULL JOIN b USING (d, user_id)"""


def j04(spark, sf):
    o = observations(spark, sf)
    a = o.groupBy("player", "won").agg(F.max("rank").alias("best"))
    return o.join(a.withColumnsRenamed({"player": "p", "won": "w"}), (F.col("player") == F.col("p")) & F.col("won").eqNullSafe(F.col("w"))).select("id", F.coalesce("best", "rank").alias("best"))


J04 = f"WITH {OBS}, a AS (SELECT player, won, max(rank) AS best FROM obs GROUP BY ALL) SELECT id, best FROM obs JOIN a ON obs.player = a.player AND obs.won IS NOT DISTINCT FROM a.won"


def j07(spark, sf):
    o = observations(spark, sf)
    b = o.select("player", F.col("id").alias("other"), F.col("day").alias("other_day"))
    return joins.band_join(o.select("player", "id", "day"), b, ["player"], "day", "other_day", 6).where("id < other").select("id", "other", (F.col("other_day") - F.col("day")).alias("gap"))


J07 = f"WITH {OBS} SELECT a.id, b.id AS other, b.day - a.day AS gap FROM obs a JOIN obs b ON a.player = b.player AND abs(a.day - b.day) <= 6 AND a.id < b.id"


def j08(spark, sf):
    m = matches(spark, sf).where("won is not null").withColumn("winner", F.when(F.col("won") == 1, F.col("p1")).otherwise(F.col("p2"))).withColumn("loser", F.when(F.col("won") == 1, F.col("p2")).otherwise(F.col("p1")))
    a, b = m.select("id", "winner", "loser", "day"), m.select(F.col("loser").alias("winner"), F.col("winner").alias("loser"), F.col("id").alias("other"), F.col("day").alias("other_day"))
    return joins.band_join(a, b, ["winner", "loser"], "day", "other_day", 2).where("id < other").groupBy("winner", "loser").agg(F.count(F.lit(1)).alias("flips"), F.min("id").alias("first"))


J08 = f"""WITH {MATCHES}, m AS (SELECT id, day, CASE WHEN won = 1 THEN p1 ELSE p2 END AS winner, CASE WHEN won = 1 THEN p2 ELSE p1 END AS loser FROM matches WHERE won IS NOT NULL)
SELECT a.winner, a.loser, count(*) AS flips, min(a.id) AS first FROM m a JOIN m b ON a.winner = b.loser AND a.loser = b.winner AND abs(a.day - b.day) <= 2 AND a.id < b.id GROUP BY ALL"""


def j09(spark, sf):
    """Two sources of one fixture, orders either way, days at most one apart: exact days first."""
    m = matches(spark, sf)
    a = m.where("id % 2 = 0").select("id", joins.pair_key(F.col("p1"), F.col("p2")).alias("pair"), "day")
    b = m.where("id % 2 = 1").select(F.col("id").alias("other"), joins.pair_key(F.col("p2"), F.col("p1")).alias("pair"), F.col("day").alias("other_day"))
    return joins.nearest(a, b, ["pair"], "day", "other_day", 1, ["id"], "other")


J09 = f"""WITH {MATCHES}, p AS (SELECT a.id, abs(a.day - b.day) AS gap, b.id AS other FROM matches a JOIN matches b ON a.id % 2 = 0 AND b.id % 2 = 1 AND a.p1 = b.p1 AND a.p2 = b.p2 AND abs(a.day - b.day) <= 1)
SELECT id, min(gap) AS gap, arg_min(other, (gap, other)) AS other FROM p GROUP BY id"""


def j10(spark, sf):
    o = observations(spark, sf)
    a, b = o.where("id % 2 = 0").select("player", "id", "day"), o.where("id % 2 = 1").select("player", F.col("id").alias("other"), "day")
    return joins.probe(a, b, ["player"], "day", (0, 1, -1), ["id"], "other")


J10 = f"""WITH {OBS}, p AS (SELECT a.id, b.id AS other, b.day - a.day AS o, CASE b.day - a.day WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS k FROM obs a JOIN obs b ON a.player = b.player AND abs(a.day - b.day) <= 1 AND a.id % 2 = 0 AND b.id % 2 = 1)
SELECT id, CAST(arg_min(o, (k, other)) AS INTEGER) AS "offset", arg_min(other, (k, other)) AS other FROM p GROUP BY id"""


def j11(spark, sf):
    o = observations(spark, sf)
    old, new = o.where("id % 3 > 0"), o.where("id % 3 = 0").select("player", F.col("day").alias("other_day"))
    return joins.overlap_anti(old, new, ["player"], "day", "other_day", 3, "id").select("id", "player", "day")


J11 = f"WITH {OBS} SELECT id, player, day FROM obs a WHERE id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM obs b WHERE b.id % 3 = 0 AND b.player = a.player AND abs(a.day - b.day) <= 3)"


def j12(spark, sf):
    o = observations(spark, sf)
    a, b = o.where("won is null").select("player", "id", "day"), o.where("won is not null").select("player", F.col("id").alias("other"), F.col("day").alias("other_day"))
    return joins.nearest(a, b, ["player"], "day", "other_day", 30, ["id"], "other")


J12 = f"""WITH {OBS}, p AS (SELECT a.id, abs(a.day - b.day) AS gap, b.id AS other FROM obs a JOIN obs b ON a.player = b.player AND abs(a.day - b.day) <= 30 AND a.won IS NULL AND b.won IS NOT NULL) SELECT id, min(gap) AS gap, arg_min(other, (gap, other)) AS other FROM p GROUP BY id"""


def j14(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    has = c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", F.lit("has").alias("kind"))
    none = c.join(o.where("o_orderstatus = 'P' and o_totalprice > 300000"), c.c_custkey == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("none").alias("kind"))
    return has.unionByName(none)


J14 = "SELECT c_custkey, 'has' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'none' FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)"


def j15(spark, sf):
    s = scored(spark, sf).where("not (model = 'rf' and uid % 5 = 0)")
    return in_every_model(s).select("uid", "model", r6(F.col("p")).alias("p"))


J15 = f"WITH {LONG}, s AS (SELECT * FROM scored WHERE NOT (model = 'rf' AND uid % 5 = 0)) SELECT uid, model, round(p + 1e-10, 6) AS p FROM s WHERE uid IN (SELECT uid FROM s GROUP BY uid HAVING count(DISTINCT model) = 4)"


def j16(spark, sf):
    """Part names, as written elsewhere, against all parts: exact, then letters alone, then brand and last word."""
    p = table(spark, sf, "part")
    known = p.select(F.col("p_partkey").alias("target"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("k0"), tx.name_key(F.concat_ws(" ", "p_name", "p_type")).alias("k1"), F.concat_ws(" ", "p_brand", tx.surname(F.col("p_name"))).alias("k2"))
    names = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("a0"), tx.name_key(F.concat_ws(" ", F.upper("p_name"), "p_type")).alias("a1"), F.concat_ws(" ", "p_brand", tx.surname(F.col("p_name"))).alias("a2"))
    return joins.resolve_in_stages(names, known, [("a0", "k0"), ("a1", "k1"), ("a2", "k2")], "p_partkey", "target")


J16 = """WITH n AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS a0, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z]', '', 'g') AS a1, p_brand || ' ' || string_split(p_name, ' ')[-1] AS a2 FROM part),
k0 AS (SELECT a0, min(p_partkey) AS t FROM n GROUP BY a0 HAVING count(*) = 1), k1 AS (SELECT a1, min(p_partkey) AS t FROM n GROUP BY a1 HAVING count(*) = 1), k2 AS (SELECT a2, min(p_partkey) AS t FROM n GROUP BY a2 HAVING count(*) = 1)
SELECT p_partkey, coalesce(k0.t, k1.t, k2.t) AS target, CAST(CASE WHEN k0.t IS NOT NULL THEN 0 WHEN k1.t IS NOT NULL THEN 1 WHEN k2.t IS NOT NULL THEN 2 END AS INTEGER) AS stage FROM n LEFT JOIN k0 USING (a0) LEFT JOIN k1 USING (a1) LEFT JOIN k2 USING (a2)"""


def j18(spark, sf):
    """Every part's title against the catalogue of names and brands."""
    p = table(spark, sf, "part")
    known = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("target")).select("target", tx.tokens(F.concat_ws(" ", "p_name", "p_brand")).alias("tokens"))
    titles = p.select("p_partkey", tx.tokens(F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("tokens"))
    return joins.best_by_tokens(titles, known, "p_partkey", "target", "tokens", 0.4, 0.05).select("p_partkey", "target", r6(F.col("score")).alias("score"))


J18 = """WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_name || ' ' || p_brand), '[a-z0-9]+')) AS k FROM part), c AS (SELECT min(p_partkey) AS target, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+')) AS k FROM part GROUP BY p_name, p_brand),
s AS (SELECT a.p_partkey, b.target, len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) AS score FROM t a JOIN c b ON list_has_any(a.k, b.k)),
r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC, target)) SELECT p_partkey, target, round(score + 1e-10, 6) AS score FROM r WHERE place = 1 AND score >= 0.4 AND score - coalesce(nxt, 0) > 0.05"""


def j19(spark, sf):
    """Settlement candidates scored by evidence; refused when low or when the runner-up is close."""
    o = observations(spark, sf)
    a, b = o.where("won is null").select("player", "id", "day", "surface", "rank"), o.where("won is not null").select("player", F.col("id").alias("other"), F.col("day").alias("other_day"), F.col("surface").alias("s2"), F.col("rank").alias("r2"))
    gap = F.abs(F.col("day") - F.col("other_day"))
    date = F.when(gap == 0, 25).when(gap <= 3, 20).when(gap <= 10, 12).when(gap <= 20, 4).otherwise(-18)
    score = 50 + date + F.when(F.col("surface") == F.col("s2"), 10).otherwise(-12) + F.when(F.abs(F.col("rank") - F.col("r2")) < 50000, 12).otherwise(-6)
    pairs = joins.band_join(a, b, ["player"], "day", "other_day", 45).select("id", "other", score.alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    best = pairs.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("place = 1")
    return best.where((F.col("score") >= 50) & (F.col("score") - F.coalesce("next", F.lit(0)) > 5)).select("id", "other", "score")


J19 = f"""WITH {OBS}, p AS (SELECT a.id, b.id AS other, CAST(50 + CASE WHEN a.day = b.day THEN 25 WHEN abs(a.day - b.day) <= 3 THEN 20 WHEN abs(a.day - b.day) <= 10 THEN 12 WHEN abs(a.day - b.day) <= 20 THEN 4 ELSE -18 END + CASE WHEN a.surface = b.surface THEN 10 ELSE -12 END + CASE WHEN abs(a.rank - b.rank) < 50000 THEN 12 ELSE -6 END AS INTEGER) AS score
FROM obs a JOIN obs b ON a.player = b.player AND abs(a.day - b.day) <= 45 AND a.won IS NULL AND b.won IS NOT NULL), r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY id ORDER BY score DESC, other))
SELECT id, other, score FROM r WHERE place = 1 AND score >= 50 AND score - coalesce(nxt, 0) > 5"""


def j22(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


J22 = "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"


def j23(spark, sf):
    e = table(spark, sf, "events")
    return joins.dominant_value(e.select("user_id", F.to_date("ts").cast("string").alias("d"), "event_type"), ["user_id", "d"], "event_type")


J23 = """WITH c AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY user_id, d ORDER BY n DESC, event_type))
SELECT user_id, d, event_type, n FROM r WHERE place = 1 AND (nxt IS NULL OR n >= 3 * nxt)"""


def d04(spark, sf):
    o = observations(spark, sf)
    return dedup.latest(o, ["player"], ["day", "id"])


D04 = f"WITH {OBS} SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY player ORDER BY day DESC, id DESC) = 1"


def d05(spark, sf):
    o = observations(spark, sf).select("player", "surface", "day", "id", "rank")
    a = dedup.first(o, ["player", "surface"], ["day", "id"]).withColumnsRenamed({"id": "first_id", "rank": "first_rank"}).drop("day")
    z = dedup.latest(o, ["player", "surface"], ["day", "id"]).withColumnsRenamed({"id": "last_id", "rank": "last_rank"}).drop("day")
    return a.join(z, ["player", "surface"])


D05 = f"WITH {OBS} SELECT player, surface, arg_min(id, (day, id)) AS first_id, arg_min(rank, (day, id)) AS first_rank, arg_max(id, (day, id)) AS last_id, arg_max(rank, (day, id)) AS last_rank FROM obs GROUP BY ALL"


def d06(spark, sf):
    q = quotes(spark, sf)
    return dedup.open_close(q, "uid", "ts", "prob", "event_id", F.col("start_at")).select("uid", r6(F.col("open")).alias("open"), r6(F.col("close")).alias("close"), "instants")


D06 = f"WITH {QUOTES} SELECT uid, round(arg_min(prob, (ts, -event_id)) + 1e-10, 6) AS open, round(arg_max(prob, (ts, event_id)) + 1e-10, 6) AS close, count(DISTINCT ts) AS instants FROM quotes WHERE ts < start_at GROUP BY uid HAVING count(DISTINCT ts) >= 2"


def d07(spark, sf):
    m = matches(spark, sf).where("won is not null")
    winner = F.when(F.col("won") == 1, F.col("p1")).otherwise(F.col("p2"))
    m = m.select("day", F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b"), winner.alias("winner"), "id", "price")
    return dedup.one_if_agreed(m, ["day", "a", "b"], "winner", [F.col("price"), -F.col("id")])


D07 = f"""WITH {MATCHES}, m AS (SELECT day, least(p1, p2) AS a, greatest(p1, p2) AS b, CASE WHEN won = 1 THEN p1 ELSE p2 END AS winner, id, price FROM matches WHERE won IS NOT NULL)
SELECT day, a, b, max(winner) AS winner, arg_max(id, (price, -id)) AS id, max(price) AS price FROM m GROUP BY day, a, b HAVING count(DISTINCT winner) = 1"""


def d08(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("pri"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("fresh"))
    q = F.when(F.col("status") == "P", 0).otherwise(1) + F.when(F.col("pri") == "1-URGENT", 1).otherwise(0)
    return dedup.merge_sources(o.where("fresh % 2 = 0"), o.where("fresh % 2 = 1"), ["k"], q, "fresh", {"status": F.col("status") == "F"})


D08 = """WITH o AS (SELECT o_custkey AS k, o_orderpriority AS pri, o_orderstatus AS status, o_orderkey AS fresh, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS q FROM orders)
SELECT k, arg_max(pri, (q, fresh)) AS pri, coalesce(max(status) FILTER (WHERE status = 'F'), arg_max(status, (q, fresh))) AS status, arg_max(fresh, (q, fresh)) AS fresh FROM o GROUP BY k"""


def d10(spark, sf):
    return dedup.work_queue(observations(spark, sf).where("won is null").select("id", "player", "day"), F.col("player") % 10 == 0, "day", "id", 500)


D10 = f"WITH {OBS} SELECT id, player, day FROM obs WHERE won IS NULL ORDER BY CASE WHEN player % 10 = 0 THEN 0 ELSE 1 END, CASE WHEN player % 10 = 0 THEN day ELSE -day END, id LIMIT 500"


def d11(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("key", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return dedup.contradictions(l.withColumn("digest", F.md5(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))), "key", "digest")


D11 = "SELECT l_orderkey || ':' || l_linenumber AS key, count(DISTINCT (l_partkey, l_suppkey)) AS digests, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1"


def d12(spark, sf):
    g = observations(spark, sf).groupBy("player", "surface").agg(F.count(F.lit(1)).alias("n"), (F.max("day") - F.min("day")).alias("spread"))
    return g.where("n > 1 and spread <= 90")


D12 = f"WITH {OBS} SELECT player, surface, count(*) AS n, max(day) - min(day) AS spread FROM obs GROUP BY ALL HAVING count(*) > 1 AND max(day) - min(day) <= 90"


def d15(spark, sf):
    rows = dedup.duplicate_groups(observations(spark, sf).where("won is null"), ["player", "surface"], ["day", "id"])
    return rows.select("id", "group_size", "place")


D15 = f"WITH {OBS} SELECT id, count(*) OVER (PARTITION BY player, surface) AS group_size, CAST(row_number() OVER (PARTITION BY player, surface ORDER BY day, id) AS INTEGER) AS place FROM obs WHERE won IS NULL"


def d16(spark, sf):
    m = matches(spark, sf).where("won is not null").withColumn("winner", F.when(F.col("won") == 1, F.col("p1")).otherwise(F.col("p2")))
    g = m.groupBy("orderkey").agg(F.countDistinct("p1", "p2").alias("pairs"), F.countDistinct("winner").alias("winners"), F.bool_or(F.col("tax") > 0.07).alias("bad"), F.min("winner").alias("w"))
    return g.select("orderkey", F.when((F.col("pairs") == 1) & (F.col("winners") == 1) & ~F.col("bad"), F.col("w")).alias("winner"))


D16 = f"WITH {MATCHES} SELECT orderkey, CASE WHEN count(DISTINCT (p1, p2)) = 1 AND count(DISTINCT CASE WHEN won = 1 THEN p1 ELSE p2 END) = 1 AND NOT bool_or(tax > 0.07) THEN min(CASE WHEN won = 1 THEN p1 ELSE p2 END) END AS winner FROM matches WHERE won IS NOT NULL GROUP BY orderkey"


def d03(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity")).orderBy(F.desc("quantity"), "l_partkey").limit(20)


D03 = "SELECT l_partkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1 ORDER BY quantity DESC, l_partkey LIMIT 20"


def u01(spark, sf):
    m = matches(spark, sf)
    return m.select("id", F.col("p1").alias("player")).unionAll(m.select("id", F.col("p2").alias("player")))


U01 = f"WITH {MATCHES} SELECT id, p1 AS player FROM matches UNION ALL SELECT id, p2 FROM matches"


def u02(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment", F.lit("customer").alias("source"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal", F.lit("supplier").alias("source")), allowMissingColumns=True)


U02 = "SELECT c_custkey AS k, c_mktsegment, 'customer' AS source, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, NULL, 'supplier', s_acctbal FROM supplier"


def u03(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n")), table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("first only")))


U03 = "SELECT n, 'both' AS kind FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT n, 'first only' FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)"


def u05(spark, sf):
    p = table(spark, sf, "part")
    a, b = tx.tokens(F.col("p_name")), tx.tokens(F.concat_ws(" ", "p_type", "p_name"))
    return p.select("p_partkey", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_except(b, a)).alias("more"), r6(tx.jaccard(a, b)).alias("jaccard"))


U05 = """WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9]+')) AS b FROM part)
SELECT p_partkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, CAST(len(list_filter(b, lambda x: NOT list_contains(a, x))) AS INTEGER) AS more, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 1e-10, 6) AS jaccard FROM t"""


def u06(spark, sf):
    """Plan against store: keys of one side alone, and counts that differ."""
    o = table(spark, sf, "orders")
    plan = o.where("o_orderkey % 7 <> 0").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("planned"))
    store = o.where("o_orderkey % 11 <> 0").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("stored"))
    return plan.join(store, "o_custkey", "full").where("not (planned <=> stored)")


U06 = "SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, planned, stored FROM (SELECT o_custkey, count(*) AS planned FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS stored FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1) b ON a.o_custkey = b.o_custkey WHERE planned IS DISTINCT FROM stored"


def u07(spark, sf):
    l = prediction_log(spark, sf)
    a, b = l.where("uid % 9 <> 0").select("uid", "segment"), l.where("uid % 8 <> 0").select("uid", "segment")
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


U07 = f"WITH {LOG} SELECT uid, segment, 'a' AS only_in FROM log WHERE uid % 9 <> 0 AND uid % 8 = 0 UNION ALL SELECT uid, segment, 'b' FROM log WHERE uid % 8 <> 0 AND uid % 9 = 0"

QUERIES = {
    "j01_left_fill": (j01, J01), "j02_validated_left": (j02, J02), "j03_full_outer": (j03, J03), "j04_null_safe": (j04, J04), "j07_band_self": (j07, J07), "j08_flipped_pairs": (j08, J08),
    "j09_pm1_day": (j09, J09), "j10_offset_probe": (j10, J10), "j11_stitch_anti": (j11, J11), "j12_nearest_time": (j12, J12), "j14_semi_anti": (j14, J14), "j15_division": (j15, J15),
    "j16_multi_stage_resolve": (j16, J16), "j18_jaccard_resolve": (j18, J18), "j19_scored_candidate": (j19, J19), "j22_dim_lookup": (j22, J22), "j23_dominant_value": (j23, J23),
    "d03_top_k": (d03, D03), "d04_latest": (d04, D04), "d05_keep_first_last": (d05, D05), "d06_open_close": (d06, D06), "d07_semantic_dedup": (d07, D07), "d08_quality_merge": (d08, D08), "d10_work_queue": (d10, D10),
    "d11_contradiction": (d11, D11), "d12_duplicate_pairs": (d12, D12), "d15_pending_review": (d15, D15), "d16_result_consensus": (d16, D16),
    "u01_two_sided_union": (u01, U01), "u02_outer_concat": (u02, U02), "u03_set_difference": (u03, U03), "u05_token_sets": (u05, U05), "u06_plan_parity": (u06, U06), "u07_log_parity": (u07, U07),
}
