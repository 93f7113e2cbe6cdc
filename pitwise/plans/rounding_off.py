"""The rest of the inventory: smaller operators of every family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwise.functions import text as tx
from pitwise.functions.rates import kelly
from pitwise.functions.similarity import ratio
from pitwise.operators import dedup, evaluate, joins, simulate, store
from pitwise.plans.analogues import LOG, LONG, MATCHES, OBS, QUOTES, WIDE, matches, observations, prediction_log, quotes, scored
from pitwise.plans.point_in_time import r6
from pitwise.session import table


def p06(spark, sf):
    """Open-vocabulary one-hot by a pivot."""
    o = table(spark, sf, "orders")
    return o.groupBy("o_custkey").pivot("o_orderstatus").agg(F.count(F.lit(1))).fillna(0)


P06 = "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1"


def p11(spark, sf):
    c = table(spark, sf, "customer").withColumn("age", F.col("c_custkey") % 40)
    return c.select("c_custkey", F.col("age").between(24, 28).cast("int").alias("peak"))


P11 = "SELECT c_custkey, CAST(c_custkey % 40 BETWEEN 24 AND 28 AS INTEGER) AS peak FROM customer"


def p14(spark, sf):
    """Draw size: what the title says, else what the level usually has."""
    p = table(spark, sf, "part")
    title = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 5 == 0, "Grand Slam").when(F.col("p_size") % 5 == 1, "Draw 96").when(F.col("p_size") % 5 == 2, "Challenger"))
    said = F.regexp_extract(title, "Draw ([0-9]+)", 1).try_cast("int")
    return p.select("p_partkey", F.coalesce(said, F.when(F.lower(title).rlike("grand slam"), 128).otherwise(32)).alias("draw"))


P14 = "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 128 WHEN 1 THEN 96 ELSE 32 END AS draw FROM part"


def p21(spark, sf):
    e = table(spark, sf, "events")
    age = F.timestamp_diff("HOUR", F.col("ts").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return e.select("event_id", F.when(age < 24, "fresh").when(age < 24 * 7, "due").otherwise("stale").alias("sla"))


P21 = "WITH a AS (SELECT event_id, date_sub('hour', ts, TIMESTAMP '2024-01-31 00:00:00') AS a FROM events) SELECT event_id, CASE WHEN a < 24 THEN 'fresh' WHEN a < 168 THEN 'due' ELSE 'stale' END AS sla FROM a"


def p24(spark, sf):
    edge = F.col("p_nn") - 1 / F.col("odds1")
    band = F.when(edge < 0, "none").when(edge < 0.02, "thin").when(edge < 0.05, "fair").when(edge < 0.1, "good").otherwise("strong")
    return prediction_log(spark, sf).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


P24 = f"WITH {LOG}, e AS (SELECT p_nn - 1/odds1 AS e FROM log) SELECT CASE WHEN e < 0 THEN 'none' WHEN e < 0.02 THEN 'thin' WHEN e < 0.05 THEN 'fair' WHEN e < 0.1 THEN 'good' ELSE 'strong' END AS band, count(*) AS n FROM e GROUP BY 1"


def p26(spark, sf):
    """Feature columns picked by name, their values summed."""
    l = prediction_log(spark, sf)
    picked = [c for c in l.columns if c.startswith("p_")]
    return l.select("uid", r6(sum((F.col(c) for c in picked[1:]), F.col(picked[0]))).alias("total"))


P26 = f"WITH {LOG} SELECT uid, round(p_nn + p_xgb + p_rf + p_market + 1e-10, 6) AS total FROM log"


def p30(spark, sf):
    title = F.concat(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, " / Doubles").otherwise(""), F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    p = table(spark, sf, "part").withColumn("title", title)
    return p.select("p_partkey", F.lower("title").rlike("doubles|/").alias("doubles"), F.regexp_extract("title", r"\(([0-9]+)\)$", 1).cast("int").alias("expected"))


P30 = "SELECT p_partkey, p_size % 3 = 0 AS doubles, p_size AS expected FROM part"


def p32(spark, sf):
    """Health of each source with the reasons that hold."""
    g = table(spark, sf, "events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.avg("value").alias("mean"), F.count_if(F.col("value") > 60).alias("high"))
    reasons = F.filter(F.array(F.when(F.col("last") < 5, "low"), F.when(F.col("high") > 10, "noisy"), F.when(F.col("last") > F.col("mean"), "rising")), lambda x: x.isNotNull())
    return g.select("event_type", F.array_join(reasons, ",").alias("reasons"), F.when(F.size(reasons) == 0, "healthy").otherwise("degraded").alias("state"))


P32 = """WITH g AS (SELECT event_type, arg_max(value, (ts, event_id)) AS l, avg(value) AS m, count(*) FILTER (WHERE value > 60) AS h FROM events GROUP BY 1), r AS (SELECT event_type, concat_ws(',', CASE WHEN l < 5 THEN 'low' END, CASE WHEN h > 10 THEN 'noisy' END, CASE WHEN l > m THEN 'rising' END) AS reasons FROM g)
SELECT event_type, reasons, CASE WHEN reasons = '' THEN 'healthy' ELSE 'degraded' END AS state FROM r"""


def j13(spark, sf):
    """Pending rows of one pair close in time: the order-free key, then days."""
    m = matches(spark, sf).where("won is null").select("id", joins.pair_key(F.col("p1"), F.col("p2")).alias("pair"), "day")
    near = joins.band_join(m, m.select("pair", F.col("id").alias("other"), F.col("day").alias("other_day")), ["pair"], "day", "other_day", 3).where("other < id")
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("near"))


J13 = f"WITH {MATCHES}, m AS (SELECT * FROM matches WHERE won IS NULL) SELECT a.id, count(*) AS near FROM m a JOIN m b ON a.p1 = b.p1 AND a.p2 = b.p2 AND abs(a.day - b.day) <= 3 AND b.id < a.id GROUP BY a.id"


def j17(spark, sf):
    """Best fuzzy match at a ratio of 0.8 or more, among names that share three letters in a row (as all such pairs of eight letters or more do) or, if shorter, two."""
    p = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    typo = p.select(F.col("k").alias("id"), F.regexp_replace("p_name", "e", "3").alias("wrong"))
    a, b = joins.grams(typo, "wrong", 3).select("id", "wrong", "gram"), joins.grams(p, "p_name", 3).select("k", "p_name", "gram")
    pairs = a.join(b, "gram").where(F.abs(F.length("wrong") - F.length("p_name")) <= 3).select("id", "k", "wrong", "p_name").distinct()
    best = pairs.withColumn("ratio", ratio("wrong", "p_name")).where("ratio >= 0.8")
    return best.groupBy("id").agg(F.max(F.struct("ratio", -F.col("k"))).alias("b")).select("id", (-F.col("b.col2")).alias("k"), r6(F.col("b.ratio")).alias("ratio"))


def j20(spark, sf):
    """Boards that list a match exactly twice are bound to it; others stay open."""
    q = quotes(spark, sf).where("prob > 0.05")
    g = q.groupBy("uid", "run").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    return g.where("n = 2").select("uid", F.col("run").cast("string").alias("run"), "a", "b")


J20 = f"WITH {QUOTES} SELECT uid, CAST(run AS VARCHAR) AS run, min(event_id) AS a, max(event_id) AS b FROM quotes WHERE prob > 0.05 GROUP BY uid, run HAVING count(*) = 2"


def j21(spark, sf):
    """Nations under two spellings: names that are alike share a word or all letters, so those are the join keys."""
    n = table(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), F.concat(F.lit("Re "), F.col("n_name")).alias("x"))
    b = n.select(F.col("n_nationkey").alias("b"), F.concat(F.upper("n_name"), F.when(F.col("n_nationkey") % 2 == 0, " re").otherwise("")).alias("y"))
    keys = lambda c: F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), tx.name_key(F.col(c)))), F.split(tx.normalised(F.col(c)), " "))))
    near = a.withColumn("key", keys("x")).join(b.withColumn("key", keys("y")), "key").where(tx.names_alike(F.col("x"), F.col("y")))
    return near.select("a", "b").distinct()


_NORM = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
J21 = f"""WITH t AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, string_split({_NORM("'Re ' || a.n_name")}, ' ') AS x, string_split({_NORM("upper(b.n_name) || CASE WHEN b.n_nationkey % 2 = 0 THEN ' re' ELSE '' END")}, ' ') AS y FROM nation a, nation b)
SELECT a, b FROM t WHERE list_has_all(y, x) OR list_has_all(x, y) OR (x[-1] = y[-1] AND x[1][1] = y[1][1]) OR regexp_replace(array_to_string(x, ''), '[^a-z]', '', 'g') = regexp_replace(array_to_string(y, ''), '[^a-z]', '', 'g')"""


def j24(spark, sf):
    """Facts of the latest year: a join to one aggregated row."""
    o = observations(spark, sf)
    return o.join(o.groupBy("player").agg(F.max("day").alias("last")), "player").where("day = last").select("id", "player")


J24 = f"WITH {OBS} SELECT id, player FROM obs o WHERE day = (SELECT max(day) FROM obs i WHERE i.player = o.player)"


def j25(spark, sf):
    """Later rows joined to each player's opening row; kept where the opening one is blank or agrees."""
    o = observations(spark, sf)
    opening = dedup.first(o.select("player", "day", "id", "won"), ["player"], ["day", "id"]).select("player", F.col("id").alias("opening"), F.col("won").alias("w0"))
    return o.join(opening, "player", "left").where(F.col("w0").isNull() | (F.col("w0") == F.col("won"))).select("id", "opening")


J25 = f"WITH {OBS}, f AS (SELECT player, arg_min(id, (day, id)) AS opening, (array_agg(won ORDER BY day, id))[1] AS w0 FROM obs GROUP BY player) SELECT id, opening FROM obs LEFT JOIN f USING (player) WHERE w0 IS NULL OR w0 = won"


def a17(spark, sf):
    g = scored(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"), evaluate.accuracy("y", "p").alias("accuracy"))
    market = g.where("model = 'market'").select(F.col("accuracy").alias("m"))
    return g.join(F.broadcast(market)).select("model", "n", r6(F.col("accuracy") - F.col("m")).alias("over_market"))


A17 = f"WITH {LONG}, g AS (SELECT model, count(*) AS n, avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS a FROM scored GROUP BY 1) SELECT model, n, round(a - (SELECT a FROM g WHERE model = 'market') + 1e-10, 6) AS over_market FROM g"


def a22(spark, sf):
    hit = ((F.col("odds1") < F.col("odds2")) == (F.col("y") == 1)).cast("double")
    return prediction_log(spark, sf).groupBy("segment").agg(r6(F.avg(hit)).alias("favourite_accuracy"))


A22 = f"WITH {LOG} SELECT segment, round(avg(CAST((odds1 < odds2) = (y = 1) AS INTEGER)) + 1e-10, 6) AS favourite_accuracy FROM log GROUP BY 1"


def a24(spark, sf):
    return scored(spark, sf).groupBy("uid").agg(F.bool_or(F.col("p") > 0.9).alias("any_sure"), F.bool_and(F.col("p") > 0.3).alias("all_possible"))


A24 = f"WITH {LONG} SELECT uid, bool_or(p > 0.9) AS any_sure, bool_and(p > 0.3) AS all_possible FROM scored GROUP BY uid"


def a35(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    bucket = F.when(F.col("o_totalprice") < 50000, "small").when(F.col("o_totalprice") < 250000, "medium").otherwise("large")
    return o.groupBy(bucket.alias("bucket"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


A35 = "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 250000 THEN 'medium' ELSE 'large' END AS bucket, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL"


def a37(spark, sf):
    edges = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    return scored(spark, sf).groupBy("model").agg(*[F.count_if((F.col("p") >= a) & (F.col("p") < b)).alias(f"from_{int(a * 100)}") for a, b in zip(edges, edges[1:])])


A37 = f"WITH {LONG} SELECT model, " + ", ".join(f"count(*) FILTER (WHERE p >= {a} AND p < {b}) AS from_{int(a * 100)}" for a, b in zip((0.0, 0.2, 0.4, 0.6, 0.8), (0.2, 0.4, 0.6, 0.8, 1.0))) + " FROM scored GROUP BY model"


def m10(spark, sf):
    """Replay manifest: each prediction's reasons and tier, counted."""
    l = prediction_log(spark, sf)
    reasons = F.filter(F.array(F.when(~F.col("gold"), "not_gold"), F.when(F.col("odds1") < 1.5, "short_odds"), F.when(F.abs(F.col("p_nn") - F.col("p_rf")) > 0.8, "models_differ")), lambda x: x.isNotNull())
    tier = F.when(F.size(reasons) == 0, "verified").when(F.size(reasons) == 1, "partial").otherwise("excluded")
    return l.select(tier.alias("tier"), F.explode(F.concat(reasons, F.array(F.lit("any")))).alias("reason")).groupBy("tier", "reason").agg(F.count(F.lit(1)).alias("n"))


M10 = f"WITH {LOG}, r AS (SELECT list_filter([CASE WHEN NOT gold THEN 'not_gold' END, CASE WHEN odds1 < 1.5 THEN 'short_odds' END, CASE WHEN abs(p_nn - p_rf) > 0.8 THEN 'models_differ' END], lambda x: x IS NOT NULL) AS r FROM log), u AS (SELECT CASE len(r) WHEN 0 THEN 'verified' WHEN 1 THEN 'partial' ELSE 'excluded' END AS tier, unnest(list_append(r, 'any')) AS reason FROM r) SELECT tier, reason, count(*) AS n FROM u GROUP BY ALL"


def d02(spark, sf):
    """Rows in round order within an event, the newest event first."""
    place = F.when(F.col("n") == 7, 1).when(F.col("n") == 6, 2).when(F.col("n") == 5, 3).otherwise(4)
    w = Window.partitionBy("p1").orderBy(F.desc("day"), place, "id")
    return matches(spark, sf, wide=True).select("id", F.row_number().over(w).alias("place"))


D02 = f"WITH {WIDE} SELECT id, CAST(row_number() OVER (PARTITION BY p1 ORDER BY day DESC, CASE n WHEN 7 THEN 1 WHEN 6 THEN 2 WHEN 5 THEN 3 ELSE 4 END, id) AS INTEGER) AS place FROM matches"


def d09(spark, sf):
    """The latest row of each match within the latest run."""
    q = quotes(spark, sf)
    last = q.agg(F.max("run").alias("run"))
    return dedup.latest(q.join(last, "run", "left_semi"), ["uid"], ["ts", "event_id"]).select("uid", "event_id", r6(F.col("prob")).alias("prob"))


D09 = f"WITH {QUOTES} SELECT uid, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(prob, (ts, event_id)) + 1e-10, 6) AS prob FROM quotes WHERE run = (SELECT max(run) FROM quotes) GROUP BY uid"


def d13(spark, sf):
    """Lineage: an immutable record beats derived ones; where vectors differ beyond tolerance the key is a conflict."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linestatus") == "F").alias("immutable"), F.array("l_discount", "l_tax").alias("v"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    best = l.groupBy("k").agg(F.max(F.struct("immutable", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "v")).alias("b"))
    near = F.forall(F.zip_with(F.col("v"), F.col("b.v"), lambda x, y: F.abs(x - y) <= 0.05 + 1e-9), lambda x: x)
    return l.join(best, "k").groupBy("k").agg(F.bool_and(near).alias("consistent"), F.max(F.col("b.immutable")).alias("immutable"))


D13 = """WITH b AS (SELECT l_orderkey AS k, arg_max(l_discount, (l_linestatus = 'F', l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) AS d, arg_max(l_tax, (l_linestatus = 'F', l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) AS t, bool_or(l_linestatus = 'F') AS im FROM lineitem GROUP BY 1)
SELECT k, bool_and(abs(l_discount - d) <= 0.05 + 1e-9 AND abs(l_tax - t) <= 0.05 + 1e-9) AS consistent, bool_or(im) AS immutable FROM lineitem JOIN b ON l_orderkey = k GROUP BY k"""


def d14(spark, sf):
    """What to fetch first: unknown entries by how often they are needed, each once."""
    o = table(spark, sf, "orders")
    need = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("need"), F.max("o_orderdate").alias("last"))
    return need.orderBy(F.desc("need"), F.desc("last"), "o_custkey").limit(50).select("o_custkey", "need")


D14 = "SELECT o_custkey, need FROM (SELECT o_custkey, count(*) AS need, max(o_orderdate) AS last FROM orders GROUP BY 1) ORDER BY need DESC, last DESC, o_custkey LIMIT 50"


def b07(spark, sf):
    """Bootstrap of whole months, as many as there are: blocks drawn by hash, their results summed."""
    l = prediction_log(spark, sf).withColumn("profit", F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    blocks = l.groupBy(F.date_format("d", "yyyy-MM").alias("block")).agg(F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("bets"))
    # one row a month: calendar time bounds them
    numbered = blocks.select((F.row_number().over(Window.orderBy("block")) - 1).cast("bigint").alias("number"), "profit", "bets")
    return simulate.bootstrap(numbered, "number", numbered.count(), 100, 23).groupBy("sim").agg(F.round(F.sum("profit"), 4).alias("profit"), F.sum("bets").alias("bets"))


B07 = f"""WITH {LOG}, b AS (SELECT strftime(d, '%Y-%m') AS block, sum(CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END) AS profit, count(*) AS bets FROM log GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY block) - 1 AS number, profit, bets, count(*) OVER () AS size FROM b),
d AS (SELECT s.range AS sim, CAST('0x' || substr(md5('23:' || s.range || ':' || number), 1, 8) AS BIGINT) % size AS n FROM n, range(100) s) SELECT sim, round(sum(profit), 4) AS profit, CAST(sum(bets) AS BIGINT) AS bets FROM d JOIN n ON n.number = d.n GROUP BY sim"""


def b08(spark, sf):
    """Permutations of the months of every season: the worst and best running result of each ordering."""
    l = prediction_log(spark, sf).withColumn("profit", F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    blocks = l.groupBy("yr", F.month("d").alias("m")).agg(F.sum("profit").alias("profit"))
    sims = blocks.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(199))))
    key = F.md5(F.concat_ws(":", F.col("sim").cast("string"), F.col("m").cast("string")))
    w = Window.partitionBy("yr", "sim").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return sims.withColumn("total", F.sum("profit").over(w)).groupBy("yr", "sim").agg(F.round(F.min("total"), 4).alias("worst"), F.round(F.max("total"), 4).alias("best"))


B08 = f"""WITH {LOG}, b AS (SELECT yr, month(d) AS m, sum(CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END) AS profit FROM log GROUP BY 1, 2), s AS (SELECT yr, CAST(range AS INTEGER) AS sim, sum(profit) OVER (PARTITION BY yr, range ORDER BY md5(range || ':' || m) ROWS UNBOUNDED PRECEDING) AS total FROM b, range(200))
SELECT CAST(yr AS INTEGER) AS yr, sim, round(min(total), 4) AS worst, round(max(total), 4) AS best FROM s GROUP BY yr, sim"""


def b11(spark, sf):
    l = prediction_log(spark, sf).withColumn("profit", F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    w = Window.partitionBy("player").orderBy("d", "uid").rowsBetween(Window.unboundedPreceding, 0)
    e = simulate.drawdown(l.withColumn("equity", 10 + F.sum("profit").over(w)), "equity", ["player"], ["d", "uid"])
    return e.groupBy("player").agg(F.bool_or(F.col("drawdown") >= 0.3 + 1e-9).alias("deep"), F.bool_or(F.col("equity") <= 6 + 1e-9).alias("floor"))


B11 = f"""WITH {LOG}, e AS (SELECT player, d, uid, 10 + sum(CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END) OVER (PARTITION BY player ORDER BY d, uid ROWS UNBOUNDED PRECEDING) AS e FROM log), p AS (SELECT *, max(e) OVER (PARTITION BY player ORDER BY d, uid ROWS UNBOUNDED PRECEDING) AS m FROM e)
SELECT player, bool_or((m - e) / m >= 0.3 + 1e-9) AS deep, bool_or(e <= 6 + 1e-9) AS floor FROM p GROUP BY player"""


def b13(spark, sf):
    """Research strategies side by side: full, half and fixed stakes where confident and with a fair edge."""
    l = prediction_log(spark, sf)
    fair = (1 / F.col("odds1")) / (1 / F.col("odds1") + 1 / F.col("odds2"))
    l = l.where((F.greatest(F.col("p_nn"), 1 - F.col("p_nn")) >= 0.575) & ~F.col("p_nn").between(0.47, 0.53) & (F.col("p_nn") - fair > 0.05))
    ret = F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0)
    k = kelly(F.col("p_nn"), F.col("odds1"))
    return l.groupBy("segment").agg(F.count(F.lit(1)).alias("bets"), F.round(F.sum(k * ret), 4).alias("full"), F.round(F.sum(0.5 * k * ret), 4).alias("half"), F.round(F.sum(0.01 * ret), 4).alias("fixed"))


B13 = f"""WITH {LOG}, k AS (SELECT segment, greatest(0.0, ((odds1-1)*p_nn-(1-p_nn))/(odds1-1)) AS k, CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END AS r FROM log WHERE greatest(p_nn, 1 - p_nn) >= 0.575 AND NOT p_nn BETWEEN 0.47 AND 0.53 AND p_nn - (1/odds1)/(1/odds1+1/odds2) > 0.05)
SELECT segment, count(*) AS bets, round(sum(k * r), 4) AS full, round(sum(0.5::DOUBLE * k * r), 4) AS half, round(sum(0.01::DOUBLE * r), 4) AS fixed FROM k GROUP BY segment"""


def b14(spark, sf):
    """Backing the favourite at one unit."""
    fav = F.col("odds1") <= F.col("odds2")
    won = fav == (F.col("y") == 1)
    profit = F.when(won, F.least("odds1", "odds2") - 1).otherwise(-1.0)
    return prediction_log(spark, sf).groupBy("yr").agg(F.count(F.lit(1)).alias("bets"), F.round(F.sum(profit), 4).alias("profit"))


B14 = f"WITH {LOG} SELECT CAST(yr AS INTEGER) AS yr, count(*) AS bets, round(sum(CASE WHEN (odds1 <= odds2) = (y = 1) THEN least(odds1, odds2) - 1 ELSE -1.0 END), 4) AS profit FROM log GROUP BY yr"


def b16(spark, sf):
    """Settlement plan: events in order, capital before and after, a digest of each account's plan."""
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    change = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 1000).otherwise(-(F.col("o_orderkey") % 700))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    plan = o.select("o_custkey", "o_orderkey", "o_orderdate", (100000 + F.sum(change).over(w)).alias("after"))
    line = F.struct("o_orderdate", "o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("after").cast("string")).alias("t"))
    g = plan.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), ",").alias("t"), F.min("after").alias("lowest"))
    return g.select("o_custkey", "lowest", F.sha2("t", 256).alias("digest"))


B16 = """WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(100000 + sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 1000 ELSE -(o_orderkey % 700) END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS after FROM orders WHERE o_orderstatus <> 'P')
SELECT o_custkey, min(after) AS lowest, sha256(string_agg(o_orderkey || ':' || after, ',' ORDER BY o_orderdate, o_orderkey)) AS digest FROM p GROUP BY 1"""


def v03(spark, sf):
    s = scored(spark, sf).withColumn("version", F.col("yr"))
    return dedup.latest(s.select("segment", "model", "version", "uid", "p"), ["segment", "model", "version"], ["uid"]).select("segment", "model", "version", "uid", r6(F.col("p")).alias("p"))


V03 = f"WITH {LONG} SELECT segment, model, CAST(yr AS INTEGER) AS version, max(uid) AS uid, round(arg_max(p, uid) + 1e-10, 6) AS p FROM scored GROUP BY ALL"


def v06(spark, sf):
    """Rounds on which the evidence agrees, with the latest evidence."""
    m = matches(spark, sf)
    g = m.groupBy("orderkey").agg(F.countDistinct("n").alias("k"), F.min("n").alias("round"), F.max_by("id", F.struct("day", "id")).alias("evidence"))
    return g.where("k = 1").select("orderkey", "round", "evidence")


V06 = f'WITH {MATCHES} SELECT orderkey, min(n) AS "round", arg_max(id, (day, id)) AS evidence FROM matches GROUP BY orderkey HAVING count(DISTINCT n) = 1'


def v11(spark, sf):
    """Typed rows and quarantined ones: text that does not fit its type, or keys that contradict."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 40 == 0, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("q"))
    t = l.withColumn("value", F.col("q").try_cast("double"))
    # keys are grouped as numbers and written afterwards; values contradict each other if the least is not the greatest, so none is counted
    g = t.groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("value").isNull()).alias("bad"), (F.min("value") != F.max("value")).alias("differ"))
    k = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return g.select(k.alias("k"), F.when(F.col("bad"), "type").when(F.col("differ"), "conflict").otherwise("ok").alias("status"))


V11 = "SELECT l_orderkey || ':' || l_linenumber AS k, CASE WHEN count(*) FILTER (WHERE l_partkey % 40 = 0) > 0 THEN 'type' WHEN count(DISTINCT l_quantity) > 1 THEN 'conflict' ELSE 'ok' END AS status FROM lineitem GROUP BY 1"


def r09(spark, sf):
    """Chart series: of one instant the last row, none from the start on."""
    q = quotes(spark, sf).where(F.col("ts") < F.col("start_at"))
    hourly = q.withColumn("instant", F.date_trunc("hour", "ts"))
    return dedup.latest(hourly.select("uid", "instant", "ts", "event_id", "prob"), ["uid", "instant"], ["ts", "event_id"]).select("uid", F.date_format("instant", "yyyy-MM-dd HH").alias("instant"), r6(F.col("prob")).alias("prob"))


R09 = f"WITH {QUOTES} SELECT uid, strftime(ts, '%Y-%m-%d %H') AS instant, round(arg_max(prob, (ts, event_id)) + 1e-10, 6) AS prob FROM quotes WHERE ts < start_at GROUP BY ALL"


def r08(spark, sf):
    """Retry eligibility: the attempt before is at least six hours old."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(w).cast("timestamp"), F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.coalesce(gap >= 6 * 3600, F.lit(True)).alias("eligible"))


R08 = "SELECT event_id, coalesce(date_sub('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) >= 21600, true) AS eligible FROM events"


def f18(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("1-URGENT", "F", "2-HIGH", "SF", "3-MEDIUM", "QF")])
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderpriority")), F.lit("R")).alias("code"))


F18 = "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'F' WHEN '2-HIGH' THEN 'SF' WHEN '3-MEDIUM' THEN 'QF' ELSE 'R' END AS code FROM orders"


def f23(spark, sf):
    """Fingerprint of a feature vector: its names and values in order, in one canonical text."""
    cols = ["p_nn", "p_xgb", "p_rf"]
    text = F.concat_ws(";", *[F.concat(F.lit(c + "="), F.format_string("%.6f", F.col(c))) for c in cols])
    return prediction_log(spark, sf).select("uid", F.sha2(text, 256).alias("fingerprint"))


F23 = f"WITH {LOG} SELECT uid, sha256('p_nn=' || printf('%.6f', p_nn) || ';p_xgb=' || printf('%.6f', p_xgb) || ';p_rf=' || printf('%.6f', p_rf)) AS fingerprint FROM log"


def f26(spark, sf):
    v = F.when(F.col("event_id") % 9 == 0, F.lit("NaN").cast("double")).when(F.col("event_id") % 11 == 0, F.lit("Infinity").cast("double")).otherwise(F.col("value"))
    return table(spark, sf, "events").withColumn("v", v).select("event_id", F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v")).alias("v"))


F26 = "SELECT event_id, CASE WHEN event_id % 9 > 0 AND event_id % 11 > 0 THEN value END AS v FROM events"

QUERIES = {
    "p06_pivot_one_hot": (p06, P06), "p11_peak_age": (p11, P11), "p14_draw_size": (p14, P14), "p21_staleness": (p21, P21), "p24_edge_bands": (p24, P24), "p26_feature_columns": (p26, P26), "p30_buckets": (p30, P30), "p32_health": (p32, P32),
    "j13_nearby_pairs": (j13, J13), "j17_fuzzy_best": (j17, None), "j20_board_binding": (j20, J20), "j21_loose_names": (j21, J21), "j24_latest_status": (j24, J24), "j25_opening_join": (j25, J25),
    "a17_family_summary": (a17, A17), "a22_favourite": (a22, A22), "a24_any_all": (a24, A24), "a35_pending_buckets": (a35, A35), "a37_distribution": (a37, A37), "m10_manifest": (m10, M10),
    "d02_round_order": (d02, D02), "d09_latest_run": (d09, D09), "d13_lineage": (d13, D13), "d14_priority": (d14, D14),
    "b07_block_bootstrap": (b07, B07), "b08_permutations": (b08, B08), "b11_bust_flags": (b11, B11), "b13_strategies": (b13, B13), "b14_favourites": (b14, B14), "b16_settlement_plan": (b16, B16),
    "v03_current_predictions": (v03, V03), "v06_round_consensus": (v06, V06), "v11_typed_quarantine": (v11, V11), "r08_retry": (r08, R08), "r09_chart_series": (r09, R09), "f18_round_codes": (f18, F18), "f23_vector_fingerprint": (f23, F23), "f26_finite": (f26, F26),
}
