"""Queries that score forecasts (family A of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwise.operators import evaluate as ev
from pitwise.operators.prefix import running
from pitwise.plans.analogues import LOG, LONG, MATCHES, QUOTES, matches, prediction_log, quotes, scored
from pitwise.plans.point_in_time import r6
from pitwise.session import table


def rounded(df, keys, names):
    return df.select(*keys, *[r6(F.col(c)).alias(c) for c in names])


def a01(spark, sf):
    m = ev.metrics(scored(spark, sf), ["model"])
    return rounded(m, ["model", "n"], ["accuracy", "log_loss", "brier", "precision", "recall", "f1"])


METRICS = """count(*) AS n, round(avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) + 1e-10, 6) AS accuracy, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)) + 1e-10, 6) AS log_loss, round(avg((p - y) ** 2) + 1e-10, 6) AS brier"""
A01 = f"""WITH {LONG} SELECT model, {METRICS}, round(count(*) FILTER (WHERE p >= 0.5 AND y = 1) / count(*) FILTER (WHERE p >= 0.5) + 1e-10, 6) AS precision, round(count(*) FILTER (WHERE p >= 0.5 AND y = 1) / count(*) FILTER (WHERE y = 1) + 1e-10, 6) AS recall,
round(2.0::DOUBLE * count(*) FILTER (WHERE p >= 0.5 AND y = 1) / (count(*) FILTER (WHERE p >= 0.5) + count(*) FILTER (WHERE y = 1)) + 1e-10, 6) AS f1 FROM scored GROUP BY model"""


def a04(spark, sf):
    return rounded(ev.auc(scored(spark, sf), ["model", "segment"]), ["model", "segment"], ["auc"])


A04 = f"""WITH {LONG}, r AS (SELECT model, segment, y, p, rank() OVER (PARTITION BY model, segment ORDER BY p) + (count(*) OVER (PARTITION BY model, segment, p) - 1) / 2 AS mid FROM scored)
SELECT model, segment, round((sum(mid) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) + 1e-10, 6) AS auc FROM r GROUP BY ALL"""


def a05(spark, sf):
    return ev.roc(scored(spark, sf), ["model"]).select("model", r6(F.col("threshold")).alias("threshold"), r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


A05 = f"""WITH {LONG}, g AS (SELECT model, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY ALL),
c AS (SELECT model, p, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS all_pos, sum(neg) OVER (PARTITION BY model) AS all_neg FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC)),
d AS (SELECT *, tp - coalesce(lag(tp) OVER w, 0) AS dtp, fp - coalesce(lag(fp) OVER w, 0) AS dfp, lead(tp) OVER w - tp AS ntp, lead(fp) OVER w - fp AS nfp FROM c WINDOW w AS (PARTITION BY model ORDER BY p DESC))
SELECT model, round(p + 1e-10, 6) AS threshold, round(fp / all_neg + 1e-10, 6) AS fpr, round(tp / all_pos + 1e-10, 6) AS tpr FROM d WHERE coalesce(dtp * nfp <> dfp * ntp, true)"""


def a06(spark, sf):
    left = ev.ece(scored(spark, sf), ["model"]).withColumnRenamed("ece", "ece_left")
    right = ev.ece(scored(spark, sf), ["model"], closed="right").withColumnRenamed("ece", "ece_right")
    return rounded(left.join(right, "model"), ["model"], ["ece_left", "ece_right"])


A06 = f"""WITH {LONG}, a AS (SELECT model, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY ALL), c AS (SELECT model, greatest(ceil(p * 10) - 1, 0) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY ALL)
SELECT model, round((SELECT sum(n * abs(mp - my)) / sum(n) FROM a WHERE a.model = m.model) + 1e-10, 6) AS ece_left, round((SELECT sum(n * abs(mp - my)) / sum(n) FROM c WHERE c.model = m.model) + 1e-10, 6) AS ece_right FROM (SELECT DISTINCT model FROM scored) m"""


def a08(spark, sf):
    squeezed = scored(spark, sf).withColumn("p", F.col("p") * 0.8)
    return rounded(ev.reliability(squeezed, ["model"]), ["model", "bin", "n"], ["mean_p", "frequency"])


A08 = f"""WITH {LONG}, g AS (SELECT model, CAST(least(floor(p * 0.8 * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p * 0.8::DOUBLE) AS mp, avg(y) AS my FROM scored GROUP BY ALL)
SELECT m.model, b.bin, coalesce(n, 0) AS n, round(mp + 1e-10, 6) AS mean_p, round(my + 1e-10, 6) AS frequency FROM (SELECT DISTINCT model FROM scored) m CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b LEFT JOIN g ON g.model = m.model AND g.bin = b.bin"""


def a09(spark, sf):
    return rounded(ev.calibration_line(scored(spark, sf), ["model"]), ["model"], ["slope", "intercept"])


SCOPES = {"all": "true", "gold": "gold", "recent": "yr >= 1998", "confident": "p < 0.2 or p > 0.8", "gold_recent": "gold and yr >= 1998"}


def a12(spark, sf):
    rows = ev.cohorts(scored(spark, sf), {k: F.expr(v) for k, v in SCOPES.items()})
    both = rows.withColumn("segment", F.explode(F.array(F.lit("ALL"), F.col("segment"))))
    return rounded(ev.metrics(both, ["model", "tier", "segment"]), ["model", "tier", "segment", "n"], ["accuracy", "log_loss", "brier"])


TIERS = " UNION ALL ".join(f"SELECT *, '{k}' AS tier FROM scored WHERE {v}" for k, v in SCOPES.items())
A12 = f"WITH {LONG}, t AS ({TIERS}), u AS (SELECT * FROM t UNION ALL SELECT * REPLACE ('ALL' AS segment) FROM t) SELECT model, tier, segment, {METRICS} FROM u GROUP BY model, tier, segment"


def a13(spark, sf):
    rows = ev.cohorts(scored(spark, sf), {k: F.expr(v) for k, v in SCOPES.items()})
    return rounded(ev.reliability(rows, ["model", "tier"]), ["model", "tier", "bin", "n"], ["mean_p", "frequency"])


A13 = f"""WITH {LONG}, t AS ({TIERS}), g AS (SELECT model, tier, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM t GROUP BY ALL)
SELECT m.model, m.tier, b.bin, coalesce(n, 0) AS n, round(mp + 1e-10, 6) AS mean_p, round(my + 1e-10, 6) AS frequency FROM (SELECT DISTINCT model, tier FROM t) m CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b LEFT JOIN g ON g.model = m.model AND g.tier = m.tier AND g.bin = b.bin"""


def a14(spark, sf):
    l = prediction_log(spark, sf)
    hit = lambda p: F.avg(((F.col(p) >= 0.5) == (F.col("y") == 1)).cast("double"))
    g = l.groupBy("segment", "yr").agg(F.count(F.lit(1)).alias("n"), hit("p_nn").alias("model"), hit("p_market").alias("market")).where("n >= 3")
    return rounded(g, ["segment", "yr", "n"], ["model", "market"])


A14 = f"WITH {LOG} SELECT segment, CAST(yr AS INTEGER) AS yr, count(*) AS n, round(avg(CAST((p_nn >= 0.5) = (y = 1) AS INTEGER)) + 1e-10, 6) AS model, round(avg(CAST((p_market >= 0.5) = (y = 1) AS INTEGER)) + 1e-10, 6) AS market FROM log GROUP BY segment, yr HAVING count(*) >= 3"


def a15(spark, sf):
    l = prediction_log(spark, sf)
    a, b = ((F.col(c) >= 0.5) == (F.col("y") == 1) for c in ("p_nn", "p_market"))
    return l.groupBy("segment").agg(F.count_if(a & b).alias("both_right"), F.count_if(~a & ~b).alias("both_wrong"), F.count_if(a & ~b).alias("model_only"), F.count_if(~a & b).alias("market_only"))


A15 = f"WITH {LOG}, x AS (SELECT segment, (p_nn >= 0.5) = (y = 1) AS a, (p_market >= 0.5) = (y = 1) AS b FROM log) SELECT segment, count(*) FILTER (WHERE a AND b) AS both_right, count(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong, count(*) FILTER (WHERE a AND NOT b) AS model_only, count(*) FILTER (WHERE NOT a AND b) AS market_only FROM x GROUP BY segment"


def a16(spark, sf):
    tier = F.when(F.col("player") <= 0, None).when(F.col("player") <= 20, "1-20").when(F.col("player") <= 50, "21-50").when(F.col("player") <= 100, "51-100").when(F.col("player") <= 200, "101-200").otherwise("201+")
    l = prediction_log(spark, sf).withColumn("tier", tier).where("tier is not null")
    return rounded(l.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), ev.accuracy("y", "p_xgb").alias("accuracy")), ["tier", "n"], ["accuracy"])


A16 = f"WITH {LOG} SELECT CASE WHEN player <= 20 THEN '1-20' WHEN player <= 50 THEN '21-50' WHEN player <= 100 THEN '51-100' WHEN player <= 200 THEN '101-200' ELSE '201+' END AS tier, count(*) AS n, round(avg(CAST((p_xgb >= 0.5) = (y = 1) AS INTEGER)) + 1e-10, 6) AS accuracy FROM log WHERE player > 0 GROUP BY 1"


def a18(spark, sf):
    l = prediction_log(spark, sf).withColumn("edge", F.col("p_nn") - 1 / F.col("odds1")).where("edge > 0")
    l = l.withColumn("bucket", F.least(F.floor(F.col("edge") * 20), F.lit(10)).cast("int")).withColumn("profit", F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    g = l.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("profit").alias("roi"), (1.96 * F.stddev_pop("profit") / F.sqrt(F.count(F.lit(1)))).alias("half_width"), F.avg("y").alias("win_rate"), F.avg("odds1").alias("avg_odds"))
    return rounded(g, ["bucket", "n"], ["roi", "half_width", "win_rate", "avg_odds"])


A18 = f"""WITH {LOG}, e AS (SELECT *, p_nn - 1 / odds1 AS edge, CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END AS profit FROM log WHERE p_nn - 1 / odds1 > 0)
SELECT CAST(least(floor(edge * 20), 10) AS INTEGER) AS bucket, count(*) AS n, round(avg(profit) + 1e-10, 6) AS roi, round(1.96::DOUBLE * stddev_pop(profit) / sqrt(count(*)) + 1e-10, 6) AS half_width, round(avg(y) + 1e-10, 6) AS win_rate, round(avg(odds1) + 1e-10, 6) AS avg_odds FROM e GROUP BY 1"""


def a19(spark, sf):
    l = prediction_log(spark, sf).withColumn("bucket", F.floor(F.col("p_nn") * 20).cast("int"))
    g = l.groupBy("segment", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("hits"), F.avg(1 / F.col("odds1")).alias("share")).where("n >= 20")
    return g.select("segment", "bucket", "n", "hits", r6(ev.binomial_tail(F.col("hits"), F.col("n"), F.col("share"))).alias("p_value"))


A19 = f"""WITH {LOG}, g AS (SELECT segment, CAST(floor(p_nn * 20) AS INTEGER) AS bucket, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, avg(1 / odds1) AS share FROM log GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT segment, bucket, n, hits, round(least(1.0, list_sum(list_transform(range(hits, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(share) + (n - k) * ln(1 - share))))) + 1e-10, 6) AS p_value FROM g"""


def a20(spark, sf):
    l = prediction_log(spark, sf).where("y = 0")
    return l.withColumn("quintile", F.ntile(5).over(Window.partitionBy("segment").orderBy("odds1", "uid"))).groupBy("segment", "quintile").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("odds1"), 6).alias("lo"), F.round(F.max("odds1"), 6).alias("hi"))


A20 = f"WITH {LOG}, q AS (SELECT segment, odds1, CAST(ntile(5) OVER (PARTITION BY segment ORDER BY odds1, uid) AS INTEGER) AS quintile FROM log WHERE y = 0) SELECT segment, quintile, count(*) AS n, round(min(odds1), 6) AS lo, round(max(odds1), 6) AS hi FROM q GROUP BY ALL"


def a21(spark, sf):
    l = prediction_log(spark, sf)
    base = F.avg(((F.col("odds1") < F.col("odds2")) == (F.col("y") == 1)).cast("double"))
    return rounded(l.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), ev.accuracy("y", "p_nn").alias("model"), base.alias("favourite")), ["yr", "n"], ["model", "favourite"])


A21 = f"WITH {LOG} SELECT CAST(yr AS INTEGER) AS yr, count(*) AS n, round(avg(CAST((p_nn >= 0.5) = (y = 1) AS INTEGER)) + 1e-10, 6) AS model, round(avg(CAST((odds1 < odds2) = (y = 1) AS INTEGER)) + 1e-10, 6) AS favourite FROM log GROUP BY yr"


def a23(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("lang"), "")).alias("token")).where("token <> ''")
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(10)


A23 = "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(lang), '')) AS token FROM documents) WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 10"


def a25(spark, sf):
    """Markets that have exactly two sides: both prices in one row."""
    q = quotes(spark, sf).where(F.col("source").isin("click", "view"))
    q = q.withColumn("side", F.when(F.col("source") == "click", 1).otherwise(2))
    g = q.groupBy("uid", "run").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("side").alias("k"), F.max(F.when(F.col("side") == 1, F.col("prob"))).alias("p1"), F.max(F.when(F.col("side") == 2, F.col("prob"))).alias("p2"))
    return g.where("n = 2 and k = 2").select("uid", F.col("run").cast("string").alias("run"), r6(F.col("p1")).alias("p1"), r6(F.col("p2")).alias("p2"))


A25 = f"WITH {QUOTES} SELECT uid, CAST(run AS VARCHAR) AS run, round(max(prob) FILTER (WHERE source = 'click') + 1e-10, 6) AS p1, round(max(prob) FILTER (WHERE source = 'view') + 1e-10, 6) AS p2 FROM quotes WHERE source IN ('click', 'view') GROUP BY uid, run HAVING count(*) = 2 AND count(DISTINCT source) = 2"


def a26(spark, sf):
    """Field by field the value of the best provenance, of equal ones the latest: one aggregation."""
    q = quotes(spark, sf)
    rank = F.when(F.col("source") == "purchase", 3).when(F.col("source") == "click", 2).otherwise(1)
    pick = lambda c, ok: F.max(F.when(ok, F.struct(rank.alias("r"), "ts", "event_id", F.col(c).alias("v"))))["v"]
    return q.groupBy("uid").agg(r6(pick("prob", F.col("prob") > 0.02)).alias("prob"), pick("source", F.lit(True)).alias("source"))


A26 = f"""WITH {QUOTES}, r AS (SELECT *, CASE source WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS r FROM quotes)
SELECT uid, round(arg_max(prob, (r, ts, event_id)) FILTER (WHERE prob > 0.02) + 1e-10, 6) AS prob, arg_max(source, (r, ts, event_id)) AS source FROM r GROUP BY uid"""


def a27(spark, sf):
    o = table(spark, sf, "orders")
    amount = F.col("o_totalprice")
    total = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, amount).otherwise(0.0))
    g = o.groupBy(F.col("o_custkey").alias("account")).agg(total("F").alias("settled"), total("O").alias("lost"), total("P").alias("open"))
    balance = 1000000 + F.col("settled") - F.col("lost")
    return g.select("account", F.round(balance, 2).alias("balance"), F.round("open", 2).alias("exposure"), F.round(F.greatest(F.lit(0.0), balance - F.col("open")), 2).alias("available"))


A27 = """WITH g AS (SELECT o_custkey AS account, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END) AS s, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0.0 END) AS l, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0.0 END) AS o FROM orders GROUP BY 1)
SELECT account, round(1000000 + s - l, 2) AS balance, round(o, 2) AS exposure, round(greatest(0.0, 1000000 + s - l - o), 2) AS available FROM g"""


def a28(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("event_type").alias("value"), F.max("ts").alias("expires"), F.bool_or(F.col("value") > 30).alias("strong"), F.countDistinct("event_type").alias("k")).where("k = 1").drop("k").withColumn("d", F.col("d").cast("string"))


A28 = "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, min(event_type) AS value, max(ts) AS expires, bool_or(value > 30) AS strong FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 1"


def a29(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    kinds = e.groupBy("user_id", "d").agg(F.countDistinct("event_type").alias("values")).where("values > 3").select("user_id", F.col("d").cast("string").alias("key"), "values", F.lit("type").alias("kind"))
    hours = e.groupBy("user_id", F.concat(F.col("d").cast("string"), F.lit(" "), F.lpad(F.hour("ts").cast("string"), 2, "0")).alias("key")).agg(F.countDistinct("event_type").alias("values")).where("values > 1").select("user_id", "key", "values", F.lit("hour").alias("kind"))
    return kinds.unionByName(hours)


A29 = """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS key, count(DISTINCT event_type) AS values, 'type' AS kind FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 3
UNION ALL SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS key, count(DISTINCT event_type), 'hour' FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 1"""


def a30(spark, sf):
    """A seal over a group's rows: the digest of their ordered canonical lines, of lines digested first so that groups stay small."""
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    line = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    g = o.groupBy(F.col("o_custkey").alias("account")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"), F.count(F.lit(1)).alias("n"))
    return g.select("account", "n", F.sha2("text", 256).alias("seal"))


A30 = "SELECT o_custkey AS account, count(*) AS n, sha256(string_agg(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority, chr(10) ORDER BY (o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) COLLATE \"binary\")) AS seal FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"
A30 = A30.replace(' COLLATE "binary"', "")


def a31(spark, sf):
    """Of customers who share a segment and a balance class the one with most orders stands for all."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    rows = c.join(n, "c_custkey", "left").fillna(0, ["orders"]).withColumn("class", F.floor(F.col("c_acctbal") / 500))
    best = rows.groupBy("c_mktsegment", "c_nationkey", "class").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("orders", -F.col("c_custkey"))).alias("b")).where("members > 1")
    return best.select("c_mktsegment", "c_nationkey", "class", "members", (-F.col("b.col2")).alias("keep"), F.col("b.orders").alias("orders"))


A31 = """WITH n AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1), r AS (SELECT c.*, coalesce(orders, 0) AS orders, CAST(floor(c_acctbal / 500) AS BIGINT) AS class FROM customer c LEFT JOIN n ON c_custkey = o_custkey)
SELECT c_mktsegment, c_nationkey, class, count(*) AS members, arg_max(c_custkey, (orders, -c_custkey)) AS keep, max(orders) AS orders FROM r GROUP BY ALL HAVING count(*) > 1"""


def a32(spark, sf):
    o = table(spark, sf, "orders")
    age = 2002 - F.year("o_orderdate")
    weight = F.when(age <= 3, 3.0).when(age <= 5, 1.0).otherwise(0.5)
    return ev.weighted_mode(o, ["o_custkey"], "o_orderpriority", weight)


A32 = """WITH w AS (SELECT o_custkey, o_orderpriority AS v, sum(CASE WHEN 2002 - year(o_orderdate) <= 3 THEN 3.0 WHEN 2002 - year(o_orderdate) <= 5 THEN 1.0 ELSE 0.5 END::DOUBLE) AS w FROM orders GROUP BY ALL)
SELECT o_custkey, arg_min(v, (-w, v)) AS mode, max(w) AS weight FROM w GROUP BY 1"""


def a33(spark, sf):
    l = prediction_log(spark, sf).withColumn("profit", F.when(F.col("y") == 1, F.col("odds1") - 1).otherwise(-1.0))
    g = l.groupBy(F.col("yr").alias("session")).agg(F.count(F.lit(1)).alias("bets"), F.sum("profit").alias("profit"), F.avg("y").alias("win_rate"), F.avg("odds1").alias("avg_odds"))
    return g.select("session", "bets", F.round("profit", 4).alias("profit"), r6(F.col("win_rate")).alias("win_rate"), r6(F.col("avg_odds")).alias("avg_odds"), r6(F.col("profit") / F.col("bets")).alias("roi"))


A33 = f"""WITH {LOG}, b AS (SELECT *, CASE WHEN y = 1 THEN odds1 - 1 ELSE -1.0 END AS profit FROM log) SELECT CAST(yr AS INTEGER) AS session, count(*) AS bets, round(sum(profit), 4) AS profit, round(avg(y) + 1e-10, 6) AS win_rate, round(avg(odds1) + 1e-10, 6) AS avg_odds, round(sum(profit) / count(*) + 1e-10, 6) AS roi FROM b GROUP BY yr"""


def a36(spark, sf):
    s = scored(spark, sf).withColumn("confidence", F.greatest(F.col("p"), 1 - F.col("p")))
    return s.groupBy("model").agg(*[F.count_if(F.col("confidence") >= c).alias(f"from_{int(c * 100)}") for c in (0.9, 0.95, 0.99)], *[F.count_if((F.col("confidence") >= c) & ((F.col("p") >= 0.5) != (F.col("y") == 1))).alias(f"wrong_{int(c * 100)}") for c in (0.9, 0.95, 0.99)])


A36 = f"WITH {LONG}, c AS (SELECT *, greatest(p, 1 - p) AS c FROM scored) SELECT model, " + ", ".join(f"count(*) FILTER (WHERE c >= {c}) AS from_{int(c * 100)}, count(*) FILTER (WHERE c >= {c} AND (p >= 0.5) <> (y = 1)) AS wrong_{int(c * 100)}" for c in (0.9, 0.95, 0.99)) + " FROM c GROUP BY model"


def a38(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95]).alias("q"), F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("std"), F.avg((F.col("l_extendedprice") > 50000).cast("double")).alias("above"))
    return m.select("l_returnflag", *[F.round(F.col("q")[i], 3).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))], F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), r6(F.col("above")).alias("above"))


A38 = "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 3) AS {n}" for q, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"))) + ", round(avg(l_extendedprice), 3) AS mean, round(stddev_samp(l_extendedprice), 3) AS std, round(avg(CAST(l_extendedprice > 50000 AS INTEGER)) + 1e-10, 6) AS above FROM lineitem GROUP BY 1"


def a40(spark, sf):
    g = prediction_log(spark, sf).groupBy("segment").agg(F.sum("y").cast("double").alias("h"), F.count(F.lit(1)).alias("n"))
    lo, hi = ev.wilson(F.col("h"), F.col("n"))
    return g.select("segment", "n", r6(lo).alias("lower"), r6(hi).alias("upper"))


A40 = f"""WITH {LOG}, g AS (SELECT segment, count(*) AS n, sum(y) / count(*) AS s FROM log GROUP BY 1) SELECT segment, n, round((s + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(s * (1 - s) / n + 3.8416::DOUBLE / (4.0::DOUBLE * n * n))) / (1 + 3.8416::DOUBLE / n) + 1e-10, 6) AS lower,
round((s + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(s * (1 - s) / n + 3.8416::DOUBLE / (4.0::DOUBLE * n * n))) / (1 + 3.8416::DOUBLE / n) + 1e-10, 6) AS upper FROM g"""


def w29(spark, sf):
    """A model is most of a table, so its rows are cut into runs of uids."""
    hit = ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")
    rows = running(scored(spark, sf).select("model", "uid", hit.alias("hit"), F.lit(1).alias("one")), "uid", [], ["hits", "n"], ["hit", "one"], by=["model"])
    return rows.select("model", "uid", r6(F.col("hits") / F.col("n")).alias("accuracy_so_far"))


W29 = f"WITH {LONG} SELECT model, uid, round(avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) OVER (PARTITION BY model ORDER BY uid ROWS UNBOUNDED PRECEDING) + 1e-10, 6) AS accuracy_so_far FROM scored"

QUERIES = {
    "a01_metrics": (a01, A01),
    "a04_auc": (a04, A04),
    "a05_roc": (a05, A05),
    "a06_ece": (a06, A06),
    "a08_reliability": (a08, A08),
    "a09_calibration_line": (a09, None),
    "a12_ledger": (a12, A12),
    "a13_cohort_calibration": (a13, A13),
    "a14_group_accuracy": (a14, A14),
    "a15_contingency": (a15, A15),
    "a16_binned": (a16, A16),
    "a18_bucket_roi": (a18, A18),
    "a19_binomial": (a19, A19),
    "a20_quintiles": (a20, A20),
    "a21_yearly_vs_baseline": (a21, A21),
    "a23_top_tokens": (a23, A23),
    "a25_two_sided": (a25, A25),
    "a26_provenance_pick": (a26, A26),
    "a27_account_state": (a27, A27),
    "a28_consensus": (a28, A28),
    "a29_conflicts": (a29, A29),
    "a30_seal": (a30, A30),
    "a31_merge_ids": (a31, A31),
    "a32_weighted_mode": (a32, A32),
    "a33_session_summary": (a33, A33),
    "a36_extremes": (a36, A36),
    "a38_quantile_summary": (a38, A38),
    "a40_wilson": (a40, A40),
    "w29_expanding_mean": (w29, W29),
}
