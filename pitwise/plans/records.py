"""Queries over append-only facts (families V, S and the rest of A and P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.functions.rates import kelly
from pitwise.operators import store
from pitwise.plans.analogues import LOG, OBS, observations, prediction_log
from pitwise.plans.point_in_time import r6
from pitwise.session import table


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), "ts", F.col("event_type").alias("state"), "value")


def v01(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.timestamp_diff("SECOND", F.col("a"), F.col("z")).alias("seconds"), "n")


V01 = "SELECT user_id, date_sub('second', min(ts), max(ts)) AS seconds, count(*) AS n FROM events GROUP BY user_id"


def v02(spark, sf):
    return store.current(events(spark, sf), ["state"], "ts", "event_id").select("state", "event_id", "key")


V02 = "SELECT event_type AS state, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(user_id, (ts, event_id)) AS key FROM events GROUP BY 1"


def v04(spark, sf):
    e = events(spark, sf).withColumn("supersedes", F.when(F.col("event_id") % 10 == 9, F.col("event_id") - 1))
    return store.current(e, ["key"], "ts", "event_id", "supersedes").select("key", "event_id", "state")


V04 = """WITH e AS (SELECT * FROM events WHERE event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_id % 10 = 9)) SELECT user_id AS key, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS state FROM e GROUP BY 1"""


def v05(spark, sf):
    """The latest generation whose seal the stored rows still meet."""
    o = observations(spark, sf).withColumn("generation", F.floor(F.col("day") / 30))
    g = o.groupBy("generation").agg(F.count(F.lit(1)).alias("n"), F.count("won").alias("settled"))
    ok = g.where("settled * 2 > n")
    return o.join(ok.agg(F.max("generation").alias("generation")), "generation", "left_semi").select("id", "generation")


V05 = f"WITH {OBS}, g AS (SELECT CAST(floor(day / 30) AS BIGINT) AS generation, count(*) AS n, count(won) AS settled FROM obs GROUP BY 1) SELECT id, CAST(floor(day / 30) AS BIGINT) AS generation FROM obs WHERE floor(day / 30) = (SELECT max(generation) FROM g WHERE settled * 2 > n)"


def v07(spark, sf):
    o = observations(spark, sf)
    a = o.where("won = 1").select("player", "surface")
    b = o.where("won = 0 and day > 10900").select("player", "surface")
    g = a.unionAll(b).groupBy("player").agg(F.countDistinct("surface").alias("k"), F.min("surface").alias("binding")).where("k = 1")
    return g.select("player", "binding")


V07 = f"WITH {OBS}, u AS (SELECT player, surface FROM obs WHERE won = 1 UNION ALL SELECT player, surface FROM obs WHERE won = 0 AND day > 10900) SELECT player, min(surface) AS binding FROM u GROUP BY player HAVING count(DISTINCT surface) = 1"
STEPS = {"view": ["click", "error", "view"], "click": ["purchase", "view", "click"], "purchase": ["view"], "error": ["view", "click"]}


def v09(spark, sf):
    return store.transition_issues(events(spark, sf), "key", ["ts", "event_id"], "state", STEPS).select("event_id", "before", "state")


V09 = "WITH e AS (SELECT event_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before, state FROM e WHERE before IS NOT NULL AND NOT list_contains([" + ", ".join(f"'{a}>{b}'" for a, bs in STEPS.items() for b in bs) + "], before || '>' || state)"


def v10(spark, sf):
    e = events(spark, sf).select("key", "event_id", "state", "value")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    out = None
    for mode in ("immutable", "mutable", "terminal"):
        merged = store.upsert(old, new, "key", mode, "event_id", "state", ["purchase"]).withColumn("mode", F.lit(mode))
        out = merged if out is None else out.unionByName(merged)
    return out.select("mode", "key", "event_id", "state")


V10 = """SELECT 'immutable' AS mode, user_id AS key, min(event_id) AS event_id, arg_min(event_type, event_id) AS state FROM events GROUP BY user_id UNION ALL SELECT 'mutable', user_id, max(event_id), arg_max(event_type, event_id) FROM events GROUP BY user_id
UNION ALL SELECT 'terminal', user_id, coalesce(min(event_id) FILTER (WHERE event_type = 'purchase'), max(event_id)), coalesce(min(event_type) FILTER (WHERE event_type = 'purchase'), arg_max(event_type, event_id)) FROM events GROUP BY user_id"""


def v12(spark, sf):
    o = observations(spark, sf)
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("player"))
    return store.three_state(keys, o.where("won = 1 and rank > 350000").select("player", "surface"), "player", "surface")


V12 = f"WITH {OBS}, g AS (SELECT player, count(DISTINCT surface) AS n, min(surface) AS v FROM obs WHERE won = 1 AND rank > 350000 GROUP BY player) SELECT c_custkey AS player, CASE WHEN coalesce(n, 0) = 0 THEN 'MISSING' WHEN n = 1 THEN 'RESOLVED' ELSE 'CONFLICT' END AS status, CASE WHEN n = 1 THEN v END AS surface FROM customer LEFT JOIN g ON c_custkey = player"


def v13(spark, sf):
    l = prediction_log(spark, sf)
    claimed = F.col("p_nn") - 1 / F.col("odds1") + F.when(F.col("uid") % 10 == 0, 0.01).otherwise(0.0)
    share = kelly(F.col("p_nn"), F.col("odds1")) * 0.18
    checks = {"edge": F.abs(claimed - (F.col("p_nn") - 1 / F.col("odds1"))) <= 1e-6, "share": share <= 0.05, "odds": F.col("odds1") > 1.06, "gold": F.when(F.col("uid") % 25 > 0, F.lit(True))}
    return store.guard(l, checks, "uid")


V13 = f"WITH {LOG}, b AS (SELECT uid, concat_ws(',', CASE WHEN uid % 10 = 0 THEN 'edge' END, CASE WHEN NOT 0.18::DOUBLE * greatest(0.0, ((odds1-1)*p_nn-(1-p_nn))/(odds1-1)) <= 0.05 THEN 'share' END, CASE WHEN NOT odds1 > 1.06::DOUBLE THEN 'odds' END, CASE WHEN uid % 25 = 0 THEN 'gold' END) AS broken FROM log) SELECT * FROM b WHERE broken <> ''"


def v14(spark, sf):
    return store.supersession_issues(events(spark, sf), "key", "ts", "event_id", "state", ["purchase"], F.col("value") > 20).select("event_id", "before", "state")


V14 = "WITH e AS (SELECT event_id, value, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before, state FROM e WHERE before = 'purchase' AND state <> 'purchase' AND NOT value > 20"


def s06(spark, sf):
    c = table(spark, sf, "customer")
    ok = c.where(F.col("c_name").rlike("^Customer#[0-9]{9}$")).select(F.nullif(F.trim("c_mktsegment"), F.lit("")).alias("segment"), "c_nationkey", F.expr("try_cast(regexp_extract(c_name, '#0*([0-9]+)$', 1) as bigint)").alias("id"))
    return ok.groupBy("segment", "c_nationkey").agg(F.min("id").alias("id"))


S06 = "SELECT nullif(trim(c_mktsegment), '') AS segment, c_nationkey, min(TRY_CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT)) AS id FROM customer WHERE regexp_matches(c_name, '^Customer#[0-9]{9}$') GROUP BY 1, 2"


def s09(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus")
    kept = store.append_if_absent(o.where("k % 3 = 0"), o.where("k % 2 = 0"), ["k"])
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


S09 = "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 GROUP BY 1"


def s18(spark, sf):
    """Links of raw pages, by pattern: one row for each list entry."""
    p = table(spark, sf, "pages")
    items = F.explode(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">([^<]*)</a></li>'), F.lit(0)))
    return p.select("page_id", items.alias("item")).select("page_id", F.regexp_extract("item", 'href="([^"]*)"', 1).alias("href")).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("href").alias("distinct_links"))


S18 = """WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT href) AS distinct_links FROM i GROUP BY page_id"""


def s20(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "struct<k:bigint>").alias("j"))
    return e.select("event_id", "j.k")


S20 = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def a30s(spark, sf):
    return store.seal(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_custkey"])


A30S = "SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(o_orderkey || '|' || o_orderstatus || '|' || o_custkey), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM orders"

QUERIES = {
    "v01_run_duration": (v01, V01), "v02_source_freshness": (v02, V02), "v04_state_view": (v04, V04), "v05_current_generation": (v05, V05), "v07_name_bindings": (v07, V07), "v09_transition_check": (v09, V09), "v10_upsert_modes": (v10, V10),
    "v12_three_state": (v12, V12), "v13_recompute_guard": (v13, V13), "v14_supersession": (v14, V14), "s06_seed_dimension": (s06, S06), "s09_append_if_absent": (s09, S09), "s18_html_rows": (s18, S18), "s20_json_rows": (s20, S20), "a30_order_free_seal": (a30s, A30S),
}
