"""Queries over ingest flows, guards and summaries of the store (families S, V, A and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.functions import scores
from pitwise.functions import text as tx
from pitwise.operators import models, store
from pitwise.operators import temporal as t
from pitwise.plans.analogues import LOG, OBS, observations, prediction_log
from pitwise.plans.point_in_time import CHANGE
from pitwise.session import table


def s07(spark, sf):
    """A staged file against a store that holds a part: members, facts and statistics that it adds."""
    staged = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1700).alias("b"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("minutes"))
    dims = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    named = staged.withColumn("a_name", F.when(F.col("k") % 4 > 0, F.concat(F.lit("n"), "a"))).withColumn("b_name", F.concat(F.lit("n"), "b"))
    members = store.missing_members(dims, named, [{"id": "a", "name": "a_name"}, {"id": "b", "name": "b_name"}], "id")
    facts, stats = store.backfill(staged.where("k % 2 = 0"), staged.where("k % 3 = 0").unionByName(staged.where("k % 6 = 0")), ["k"], ["minutes"])
    parts = [members.select(F.lit("member").alias("kind"), F.col("id").alias("key"), "name"), facts.select(F.lit("fact").alias("kind"), F.col("k").alias("key"), F.lit(None).cast("string").alias("name")), stats.select(F.lit("stats").alias("kind"), F.col("k").alias("key"), F.lit(None).cast("string").alias("name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


S07 = """WITH st AS (SELECT o_orderkey AS k, o_custkey AS a, o_orderkey % 1700 AS b, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS minutes FROM orders),
m AS (SELECT a AS id, CASE WHEN k % 4 > 0 THEN 'n' || a END AS name FROM st UNION ALL SELECT b, 'n' || b FROM st)
SELECT 'member' AS kind, id AS key, min(name) AS name FROM m WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY id
UNION ALL SELECT 'fact', k, NULL FROM st WHERE k % 3 = 0 AND k % 2 <> 0 UNION ALL SELECT 'stats', k, NULL FROM st WHERE k % 3 = 0 AND minutes IS NOT NULL"""


def s10(spark, sf):
    """Results by name: who is known, who is made, and which names several bear."""
    known = table(spark, sf, "customer").select(F.concat(F.lit("Player "), (F.col("c_custkey") % 1100).cast("string")).alias("name"), F.col("c_custkey").alias("id")).where("id % 2 = 0")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit(" Player "), (F.col("o_custkey") % 1500).cast("string"), F.lit(" ")).alias("w"), F.when(F.col("o_orderkey") % 50 == 0, "P").otherwise(F.concat(F.lit("Player "), (F.col("o_orderkey") % 1300).cast("string"))).alias("l"))
    names = o.select(F.col("w").alias("name")).unionByName(o.select(F.col("l").alias("name")))
    found = store.resolve_or_create(names, known, "name", "id")
    side = lambda c: found.select(F.col("name").alias(f"_{c}"), F.col("id").alias(f"{c}_id"), F.col("status").alias(f"{c}_status"))
    rows = o.withColumn("_w", F.trim("w")).withColumn("_l", F.trim("l")).join(side("w"), "_w").join(side("l"), "_l")
    outcome = F.when(F.col("w_id").isNull() | F.col("l_id").isNull() | (F.col("w_id") == F.col("l_id")), "skipped").otherwise("inserted")
    return rows.select("k", "w_id", "w_status", "l_id", "l_status", outcome.alias("outcome"))


S10 = """WITH c AS (SELECT 'Player ' || (c_custkey % 1100) AS name, count(*) AS n, min(c_custkey) AS id FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1),
o AS (SELECT o_orderkey AS k, 'Player ' || (o_custkey % 1500) AS w, CASE WHEN o_orderkey % 50 = 0 THEN 'P' ELSE 'Player ' || (o_orderkey % 1300) END AS l FROM orders),
f AS (SELECT x.name, CASE WHEN n = 1 THEN 'known' WHEN n > 1 THEN 'ambiguous' WHEN length(x.name) >= 5 THEN 'created' ELSE 'short' END AS status, CASE WHEN n = 1 THEN id WHEN n IS NULL AND length(x.name) >= 5 THEN -1 - CAST('0x' || substr(md5(x.name), 1, 12) AS BIGINT) END AS id FROM (SELECT w AS name FROM o UNION SELECT l FROM o) x LEFT JOIN c USING (name))
SELECT k, a.id AS w_id, a.status AS w_status, b.id AS l_id, b.status AS l_status, CASE WHEN a.id IS NULL OR b.id IS NULL OR a.id = b.id THEN 'skipped' ELSE 'inserted' END AS outcome FROM o JOIN f a ON o.w = a.name JOIN f b ON o.l = b.name"""


def s12(spark, sf):
    """A table rebuilt from rows in which a later one of a key takes its place."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return store.replace_by_key(e.where("event_id % 7 = 0").dropDuplicates(["event_id"]).join(e.groupBy("user_id").agg(F.min("event_id").alias("event_id")), ["user_id", "event_id"]).select(*e.columns), e.where("event_id % 3 = 0"), "user_id", ["ts", "event_id"])


S12 = """WITH s AS (SELECT e.* FROM events e JOIN (SELECT min(event_id) AS event_id FROM events GROUP BY user_id) USING (event_id) WHERE event_id % 7 = 0), l AS (SELECT * FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_id, user_id, ts, event_type FROM l UNION ALL SELECT event_id, user_id, ts, event_type FROM s WHERE user_id NOT IN (SELECT user_id FROM l)"""


def v08(spark, sf):
    """Writes that the store must refuse."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("state"), F.when(F.col("event_id") % 41 == 0, "none").otherwise(F.sha2(F.concat_ws("|", "user_id", "event_type"), 256)).alias("sha"))
    first = e.groupBy("user_id").agg(F.min(F.struct("event_id", "state", "sha")).alias("b")).select("user_id", "b.*")
    writes = e.join(first.select("event_id"), "event_id", "left_anti").withColumn("op", F.when(F.col("event_id") % 29 == 0, "delete").when(F.col("event_id") % 2 == 0, "insert").otherwise("update"))
    return store.write_issues(first, writes, "user_id", "op", "state", "sha", ["purchase", "error"]).select("event_id", "issue")


V08 = """WITH e AS (SELECT event_id, user_id, event_type AS state, CASE WHEN event_id % 41 = 0 THEN 'none' ELSE sha256(user_id || '|' || event_type) END AS sha FROM events), f AS (SELECT user_id, min(event_id) AS event_id, arg_min(state, event_id) AS state, arg_min(sha, event_id) AS sha FROM e GROUP BY user_id),
w AS (SELECT e.event_id, CASE WHEN e.event_id % 29 = 0 THEN 'delete' WHEN e.event_id % 41 = 0 THEN 'hash' WHEN f.state IN ('purchase', 'error') AND e.sha <> f.sha THEN 'terminal' WHEN e.event_id % 2 = 0 AND e.sha <> f.sha THEN 'contradiction' END AS issue FROM e JOIN f USING (user_id) WHERE e.event_id <> f.event_id) SELECT * FROM w WHERE issue IS NOT NULL"""
REASONS = ("no_odds", "late", "no_rank", "identity")


def a39(spark, sf):
    """Rows of each replay tier, and of each reason that their codes list."""
    codes = F.array_join(F.filter(F.array(*[F.when(F.col("uid") % (i + 3) == 0, r) for i, r in enumerate(REASONS)]), lambda x: x.isNotNull()), ";")
    l = prediction_log(spark, sf).select(F.element_at(F.array(*map(F.lit, ("gold", "silver", "bronze"))), (F.col("uid") % 3 + 1).cast("int")).alias("tier"), codes.alias("codes"))
    counts = F.explode(F.concat(F.array(F.struct(F.lit("tier").alias("kind"), F.col("tier").alias("name"))), F.transform(F.filter(F.split("codes", ";"), lambda r: r != ""), lambda r: F.struct(F.lit("reason").alias("kind"), r.alias("name")))))
    return l.select(counts.alias("c")).groupBy("c.kind", "c.name").agg(F.count(F.lit(1)).alias("n"))


A39 = f"WITH {LOG} SELECT 'tier' AS kind, ['gold', 'silver', 'bronze'][uid % 3 + 1] AS name, count(*) AS n FROM log GROUP BY 2 UNION ALL " + " UNION ALL ".join(f"SELECT 'reason', '{r}', count(*) FROM log WHERE uid % {i + 3} = 0 HAVING count(*) > 0" for i, r in enumerate(REASONS))


def f10(spark, sf):
    """Scores from columns of games: sets that do not read as numbers are left out."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    column = lambda i, side: F.when(F.col("k") % (5 + i) == 0, None).when(F.col("k") % (11 + i) == 0, "x").otherwise(F.concat((F.col("k") % (7 - side)).cast("string"), F.lit(".0")))
    made = scores.assembled([(column(i, 0), column(i, 1)) for i in range(5)])
    return o.select("k", F.array_join(F.transform(made, lambda x: F.concat(x["w"].cast("string"), F.lit("-"), x["l"].cast("string"))), " ").alias("score"))


F10 = "SELECT o_orderkey AS k, CASE WHEN len(s) >= 2 THEN array_to_string(s, ' ') END AS score FROM (SELECT o_orderkey, list_filter([" + ", ".join(f"CASE WHEN o_orderkey % {5 + i} = 0 OR o_orderkey % {11 + i} = 0 THEN NULL ELSE (o_orderkey % 7) || '-' || (o_orderkey % 6) END" for i in range(5)) + "], lambda x: x IS NOT NULL) AS s FROM orders)"


def f15(spark, sf):
    """Place words of event titles."""
    p = table(spark, sf, "part")
    kind = F.element_at(F.array(*map(F.lit, ("Challenger - ", "ITF Men's - ITF ", "ATP 250 ", "M25 "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    title = F.concat(kind, "p_name", F.lit(" Open Qualifying "), F.when(F.col("p_partkey") % 2 == 0, "(12)").otherwise("- Men's Singles"))
    return p.select("p_partkey", tx.place_signature(title).alias("place"))


F15 = "SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.NO_PLACE) + "], w) AND NOT regexp_matches(w, '^[0-9]+$')), ' ') AS place FROM part"


def w10(spark, sf):
    """Change of rank in 30 and in 90 days."""
    o = t.with_day_bounds(observations(spark, sf), ["player"], "rank")
    return o.select("id", *[F.round(t.change_since(["player"], "rank", n), 2).alias(f"change_{n}") for n in (30, 90)])


_ASOF = CHANGE.split(" AS (", 1)[1]
W10 = f"WITH {OBS}, " + ", ".join(f"c{n} AS ({_ASOF.replace('365', str(n)).replace('547', str(n + n // 2))}" for n in (30, 90)) + " SELECT obs.id, round(coalesce(c30.c, 0.0), 2) AS change_30, round(coalesce(c90.c, 0.0), 2) AS change_90 FROM obs LEFT JOIN c30 ON obs.id = c30.id LEFT JOIN c90 ON obs.id = c90.id"


def m08(spark, sf):
    """A registry of one model for each brand, with what is wrong in it."""
    p = table(spark, sf, "part").withColumn("b", F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int"))
    names = p.groupBy("b").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    features = F.when(F.col("b") % 11 == 0, F.array().cast("array<string>")).when(F.col("b") % 7 == 0, F.concat("names", F.slice("names", 1, 1))).otherwise(F.col("names"))
    rows = names.select(F.concat(F.lit("m"), "b").alias("model"), (F.col("b") % 6).alias("family"), features.alias("features"), (F.size(features) + F.when(F.col("b") % 5 == 0, 1).otherwise(0)).alias("declared"), F.when(F.col("b") % 4 == 0, "0").otherwise(F.sha2(F.array_join(features, "\n"), 256)).alias("sha256"), F.when(F.col("b") % 9 == 0, "broken").when(F.col("b") % 2 == 0, "active").otherwise("shadow").alias("state"))
    return models.registry_issues(rows)


M08 = """WITH p AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS b, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY 1),
r AS (SELECT 'm' || b AS model, b, b % 6 AS family, CASE WHEN b % 11 = 0 THEN [] WHEN b % 7 = 0 THEN list_append(names, names[1]) ELSE names END AS f, CASE WHEN b % 9 = 0 THEN 'broken' WHEN b % 2 = 0 THEN 'active' ELSE 'shadow' END AS state FROM p), a AS (SELECT family, count(*) AS n FROM r WHERE state = 'active' GROUP BY 1)
SELECT model, 'empty' AS issue FROM r WHERE len(f) = 0 UNION ALL SELECT model, 'repeated' FROM r WHERE len(list_distinct(f)) < len(f) UNION ALL SELECT model, 'count' FROM r WHERE b % 5 = 0 UNION ALL SELECT model, 'hash' FROM r WHERE b % 4 = 0 UNION ALL SELECT model, 'state' FROM r WHERE state = 'broken' UNION ALL SELECT model, 'active' FROM r JOIN a USING (family) WHERE state = 'active' AND n > 1"""

QUERIES = {"m08_registry_contract": (m08, M08), "s07_backfill": (s07, S07), "s10_resolve_or_create": (s10, S10), "s12_replace_by_key": (s12, S12), "v08_write_guard": (v08, V08), "a39_replay_counts": (a39, A39), "f10_assembled_scores": (f10, F10), "f15_place_words": (f15, F15), "w10_rank_change_30_90": (w10, W10)}
