"""Queries of row-wise features and scalar functions (families P and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.functions import dates, rates
from pitwise.functions import text as tx
from pitwise.operators import features as fx
from pitwise.plans.analogues import LOG, MATCHES, OBS, matches, observations, prediction_log
from pitwise.plans.point_in_time import r6
from pitwise.session import table


def p01(spark, sf):
    m = matches(spark, sf)
    swap = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 2), 16, 10).cast("int") % 2 == 1
    return fx.swap_sides(m, [("p1", "p2")], swap).select("id", "p1", "p2", F.when(F.col("swapped"), 1 - F.col("won")).otherwise(F.col("won")).alias("won"))


SWAP = "substr(md5(CAST(id AS VARCHAR)), 2, 1) IN ('1','3','5','7','9','b','d','f')"
P01 = f"WITH {MATCHES} SELECT id, CASE WHEN {SWAP} THEN p2 ELSE p1 END AS p1, CASE WHEN {SWAP} THEN p1 ELSE p2 END AS p2, CASE WHEN {SWAP} THEN 1 - won ELSE won END AS won FROM matches"


def p02(spark, sf):
    l = table(spark, sf, "part")
    cols = fx.pair_features(F.col("p_retailprice"), F.col("p_size") * 30.0, "price") + fx.pair_features(F.col("p_size"), F.col("p_partkey") % 50, "rank", True)[::3]
    return l.select("p_partkey", *cols).select("p_partkey", r6(F.col("price_diff")).alias("price_diff"), r6(F.col("price_ratio")).alias("price_ratio"), r6(F.col("price_avg")).alias("price_avg"), "price_advantage", F.col("rank_diff").cast("bigint").alias("rank_diff"), "rank_advantage")


P02 = """SELECT p_partkey, round(p_retailprice - p_size * 30.0::DOUBLE + 1e-10, 6) AS price_diff, round(greatest(p_retailprice, p_size * 30.0::DOUBLE) / least(p_retailprice, p_size * 30.0::DOUBLE) + 1e-10, 6) AS price_ratio, round((p_retailprice + p_size * 30.0::DOUBLE) / 2 + 1e-10, 6) AS price_avg,
CAST(p_retailprice > p_size * 30.0::DOUBLE AS INTEGER) AS price_advantage, p_size - p_partkey % 50 AS rank_diff, CAST(p_size < p_partkey % 50 AS INTEGER) AS rank_advantage FROM part"""


def p03(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    v = fx.profile_defaults(F.when(k % 3 > 0, (k % 150 - 5).cast("double")), F.when(k % 4 > 0, (k % 80).cast("double")), F.when(k % 5 > 0, (k % 1200).cast("double")), F.when(k % 7 > 0, F.col("c_acctbal")))
    return c.select("c_custkey", *[x.alias(n) for n, x in v.items()])


P03 = """WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 150 - 5 END AS h, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 80 END AS a, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 1200 END AS r, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS b FROM customer)
SELECT c_custkey, CAST(CASE WHEN h >= 1 THEN h ELSE 180 END AS DOUBLE) AS height, CAST(coalesce(a, 25) AS DOUBLE) AS age, CAST(CASE WHEN r > 0 THEN r ELSE 999 END AS DOUBLE) AS rank,
CAST(CASE WHEN b >= 0 THEN b WHEN NOT coalesce(r > 0, false) OR r >= 999 THEN 0 ELSE 500 END AS DOUBLE) AS points FROM p"""


def p05(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("points_won"), F.when(F.col("c_custkey") % 3 == 0, 0.25).alias("win_rate_90"), F.when(F.col("c_custkey") % 5 == 0, 3.0).alias("n_14"))
    return fx.fill_by_name(c)


P05 = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 500.0 END AS points_won, CASE WHEN c_custkey % 3 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS win_rate_90, CASE WHEN c_custkey % 5 = 0 THEN 3.0 ELSE 0.0 END::DOUBLE AS n_14 FROM customer"
LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def p07(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *fx.one_hot(F.col("o_orderpriority"), LEVELS[:4], "level", other=True))


P07 = "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderpriority = '{v}' AS INTEGER) AS level_{i}" for i, v in enumerate(LEVELS[:4])) + ", CAST(o_orderpriority = '5-LOW' AS INTEGER) AS level_other FROM orders"


def p08(spark, sf):
    hot = table(spark, sf, "orders").select("o_orderkey", *fx.one_hot(F.col("o_orderpriority"), LEVELS[:4], "level"))
    return hot.select("o_orderkey", fx.one_hot_decode([f"level_{i}" for i in range(4)], LEVELS[:4]).alias("level"))


P08 = "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE o_orderpriority END AS level FROM orders"


def p09(spark, sf):
    hot = table(spark, sf, "orders").select("o_orderkey", *fx.one_hot(F.col("o_orderpriority"), LEVELS[:4], "level"))
    hot = hot.withColumn("level_0", F.when(F.col("o_orderkey") % 10 == 0, 2).otherwise(F.col("level_0")))
    return hot.select("o_orderkey", F.array_join(fx.one_hot_issues([f"level_{i}" for i in range(4)]), ",").alias("issues"))


P09 = """WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE CAST(o_orderpriority = '1-URGENT' AS INTEGER) END AS a, CAST(o_orderpriority IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') AS INTEGER) AS b FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN a = 2 THEN 'not binary' END, CASE WHEN a + b <> 1 THEN 'sum' END) AS issues FROM h"""


def p10(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", *[v.alias(k) for k, v in dates.season_flags(d).items()], dates.week_key(d).alias("week"), dates.monday_number(dates.day_number(d)).alias("monday"))


P10 = """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CAST(month(d) BETWEEN 4 AND 6 AS INTEGER) AS clay_season, CAST(month(d) BETWEEN 6 AND 7 AS INTEGER) AS grass_season, CAST(month(d) >= 10 OR month(d) <= 2 AS INTEGER) AS indoor_season,
isoyear(d) || '-' || lpad(CAST(week(d) AS VARCHAR), 2, '0') AS week, date_diff('day', DATE '1970-01-01', CAST(date_trunc('week', d) AS DATE)) AS monday FROM o"""


LEVEL_OF, DRAWS, CODES = ("G", "M", "A", "C", "O", "D"), (32, 48, 64, 96, 128), ("R64", "R32", "R16", "QF", "SF", "F", "Q1", "Q3", "RR")


def p12(spark, sf):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    key, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    offset = fx.round_day_offset(pick(LEVEL_OF, key), pick(DRAWS, key), pick(CODES, key), start, F.when(key % 2 == 0, 3))
    return table(spark, sf, "orders").select("o_orderkey", offset.alias("days"), F.date_add(start, offset).cast("string").alias("played"))


def _p12_sql() -> str:
    cases = lambda t, k: "CASE " + k + " || ':' || code " + " ".join(f"WHEN '{a}:{r}' THEN {n}" for a, rs in t.items() for r, n in rs.items()) + " ELSE 0 END"
    pick = lambda v: "[" + ", ".join(repr(x) for x in v) + f"][o_orderkey % {len(v)} + 1]"
    return f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, {pick(LEVEL_OF)} AS level, {pick(DRAWS)} AS draw, {pick(CODES)} AS code, CASE WHEN o_orderkey % 2 = 0 THEN 3 END AS nq FROM orders),
k AS (SELECT *, isodow(d) - 1 AS dow, CASE WHEN level = 'G' THEN 'G' WHEN level = 'M' AND draw >= 96 THEN 'M_large' WHEN level = 'M' AND draw = 64 AND isodow(d) <> 1 THEN 'M_medium_long' WHEN level = 'M' AND draw = 64 THEN 'M_medium_short' WHEN level = 'M' THEN 'M_small' ELSE 'standard' END AS kind FROM o),
f AS (SELECT *, CASE WHEN dow = 6 THEN 7 ELSE 6 - dow END + CASE WHEN kind IN ('G', 'M_large', 'M_medium_long') THEN 7 ELSE 0 END AS final FROM k),
r AS (SELECT o_orderkey, d, CAST(CASE WHEN level IN ('O', 'D') THEN {cases(fx.STATIC, 'level')} WHEN code IN ('Q1', 'Q2', 'Q3', 'Q4') THEN coalesce(-(nq - CAST(code[2] AS INTEGER) + 1), {cases(fx.QUALIFYING, "CASE WHEN level IN ('G', 'M') THEN level ELSE 'default' END")}) ELSE final + {cases(fx.BEFORE_FINAL, 'kind')} END AS INTEGER) AS days FROM f)
SELECT o_orderkey, days, CAST(d + days AS VARCHAR) AS played FROM r"""


def p13(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), F.element_at(F.array(*map(F.lit, ("Q1", "Q2", "QF", "R32", "Q3"))), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("code"))
    return fx.qualifier_rounds(o, "event", "code")


P13 = "SELECT o_custkey AS event, count(DISTINCT CASE o_orderkey % 5 WHEN 0 THEN 'Q1' WHEN 1 THEN 'Q2' WHEN 4 THEN 'Q3' END) AS qualifier_rounds FROM orders GROUP BY 1"


def p16(spark, sf):
    k = F.col("p_partkey") % 5
    title = F.concat_ws(" ", F.col("p_type"), F.when(k == 0, "Masters 1000").when(k == 1, "Challenger").when(k == 2, "M25").when(k == 3, "ITF Men"))
    level = fx.level_of_title(title)
    return table(spark, sf, "part").select("p_partkey", level.alias("level"), fx.segment_of_level(level, title).alias("segment"))


P16 = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'C' WHEN 2 THEN '25' WHEN 3 THEN '15' ELSE 'A' END AS level, CASE p_partkey % 5 WHEN 1 THEN 'challenger' WHEN 2 THEN 'itf' WHEN 3 THEN 'itf' ELSE 'atp' END AS segment FROM part"


def p17(spark, sf):
    title = F.concat_ws(" ", F.lit("City"), F.when(F.col("p_size") % 4 == 0, "Clay Trophy").when(F.col("p_size") % 4 == 1, "Lawn Court").when(F.col("p_size") % 4 == 2, "Barcelona Open"))
    return table(spark, sf, "part").select("p_partkey", fx.surface_of_title(title).alias("surface"))


P17 = "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Clay' WHEN 1 THEN 'Grass' WHEN 2 THEN 'Clay' END AS surface FROM part"


def p18(spark, sf):
    t = F.when(F.col("user_id") % 5 == 0, "n/a").when(F.col("user_id") % 7 == 0, "NaN").otherwise((F.col("value") / 40).cast("string"))
    return table(spark, sf, "events").select("event_id", r6(rates.probability(t)).alias("p"), r6(rates.decimal_odds(t)).alias("odds"))


P18 = "WITH v AS (SELECT event_id, CASE WHEN user_id % 5 = 0 OR user_id % 7 = 0 THEN NULL ELSE value / 40 END AS v FROM events) SELECT event_id, round(CASE WHEN v BETWEEN 0 AND 1 THEN v END + 1e-10, 6) AS p, round(CASE WHEN v > 1 THEN v END + 1e-10, 6) AS odds FROM v"


def p19(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fx.first_known(F.when(F.col("c_custkey") % 3 == 0, " "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.col("c_name")).alias("v"))


P19 = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS v FROM customer"


def p20(spark, sf):
    l = prediction_log(spark, sf)
    grade = F.col("gold") & (F.col("odds1") > 1.5) & (F.col("odds2") > 1.5) & (F.abs(F.col("p_nn") - F.col("p_xgb")) < 0.5)
    return l.groupBy("player").agg(F.bool_or(grade).alias("gold_grade"), F.count_if(grade).alias("n"))


P20 = f"WITH {LOG} SELECT player, bool_or(gold AND odds1 > 1.5 AND odds2 > 1.5 AND abs(p_nn - p_xgb) < 0.5) AS gold_grade, count(*) FILTER (WHERE gold AND odds1 > 1.5 AND odds2 > 1.5 AND abs(p_nn - p_xgb) < 0.5) AS n FROM log GROUP BY player"


def p22(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 50 > 0, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_partkey") % 97 == 0, 1e7).otherwise(F.col("l_extendedprice")).alias("price"))
    return fx.out_of_distribution(l, ["quantity", "price"], F.col("l_partkey") % 97 != 0).select("l_orderkey", "l_linenumber", "l_partkey", "flags")


P22 = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 50 > 0 THEN l_quantity END AS q, CASE WHEN l_partkey % 97 = 0 THEN 1e7 ELSE l_extendedprice END AS p FROM lineitem), s AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(p) AS mp, stddev_pop(p) AS sp FROM l WHERE l_partkey % 97 <> 0)
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN q IS NULL THEN 'quantity:missing' WHEN abs(q - mq) > 8 * sq THEN 'quantity:far' END, CASE WHEN abs(p - mp) > 8 * sp THEN 'price:far' END) AS flags FROM l, s"""


def p23(spark, sf):
    reasons = F.filter(F.array(F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_totalprice") > 400000, "large"), F.when(F.col("o_orderpriority").rlike("^[12]"), "urgent")), lambda x: x.isNotNull())
    return table(spark, sf, "orders").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


P23 = "SELECT 'pending' AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'large', count(*) FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority[1] IN ('1', '2')"


def p25(spark, sf):
    l = prediction_log(spark, sf)
    blend = 0.5 / (1 + F.exp(-4 * (F.col("p_nn") - F.col("p_xgb")))) + 0.5 * F.col("p_market")
    return l.select("uid", r6(blend).alias("blend"), r6(blend * F.col("odds1") - 1).alias("ev")).where("ev > 0.05")


P25 = f"WITH {LOG}, b AS (SELECT uid, odds1, 0.5::DOUBLE / (1 + exp(-4 * (p_nn - p_xgb))) + 0.5::DOUBLE * p_market AS blend FROM log) SELECT uid, round(blend + 1e-10, 6) AS blend, round(blend * odds1 - 1 + 1e-10, 6) AS ev FROM b WHERE round(blend * odds1 - 1 + 1e-10, 6) > 0.05"


def p27(spark, sf):
    w = fx.walk_forward(1995, 2001, 3)
    return fx.split_windows(prediction_log(spark, sf).select("uid", "yr"), "yr", w).groupBy("window", "part").agg(F.count(F.lit(1)).alias("n"), F.min("yr").alias("lo"), F.max("yr").alias("hi"))


P27 = f"WITH {LOG}, w AS (SELECT CAST(range AS INTEGER) AS w, 1995 + range AS f FROM range(3)) SELECT w AS \"window\", CASE WHEN yr < f + 3 THEN 'train' WHEN yr < f + 4 THEN 'validation' ELSE 'test' END AS part, count(*) AS n, CAST(min(yr) AS INTEGER) AS lo, CAST(max(yr) AS INTEGER) AS hi FROM log, w WHERE yr >= f AND yr < f + 5 GROUP BY ALL"


def p28(spark, sf):
    l = prediction_log(spark, sf).select("uid", "yr", F.when(F.col("uid") % 4 > 0, F.col("odds1")).alias("odds1"), F.when(F.col("uid") % 5 > 0, F.col("odds2")).alias("odds2"))
    return fx.median_impute(l, ["odds1", "odds2"], F.col("yr") < 1999).select("uid", r6(F.col("odds1")).alias("odds1"), r6(F.col("odds2")).alias("odds2"))


P28 = f"WITH {LOG}, l AS (SELECT uid, yr, CASE WHEN uid % 4 > 0 THEN odds1 END AS a, CASE WHEN uid % 5 > 0 THEN odds2 END AS b FROM log), m AS (SELECT median(a) AS ma, median(b) AS mb FROM l WHERE yr < 1999) SELECT uid, round(coalesce(a, ma) + 1e-10, 6) AS odds1, round(coalesce(b, mb) + 1e-10, 6) AS odds2 FROM l, m"


def p29(spark, sf):
    return fx.recency_weights(prediction_log(spark, sf).select("uid", "d"), "d", 730.0).select("uid", r6(F.col("weight")).alias("weight"))


P29 = f"WITH {LOG}, r AS (SELECT uid, pow(0.5, date_diff('day', d, (SELECT max(d) FROM log)) / 730.0::DOUBLE) AS w FROM log) SELECT uid, round(w / (SELECT avg(w) FROM r) + 1e-10, 6) AS weight FROM r"


def p31(spark, sf):
    stages = [("accepted", F.col("o_orderstatus") != "X"), ("finite", F.col("o_totalprice") > 0), ("complete", F.col("o_orderstatus") != "P"), ("clean", F.col("o_custkey") % 11 > 0), ("valid", F.col("o_totalprice") < 400000)]
    return fx.nested_funnel(table(spark, sf, "orders"), stages)


P31 = "SELECT count(*) AS accepted, count(*) FILTER (WHERE o_totalprice > 0) AS finite, count(*) FILTER (WHERE o_totalprice > 0 AND o_orderstatus <> 'P') AS complete, count(*) FILTER (WHERE o_totalprice > 0 AND o_orderstatus <> 'P' AND o_custkey % 11 > 0) AS clean, count(*) FILTER (WHERE o_totalprice > 0 AND o_orderstatus <> 'P' AND o_custkey % 11 > 0 AND o_totalprice < 400000) AS valid FROM orders"


def f12(spark, sf):
    t = F.concat(F.lit("Événement: "), F.col("c_name"), F.lit(" Ünïcode (12) (3)"))
    return table(spark, sf, "customer").select("c_custkey", tx.normalised(t).alias("normal"), tx.name_key(t).alias("letters"), tx.title_key(t).alias("title"), tx.surname(F.lower("c_name")).alias("surname"))


F12 = """WITH t AS (SELECT c_custkey, c_name, 'Événement: ' || c_name || ' Ünïcode (12) (3)' AS t FROM customer), f AS (SELECT *, strip_accents(lower(t)) AS f FROM t)
SELECT c_custkey, trim(regexp_replace(regexp_replace(f, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS normal, regexp_replace(f, '[^a-z]', '', 'g') AS letters, trim(regexp_replace(t, '(\\s*\\([0-9]+\\))+\\s*$', '')) AS title, lower(c_name) AS surname FROM f"""


def f20(spark, sf):
    d = F.to_date("o_orderdate")
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.date_format(d, "yyyyMMdd")).when(kind == 1, F.date_format(d, "yyyy-MM-dd")).when(kind == 2, F.date_format(d, "ddMMMyy")).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", F.to_date(dates.parsed_date(text)).cast("string").alias("d"))


F20 = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(CAST(CASE WHEN o_orderkey % 4 = 2 AND year(o_orderdate) < 2000 THEN o_orderdate + INTERVAL 100 YEAR ELSE o_orderdate END AS DATE) AS VARCHAR) END AS d FROM orders"


def f21(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.stable_uid(F.col("o_orderkey"), F.col("o_orderpriority"), F.lit(None)).alias("uid"), tx.record_sha("o_orderkey", "o_orderstatus", "o_custkey").alias("sha"), tx.seed_of(F.col("o_orderpriority")).alias("seed"))


F21 = """SELECT o_orderkey, substr(sha1(o_orderkey || '||' || lower(o_orderpriority) || '||'), 1, 20) AS uid, sha256('o_custkey=' || o_custkey || chr(31) || 'o_orderkey=' || o_orderkey || chr(31) || 'o_orderstatus=' || o_orderstatus) AS sha,
CAST('0x' || substr(md5(o_orderpriority), 1, 8) AS BIGINT) AS seed FROM orders"""


def f27(spark, sf):
    parsed = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.try_element_at(parsed, F.lit("k")).alias("k2"), F.size(parsed).alias("n"))


F27 = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k2, CAST(len(json_keys(props)) AS INTEGER) AS n FROM events"


def f28(spark, sf):
    g = observations(spark, sf).groupBy("player").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("day", "id", "surface")))), lambda x: x["surface"]).alias("s"))
    return g.select("player", F.array_join(F.slice("s", 1, 3), ",").alias("newest"), F.array_join(F.array_distinct("s"), ",").alias("kinds"))


F28 = f"WITH {OBS}, g AS (SELECT player, list(surface ORDER BY day DESC, id DESC) AS s FROM obs GROUP BY player) SELECT player, array_to_string(s[:3], ',') AS newest, array_to_string(list_transform(list_sort(list_transform(list_distinct(s), lambda x: {{'i': list_position(s, x), 'v': x}})), lambda y: y.v), ',') AS kinds FROM g"

QUERIES = {
    "p01_side_swap": (p01, P01), "p02_pair_features": (p02, P02), "p03_profile_defaults": (p03, P03), "p05_fill_by_name": (p05, P05), "p07_one_hot": (p07, P07), "p08_one_hot_decode": (p08, P08), "p09_one_hot_check": (p09, P09),
    "p10_season": (p10, P10), "p12_round_offset": (p12, _p12_sql()), "p13_qualifier_rounds": (p13, P13), "p16_segment": (p16, P16), "p17_surface_hint": (p17, P17), "p18_safe_numbers": (p18, P18), "p19_first_known": (p19, P19), "p20_gold_grade": (p20, P20),
    "p22_ood_flags": (p22, P22), "p23_reasons": (p23, P23), "p25_value_bets": (p25, P25), "p27_walk_forward": (p27, P27), "p28_median_impute": (p28, P28), "p29_recency_weights": (p29, P29), "p31_funnel": (p31, P31),
    "f12_text_keys": (f12, F12), "f20_date_formats": (f20, F20), "f21_stable_ids": (f21, F21), "f27_json_fields": (f27, F27), "f28_array_slices": (f28, F28),
}
