
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwise.functions.dates import day_number
from pitwise.session import table

OBS = """obs AS (SELECT o_orderkey AS id, o_custkey AS player, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS won, o_orderpriority AS surface, o_totalprice AS rank FROM orders)"""

MATCH_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
MATCHES = f"""matches AS (SELECT l.l_orderkey * 100 + row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {", ".join("l." + c for c in MATCH_ORDER)}) AS id, o.o_custkey % 20 AS p1, 20 + l.l_suppkey % 20 AS p2,
  date_diff('day', DATE '1970-01-01', CAST(l.l_shipdate AS DATE)) AS day, CASE l.l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS won,
  l.l_linestatus AS level, l.l_linenumber AS n, l.l_orderkey AS orderkey, l.l_quantity AS quantity, l.l_extendedprice AS price, l.l_tax AS tax, l.l_discount AS discount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

#: Every customer and supplier is a player of its own, as histories want it; the 40 groups above are for joins that need pairs to meet often.
WIDE = MATCHES.replace("o.o_custkey % 20 AS p1, 20 + l.l_suppkey % 20 AS p2", "o.o_custkey AS p1, l.l_suppkey + 1000000000 AS p2")

QUOTES = """quotes AS (SELECT event_id, user_id AS uid, ts, CAST(ts AS DATE) AS run, value / 500 AS prob, event_type AS source,
  TIMESTAMP '2024-01-20 00:00:00' + to_hours(CAST(user_id AS INTEGER)) AS start_at FROM events)"""

LOG = """log AS (SELECT o_orderkey AS uid, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS y, ((o_orderkey*37)%1000+0.5)/1001.0::DOUBLE AS p_nn, ((o_orderkey*53+17)%1000+0.5)/1001.0::DOUBLE AS p_xgb,
  ((o_orderkey*91+5)%1000+0.5)/1001.0::DOUBLE AS p_rf, ((o_orderkey*29+3)%1000+0.5)/1001.0::DOUBLE AS p_market, 1.05::DOUBLE+((o_orderkey*7)%400)/100.0::DOUBLE AS odds1, 1.05::DOUBLE+((o_orderkey*11)%400)/100.0::DOUBLE AS odds2,
  o_orderpriority AS segment, o_custkey % 3 = 0 AS gold, o_custkey AS player, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS yr FROM orders WHERE o_orderstatus IN ('F', 'O'))"""

LONG = LOG + """, scored AS (SELECT uid, y, segment, gold, yr, 'nn' AS model, p_nn AS p FROM log UNION ALL SELECT uid, y, segment, gold, yr, 'xgb', p_xgb FROM log
  UNION ALL SELECT uid, y, segment, gold, yr, 'rf', p_rf FROM log UNION ALL SELECT uid, y, segment, gold, yr, 'market', p_market FROM log)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity's dated results: id, player, day, won (1, 0, null), surface, rank."""
    o = table(spark, sf_dir, "orders")
    won = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("player"), day_number(F.col("o_orderdate")).alias("day"), won.alias("won"), F.col("o_orderpriority").alias("surface"), F.col("o_totalprice").alias("rank"))


def matches(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Two-sided results; ``id`` counts the lines of each order in the order of all their columns. ``wide``: every customer and supplier is a player, not 40 groups of them."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    won = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
    rows = l.join(o, l.l_orderkey == o.o_orderkey)
    ident = F.col("l_orderkey") * 100 + F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*MATCH_ORDER))
    return rows.select(ident.cast("bigint").alias("id"), (F.col("o_custkey") if wide else F.col("o_custkey") % 20).alias("p1"), (F.col("l_suppkey") + 1_000_000_000 if wide else 20 + F.col("l_suppkey") % 20).alias("p2"), day_number(F.col("l_shipdate")).alias("day"), won.alias("won"), F.col("l_linestatus").alias("level"), F.col("l_linenumber").alias("n"), F.col("l_orderkey").alias("orderkey"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations of a match before (or after) its start."""
    e = table(spark, sf_dir, "events")
    start = F.lit("2024-01-20").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("user_id").cast("int"))
    return e.select("event_id", F.col("user_id").alias("uid"), "ts", F.to_date("ts").alias("run"), (F.col("value") / 500).alias("prob"), F.col("event_type").alias("source"), start.alias("start_at"))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled predictions of four models with both prices."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    key = F.col("o_orderkey")
    p = lambda a, b: ((key * a + b) % 1000 + F.lit(0.5).cast("double")) / F.lit(1001.0).cast("double")
    odds = lambda a: F.lit(1.05).cast("double") + (key * a) % 400 / F.lit(100.0).cast("double")
    return o.select(key.alias("uid"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), p(37, 0).alias("p_nn"), p(53, 17).alias("p_xgb"), p(91, 5).alias("p_rf"), p(29, 3).alias("p_market"), odds(7).alias("odds1"), odds(11).alias("odds2"), F.col("o_orderpriority").alias("segment"), (F.col("o_custkey") % 3 == 0).alias("gold"), F.col("o_custkey").alias("player"), F.to_date("o_orderdate").alias("d"), F.year("o_orderdate").alias("yr"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in long form: a row for each prediction and model."""
    log = prediction_log(spark, sf_dir)
    long = log.unpivot(["uid", "y", "segment", "gold", "yr"], ["p_nn", "p_xgb", "p_rf", "p_market"], "model", "p")
    return long.withColumn("model", F.substring("model", 3, 20))
