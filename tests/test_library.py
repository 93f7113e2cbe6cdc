"""Values worked out by hand, and properties that must hold whatever the data."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pitwise.functions import dates, rates, scores
from pitwise.functions import text as tx
from pitwise.operators import dedup, evaluate, features, joins, simulate, store, temporal
from pitwise.operators.prefix import running
from pitwise.sources import files, paging, sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_rates_by_hand(spark):
    got = one(spark, a=rates.laplace(F.lit(3), F.lit(5)), none=rates.laplace(F.lit(0), F.lit(0)), fair=rates.devig(F.lit(1.5), F.lit(3.0)), k=rates.kelly(F.lit(0.6), F.lit(2.0)), no=rates.kelly(F.lit(0.4), F.lit(2.0)), bad=rates.kelly(F.lit(0.6), F.lit(1.0)))
    assert got["a"] == pytest.approx(4.5 / 8) and got["none"] == 0.5 and got["fair"] == pytest.approx(2 / 3)
    assert got["k"] == pytest.approx(0.2) and got["no"] == 0.0 and got["bad"] == 0.0


def test_american_odds(spark):
    df = spark.createDataFrame([("EVEN", 2.0), ("pk", 2.0), ("+150", 2.5), ("-200", 1.5), ("0", None), ("x", None), (None, None)], "t string, want double")
    for r in df.select("want", rates.american_to_decimal(F.col("t")).alias("got")).collect():
        assert r.got == r.want


def test_scores_by_hand(spark):
    df = spark.createDataFrame([("6-4 6-7(3) 6-1", 3), ("6-3 RET", None), ("W/O", 0), ("6-0 6-0", 2), ("abc", None), (None, None)], "s string, sets int")
    rows = df.select("s", "sets", scores.set_count(F.col("s")).alias("n"), scores.summary(F.col("s"), F.lit(None).cast("int")).alias("x"), scores.flipped(F.col("s")).alias("f")).collect()
    assert [r.n for r in rows if r.s != "6-3 RET"] == [3, 0, 2, None, None]
    first = rows[0].x
    assert (first.sets_won, first.sets_lost, first.games_won, first.games_lost, first.tiebreaks, first.tiebreaks_won, first.straight, first.deciding) == (2, 1, 18, 12, 1, 0, 0, 1)
    assert not rows[1].x.valid and rows[1].x.games_won is None and rows[0].f == "4-6 7-6(3) 1-6"


def test_dates(spark):
    got = one(spark, monday=dates.monday_number(dates.day_number(F.lit("2024-05-15"))), week=dates.week_key(F.lit("2021-01-03").cast("date")), d=dates.parsed_date(F.lit("25 May, 26")).cast("date").cast("string"), bad=dates.parsed_date(F.lit("soon")))
    assert got["monday"] == 19856 and got["week"] == "2020-53" and got["d"] == "2026-05-25" and got["bad"] is None


def test_names(spark):
    alike = [("José Núñez", "jose nunez"), ("R. Nadal", "Rafael Nadal"), ("Anna Maria Lopez", "Anna Lopez")]
    other = [("Jo Smith", "Al Smith"), ("Ann Lee", "Bob Ray")]
    df = spark.createDataFrame([(*p, True) for p in alike] + [(*p, False) for p in other], "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", tx.names_alike(F.col("a"), F.col("b")).alias("got")).collect())


def test_shifted_duplicates_keep_the_last_kept(spark):
    rows = [("m", 0, 1), ("m", 5, 2), ("m", 15, 3), ("m", 40, 4), ("n", 3, 5), ("m", 60, 6)]
    df = spark.createDataFrame(rows, "sig string, day bigint, id bigint")
    assert sorted(r.id for r in temporal.quarantine_shifted(df, ["sig"], "day", "id").collect()) == [1, 3, 4, 5, 6]


def test_history_never_sees_its_own_day_or_later(spark):
    rows = [(1, "a", 10, 1), (2, "a", 10, 0), (3, "a", 11, 1), (4, "a", 20, None), (5, "b", 10, 1)]
    schema = "id bigint, player string, day bigint, won int"
    see = lambda df: {r.id: (r.n, r.rate) for r in df.select("id", temporal.prior_count(["player"], 30).alias("n"), temporal.prior_rate(["player"], days=30).alias("rate")).collect()}
    base = see(spark.createDataFrame(rows, schema))
    assert base[1] == base[2] == (0, 0.5) and base[3][0] == 2 and base[4] == (3, pytest.approx(3.5 / 6))
    later = see(spark.createDataFrame(rows[::-1] + [(9, "a", 21, 1)], schema))
    assert {k: v for k, v in later.items() if k != 9} == base


def test_streaks(spark):
    rows = [(i, "a", d, w) for i, (d, w) in enumerate([(1, 1), (2, 1), (3, 0), (4, 0), (4, 1), (5, 1), (6, None)])]
    got = {r.id: r.streak for r in temporal.streaks(spark.createDataFrame(rows, "id int, player string, day int, won int"), ["player"]).collect()}
    assert [got[i] for i in range(7)] == [0, 1, 2, -1, -1, 0, 1]


def test_complete_days_stop_at_the_first_that_does_not_fit(spark):
    rows = [(i, "a", d, 1) for i, d in enumerate([1, 2, 2, 2, 3, 4])] + [(9, "a", 5, 0)]
    df = temporal.recent_complete_days(spark.createDataFrame(rows, "id int, player string, day int, won int"), ["player"], last=3, days=30)
    assert df.where("id = 9").first().recent_n == 2


def test_auc_and_ece_edges(spark):
    df = spark.createDataFrame([("t", 1, 0.5), ("t", 0, 0.5), ("o", 1, 0.2), ("g", 1, 0.9), ("g", 0, 0.1)], "k string, y int, p double")
    auc = {r.k: r.auc for r in evaluate.auc(df, ["k"]).collect()}
    assert auc == {"t": 0.5, "o": None, "g": 1.0}
    assert evaluate.roc(df.where("k = 'o'"), ["k"]).count() == 0
    exact = spark.createDataFrame([("z", 1, 1.0), ("z", 0, 0.0)], "k string, y int, p double")
    assert evaluate.ece(exact, ["k"]).first().ece == 0.0


def test_binomial_tail(spark):
    got = one(spark, x=evaluate.binomial_tail(F.lit(7).cast("bigint"), F.lit(10).cast("bigint"), F.lit(0.4)))["x"]
    assert got == pytest.approx(sum(math.comb(10, k) * 0.4**k * 0.6 ** (10 - k) for k in range(7, 11)))


def test_calibration_line_recovers_the_truth(spark):
    df = spark.range(20000).select(F.lit("a").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 + 0.0005).alias("p"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100000)) / 100000.0)
    df = df.toDF("k", "p", "u").withColumn("y", (F.col("u") < F.col("p")).cast("int"))
    got = evaluate.calibration_line(df, ["k"]).first()
    assert got.slope == pytest.approx(1, abs=0.08) and got.intercept == pytest.approx(0, abs=0.08)


def test_validated_join_fails_on_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="twice"):
        joins.validated_left(left, right, ["k"]).collect()
    assert joins.validated_left(left, right.limit(1), ["k"]).count() == 1


def test_band_join_finds_every_pair(spark):
    a = spark.range(60).select(F.lit(1).alias("k"), F.col("id").alias("i"), ((F.col("id") * 7) % 53).alias("d"))
    b = spark.range(60).select(F.lit(1).alias("k"), F.col("id").alias("j"), ((F.col("id") * 11) % 47).alias("e"))
    want = {(i, j) for i in range(60) for j in range(60) if abs(i * 7 % 53 - j * 11 % 47) <= 4}
    assert {(r.i, r.j) for r in joins.band_join(a, b, ["k"], "d", "e", 4).collect()} == want


def test_ambiguous_names_resolve_to_nothing(spark):
    names = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "id int, a string, b string")
    known = spark.createDataFrame([(10, "x", "r"), (11, "x", "p"), (12, "z", "q")], "t int, ka string, kb string")
    got = {r.id: (r.t, r.stage) for r in joins.resolve_in_stages(names, known, [("a", "ka"), ("b", "kb")], "id", "t").collect()}
    assert got == {1: (11, 1), 2: (12, 1)}


def test_conflicting_claims_drop_the_group(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 9), ("b", 1, 5), ("b", 2, 9)], "k string, winner int, rank int")
    assert [(r.k, r.rank) for r in dedup.one_if_agreed(df, ["k"], "winner", [F.col("rank")]).collect()] == [("a", 9)]


def test_running_sum_and_maximum(spark):
    df = spark.range(500).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) - 50).cast("double").alias("v"))
    rows = sorted(running(running(df, "id", [], "s", "v", 5.0), "id", [], "m", "s", kind="max").collect(), key=lambda r: r.id)
    total, top = 5.0, -math.inf
    for r in rows:
        total += r.v
        top = max(top, total)
        assert r.s == pytest.approx(total) and r.m == pytest.approx(top)


def test_block_budget(spark):
    df = spark.createDataFrame([("a", 6.0), ("a", 4.0), ("b", 8.0), ("c", 5.0), (None, 3.0)], "block string, wish double")
    got = sorted((r.block, r.stake) for r in simulate.block_stakes(df, "block", "wish", 14.0).collect())
    assert got == [("a", 4.0), ("a", 6.0), ("b", 4.0), ("c", 0.0)]


def test_kelly_replay_uses_the_raw_hurdle(spark):
    df = spark.createDataFrame([(1, 0.51, 1, 1.9, 1.9), (2, 0.60, 1, 2.0, 1.8)], "uid int, p double, y int, odds1 double, odds2 double")
    got = simulate.replay_summary(df, "p", "y").first()
    assert got.bets == 1 and got.profit == pytest.approx(1.0)


def test_swapping_sides_mirrors_pair_features(spark):
    df = spark.createDataFrame([(3.0, 5.0), (7.0, 2.0), (4.0, 4.0)], "a double, b double")
    for r in df.select(F.struct(*features.pair_features(F.col("a"), F.col("b"), "x")).alias("f"), F.struct(*features.pair_features(F.col("b"), F.col("a"), "x")).alias("g")).collect():
        assert r.f.x_diff == -r.g.x_diff and r.f.x_ratio == r.g.x_ratio and r.f.x_avg == r.g.x_avg
        assert r.f.x_advantage + r.g.x_advantage == (r.f.x_diff != 0)


def test_round_offsets_by_hand(spark):
    rows = [("G", 128, "F", "2024-05-26", None, 14), ("M", 96, "R64", "2024-03-06", None, 2), ("M", 64, "R64", "2024-08-05", None, 0), ("M", 64, "R16", "2024-04-24", None, 3), ("A", 32, "R32", "2024-02-05", None, 0), ("A", 32, "Q1", "2024-02-05", 2, -2), ("M", 96, "Q1", "2024-03-06", None, -2), ("O", 8, "RR", "2024-11-10", None, 1), ("C", 32, "QF", "2024-02-05", None, 4)]
    df = spark.createDataFrame(rows, "level string, draw int, code string, start string, nq int, want int").withColumn("start", F.to_date("start"))
    got = df.select("want", features.round_day_offset(*[F.col(c) for c in ("level", "draw", "code", "start", "nq")]).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1, "open"), ("b", 1, "won")], "k string, at int, state string")
    new = spark.createDataFrame([("a", 2, "won"), ("b", 2, "open")], "k string, at int, state string")
    for mode in ("immutable", "mutable", "terminal"):
        once = store.upsert(old, new, "k", mode, "at", "state", ["won"])
        assert sorted(once.collect()) == sorted(store.upsert(once, new, "k", mode, "at", "state", ["won"]).collect())
    assert {r.k: r.state for r in store.upsert(old, new, "k", "terminal", "at", "state", ["won"]).collect()} == {"a": "won", "b": "won"}


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Match Day,N,_ctl\n2024-01-01,1,x\n2024-01-02,bad,y\n")
    (tmp_path / "b.csv").write_text("Match Day,M\n2024-01-03,7\n")
    df = files.csv_text(spark, f"file://{tmp_path}/a.csv", drop=("_ctl",))
    assert df.columns == ["match_day", "n"]
    assert [r.n for r in files.typed(df, {"n": "int"}).orderBy("match_day").collect()] == [1, None]
    assert files.csv_optional(spark, f"file://{tmp_path}/none.csv", "a int, b string").count() == 0
    both = files.union_files(spark, {"a": f"file://{tmp_path}/a.csv", "b": f"file://{tmp_path}/b.csv"}, ["Match Day"])
    assert [r.data_source for r in both.collect()] == ["a", "a", "b"]


def test_json_discovery(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "metrics.json").write_text(json.dumps({"auc": 0.7, "acc": 0.6}))
    (tmp_path / "metrics.json").write_text(json.dumps({"roc_auc": 0.8}))
    got = files.discovered_json(spark, f"file://{tmp_path}", "metrics.json", {"auc": ["auc", "roc_auc"], "accuracy": ["accuracy", "acc"]})
    assert sorted((r.auc, r.accuracy or 0) for r in got.collect()) == [(0.7, 0.6), (0.8, 0)]


def test_paged_source(spark, tmp_path):
    (tmp_path / "page-0.jsonl").write_text('{"next": "1"}\n{"id": "a", "v": 1}\n')
    (tmp_path / "page-1.jsonl").write_text('{"next": null}\n{"id": "b", "v": 2}\n{"id": "a", "v": 1}\n')
    read = lambda: paging.records(spark, str(tmp_path), "id").collect()
    assert sorted(r.key for r in read()) == ["a", "b"]
    (tmp_path / "page-1.jsonl").write_text('{"next": "0"}\n')
    with pytest.raises(Exception, match="circle"):
        read()


def test_publish_and_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    root = f"file://{tmp_path}/p"
    sinks.publish(spark, {"t": df}, root, "s1")
    sinks.publish(spark, {"t": df.limit(1)}, root, "s2")
    assert sinks.published(spark, root, "t").count() == 1
    path = f"file://{tmp_path}/t"
    assert sinks.append_absent(df, path, ["k"]) == 2 and sinks.append_absent(df, path, ["k"]) == 0
    assert sinks.markdown(df.orderBy("k")).splitlines()[2] == "| 1 | a |"


def test_compounded_paths_do_not_leave_the_range_of_doubles(spark):
    df = spark.range(8000).select(F.lit(0).alias("k"), F.col("id").alias("at"), F.lit(-0.25).alias("down"), F.lit(0.25).alias("up"))
    for growth, value in (("down", 0.75), ("up", 1.25)):
        rows = simulate.compounded(df, ["k"], ["at"], growth).orderBy("at").collect()
        assert all(r.log_equity == pytest.approx(math.log(1000) + (r["at"] + 1) * math.log(value), abs=1e-10) for r in rows)
        assert rows[0].equity == pytest.approx(1000 * value)


def test_nearest_of_large_days_is_not_a_product(spark):
    """Two days of 30000 rows on each side would be 1.8 billion pairs."""
    side = lambda name, day: spark.range(60000).select(F.lit(1).alias("k"), F.col("id").alias(name), (F.col("id") % 2).alias(day))
    got = joins.nearest(side("i", "d"), side("j", "e"), ["k"], "d", "e", 1, ["i"], "j")
    assert got.agg(F.count("*"), F.max("gap"), F.max("j")).first() == (60000, 0, 1)


def test_nearest_by_brute_force(spark):
    a = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("i"), ((F.col("id") * 7) % 23).alias("d"))
    b = spark.range(400).select(F.lit(1).alias("k"), F.when(F.col("id") != 5, F.col("id")).alias("j"), ((F.col("id") * 11) % 31).alias("e"))
    right = [(i * 11 % 31, -1 if i == 5 else i) for i in range(400)]
    want = {(i, *min((abs(i * 7 % 23 - e), j) for e, j in right if abs(i * 7 % 23 - e) <= 2)) for i in range(400)}
    near = joins.nearest(a, b, ["k"], "d", "e", 2, ["i"], "j")
    assert {(r.i, r.gap, -1 if r.j is None else r.j) for r in near.collect()} == want


def test_running_sums_of_keys_that_are_most_of_a_table(spark):
    df = spark.range(300).select(F.when(F.col("id") % 2 == 0, "a").alias("k"), "id", F.lit(1).alias("one"), F.col("id").cast("double").alias("v"))
    got = {(r.k, r.id): (r.n, r.s) for r in running(df, "id", [], ["n", "s"], ["one", "v"], by=["k"]).collect()}
    assert got == {("a" if i % 2 == 0 else None, i): (i // 2 + 1, sum(range(i % 2, i + 1, 2))) for i in range(300)}


def test_equal_titles_are_matched_once(spark):
    """20000 equal titles against 2000 entries that share their token would be 40 million pairs, each with both sets."""
    left = spark.range(20000).select(F.col("id").alias("i"), F.array(F.lit("x"), F.lit("y0")).alias("t"))
    right = spark.range(2000).select(F.col("id").alias("j"), F.array(F.lit("x"), F.concat(F.lit("y"), F.col("id").cast("string"))).alias("t"))
    got = joins.best_by_tokens(left, right, "i", "j", "t", 0.4, 0.05)
    assert got.agg(F.count("*"), F.min("j"), F.max("j"), F.min("score")).first() == (20000, 0, 0, 1.0)


def test_a_snapshot_of_many_copies_is_not_gathered(spark):
    from pitwise.operators import lineage

    vector = F.array((F.col("id") % 3).cast("double"))
    rows = spark.range(2000).select(F.lit(1).alias("snapshot_id"), (F.col("id") == 7).alias("immutable"), F.lit("s").alias("source"), F.col("id").alias("row"), F.lit("r").alias("run_id"), F.lit("ok").alias("status"), vector.alias("vector"), F.lit("1").alias("claimed_count"))
    hash_of = lambda v: F.array_join(v.cast("array<string>"), ",")
    found = lineage.resolved(rows.withColumn("claimed_hash", hash_of(F.col("vector"))), hash_of)
    got = found.first()
    assert (got.state, got.reasons, got.copies, got.hashes, got.row) == ("conflict", "derived", 2000, 3, 7)
    assert "collect_set" not in found._jdf.queryExecution().toString()
