"""Settlement plans and staking paths on small cases that are worked out by hand."""

import hashlib

import pytest

from pitwise.operators import fold

BET = "source_row bigint, bet_id bigint, account bigint, match_id bigint, p1 string, p2 string, date date, bet_on string, on_first boolean, stake bigint, odds bigint, status string, profit bigint"
RESULT = "match_id bigint, p1 string, p2 string, date date, winner int"


def plan(spark, bets, results, capital=1_000_000):
    import datetime as dt

    day = dt.date(2026, 7, 10)
    base = dict(account=1, p1="a", p2="b", date=day, bet_on="a", on_first=True, stake=1000, odds=200, status="pending", profit=None)
    names = [c.split()[0] for c in BET.split(", ")]
    rows = [tuple((base | {"source_row": i, "bet_id": i, "match_id": i} | b)[n] for n in names) for i, b in enumerate(bets)]
    found = [tuple(({"p1": "a", "p2": "b", "date": day} | r)[n] for n in ("match_id", "p1", "p2", "date", "winner")) for r in results]
    out = fold.settlement_plan(spark.createDataFrame(rows, BET), spark.createDataFrame(found, RESULT), capital).collect()
    return {r.source_row: r for r in out}


def test_winners_are_compared_by_name_whatever_the_order_of_sides(spark):
    got = plan(spark, [{}, {"bet_on": "b", "on_first": False}], [{"match_id": 0, "winner": 1}, {"match_id": 0, "p1": "b", "p2": "a", "winner": 2}, {"match_id": 1, "winner": 1}])
    assert (got[0].result, got[0].profit, got[0].after) == ("win", 100_000, 1_100_000)
    assert (got[1].result, got[1].profit, got[1].after) == ("loss", -100_000, 1_000_000)
    first = hashlib.sha256(b"|0:100000:1100000").hexdigest()
    assert got[1].digest == hashlib.sha256(f"{first}|1:-100000:1000000".encode()).hexdigest()


def test_nothing_unknown_is_settled(spark):
    import datetime as dt

    results = [{"match_id": 0, "winner": -1}, {"match_id": 1, "winner": None}, {"match_id": 2, "winner": 1}, {"match_id": 2, "winner": 2}, {"match_id": 3, "winner": 1}, {"match_id": 3, "winner": -1}, {"match_id": 4, "winner": 1}, {"match_id": 4, "p2": "c", "winner": 1}]
    results += [{"match_id": 5, "winner": 1}, {"match_id": 5, "date": dt.date(2026, 7, 11), "winner": 1}, {"match_id": 6, "p2": "c", "winner": 1}, {"match_id": 7, "date": dt.date(2026, 7, 11), "winner": 1}, *({"match_id": m, "winner": 1} for m in (9, 10, 11, 12))]
    bets = [{} for _ in range(9)] + [{"on_first": False}, {"bet_on": "z"}, {"stake": 0, "odds": 100}, {"stake": None}]
    got = plan(spark, bets, results)
    want = ["void", "unresolved", "conflicting_winners", "conflicting_winners", "ambiguous_match", "ambiguous_match", "pair_mismatch", "date_mismatch", "no_result", "side_orientation", "side_not_in_pair", "invalid_stake,invalid_odds", "invalid_stake"]
    assert [got[i].reasons for i in range(len(want))] == want
    assert all(r.profit is None and r.after is None and r.digest is None for r in got.values())


def test_capital_repeats_and_wrong_books(spark):
    bets = [{"stake": 9000}, {"stake": 3000}, {"stake": 500}, {"bet_id": 77}, {"bet_id": 77}, {"account": 2}, {"account": 2, "status": "settled", "profit": 5}, {"account": 3}, {"account": 3, "status": "settled", "profit": -100_000}]
    results = [{"match_id": m, "winner": 2 if m in (0, 2) else 1} for m in range(9)]
    got = plan(spark, bets, results)
    assert [got[i].reasons for i in (0, 1, 2, 3, 4, 5, 7)] == ["", "insufficient_capital", "", "nonunique_bet_id", "nonunique_bet_id", "account_blocked", ""]
    assert [got[i].after for i in (0, 2, 7)] == [100_000, 50_000, 1_000_000]
    assert set(got) == {0, 1, 2, 3, 4, 5, 7}  # settled bets are not planned again


def paths(spark, rows, **more):
    df = spark.createDataFrame([("x", i, *r) for i, r in enumerate(rows)], "key string, n int, day int, p double, odds double, won boolean")
    return sorted(tuple(r)[1:] for r in fold.staking_paths(df, ["key"], ["n"], "n", **more).collect())


def test_bets_of_a_day_are_staked_from_its_opening(spark):
    rows = [(1, 0.75, 2.0, True), (1, 0.75, 2.0, False), (2, 0.75, 2.0, True), (2, 0.1, 2.0, True)]
    assert paths(spark, rows, block="day", k=0.5, start=100.0, friction_bps=100.0) == [(0, 25.0, 24.75, 99.5), (1, 25.0, -25.25, 99.5), (2, 49.75, 49.2525, 148.7525), (3, 0.0, 0.0, 148.7525)]


def test_shortfalls_and_the_end_of_a_path(spark):
    rows = [(1, 0.75, 2.0, False)] * 3 + [(2, 0.75, 2.0, True)]
    assert [r[1] for r in paths(spark, rows, block="day", k=1.0, start=10.0, least=4.0)] == [0, 0, 0, 10.0]
    scaled = paths(spark, rows, block="day", k=1.0, start=10.0, least=4.0, shortfall="all-in")
    assert [r[1] for r in scaled] == pytest.approx([10 / 3] * 3 + [0.0]) and scaled[-1][3] == 0.0
    assert [r[1] for r in paths(spark, rows, k=1.0, start=10.0, least=4.0)] == [4.0, 4.0, 0.0, 0.0]


def test_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1, 0.75, 2.0, True), ("a", 2, 0.75, 2.0, True)], "key string, n int, p double, odds double, won boolean")
    assert sorted(r.n for r in fold.staking_paths(df, ["key"], ["n"], "n").collect()) == [1, 2]
    assert fold.staking_paths(df.limit(0), ["key"], ["n"], "n").count() == 0


def test_strategies_by_a_walk_of_their_own(spark):
    """Each strategy stakes from its own bankroll, over all bets of a key: small bets are left out, raised, or of the first bankroll."""
    import math
    import random

    r = random.Random(5)
    rows = [("ab"[i % 2], i, r.choice([0.3, 0.6, 0.8, 1.0]), r.choice([1.5, 2.0, 4.0]), r.random() < 0.45) for i in range(400)]
    strategies = {"full": ("growing", 1.0, None), "capped": ("growing", 1.0, 0.05), "hybrid": ("raised", 0.02, None), "fixed": ("level", 1.0, None)}
    df = spark.createDataFrame(rows, "key string, n int, p double, odds double, won boolean").repartition(3)
    got = {(x.strategy, x.n): x for x in fold.strategy_paths(df, ["key"], ["n"], "n", strategies, start=10.0, least=0.5).collect()}
    assert len(got) == len(rows) * len(strategies)
    seen = set()
    for name, (rule, share, most) in strategies.items():
        bank = dict.fromkeys("ab", 10.0)
        for key, n, p, odds, won in rows:
            f = max(0.0, ((odds - 1) * p - (1 - p)) / (odds - 1))
            stake = (10.0 if rule == "level" else bank[key]) * min(share * f, most or 1.0)
            raised = rule == "raised" and f > 0 and stake < 0.5 <= bank[key]
            stake = 0.5 if raised else stake
            placed = f > 0 and stake >= 0.5
            seen.add((name, placed, raised))
            bank[key] += (stake * (odds - 1) if won else -stake) if placed else 0.0
            x = got[name, n]
            assert x.placed == placed
            if rule == "level":
                assert x.log_equity is None and x.equity == pytest.approx(bank[key], abs=2e-4)
            else:
                assert x.equity is None and (x.log_equity is None if bank[key] <= 1e-9 else x.log_equity == pytest.approx(math.log(bank[key]), abs=1e-6))
    assert {("full", True, False), ("full", False, False), ("hybrid", True, True), ("hybrid", False, False)} <= seen


def test_strategies_bet_on_either_side_and_keep_their_bankroll_over_the_years(spark):
    from pitwise.plans import research
    from pitwise.plans.analogues import prediction_log

    sf = "/root/testdata/sf0.001"
    log = {r.uid: r for r in prediction_log(spark, sf).collect()}
    got = research.b13c(spark, sf).where("strategy = 'fixed'").collect()
    low = [x for x in got if log[x.uid].p_nn < 0.47]
    assert len(low) > 50 and any(x.placed for x in low)
    path = sorted((x for x in got if log[x.uid].segment == log[got[0].uid].segment), key=lambda x: (log[x.uid].d, x.uid))
    steps = [b.equity - a.equity for a, b in zip(path, path[1:])]
    assert len({log[x.uid].yr for x in path}) > 3 and all((s != 0) == b.placed for s, b in zip(steps, path[1:]))
