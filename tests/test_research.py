"""Stretches of paths, permutations and lineage against walks by hand."""

import random

import pytest

from pitwise.operators import lineage, montecarlo
from pitwise.plans import research


def walk(gains):
    run = low = high = fall = 0
    for g in gains:
        run += g
        low, high = min(low, run), max(high, run)
        fall = max(fall, high - run)
    return run, low, high, fall


def test_joined_stretches_are_the_whole_path(spark):
    r = random.Random(3)
    rows = [("ab"[i % 2], i // 14, i, r.randint(-9, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, part int, n int, gain bigint").repartition(5)
    parts = montecarlo.stretches(df, ["key", "part"], ["n"], "gain")
    got = {x.key: (x.total, x.low, x.high, x.fall) for x in montecarlo.joined(parts, ["key"], ["part"]).collect()}
    assert got == {k: walk([g for key, _, _, g in rows if key == k]) for k in "ab"}


def test_every_simulation_is_a_permutation(spark):
    for size in (1, 2, 5, 97, 100):
        prime = montecarlo.prime_from(size)
        rows = spark.range(size).crossJoin(spark.range(6).withColumnRenamed("id", "sim"))
        places = rows.select("sim", montecarlo.permuted(rows.id, rows.sim, prime, 4).alias("place")).collect()
        by_sim = {s: [p.place for p in places if p.sim == s] for s in range(6)}
        assert all(len(set(v)) == size and 0 <= min(v) and max(v) < prime for v in by_sim.values())
        assert size < 97 or len({tuple(v) for v in by_sim.values()}) == 6


def test_permutations_keep_the_sum_and_slots_do_not_matter(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(i, r.randint(-5, 6)) for i in range(150)], "n bigint, gain bigint")
    few, many = (montecarlo.row_permutation(df, "n", 150, "gain", 9, 2, slots).orderBy("sim").collect() for slots in (1, 64))
    assert few == many and len({x.low for x in few}) > 1
    assert {x.total for x in few} == {sum(g for _, g in df.collect())}


RECORD = "snapshot_id int, immutable boolean, source string, row int, run_id string, status string, vector array<double>, claimed_count string, claimed_hash string"


def states(spark, groups):
    base = dict(immutable=False, source="a", run_id="r", status="ok", vector=[300.0, 301.0], claimed_count="2", claimed_hash=None)
    names = [c.split()[0] for c in RECORD.split(", ")]
    rows = [tuple((base | {"snapshot_id": i, "row": k} | x)[n] for n in names) for i, g in enumerate(groups) for k, x in enumerate(g)]
    df = spark.createDataFrame(rows, RECORD)
    df = df.withColumn("claimed_hash", research.F.coalesce("claimed_hash", research._hash(research.F.col("vector"))))
    return {r.snapshot_id: r for r in lineage.resolved(df, research._hash).collect()}


def test_states_of_lineage(spark):
    near, far, part = [300.0 + 1 / research.UNIT, 301.0], [300.0, 301.001], [300.0, None]
    groups = {
        "copy off by rounding": ([{}, {"immutable": True}, {"vector": near}], "verified", ""),
        "copy that differs": ([{"immutable": True}, {"vector": far}], "conflict", "derived"),
        "two immutable ones that differ by rounding": ([{"immutable": True}, {"immutable": True, "vector": near}], "conflict", "immutable"),
        "two immutable ones that agree": ([{"immutable": True}, {"immutable": True, "source": "b"}], "verified", ""),
        "another run": ([{"immutable": True}, {"run_id": "q"}], "conflict", "run"),
        "malformed count": ([{"immutable": True, "claimed_count": "2.0x"}], "invalid", "count"),
        "a part of a complete vector": ([{"immutable": True}, {"vector": part}], "conflict", "derived"),
        "a part of a skipped vector": ([{"immutable": True, "status": "skip"}, {"status": "skip", "vector": part}], "invalid", "status"),
        "a part that contradicts": ([{"immutable": True, "status": "skip"}, {"status": "skip", "vector": [299.0, None]}], "conflict", "derived"),
        "copies alone that agree": ([{}, {"source": "b"}], "verified", ""),
        "copies alone off by rounding": ([{}, {"vector": near}], "conflict", "contradiction"),
        "a hash of something else": ([{"immutable": True, "claimed_hash": "bad"}, {}], "invalid", "hash"),
        "unknown status": ([{"immutable": True, "status": None}], "invalid", "status"),
    }
    got = states(spark, [g for g, _, _ in groups.values()])
    assert [(got[i].state, got[i].reasons) for i in range(len(groups))] == [(s, r) for _, s, r in groups.values()]
    assert all((r.vector_hash is None) == (r.state != "verified") for r in got.values())
    assert got[0].immutable and got[0].row == 1 and got[0].hashes == 2


def test_bundle_agrees_with_single_measures(spark):
    from pitwise.operators import evaluate
    from pitwise.plans.analogues import scored

    rows = scored(spark, "/root/testdata/sf0.001")
    one = {r.model: r for r in evaluate.bundle(rows, ["model"]).collect()}
    auc = {r.model: r.auc for r in evaluate.auc(rows, ["model"]).collect()}
    ece = {r.model: r.ece for r in evaluate.ece(rows, ["model"]).collect()}
    for m, r in one.items():
        assert r.auc == pytest.approx(auc[m]) and r.ece == pytest.approx(ece[m])
