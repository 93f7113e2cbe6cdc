"""Model selection on rows whose outcome follows a planted rule."""

import math

import pytest
from pyspark.sql import functions as F

from pitwise.operators import models, training

FEATURES = ["a", "b", "c"]
GRIDS = {
    "gbt": {"deep": {"rounds": 25, "maxDepth": 6, "stepSize": 0.5}, "even": {"rounds": 15, "maxDepth": 3, "stepSize": 0.2}},
    "forest": {"stump": {"numTrees": 5, "maxDepth": 1}, "tree": {"numTrees": 20, "maxDepth": 6}},
    "network": {"one": {"rounds": 5, "iterations": 5, "hidden": (6,)}, "two": {"rounds": 5, "iterations": 5, "hidden": (8, 4)}},
}


@pytest.fixture(scope="module")
def rows(spark):
    """The chance of ``y`` is logistic in 2a + 2b (c says nothing); a tenth validates and a tenth is for the test."""
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 5_000 - 1
    df = spark.range(6000).select("id", unit(1).alias("a"), unit(2).alias("b"), unit(3).alias("c"))
    chance = 1 / (1 + F.exp(-2 * F.col("a") - 2 * F.col("b")))
    part = F.when(F.col("id") % 10 == 8, "validation").when(F.col("id") % 10 == 9, "test").otherwise("train")
    return df.withColumn("chance", chance).withColumn("y", ((unit(4) + 1) / 2 < chance).cast("double")).withColumn("part", part).persist()


def loss(pairs):
    return sum(-math.log(max(p if y else 1 - p, 1e-9)) for p, y in pairs) / len(pairs)


@pytest.mark.parametrize("family", list(GRIDS))
def test_the_chosen_model_learns_the_planted_rule(spark, rows, family):
    chosen = training.select(rows, FEATURES, family, GRIDS[family], patience=3)
    by_config = {}
    for r in sorted(chosen.rows(spark).collect(), key=lambda r: r["round"]):
        by_config.setdefault(r["config"], []).append(r)
    assert set(by_config) == set(GRIDS[family])
    for curve in by_config.values():
        losses = [r["log_loss"] for r in curve]
        best = losses.index(min(losses))
        assert [r["round"] for r in curve] == list(range(1, len(curve) + 1)) and [r["kept"] for r in curve] == [i == best for i in range(len(curve))]
        assert len(curve) <= best + 1 + 3  # it ends three rounds after its best at the latest
    picked = [r for curve in by_config.values() for r in curve if r["chosen"]]
    least = min(r["log_loss"] for curve in by_config.values() for r in curve)
    assert [(r["config"], r["round"], r["log_loss"]) for r in picked] == [(chosen.config, chosen.rounds, least)]

    held = models.score(chosen.model, rows.where("part = 'validation'"), ["y"]).collect()
    assert loss([(r["p"], r["y"]) for r in held]) == pytest.approx(least, abs=1e-6)  # the model kept is that of the curve's point
    later = models.score(chosen.model, rows.where("part = 'test'"), ["y", "chance"]).collect()
    rate = rows.where("part = 'train'").agg(F.avg("y")).first()[0]
    known, mine = loss([(r["chance"], r["y"]) for r in later]), loss([(r["p"], r["y"]) for r in later])
    base = loss([(rate, r["y"]) for r in later])
    assert mine < base - 0.75 * (base - known)  # most of what can be known is learned


def test_deep_fast_trees_stop_early(spark, rows):
    chosen = training.select(rows, FEATURES, "gbt", {"deep": GRIDS["gbt"]["deep"]}, patience=2)
    assert chosen.rounds < 25 and len(chosen.curves["deep"].losses) == chosen.rounds + 2


def test_later_rows_and_unlabelled_ones_do_not_matter(spark, rows):
    grid = {"one": {"rounds": 3, "maxDepth": 3}}
    before = training.select(rows, FEATURES, "gbt", grid).curves["one"].losses
    other = rows.where("part = 'test'").withColumn("y", 1 - F.col("y"))
    blank = rows.limit(5).withColumn("y", F.lit(None).cast("double"))
    after = training.select(rows.where("part <> 'test'").unionByName(other).unionByName(blank), FEATURES, "gbt", grid).curves["one"].losses
    assert after == pytest.approx(before, abs=1e-9)


@pytest.mark.parametrize("losses, patience, best, seen", [([3, 2, 1], 2, 3, 3), ([3, 1, 2, 2, 0], 2, 2, 4), ([1, 1, 1], 2, 1, 3), ([5], 1, 1, 1)])
def test_curves_end_after_rounds_without_gain(losses, patience, best, seen):
    curve = training.Curve(patience)
    for x in losses:
        if not curve.add(x):
            break
    assert (curve.best, len(curve.losses)) == (best, seen)


def test_a_missing_part_is_an_error(spark, rows):
    with pytest.raises(ValueError):
        training.select(rows.where("part = 'train'"), FEATURES, "forest", GRIDS["forest"])


def test_configurations_are_fitted_at_once_and_keep_their_order(spark, rows, monkeypatch):
    """Each fit waits for another one; of equal losses the first configuration of the grid is kept."""
    import threading

    both = threading.Barrier(2)

    def fit(train, held, config, patience, seed):
        both.wait(30)
        curve = training.Curve(patience)
        curve.add(config["loss"])
        return curve, lambda: models.fit(rows, FEATURES).stages[-1]

    monkeypatch.setitem(training._FAMILIES, "waiting", fit)
    chosen = training.select(rows, FEATURES, "waiting", {"a": {"loss": 0.7}, "b": {"loss": 0.6}, "c": {"loss": 0.6}, "d": {"loss": 0.9}})
    assert chosen.config == "b" and list(chosen.curves) == ["a", "b", "c", "d"]
