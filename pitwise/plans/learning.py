"""Queries that fit and score models (family M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import evaluate as ev
from pitwise.operators import models as md
from pitwise.operators import training
from pitwise.plans.analogues import LOG, prediction_log
from pitwise.plans.point_in_time import r6

FEATURES = ["p_nn", "p_xgb", "p_market", "odds1", "odds2"]

#: Smaller than the operator's own grids, so that the queries end soon.
GRIDS = {
    "gbt": {"depth4": {"rounds": 12, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8}, "depth2": {"rounds": 12, "maxDepth": 2, "stepSize": 0.2}},
    "forest": {"depth5": {"numTrees": 20, "maxDepth": 5}, "depth8": {"numTrees": 12, "maxDepth": 8, "minInstancesPerNode": 5}},
    "network": {"two_layers": {"rounds": 6, "iterations": 8, "hidden": (16, 8)}, "one_layer": {"rounds": 6, "iterations": 8, "hidden": (8,)}},
}


def rows(spark, sf):
    return prediction_log(spark, sf).withColumn("y", F.col("y").cast("double"))


def m05(spark, sf):
    l = prediction_log(spark, sf)
    return l.select("uid", *md.scaled(l, ["odds1", "odds2"])).select("uid", r6(F.col("odds1")).alias("odds1"), r6(F.col("odds2")).alias("odds2"))


M05 = f"WITH {LOG}, s AS (SELECT avg(odds1) AS m1, stddev_samp(odds1) AS s1, avg(odds2) AS m2, stddev_samp(odds2) AS s2 FROM log) SELECT uid, round((odds1 - m1) / s1 + 1e-10, 6) AS odds1, round((odds2 - m2) / s2 + 1e-10, 6) AS odds2 FROM log, s"


def m06(spark, sf):
    return md.calibrate(rows(spark, sf).select("uid", "y", F.col("p_xgb").alias("p"))).select("uid", r6(F.col("calibrated")).alias("calibrated"))


def _parts(spark, sf):
    """The log by year: the last year before 2000 validates, the ones before it train."""
    return rows(spark, sf).withColumn("part", F.when(F.col("yr") < 1999, "train").when(F.col("yr") == 1999, "validation").otherwise("test"))


def _selected(family):
    """Scores of the later years by the configuration and the round that the validation year chose."""

    def run(spark, sf):
        parts = _parts(spark, sf)
        chosen = training.select(parts, FEATURES, family, GRIDS[family], patience=3)
        return md.score(chosen.model, parts.where("part = 'test'"), ["uid", "y"]).select("uid", r6(F.col("p")).alias("p"))

    return run


def m04(spark, sf):
    """Held-out log loss of every family, configuration and round until it stops, and which of them each family keeps."""
    parts = _parts(spark, sf)
    curves = [training.select(parts, FEATURES, family, grid, patience=3).rows(spark) for family, grid in GRIDS.items()]
    return curves[0].unionByName(curves[1]).unionByName(curves[2]).withColumn("log_loss", r6(F.col("log_loss")))


def _scored(kind):
    def run(spark, sf):
        all_rows = rows(spark, sf)
        model = md.fit(all_rows.where("yr < 2000"), FEATURES, kind)
        return md.score(model, all_rows.where("yr >= 2000"), ["uid", "y"]).select("uid", r6(F.col("p")).alias("p"))

    return run


def m09(spark, sf):
    all_rows = rows(spark, sf)
    model = md.fit(all_rows.where("yr < 2000"), FEATURES)
    out = md.score(model, all_rows.where("yr >= 2000"), ["uid", "y", "gold"])
    tiers = ev.cohorts(out, {"all": F.lit(True), "gold": F.col("gold")})
    return ev.metrics(tiers, ["tier"]).select("tier", "n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("log_loss")).alias("log_loss"))


QUERIES = {
    "m05_scaling": (m05, M05), "m06_isotonic": (m06, None), "m01_network": (_selected("network"), None), "m02_boosted": (_selected("gbt"), None), "m03_forest": (_selected("forest"), None), "m04_model_search": (m04, None), "m07_score": (_scored("logistic"), None), "m09_replay": (m09, None),
}
