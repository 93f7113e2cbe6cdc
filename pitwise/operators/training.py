"""Model selection: a grid of configurations, early stopping, and the held-out curve that the choice follows.

Rows carry a column that says ``train`` or ``validation``. Every configuration
is fitted on the first and judged by its log loss on the second; what is left
over (a later test period) is never looked at. All fitting and scoring is
Spark ML's; the driver holds one number for each configuration and round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.operators import evaluate
from pitwise.operators.models import score

#: For each family, its configurations by name. ``rounds`` is the most that may be fitted: boosted trees, or blocks of
#: ``iterations`` passes of a network. A forest has no rounds.
GRIDS: dict[str, dict[str, dict]] = {
    "gbt": {
        "depth6": {"rounds": 200, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8},
        "depth8": {"rounds": 150, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.8},
        "depth5": {"rounds": 250, "maxDepth": 5, "stepSize": 0.03, "subsamplingRate": 0.9, "minInstancesPerNode": 2},
    },
    "forest": {
        "depth10": {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 5},
        "depth15": {"numTrees": 150, "maxDepth": 15, "minInstancesPerNode": 5},
    },
    "network": {
        "four_layers": {"rounds": 20, "iterations": 10, "hidden": (128, 64, 32, 16)},
        "two_layers": {"rounds": 20, "iterations": 10, "hidden": (32, 16)},
    },
}

#: Configurations that are fitted at once: a fit is many short jobs, which leave most cores idle between them.
AT_ONCE = 2


@dataclass
class Curve:
    """Held-out log loss of one configuration after each round, until ``patience`` rounds brought nothing lower."""

    patience: int
    losses: list[float] = field(default_factory=list)

    def add(self, loss: float) -> bool:
        """Take the next round's loss; false if the rounds end with it."""
        self.losses.append(loss)
        return len(self.losses) - self.best < self.patience

    @property
    def best(self) -> int:
        """The round of the least loss, the first of equal ones, counted from one."""
        return self.losses.index(min(self.losses)) + 1


@dataclass
class Choice:
    """The chosen configuration, its number of rounds, the fitted model, and all curves."""

    family: str
    config: str
    rounds: int
    model: PipelineModel
    curves: dict[str, Curve]

    def rows(self, spark: SparkSession) -> DataFrame:
        """family, config, round, log_loss, kept (the round its configuration would stop at), chosen."""
        found = [
            (self.family, config, i, loss, i == curve.best, config == self.config and i == self.rounds)
            for config, curve in self.curves.items()
            for i, loss in enumerate(curve.losses, 1)
        ]
        return spark.createDataFrame(found, "family string, config string, round int, log_loss double, kept boolean, chosen boolean")


def _loss(model, rows: DataFrame) -> float:
    return score(model, rows, ["y"]).agg(evaluate.log_loss("y", "p")).first()[0]


def _boosted(train: DataFrame, held: DataFrame, config: dict, patience: int, seed: int):
    """All rounds are grown once and judged in one pass; the model kept is grown anew up to its best round, tree for tree the same."""
    settings = {k: v for k, v in config.items() if k != "rounds"} | {"seed": seed, "featuresCol": "features", "labelCol": "y"}
    whole, curve = GBTClassifier(maxIter=config["rounds"], **settings).fit(train), Curve(patience)
    for loss in whole.evaluateEachIteration(held):
        if not curve.add(loss / 2):  # the library's loss is twice the log loss
            break
    kept = lambda: whole if curve.best == config["rounds"] else GBTClassifier(maxIter=curve.best, **settings).fit(train)
    return curve, kept


def _forest(train: DataFrame, held: DataFrame, config: dict, patience: int, seed: int):
    model, curve = RandomForestClassifier(seed=seed, featuresCol="features", labelCol="y", **config).fit(train), Curve(patience)
    curve.add(_loss(model, held))
    return curve, lambda: model


def _network_rounds(train: DataFrame, config: dict, seed: int) -> Iterator:
    """A network after each block of iterations, every block going on from the weights of the one before."""
    width = train.select("features").first()[0].size
    settings = {"layers": [width, *config["hidden"], 2], "maxIter": config["iterations"], "seed": seed, "featuresCol": "features", "labelCol": "y"}
    model = None
    for _ in range(config["rounds"]):
        start = {} if model is None else {"initialWeights": model.weights}
        model = MultilayerPerceptronClassifier(**settings, **start).fit(train)
        yield model


def _network(train: DataFrame, held: DataFrame, config: dict, patience: int, seed: int):
    curve, best = Curve(patience), None
    for model in _network_rounds(train, config, seed):
        more = curve.add(_loss(model, held))
        best = model if curve.best == len(curve.losses) else best
        if not more:
            break
    return curve, lambda: best


_FAMILIES = {"gbt": _boosted, "forest": _forest, "network": _network}


def select(df: DataFrame, features: list[str], family: str, grid: dict[str, dict] | None = None, part: str = "part", patience: int = 5, seed: int = 1) -> Choice:
    """Fit every configuration on the ``train`` rows and keep that of the least log loss on the ``validation`` rows.

    Scaling is fitted on the ``train`` rows too. Rows without a label ``y`` and rows with a null feature have no part
    in it; equal losses go to the first configuration. Without ``train`` or ``validation`` rows it raises ValueError.
    """
    known = df.where("y is not null").dropna(subset=features).select(*features, F.col("y").cast("double").alias("y"), F.col(part).alias("part"))
    prepare = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)])
    train, held = known.where("part = 'train'"), known.where("part = 'validation'")
    if train.isEmpty() or held.isEmpty():
        raise ValueError("a choice needs train and validation rows")
    scaling = prepare.fit(train)
    train, held = (scaling.transform(x).select("features", "y").persist() for x in (train, held))
    try:
        configs = grid or GRIDS[family]
        with ThreadPool(min(AT_ONCE, len(configs))) as pool:
            fit = inheritable_thread_target(df.sparkSession)(lambda config: _FAMILIES[family](train, held, config, patience, seed))
            found = dict(zip(configs, pool.map(fit, configs.values(), chunksize=1)))
        name = min(found, key=lambda n: min(found[n][0].losses))
        curve, kept = found[name]
        return Choice(family, name, curve.best, PipelineModel([*scaling.stages, kept()]), {n: c for n, (c, _) in found.items()})
    finally:
        train.unpersist()
        held.unpersist()
