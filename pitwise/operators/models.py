"""Models on Spark ML: scaling, forests, boosted trees, a small network, calibration, and scoring under a feature contract."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classifier(kind: str, n_features: int):
    common = {"featuresCol": "features", "labelCol": "y"}
    if kind == "gbt":
        return GBTClassifier(maxIter=10, maxDepth=4, seed=1, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=20, maxDepth=5, seed=1, **common)
    if kind == "network":
        return MultilayerPerceptronClassifier(layers=[n_features, 16, 8, 2], maxIter=30, seed=1, **common)
    return LogisticRegression(regParam=0.01, **common)


def fit(df: DataFrame, features: list[str], kind: str = "logistic") -> PipelineModel:
    """Assemble, scale and fit on the rows given (label ``y``)."""
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), classifier(kind, len(features))]
    return Pipeline(stages=stages).fit(df)


def score(model: PipelineModel, df: DataFrame, keep: list[str], name: str = "p") -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(name))


def calibrate(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Isotonic calibration of ``p`` on the rows given, as ``calibrated``."""
    rows = df.withColumn("_x", F.col(p)).withColumn("_y", F.col(y).cast("double"))
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="calibrated").fit(rows)
    return model.transform(rows).drop("_x", "_y")


def scaled(df: DataFrame, columns: list[str]) -> list[Column]:
    """Each column less its mean over its sample deviation, from one aggregated row."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return [F.try_divide(F.col(c) - stats[f"m_{c}"], F.lit(stats[f"s_{c}"])).alias(c) for c in columns]


def contract_issues(df: DataFrame, features: list[str]) -> list[str]:
    """What keeps a table from being scored: missing, unexpected or non-numeric features."""
    kinds = dict(df.dtypes)
    return [f"missing:{f}" for f in features if f not in kinds] + [f"type:{f}" for f in features if f in kinds and kinds[f] not in ("double", "float", "int", "bigint")]


STATES = ("candidate", "shadow", "active", "retired")


def registry_issues(registry: DataFrame) -> DataFrame:
    """model and issue of every registry row that breaks the contract. Rows: model, family, features, declared, sha256, state.

    Features are listed once each, as many as declared, and hash (joined by lines)
    to ``sha256``; the state is a known one; a family has one active model at most.
    """
    features = F.coalesce("features", F.array().cast("array<string>"))
    active = registry.where("state = 'active'").groupBy("family").agg(F.count(F.lit(1)).alias("_active"))
    rows = registry.join(active, "family", "left")
    checks = {
        "empty": F.size(features) == 0,
        "repeated": F.size(F.array_distinct(features)) < F.size(features),
        "count": ~F.size(features).eqNullSafe(F.col("declared").cast("int")),
        "hash": ~F.sha2(F.array_join(features, "\n"), 256).eqNullSafe(F.col("sha256")),
        "state": ~F.coalesce(F.col("state").isin(*STATES), F.lit(False)),
        "active": (F.col("state") == "active") & (F.col("_active") > 1),
    }
    issues = F.filter(F.array(*[F.when(c, name) for name, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select("model", F.explode(issues).alias("issue"))
