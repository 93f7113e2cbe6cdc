"""Sinks: snapshots with a manifest, append of absent rows, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.operators.dedup import latest


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, sync_id: str) -> DataFrame:
    """Write each table as ``root/<sync_id>/<name>``, then one manifest row for each; readers take the newest manifest's paths."""
    rows = []
    for name, df in tables.items():
        path = f"{root}/{sync_id}/{name}"
        df.write.mode("errorifexists").parquet(path)
        rows.append((sync_id, name, path, spark.read.parquet(path).count()))
    manifest = spark.createDataFrame(rows, "sync_id string, name string, path string, n bigint").withColumn("at", F.current_timestamp())
    manifest.write.mode("append").parquet(f"{root}/manifest")
    return manifest


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table under the newest manifest."""
    last = latest(spark.read.parquet(f"{root}/manifest").where(F.col("name") == name), ["name"], ["at", "sync_id"]).first()
    return spark.read.parquet(last["path"])


def append_absent(rows: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key the table at ``path`` lacks, one for each key; how many there were."""
    spark, fresh = rows.sparkSession, rows.dropDuplicates(key)
    try:
        fresh = fresh.join(spark.read.parquet(path).select(*key).distinct(), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh = fresh.persist()
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as one file of CSV or JSON lines."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """The first ``most`` rows as a Markdown table."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
