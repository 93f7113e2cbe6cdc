"""Scheduled micro-batch runs that may be killed at any moment and repeated.

A run drains its source. Each batch replaces the folder of its own number, so a batch
that is repeated after a crash gives the same rows once; which batches were committed
is the stream's own checkpoint. The run log is append-only: a run is what its latest
terminal row says, or running while it has none. An interrupted run is closed once,
by the next run of its kind; runs with an end are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, kind string, status string, at timestamp, note string"
#: How a run may end.
TERMINAL = ("success", "failed", "cancelled")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def log(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the run log."""
    return spark.read.schema(LOG).parquet(f"{root}/runs") if _exists(spark, f"{root}/runs") else spark.createDataFrame([], LOG)


def record(spark: SparkSession, root: str, run_id: str, kind: str, status: str, at: str, note: str = "") -> None:
    rows = spark.createDataFrame([(run_id, kind, status, at, note)], "run_id string, kind string, status string, at string, note string")
    rows.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{root}/runs")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """One row for each run: kind, status, start and end. The first terminal row holds."""
    rows = log(spark, root)
    ended = F.col("status").isin(*TERMINAL)
    g = rows.groupBy("run_id").agg(F.first("kind").alias("kind"), F.min("at").alias("started"), F.min_by(F.struct("status", "at", "note"), F.when(ended, F.struct("at", "status"))).alias("end"))
    return g.select("run_id", "kind", F.coalesce("end.status", F.lit("running")).alias("status"), "started", F.col("end.at").alias("ended"), F.col("end.note").alias("note"))


def close_interrupted(spark: SparkSession, root: str, kind: str, at: str, status: str = "cancelled", note: str = "interrupted") -> str | None:
    """End the newest run of a kind if it is still running; its id, or None."""
    last = runs(spark, root).where(F.col("kind") == kind).orderBy(F.desc("started"), F.desc("run_id")).first()
    if last is None or last["status"] != "running":
        return None
    record(spark, root, last["run_id"], kind, status, at, note)
    return last["run_id"]


def due(spark: SparkSession, root: str, kind: str, at: str, minutes: int = 90) -> bool:
    """Whether a recovery run is wanted: no run is active, and the latest success is older than ``minutes``, or there is none."""
    now = F.lit(at).cast("timestamp")
    g = runs(spark, root).where(F.col("kind") == kind).agg(F.count_if(F.col("status") == "running").alias("active"), F.max(F.when(F.col("status") == "success", F.col("ended"))).alias("last"))
    return g.select((F.col("active") == 0) & F.coalesce(F.col("last") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), F.lit(True))).first()[0]


def run(stream: DataFrame, root: str, kind: str, run_id: str, at: str, after_batch: Callable[[int], None] | None = None) -> str | None:
    """Drain ``stream`` into ``root/data``, one folder a batch, and log the run; the id of an interrupted run that it closed.

    ``after_batch`` is called when a batch's rows are written and before the batch is committed.
    """
    spark = stream.sparkSession
    closed = close_interrupted(spark, root, kind, at)
    record(spark, root, run_id, kind, "running", at)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/data/batch={number}")
        if after_batch is not None:
            after_batch(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state/{kind}").trigger(availableNow=True).start()
    query.awaitTermination()
    record(spark, root, run_id, kind, "success", at)
    return closed


def data(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What all runs have written, with the batch that it came in."""
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{root}/data").parquet(f"{root}/data")
