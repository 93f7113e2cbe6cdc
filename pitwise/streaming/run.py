"""Runs a streaming plan over what its source holds now and reads its result back as a batch table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder for state and results, under the shared folder the session names; a temporary one only where one process does all the work."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        base = "file://" + tempfile.mkdtemp(prefix="pitwise-stream-")
    return f"{base.rstrip('/')}/stream/{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, with the schema of its files."""
    path = f"{sf_dir}/{name}.parquet"
    # as a pattern the path may name a file as well as a folder of files
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input, then stop. Append results go to a file sink; complete ones replace the table each batch."""
    spark, at = stream.sparkSession, work_dir(stream.sparkSession)
    out, schema = f"{at}/out", stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(schema).parquet(out)
