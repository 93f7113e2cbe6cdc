"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words everywhere in this subpackage.
SPACES = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, as the session names it; a temporary one only where one process does all the work."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
    shared_dir.local = getattr(shared_dir, "local", None) or "file://" + tempfile.mkdtemp(prefix="pitwise-")
    return shared_dir.local


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, which outlives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: like :func:`cut`, but columnar and compressed."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/pitwise/{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` table once all that was made of it is itself cut."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame) -> None:
    """Let Spark delete the shuffle and checkpoint files of plans that nothing holds any more; it does so as the driver collects garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def by_key(batches: Iterator[pa.RecordBatch], keys: int, least: int, done: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Hand rows that are sorted by the first ``keys`` columns to ``done``: at least ``least`` at once, and a key's rows together."""
    held: list[list[np.ndarray]] = []
    waiting = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        waiting += batch.num_rows
        if waiting < least or all(held[0][k][0] == held[-1][k][-1] for k in range(keys)):
            continue
        rows = [np.concatenate(x) for x in zip(*held)]
        last = np.logical_and.reduce([rows[k] == rows[k][-1] for k in range(keys)])
        keep = int(np.flatnonzero(~last)[-1]) + 1
        held, waiting = [[c[keep:] for c in rows]], len(rows[0]) - keep
        yield from done([c[:keep] for c in rows])
    if held:
        yield from done([np.concatenate(x) for x in zip(*held)])


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` split points of a numeric column; only that column is read."""
    if buckets < 2:
        return []
    cuts = df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    return sorted({int(c) for c in cuts})


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds below ``value``, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps, step = [], 1
    while step <= len(bounds):
        steps.insert(0, step)
        step *= 2
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) < value), at + s).otherwise(at),
    )


def slots(spark: SparkSession) -> int:
    """Partitions to spread work over: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
