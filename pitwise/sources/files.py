"""File sources: text-typed CSV with optional presence, unions with provenance, discovered JSON, workbooks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StringType, StructType


def csv_optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV with a header and the schema given; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).csv(path, header=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def csv_text(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """All columns as strings, names in lower case with underscores, control columns dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    return df.drop(*drop)


def union_files(spark: SparkSession, paths: dict[str, str], order: list[str]) -> DataFrame:
    """CSV files of different columns under one another, with ``data_source``; missing columns are null."""
    out = None
    for name, path in paths.items():
        df = spark.read.csv(path, header=True, inferSchema=False).withColumn("data_source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.orderBy(*order)


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast where the text fits, null where it does not."""
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def discovered_json(spark: SparkSession, root: str, pattern: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Metrics from JSON files anywhere below ``root``: for each name the first of its keys that is there."""
    keys = sorted({k for ks in aliases.values() for k in ks})
    schema = StructType([StructField(k, StringType()) for k in keys])
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("multiLine", "true").json(root)
    return df.select(F.input_file_name().alias("file"), *[F.coalesce(*ks).try_cast("double").alias(n) for n, ks in aliases.items()])


def workbooks(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Sheets of workbooks, one task a file: there is no built-in reader, and the library for it may be absent."""
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def read(batches):
        import pandas as pd

        for batch in batches:
            for path in batch["path"]:
                yield pd.read_excel(path)[names]

    return files.mapInPandas(read, schema)
