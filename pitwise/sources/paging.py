"""Cursor-paged records as a Python data source, batch and stream.

Pages are JSON-lines files ``page-<cursor>.jsonl`` in a folder that all executors see
(a service's recorded answers; any file system that pyarrow opens); the first line of
a page names the next one, or none. The driver follows first lines only, so cycles
show before anything is read; every page is a partition, and its rows leave as they
are read. A stream goes on with the pages that appear: the newest one names a cursor
whose page is not there yet.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Page(InputPartition):
    def __init__(self, cursor: str):
        self.cursor = cursor


class Pages:
    """A folder of pages: which follow a cursor, and what one holds."""

    def __init__(self, folder: str, key: str):
        self.folder, self.key = folder, key

    def _open(self, cursor: str):
        system, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        return system.open_input_stream(f"{path.rstrip('/')}/page-{cursor}.jsonl")

    @staticmethod
    def _lines(stream):
        rest = b""
        while block := stream.read(1 << 16):
            *lines, rest = (rest + block).split(b"\n")
            yield from lines
        yield rest

    def after(self, cursor: str | None, seen: set[str]) -> tuple[list[str], str | None]:
        """Cursors from ``cursor`` on, and the one that is named but not there yet; a cursor that comes again is an error."""
        found = []
        while cursor is not None:
            if cursor in seen:
                raise ValueError(f"the pages run in a circle at {cursor}")
            try:
                with self._open(cursor) as f:
                    following = json.loads(next(self._lines(f))).get("next")
            except FileNotFoundError:
                return found, cursor
            seen.add(cursor)
            found.append(cursor)
            cursor = following
        return found, None

    def read(self, partition: Page):
        with self._open(partition.cursor) as f:
            lines = self._lines(f)
            next(lines)
            for line in lines:
                if line.strip():
                    text = line.decode().strip()
                    yield str(json.loads(text)[self.key]), text, partition.cursor


class PagedReader(Pages, DataSourceReader):
    def partitions(self):
        found, missing = self.after("0", set())
        if missing == "0":
            raise ValueError(f"there is no first page in {self.folder}")
        return [Page(c) for c in found]


class PagedStream(Pages, DataSourceStreamReader):
    """An offset is the number of pages before it, with the cursor that comes next; after a failure the same pages are read again."""

    def initialOffset(self):
        return {"pages": 0, "next": "0"}

    def latestOffset(self):
        found, missing = self.after("0", set())
        return {"pages": len(found), "next": missing}

    def partitions(self, start: dict, end: dict):
        return [Page(c) for c in self.after("0", set())[0][start["pages"] : end["pages"]]]

    def commit(self, end: dict):
        pass


class PagedSource(DataSource):
    """Options: ``folder``, ``key``. Rows: key, the record as JSON text, and its page."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "key string, record string, page string"

    def reader(self, schema):
        return PagedReader(self.options["folder"], self.options["key"])

    def streamReader(self, schema):
        return PagedStream(self.options["folder"], self.options["key"])


def records(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """One row for each key of all pages (key, record, copies); a record that came again changed fails the read."""
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").option("folder", folder).option("key", key).load()
    g = rows.groupBy("key").agg(F.min("record").alias("record"), F.max("record").alias("_other"), F.count("*").alias("copies"))
    changed = F.raise_error(F.concat(F.lit("record "), F.col("key"), F.lit(" came again changed"))).cast("string")
    return g.select("key", F.when(F.col("record") == F.col("_other"), F.col("record")).otherwise(changed).alias("record"), "copies")
