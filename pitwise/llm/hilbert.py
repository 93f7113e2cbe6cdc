"""Shards cut from a Hilbert curve through several metadata dimensions.

Source, language, text size and doc_id are quantised to a few bits each; a
row's place on the Hilbert curve through that grid keeps neighbours in every
dimension together, so shards cut as runs of the order have narrow ranges in
all of them and a reader's filters on any of them skip whole files. Runs are
cut by rank: shard sizes in rows differ by one at most (law ``rows``).

Ranks come from a range partitioning, a count for each partition and a row
number inside it; no order passes through one task. Ties on the curve go by
doc_id, then the text's checksum: a grid cell may hold any share of the rows.
Null texts have no bytes, null dimensions are the lowest value, repeated rows
each get a slot, an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.common import bucket_of, cut, range_bounds


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) of ``bits`` bits in each dimension (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def _ranked_names(rows: DataFrame, name: str, cells: int) -> DataFrame:
    """Each name's rank by code point, scaled to the grid: one row a name."""
    names = rows.where(F.col(name).isNotNull()).select(name).distinct()
    share = F.row_number().over(Window.orderBy(name)) * cells / (F.count("*").over(Window.partitionBy()) + 1)
    return names.select(name, F.floor(share).cast("int").alias(f"{name}_cell"))


def curve_places(rows: DataFrame, bits: int = 6) -> DataFrame:
    """``rows`` (doc_id, source, lang, size and more, to be kept small) with their place on the curve."""
    cells = 1 << bits
    ids, sizes = range_bounds(rows, "doc_id", cells), range_bounds(rows, "size", cells)
    grid = rows
    for name in ("source", "lang"):
        grid = grid.join(_ranked_names(rows, name, cells), name, "left")
    cell = ("source_cell", "lang_cell", "size_cell", "id_cell")
    grid = grid.select(*rows.columns, F.coalesce("source_cell", F.lit(0)).alias("source_cell"), F.coalesce("lang_cell", F.lit(0)).alias("lang_cell"), bucket_of(F.col("size"), sizes).alias("size_cell"), bucket_of(F.col("doc_id"), ids).alias("id_cell"))

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["place"] = hilbert_index(part[list(cell)].to_numpy(), bits) if len(part) else np.empty(0, np.int64)
            yield part.drop(columns=list(cell))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return grid.mapInPandas(placed, f"{kinds}, place bigint")


def _measured(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), "source", "lang", (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(body.cast("binary")).cast("bigint").alias("text_crc32"))


#: What tells rows apart.
_KNOWN = ("doc_id", "source", "lang", "size", "text_crc32")


def _ranked(docs: DataFrame, shards: int, bits: int) -> DataFrame:
    """What a row is known by, its place on the curve, rank, shard, and the number of all rows."""
    curve = curve_places(cut(_measured(docs)), bits)
    order = ("place", "doc_id", "text_crc32", "size", "source", "lang")
    runs = cut(curve.repartitionByRange(*order).withColumn("run", F.spark_partition_id()))
    counts = runs.groupBy("run").agg(F.count("*").alias("n"))
    # one row for each partition of the range
    before = counts.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    numbered = runs.withColumn("at", F.row_number().over(Window.partitionBy("run").orderBy(*order)) - 1).join(F.broadcast(before), "run")
    rank = numbered.select(*_KNOWN, "place", (F.col("before") + F.col("at")).alias("rank"), "total")
    return rank.withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)"))


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, place on the curve, rank, shard and gapless slot of every row."""
    first = F.expr("(shard * total + {0} - 1) div {0}".format(shards))
    return _ranked(docs, shards, bits).withColumn("slot", F.col("rank") - first).select("doc_id", "size", "text_crc32", "place", "rank", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, bits: int = 6) -> tuple[str, str]:
    """Write whole documents by the shards that :func:`hilbert_shards` gives them, a folder and one file each; the names of the columns for shard and size.

    Readers skip files by the ranges of source, lang, size and doc_id. The two columns get underscores in front where
    documents have a column of their name. Null texts have no bytes, null dimensions are the lowest value. Rows that are
    equal in all that they are known by share a run of ranks, which is dealt among them where it spans shards. An empty
    table writes no shard.
    """
    def unused(name: str) -> str:
        return name if name.lower() not in {c.lower() for c in docs.columns} else unused(f"_{name}")

    shard, size = unused("shard"), unused("curve_size")
    ranked = cut(_ranked(docs, shards, bits))
    groups = ranked.groupBy(*_KNOWN).agg(F.min("rank").alias("rank"), F.min("shard").alias("low"), F.max("shard").alias("high"), F.first("total").alias("total"), F.first("place").alias("place"))
    groups = groups.withColumnsRenamed({c: f"_{c}" for c in _KNOWN})
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(body.cast("binary")).cast("bigint").alias("text_crc32"))
    same = (rows.text_crc32 == F.col("_text_crc32")) & (rows["size"] == F.col("_size"))
    for c in ("doc_id", "source", "lang"):
        same = same & rows[c].eqNullSafe(F.col(f"_{c}"))
    met = rows.join(groups, same)
    whole = met.where("low = high").select("doc", "size", "place", "doc_id", F.col("low").alias("shard"))
    # only equal rows on both sides of a cut are numbered
    at = F.row_number().over(Window.partitionBy(*_KNOWN).orderBy("place")) - 1
    split = met.where("low < high").withColumn("at", at).select("doc", "size", "place", "doc_id", F.expr(f"cast((rank + at) * {shards} div total as int)").alias("shard"))
    ordered = whole.unionByName(split).repartition(shards, "shard").sortWithinPartitions("shard", "place", "doc_id")
    ordered.select("doc.*", F.col("size").alias(size), F.col("shard").alias(shard)).write.partitionBy(shard).parquet(path)
    return shard, size
