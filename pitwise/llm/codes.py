"""Vector codes: every part of a vector becomes the number of its nearest codebook entry.

Vectors are scaled and floored to integers and cut into equal parts; each part
position has a codebook of its own, which starts as that part of the vectors with
the smallest ids. In a round a kd-tree of each codebook is broadcast (``parts``
times ``entries`` points, whatever the table holds), every part is assigned by
branch and bound, and integer sums and counts of each entry's parts, a row for
each task and entry, give the entries of the next round. A node whose bound equals
the best distance so far is visited too, so of equally near entries the first wins.
All of it is in integers: results do not depend on the order or place of rows.

A row counts if its vector is not null and holds finite components only. Vectors
of other lengths than the longest are filled up with zeros, to a multiple of
``parts``. Repeated rows are rows; of several vectors of one id the smallest starts
a codebook. Null ids come last among the starts and keep their rows; null labels
are one label. Fewer vectors than ``entries`` give smaller codebooks, an empty table
no rows. Components so large that squared distances leave 64 bits raise an error.
Only the three named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of a leaf of the kd-tree.
LEAF = 4
#: Copies of a label's sum, so that rows of a frequent label join in several tasks.
SALTS = 16
_FAR = np.iinfo(np.int64).max


class Node(NamedTuple):
    """A box of codebook entries: a leaf lists them, in ascending order; else ``left`` and ``right`` have them."""

    low: np.ndarray
    high: np.ndarray
    entries: list[int]
    left: Node | None
    right: Node | None


def tree_of(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook, cut at the median of the widest side."""
    entries = np.arange(len(book)) if entries is None else entries
    points = book[entries]
    low, high = points.min(axis=0), points.max(axis=0)
    if len(entries) <= LEAF:
        return Node(low, high, sorted(entries.tolist()), None, None)
    order = np.argsort(points[:, (high - low).argmax()], kind="stable")
    half = len(entries) // 2
    return Node(low, high, [], tree_of(book, entries[order[:half]]), tree_of(book, entries[order[half:]]))


def nearest(tree: Node, book: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry for each row of ``parts`` and the squared distance; of equally near ones the first."""
    best, found = np.full(len(parts), _FAR), np.full(len(parts), len(book))

    def bound(node: Node, x: np.ndarray) -> np.ndarray:
        return (np.maximum(np.maximum(node.low - x, x - node.high), 0) ** 2).sum(axis=1)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        x = parts[rows]
        for e in node.entries:
            d = ((x - book[e]) ** 2).sum(axis=1)
            better = (d < best[rows]) | ((d == best[rows]) & (e < found[rows]))
            best[rows[better]], found[rows[better]] = d[better], e
        if node.left is None or node.right is None:
            return
        to_left, to_right = bound(node.left, x), bound(node.right, x)
        near = to_left <= to_right
        visit(node.left, rows[near])
        visit(node.right, rows[~near])
        visit(node.right, rows[near & (to_right <= best[rows])])
        visit(node.left, rows[~near & (to_left <= best[rows])])

    visit(tree, np.arange(len(parts)))
    return found, best


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there, whole and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col(vector).isNotNull() & ~F.exists(vector, bad))


def _cut(column: pa.ListArray, width: int, parts: int, scale: float) -> np.ndarray:
    """The integer components of a batch: vectors by parts by ``width``."""
    n, flat = len(column), np.floor(np.asarray(column.flatten(), np.float64) * scale)
    if len(flat) and np.abs(flat).max() > (1 << 30) // max(1, width):
        raise ValueError("components are too large: their squared distances leave 64 bits")
    size = np.diff(np.asarray(column.offsets))
    out = np.zeros((n, parts * width), np.int64)
    out[np.arange(parts * width) < size[:, None]] = flat
    return out.reshape(n, parts, width)


class Codebooks(NamedTuple):
    """Final entries: an array of entries by width for each part, and how vectors are made integers."""

    books: np.ndarray
    scale: float

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position within the part."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _start(kept: DataFrame, id: str, vector: str, parts: int, entries: int, scale: float) -> Codebooks:
    """That part of the vectors with the smallest ids; a task keeps ``entries`` of them before anything is shuffled."""
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = max(1, -(-longest // parts))
    schema = T.StructType([kept.schema[id], kept.schema[vector]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1)
            for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)):
                if ids[i] not in held and len(held) >= entries and (ids[i] is None or (None not in held and ids[i] > max(held))):
                    break
                row = rows[i].as_py()
                held[ids[i]] = min(held.get(ids[i], row), row)
                if len(held) > entries:
                    del held[None if None in held else max(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), batch.schema.field(0).type), pa.array(list(held.values()), batch.schema.field(1).type)], [id, vector])

    few = kept.select(id, vector).mapInArrow(run, schema).groupBy(id).agg(F.min(vector).alias(vector))
    rows = few.orderBy(F.col(id).asc_nulls_last()).limit(entries).collect()
    books = _cut(pa.array([r[vector] for r in rows], pa.list_(pa.float64())), width, parts, scale)
    return Codebooks(np.ascontiguousarray(books.transpose(1, 0, 2)), scale)


def _assigned(batch: pa.RecordBatch, column: int, code: Codebooks, trees: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components, entry numbers and squared distances of a batch, each by vector and part."""
    parts, _, width = code.books.shape
    x = _cut(batch.column(column), width, parts, code.scale)
    found, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p in range(parts):
        found[:, p], far[:, p] = nearest(trees[p], code.books[p], x[:, p])
    return x, found, far


def _round(kept: DataFrame, vector: str, code: Codebooks) -> Codebooks:
    """Assign every part, and move every used entry to the floored mean of its parts."""
    shared = kept.sparkSession.sparkContext.broadcast((code, [tree_of(b) for b in code.books]))
    parts, entries, width = code.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, trees = shared.value
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, found, _ = _assigned(batch, 0, code, trees)
            for p in range(parts):
                np.add.at(sums[p], found[:, p], x[:, p])
                counts[p] += np.bincount(found[:, p], minlength=entries)
        used = np.nonzero(counts)
        columns = [used[0].astype(np.int32), used[1].astype(np.int32), counts[used], *sums[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    schema = "part int, entry int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width))
    sums = kept.select(vector).mapInArrow(run, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(width)])])
    books = code.books.copy()
    for r in sums.collect():  # a row for each entry
        books[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    shared.unpersist()
    return Codebooks(books, code.scale)


def trained(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all usable vectors."""
    kept = usable(vectors, vector)
    code = _start(kept, id, vector, parts, entries, scale)
    for _ in range(rounds if code.books.shape[1] else 0):
        code = _round(kept, vector, code)
    return code


def encoded(vectors: DataFrame, code: Codebooks, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The id and label of every usable vector, its entry numbers (two hex digits a part) and its squared error."""
    shared = vectors.sparkSession.sparkContext.broadcast((code, [tree_of(b) for b in code.books] if code.books.shape[1] else []))
    schema = T.StructType([vectors.schema[id], vectors.schema[label], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, trees = shared.value
        for batch in batches:
            _, found, far = _assigned(batch, 2, code, trees)
            digits = found.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes().hex() for row in digits], pa.string()), pa.array(far.sum(axis=1), pa.int64())], [id, label, "code", "error"])

    return usable(vectors, vector).select(id, label, vector).mapInArrow(run, schema)


def decoded(codes: DataFrame, code: Codebooks, id: str = "vec_id") -> DataFrame:
    """The id of every row of ``codes``, and ``components``: the entries that its code names, as scaled integers."""
    shared = codes.sparkSession.sparkContext.broadcast(code.books)
    schema = T.StructType([codes.schema[id], T.StructField("components", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            found = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(batch.num_rows, len(books))
            vectors = books[np.arange(len(books)), found].reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.int64()))], [id, "components"])

    return codes.select(id, "code").mapInArrow(run, schema)


def compressed(vectors: DataFrame) -> DataFrame:
    """Codes and errors of every usable vector, the error of its label, and the digest of the codebooks."""
    code = trained(vectors)
    rows = encoded(vectors, code)
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    # a label's sum in several copies: rows of a frequent label meet it in several tasks
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    rows = rows.join(sums, F.col("label").eqNullSafe(F.col("of")) & (rows.salt == sums.salt))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(code.digest()).alias("codebooks_sha256"))
