"""The prefix trie of conversations, by most-significant-turn radix partitioning.

A turn (role and text) is replaced by an id from a dictionary of the distinct turns,
which is written once; a conversation is then an array of ids. Equal conversations
become one sequence with a count, the smallest conv_id and a digest of its conv_ids.

Sequences start in one bucket, the root. Each round counts the next turn of all
sequences of the open buckets (a partial aggregation, so a frequent turn costs a
task one row), which makes one bucket for each child. A bucket with more than
``LOCAL`` turns left stays open and its children are nodes; any other is finished by
one task, with a multikey quicksort that emits the nodes below. Rounds end when no
bucket is open: many sequences that start alike take a round for each common turn,
few never do. What a local bucket has in leaves and saved tokens is summed into the
nodes above it, each of which it knows by name: a node is known by its depth and
the smallest conv_id of its members.

A conversation is a row: its turn ids must fit into a task. Nothing else that may
grow is gathered: the conv_ids of equal conversations are joined in blocks of
``BLOCK`` ids and digested as a stream of such blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.common import discard, stored

#: Turn ids that one task finishes a bucket with.
LOCAL = 200_000
#: Ids joined into one string before the digest of equal conversations.
BLOCK = 4096
_NONE = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, heads: int = 6, every: int = 100) -> DataFrame:
    """conv_id, ids and lens (turn ids and code points, in order) of every conversation, rebuilt from a shared start.

    Conversation c takes the first h turns of conversation c - c % ``every``, h = crc32(c) % ``heads``, in place of
    its own first h. Turns go by number, nulls first; equal numbers by role, then text. Null roles and texts are empty;
    rows without conv_id are left out; a repeated row is a turn of its own; an empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        "conv_id", (F.col("conv_id") - F.pmod("conv_id", F.lit(every))).alias("base"), "turn", role.alias("role"),
        F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), text, role).alias("k2"), F.length(text).alias("len"), text.alias("text"))
    # each distinct turn gets its number in the job that writes the dictionary
    known = stored(rows.groupBy("k1", "k2").agg(F.first("len").alias("len")).select("k1", "k2", "len", F.monotonically_increasing_id().alias("id")))
    # equal numbers in one conversation are rare: only there the text itself decides
    tied = Window.partitionBy("conv_id", "turn")
    plain = rows.withColumn("text", F.when(F.count("*").over(tied) > 1, F.col("text"))).drop("len")
    coded = plain.join(known, ["k1", "k2"]).select("conv_id", "base", F.struct("turn", "role", "text", "id", "len").alias("x"))
    own = coded.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    own = own.withColumns({"ids": F.col("x.id"), "lens": F.col("x.len")}).drop("x")
    first = Window.partitionBy("base")  # at most ``every`` conversations
    head = lambda c: F.coalesce(F.max(F.when(F.col("conv_id") == F.col("base"), F.slice(c, 1, heads))).over(first), F.array().cast(f"array<{'bigint' if c == 'ids' else 'int'}>"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    own = own.withColumns({"h": h, "head_ids": head("ids"), "head_lens": head("lens")})
    whole = lambda c: F.concat(F.slice(f"head_{c}", F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1))))
    return own.select("conv_id", whole("ids").alias("ids"), whole("lens").alias("lens"))


def _sequences(conversations: DataFrame) -> DataFrame:
    """Distinct sequences: the smallest conv_id, how many there are, ids, lens and the digest of all conv_ids in order."""
    keyed = conversations.select("conv_id", F.floor(F.col("conv_id") / BLOCK).alias("block"), "ids", "lens", F.xxhash64("ids").alias("k1"), F.xxhash64(F.lit(1), "ids", "lens").alias("k2"))
    blocks = keyed.groupBy("k1", "k2", "block").agg(F.sort_array(F.collect_list("conv_id")).alias("members"), F.first(F.struct("ids", "lens")).alias("of"))
    blocks = blocks.select("k1", "k2", "block", F.col("members")[0].alias("conv"), F.size("members").cast("bigint").alias("n"), F.array_join(F.col("members").cast("array<string>"), ",").alias("names"), "of.ids", "of.lens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n", "ids", "lens", "ends"]
        held, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            ids, lens = batch.column(6), batch.column(7)
            for i, (a, b, conv, n, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)))):
                if held is not None and held[0] == (a, b):
                    digest.update(b"," + text.encode())
                    held[1][1] += n
                    continue
                if held is not None:
                    out.append((*held[1], digest.hexdigest()))
                held, digest = ((a, b), [conv, n, ids[i].as_py(), lens[i].as_py()]), hashlib.sha256(text.encode())
            if out:
                yield _batch(out, names)
        if held is not None:
            yield _batch([(*held[1], digest.hexdigest())], names)

    return blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").mapInArrow(run, "conv bigint, n bigint, ids array<bigint>, lens array<int>, ends string")


_TYPES = {"ids": pa.list_(pa.int64()), "lens": pa.list_(pa.int32()), "path": pa.list_(pa.int64()), "ends": pa.string(), "depth": pa.int32()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(name, pa.int64())) for name, c in zip(names, zip(*rows))], names)


_NODE = "conv bigint, depth int, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends string, path array<bigint>"
_NODE_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def finished(rows: list[tuple], depth: int) -> list[list]:
    """The nodes of one bucket: its top, at ``depth``, and all below it.

    ``rows`` are sequences (conv, n, ids, lens, ends) that agree on their first ``depth`` turns. A multikey quicksort:
    a part is split by its median turn into smaller, equal and larger; the equal part is a node, and is split by its
    next turn in the same way. Nodes are (conv, depth, parent, n_convs, n_children, n_leaves, saved, ends).
    """
    nodes: list[list] = []
    above: list[int] = []  # each node's place of its parent

    def node(part: list[int], at: int, parent: int) -> list[int]:
        """Emit the node of ``part``; what goes on below it."""
        members = sum(rows[i][1] for i in part)
        end = next((rows[i][4] for i in part if len(rows[i][2]) == at), _NONE)
        saved = (members - 1) * rows[part[0]][3][at - 1] if at else 0
        nodes.append([min(rows[i][0] for i in part), at, nodes[parent][0] if parent >= 0 else None, members, 0, 0, saved, end])
        above.append(parent)
        return [i for i in part if len(rows[i][2]) > at]

    todo = [(node(list(range(len(rows))), depth, -1), depth, 0)]
    while todo:
        part, at, parent = todo.pop()
        if not part:
            continue
        pivot = sorted(rows[i][2][at] for i in part)[len(part) // 2] if len(part) < 8 else sorted(rows[i][2][at] for i in (part[0], part[len(part) // 2], part[-1]))[1]
        less, same, more = [], [], []
        for i in part:
            x = rows[i][2][at]
            (less if x < pivot else more if x > pivot else same).append(i)
        todo += [(less, at, parent), (more, at, parent), (node(same, at + 1, parent), at + 1, len(nodes) - 1)]
    for i in range(len(nodes) - 1, -1, -1):  # a node comes after its parent
        nodes[i][5] = nodes[i][5] or 1
        if above[i] >= 0:
            up = nodes[above[i]]
            up[4], up[5], up[6] = up[4] + 1, up[5] + nodes[i][5], up[6] + nodes[i][6]
    return nodes


def _local(sequences: DataFrame) -> DataFrame:
    """Nodes of all local buckets; the top of each keeps the ``path`` of nodes above it."""

    def done(key: tuple, path: list, rows: list[tuple]) -> list[tuple]:
        found = finished(rows, key[0])
        found[0][2] = path[-1] if path else None
        return [(*x, path if i == 0 else None) for i, x in enumerate(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, path, rows, out = None, None, [], []
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                for depth, bucket, way, *row in zip(*(c.to_pylist() for c in batch.slice(first, 1024).columns)):
                    if key != (depth, bucket):
                        if rows:
                            out += done(key, path, rows)
                        key, path, rows = (depth, bucket), way, []
                    rows.append(tuple(row))
                    if len(out) > 20_000:
                        yield _batch(out, _NODE_NAMES)
                        out = []
        if rows:
            out += done(key, path, rows)
        if out:
            yield _batch(out, _NODE_NAMES)

    ordered = sequences.select("depth", "bucket", "path", "conv", "n", "ids", "lens", "ends").repartition("depth", "bucket").sortWithinPartitions("depth", "bucket", "conv")
    return ordered.mapInArrow(run, _NODE)


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """Every node of the trie over ``conversations`` (conv_id, ids, lens): a distinct sequence of first turns.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256,
    the digest of the conv_ids that end there. A conversation without turns ends at the root; an empty table has no nodes.
    """
    spark = conversations.sparkSession
    open_rows = _sequences(conversations).withColumns({"depth": F.lit(0), "path": F.array().cast("array<bigint>")})
    total = stored(open_rows)
    left, upper, closed = [total], [], []
    top = total.agg(F.min("conv").alias("conv"), F.sum("n").alias("n_convs"), F.sum(F.size("ids")).alias("turns"), F.count("*").alias("sequences"), F.max(F.when(F.size("ids") == 0, F.col("ends"))).alias("ends")).first()
    depth, rows = 0, total.withColumn("bucket", F.lit(top.conv).cast("bigint"))
    if top.conv is None or top.turns <= local or top.sequences == 1:
        closed.append(rows)
        rows = None
    else:
        upper.append(spark.createDataFrame([(top.conv, 0, None, top.n_convs, 0, top.ends or _NONE, [])], "conv bigint, depth int, parent bigint, n_convs bigint, own bigint, ends string, path array<bigint>"))
    while rows is not None:
        # the next turn of every sequence that has one, counted by bucket
        going = rows.where(F.size("ids") > depth).withColumn("turn", F.col("ids")[depth])
        kids = going.groupBy("bucket", "turn").agg(
            F.min("conv").alias("kid"), F.sum("n").alias("n_convs"), F.sum(F.size("ids") - depth).alias("turns"), F.count("*").alias("sequences"),
            F.first(F.col("lens")[depth]).alias("len"), F.max(F.when(F.size("ids") == depth + 1, F.col("ends"))).alias("ends"), F.first("path").alias("path"))
        kids = stored(kids.withColumn("open", (F.col("turns") > local) & (F.col("sequences") > 1)))
        left.append(kids)
        path = F.concat("path", F.array("bucket"))
        upper.append(kids.where("open").select(F.col("kid").alias("conv"), F.lit(depth + 1).alias("depth"), F.col("bucket").alias("parent"), "n_convs", ((F.col("n_convs") - 1) * F.col("len")).alias("own"), F.coalesce("ends", F.lit(_NONE)).alias("ends"), path.alias("path")))
        moved = going.join(kids.select("bucket", "turn", "kid", "open"), ["bucket", "turn"])
        moved = stored(moved.select("conv", "n", "ids", "lens", "ends", F.lit(depth + 1).alias("depth"), path.alias("path"), F.col("kid").alias("bucket"), "open"))
        left.append(moved)
        closed.append(moved.where("not open").drop("open"))
        depth, rows = depth + 1, moved.where("open").drop("open")
        if not kids.where("open").limit(1).count():
            rows = None
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    nodes = stored(_local(union([c.select("depth", "bucket", "path", "conv", "n", "ids", "lens", "ends") for c in closed])))
    if upper:
        nodes = nodes.unionByName(_upper(nodes, stored(union(upper))))
    for table in left:
        discard(table)
    return nodes.select(F.col("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def _upper(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """The nodes that rounds emitted, with what is below them: leaves and saved tokens of local buckets, and saved tokens of each other."""
    tops = nodes.where("path is not null")
    below = tops.select("path", F.col("n_leaves").alias("leaves"), "saved", F.lit(1).alias("kid"))
    below = below.unionByName(upper.select("path", F.lit(0).cast("bigint").alias("leaves"), F.col("own").alias("saved"), F.lit(1).alias("kid")))
    above = below.select(F.size("path").alias("depth_below"), F.posexplode("path").alias("depth", "conv"), "leaves", "saved", "kid")
    sums = above.groupBy("depth", "conv").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("below"), F.sum(F.when(F.col("depth") == F.col("depth_below") - 1, F.col("kid")).otherwise(0)).cast("bigint").alias("n_children"))
    joined = upper.join(sums, ["depth", "conv"])
    return joined.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", (F.col("own") + F.col("below")).alias("saved"), "ends", F.lit(None).cast("array<bigint>").alias("path"))
