"""SimHash near-duplicates by pigeonhole blocks.

A text is lower-cased (A-Z), cut into words at ASCII white space and into
shingles of ``size`` words; every shingle's XXH64 votes on each bit. To find
all fingerprints within a small Hamming distance, the 64 bits are split into
five blocks: two fingerprints that differ in at most two bits agree on three
blocks at least, so each is keyed by its ten triples of blocks, and only
fingerprints that share a key are compared.

Work is done on distinct fingerprints, so exact copies cost nothing, and a key
that very many fingerprints share is not compared pairwise: there each
fingerprint meets its neighbours at the values one bit away (two values within
two bits share such a midpoint), which is as exact and linear in the group.

Nulls and empty texts have no words: fingerprint zero, linked like any other.
A null doc_id keeps its row and takes its component's smallest known id.
Repeated rows are kept; an empty table gives an empty result. Only ``doc_id``
and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm import setjoin
from pitwise.llm.common import cut, discard, stored
from pitwise.llm.components import components

#: Fingerprints sharing a block key are compared in pairs up to this many; beyond it, through midpoints.
PAIRWISE = 16
_EDGES = (0, 13, 26, 39, 52, 64)
_BLOCKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_EDGES, _EDGES[1:])]
MASKS = [sum(c) for c in combinations(_BLOCKS, 3)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, repeats included; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, 42)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - size + 1].tolist()
    stop = end[size - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(start, stop)), np.uint64, len(start))


def majority(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """Bits set in over half the hashes, most significant first. Lanes beyond the first remix each hash."""
    counts = np.zeros(64 * lanes, np.int64)
    salts = np.array([(0x9E3779B97F4A7C15 * lane) & 0xFFFFFFFFFFFFFFFF for lane in range(1, lanes)], np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None]
        if lanes > 1:
            x = part + salts
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            part = np.concatenate([part, x ^ (x >> np.uint64(31))], axis=1)
        wide = np.ascontiguousarray(part, ">u8").view(np.uint8)
        counts += np.unpackbits(wide, axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, size: int = 5, lanes: int = 1) -> DataFrame:
    """doc_id, ``mark`` (a hash of the text) and ``fp``: a bigint, or an array of them for several lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(body.as_py() or b"", size), lanes) for body in batch.column(2)]
            flat = np.frombuffer(b"".join(prints), ">i8").astype(np.int64)
            fp = pa.array(flat) if lanes == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1) * lanes, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], ["doc_id", "mark", "fp"])

    source = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("body"))
    return source.mapInArrow(run, f"doc_id bigint, mark bigint, fp {'bigint' if lanes == 1 else 'array<bigint>'}")


def _bits_apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct ``fp`` values within two bits of each other."""
    keyed = nodes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(MASKS)])).alias("k"),
    ).select("fp", "k.c", "k.key")
    groups = keyed.groupBy("c", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    groups = cut(groups)
    pairs = groups.where("n = 2").select("a", "b")
    members = keyed.join(groups.where("n > 2").select("c", "key", "n"), ["c", "key"])
    few = members.where(F.col("n") <= PAIRWISE)
    few = few.select("c", "key", F.col("fp").alias("a")).join(few.select("c", "key", F.col("fp").alias("b")), ["c", "key"]).where("a < b").select("a", "b")
    near = pairs.unionByName(few).where(_bits_apart("a", "b") <= 2)

    many = members.where(F.col("n") > PAIRWISE).select("fp").distinct()
    spots = many.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))).alias("spot"))
    hubs = spots.groupBy("spot").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("spot", "a")
    met = spots.join(hubs, "spot").where("fp > a").select("a", F.col("fp").alias("b"))
    return near.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most two differing bits."""
    prints = cut(fingerprints(docs, size))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def unique_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates: its smallest doc_id, with all columns.

    Two documents are linked where the Jaccard similarity of their shingle sets
    is ``similarity`` or more. Documents meet by SimHash fingerprints (:func:`links`)
    first; as near fingerprints are not all such pairs, those that are still apart then
    meet by members of their sets, so that all count (:mod:`pitwise.llm.setjoin`),
    and a shingle counts once however often a text repeats it. Nulls and empty
    texts are alike; of repeated rows one stays; a null doc_id goes last; an
    empty table gives none; further columns may have any name.
    """
    shingles = partial(shingle_hashes, size=size)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("body"))
    wide = stored(setjoin.prefixes(texts, shingles, majority, similarity, *setjoin.frequent_hashes(texts, shingles)))
    prints = cut(wide.select("doc_id", "mark", "id"))
    roots = setjoin.linked(texts, wide, shingles, similarity, links)
    discard(wide)
    rooted = prints.join(roots, prints.id == roots.node, "left").select("doc_id", "mark", F.coalesce("root", "id").alias("root"))
    rooted = rooted.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("times"))
    one = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("mark"), F.col("times"))).alias("one"))
    one = cut(one.select(F.col("one.doc_id").alias("one_id"), F.col("one.mark").alias("one_mark"), F.col("one.times").alias("times")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("bigint").alias("key_id"), F.xxhash64("text").alias("key_mark"))
    rows = rows.join(one, rows.key_id.eqNullSafe(one.one_id) & (rows.key_mark == one.one_mark)).select("doc", "key_id", "key_mark", "times")
    # only rows that are there more than once are dealt out again
    again = rows.where("times > 1").dropDuplicates(["key_id", "key_mark"])
    return rows.where("times = 1").unionByName(again).select("doc.*")
