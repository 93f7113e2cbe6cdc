"""Exact similarity join of shingle sets: every pair whose Jaccard similarity is at least a limit.

A text's set holds the hashes of its distinct shingles, sorted by one order of
all hashes: those that a sample of the corpus shows often go last. Two sets of n and
m members with a Jaccard similarity of s share at least ``s / (1 + s) * (n + m)``
of them, hence one of the first ``n - ceil(s * n) + 1`` of each (the prefix).
This holds for any order, so the sample only decides how many candidates there
are, never which pairs are found.

Sets that meet in a prefix are candidates where their sizes, and their places from
the shared member on, leave room for the limit, and where their SimHash
fingerprints differ in no more bits than those of a pair at the limit do: first 128
bits of it, then all ``64 * LANES``. Each of the two lets all but ``LOST`` of the pairs
at the limit through (an exact binomial tail), fewer of closer ones. Candidates are
compared by whole sets.

What matters is which sets hang together, so pairs inside a component are not
compared: first sets meet by SimHash, those of equal fingerprints of 64 bits and of
fingerprints at most two bits apart (whole sets decide here too); then what is apart
from the main component of a prefix member's group meets a random set of that, then
the nearest set (by fingerprint) of another component, and last, what is still apart
meets all others. The last round is complete, whatever the size of the group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.llm.common import by_key, cut, discard, free, slots, stored
from pitwise.llm.components import components

#: One in SAMPLE texts is looked at for frequent hashes; at most FREQUENT of them are sent to the tasks (0.5 MB).
SAMPLE, FREQUENT = 16, 65_536
#: Words of 64 bits of a fingerprint; sets of fewer than SMALL members are not held to it.
LANES, SMALL = 16, 32
#: Words of a fingerprint that go with each member of a prefix, and the share of pairs at the limit that a test may lose.
FIRST, LOST = 2, 1e-10
#: Rounds in which sets meet random ones of their group before all that are apart do.
HUBS = 2
#: Groups of a hash up to this many sets are cleared at once of those that nobody in them is like; larger ones in the joins.
BLOCK = 8192


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def bits_apart(similarity: float, lanes: int) -> int:
    """How many of 64 bits a lane fingerprints of sets at the limit differ in at most, but for ``LOST`` of all pairs: each bit differs with the angle's share."""
    bits = 64 * lanes
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    chance, tail, most = math.log(share) * bits, 0.0, bits
    while most > 0 and tail + math.exp(chance) <= LOST:
        tail += math.exp(chance)
        # of one bit fewer: the ratio of neighbouring terms of the binomial distribution
        chance += math.log(most / (bits - most + 1) * (1 - share) / share)
        most -= 1
    return most


def ordered_set(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Distinct hashes: those not in ``frequent`` (sorted) first, then by ``rank``; ties by value."""
    found = np.unique(hashes)
    if not len(frequent) or not len(found):
        return found
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    return found[np.argsort(np.where(frequent[at] == found, rank[at], -1), kind="stable")]


def frequent_hashes(texts: DataFrame, shingles) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that most texts of a sample hold, sorted, and their ranks by frequency. ``texts``: mark, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles(body.as_py() or b"")).view(np.int64))], ["h"])

    some = texts.select("mark", "body").where(F.pmod(F.xxhash64("mark"), F.lit(SAMPLE)) == 0).dropDuplicates(["mark"])
    counts = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    frequent = np.array([r["h"] for r in reversed(rows)], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    return frequent[order], order


def prefixes(texts: DataFrame, shingles, fingerprint, similarity: float, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """doc_id, mark, ``id`` (a hash of the set), ``n`` (its size), ``prefix`` and ``fp``. ``texts``: doc_id, mark, body."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                ids, sizes, parts, prints = [], [], [], []
                for body in rows.column(2):
                    found = ordered_set(shingles(body.as_py() or b""), frequent, rank)
                    ids.append(xxhash.xxh64_intdigest(found.tobytes(), 7))
                    sizes.append(len(found))
                    parts.append(found[: prefix_size(len(found), similarity)].view(np.int64))
                    prints.append(fingerprint(found, LANES))
                ends = np.cumsum([0, *map(len, parts)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
                flat = np.frombuffer(b"".join(prints), ">i8").astype(np.int64)
                fp = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1) * LANES, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists, fp], ["doc_id", "mark", "id", "n", "prefix", "fp"])

    return texts.select("doc_id", "mark", "body").mapInArrow(run, "doc_id bigint, mark bigint, id bigint, n int, prefix array<bigint>, fp array<bigint>")


def packed(members: np.ndarray) -> bytes:
    """The high six bytes of each hash: of two sets of 1,000, members agree by chance in one of 280 million pairs."""
    return members.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(">u8").astype(np.uint64).ravel()


def _partnered(h: np.ndarray, place: np.ndarray, first: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which rows, sorted by ``h``, have another of the same ``h`` with room for the limit and a fingerprint near theirs. Groups beyond ``BLOCK`` rows are kept whole."""
    limit, share = bits_apart(similarity, FIRST), similarity / (1 + similarity)
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    count = np.diff(edges)
    size = np.repeat(count, count)
    at, n = place >> 32, place & 0xFFFFFFFF

    def near(i, j):
        least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        room = (least >= similarity * most - 1e-6) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= share * (n[i] + n[j]) - 1e-6)
        bits = sum(np.bitwise_count((f[i] ^ f[j]).view(np.uint64)).astype(np.int32) for f in first)  # of a signed number it would count the absolute value
        return room & ((bits <= limit) | (least < SMALL))

    alive = size > BLOCK
    for d in range(1, 32):
        i = np.flatnonzero((h[:-d] == h[d:]) & (size[:-d] <= 32)) if d < len(h) else np.empty(0, np.int64)
        if not len(i):
            break
        i = i[near(i, i + d)]
        alive[i] = alive[i + d] = True
    for k in np.flatnonzero((count > 32) & (count <= BLOCK)).tolist():
        rows = np.arange(edges[k], edges[k + 1])
        for part in np.array_split(rows, -(-len(rows) // 256)):
            met = near(part[:, None], rows[None, :])
            met[np.arange(len(part)), part - rows[0]] = False
            alive[part] |= met.any(axis=1)
    return alive


_FIRST = [f"first{i}" for i in range(FIRST)]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each set of a task: copies are one before their prefixes are spread."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        fresh = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
        if fresh:
            yield batch.take(pa.array(fresh)) if len(fresh) < len(ids) else batch


def _met(wide: DataFrame, similarity: float) -> DataFrame:
    """h, id, at, n, first (words of the fingerprint): the members of prefixes that another set holds that may be alike."""
    once = wide.select("id", "n", F.slice("fp", 1, FIRST).alias("fp"), "prefix").mapInArrow(_once, "id bigint, n int, fp array<bigint>, prefix array<bigint>")
    rows = once.select("id", "n", *[F.col("fp")[i].alias(c) for i, c in enumerate(_FIRST)], F.posexplode("prefix").alias("at", "h")).select("h", "id", (F.shiftleft(F.col("at").cast("bigint"), 32) + F.col("n")).alias("place"), *_FIRST)
    ordered = rows.repartition("h").sortWithinPartitions("h", "id")

    def shared(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, ids = columns[:2]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])])  # equal texts have one set
        h, ids, place, *first = (c[new] for c in columns)
        twin = np.concatenate([[False], h[1:] == h[:-1], [False]])
        keep = np.flatnonzero(twin[:-1] | twin[1:])
        keep = keep[_partnered(h[keep], place[keep], [f[keep] for f in first], similarity)] if len(keep) else keep
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(ids[keep]), pa.array((place[keep] >> 32).astype(np.int32)), pa.array((place[keep] & 0xFFFFFFFF).astype(np.int32)), *[pa.array(f[keep]) for f in first]], ["h", "id", "at", "n", *_FIRST])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_key(batches, 1, 200_000, shared)

    return ordered.mapInArrow(run, "h bigint, id bigint, at int, n int, " + ", ".join(f"{c} bigint" for c in _FIRST))


def _room(similarity: float) -> Column:
    """Whether sets of sizes n_a, n_b that meet at places at_a, at_b can reach the limit."""
    share = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6) & (share >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6)


def _bits() -> Column:
    """Bits between the fingerprints fp_a and fp_b."""
    return sum((F.bit_count(F.col("fp_a")[i].bitwiseXOR(F.col("fp_b")[i])) for i in range(LANES)), F.lit(0))


def _alike(similarity: float) -> Column:
    """Whether the fingerprints leave room for the limit."""
    return (_bits() <= bits_apart(similarity, LANES)) | (F.least("n_a", "n_b") < SMALL)


def _both(one: DataFrame, more: DataFrame) -> DataFrame:
    """Two cut tables as one, of no more partitions than the session's."""
    return cut(one.unionByName(more).coalesce(slots(one.sparkSession)))


class _Sets:
    """The sets that candidates are compared by, and which pairs have been compared."""

    def __init__(self, texts: DataFrame, wide: DataFrame, met: DataFrame, shingles, similarity: float):
        self.similarity = similarity
        # grouped before the join: very many equal texts are one row for each task
        nodes = wide.groupBy("id").agg(F.max("n").alias("n"), F.max("fp").alias("fp"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("one"))
        self.nodes = stored(nodes.join(met.select("id").distinct(), "id", "left_semi"))
        self.sets = stored(self._of(texts, shingles))
        self.done = None
        free(texts)

    def _of(self, texts: DataFrame, shingles) -> DataFrame:
        """id and ``members`` of every candidate, from one of its texts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 64):
                    rows = batch.slice(first, 64)
                    members = [packed(np.unique(shingles(body.as_py() or b""))) for body in rows.column(1)]
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(members, pa.binary())], ["id", "members"])

        one = self.nodes.select("id", F.col("one.doc_id").alias("one_id"), F.col("one.mark").alias("one_mark"))
        bodies = texts.join(one, texts.doc_id.eqNullSafe(one.one_id) & (texts.mark == one.one_mark))
        # repeated rows give their set again; equal sets are one
        return bodies.select("id", "body").mapInArrow(run, "id bigint, members binary").groupBy("id").agg(F.max("members").alias("members"))

    def links(self, pairs: DataFrame, near: bool = False) -> DataFrame:
        """The pairs (a, b) whose whole sets reach the limit, of those whose fingerprints may (``near``: all do) and that have not been compared."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.done is not None:
            pairs = pairs.join(self.done, ["a", "b"], "left_anti")
        if not near:
            side = lambda c: self.nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("fp").alias(f"fp_{c}"))
            pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(_alike(self.similarity)).select("a", "b")
        pairs = cut(pairs)
        self.done = pairs if self.done is None else _both(self.done, pairs)
        similarity = self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = unpacked(x.as_py()), unpacked(y.as_py())
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

        left, right = self.sets.select(F.col("id").alias("a"), F.col("members").alias("x")), self.sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
        found = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))
        free(pairs)
        return found

    def close(self) -> None:
        discard(self.sets)
        discard(self.nodes)


def _apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """met with ``root`` and the group's ``main`` root (that of most of its sets), where a group has several roots."""
    rows = met.join(roots, met.id == roots.node, "left").select("h", "id", "at", "n", *_FIRST, F.coalesce("root", "id").alias("root"))
    mains = rows.groupBy("h", "root").agg(F.count("*").alias("times")).groupBy("h").agg(F.max(F.struct("times", "root")).alias("main"), F.count("*").alias("roots"))
    return stored(rows.join(mains.where("roots > 1").select("h", F.col("main.root").alias("main")), "h"))


def _with_hub(rows: DataFrame, hubs: DataFrame, similarity: float, draw: int) -> DataFrame:
    """Pairs (a, b) of each row with a random one of its group's ``hubs``."""
    hub = hubs.groupBy("h").agg(F.min(F.struct(F.xxhash64(F.lit(draw), "h", "id").alias("draw"), "id", "at", "n")).alias("hub"))
    hub = hub.select("h", F.col("hub.id").alias("a"), F.col("hub.at").alias("at_a"), F.col("hub.n").alias("n_a"))
    rows = rows.select("h", F.col("id").alias("b"), F.col("at").alias("at_b"), F.col("n").alias("n_b"))
    return rows.join(hub, "h").where((F.col("a") != F.col("b")) & _room(similarity)).select("a", "b")


def _others(apart: DataFrame, sets: _Sets, similarity: float) -> DataFrame:
    """Pairs (a, b) of a set apart from its group's main component and one of another component, and the bits between them."""
    rows = apart.join(sets.nodes.select("id", "fp"), "id")
    side = lambda c: rows.select("h", *[F.col(k).alias(f"{k}_{c}") for k in ("id", "at", "n", "root", "main", *_FIRST, "fp")])
    met = side("a").where("root_a <> main_a").join(side("b"), "h").where("root_a <> root_b")
    first = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _FIRST), F.lit(0))
    near = (first <= bits_apart(similarity, FIRST)) | (F.least("n_a", "n_b") < SMALL)
    return met.where(_room(similarity) & near & _alike(similarity)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), _bits().alias("apart"))


def _printed(sets: _Sets, near_prints: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) by 64-bit SimHash: each set and the first of its fingerprint, and the firsts of fingerprints that ``near_prints`` links."""
    nodes = sets.nodes.select("id", F.col("fp")[0].alias("fp"))
    firsts = cut(nodes.groupBy("fp").agg(F.min("id").alias("first")))
    same = nodes.join(firsts, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    side = lambda c, name: firsts.select(F.col("fp").alias(c), F.col("first").alias(name))
    near = near_prints(firsts.select("fp")).join(side("a", "x"), "a").join(side("b", "y"), "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def linked(texts: DataFrame, wide: DataFrame, shingles, similarity: float, near_prints: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of every set that has a link, as :func:`components` gives them. ``wide``: see :func:`prefixes`.

    ``near_prints`` gives edges (a, b) between near ones of distinct fingerprints ``fp``.
    """
    met = stored(_met(wide, similarity))
    free(wide)
    sets = _Sets(texts, wide, met, shingles, similarity)
    links = sets.links(_printed(sets, near_prints))
    for draw in range(HUBS):
        apart = _apart(met, components(links))
        links = _both(links, sets.links(_with_hub(apart.where("root <> main"), apart.where("root = main"), similarity, draw)))
        discard(apart)
        free(links)
    for last in (False, True):
        roots = components(links)
        apart = _apart(met, roots)
        rest = _others(apart, sets, similarity)
        rest = rest.select("a", "b") if last else rest.groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))
        more = sets.links(rest, near=True)
        links = _both(links, more)
        discard(apart)
        free(links)
    roots = components(links) if more.take(1) else roots
    sets.close()
    discard(met)
    return roots
