"""Bytes that repeat: strings of at least ``LEAST`` bytes that start in two places, by interval expansion on a Burrows-Wheeler transform.

Every window of ``least`` bytes has a key, the smallest hash of its grams of ``GRAM``
bytes. Neighbouring windows of one key are one segment; equal windows have equal keys,
wherever they stand, so each key is a problem of its own. Where all segments of a key
are equal (and hold its gram once), they repeat as a whole or not at all, which counts
of their digests tell. Of other keys every distinct segment goes, once, to the task of
its key: there the segments of some keys are joined, their rotations sorted by their
first 512 bytes, and the transform's intervals extended backwards, breadth first. That
sets the common prefix of neighbours in the order by increasing value; what is not set
when strings reach ``least`` bytes has a common prefix of ``least`` or more.

Segments of one key that are more than ``BUCKET`` bytes (a phrase that many texts hold,
in other surroundings each) are cut again, by the smallest grams under three further
hashes, then under twelve, and what is still too large by single windows; then equal
ones are counted as above. So no task holds more than two buckets, and nothing is left out.

Equal segments are told by their key and a 64-bit digest, both 64 bits of hash; texts
by doc_id and a 64-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.common import discard, free, stored

LEAST, GRAM = 400, 64
#: Bytes of distinct segments that one transform holds, beside those of one further key.
BUCKET = 2_000_000
#: Hashes that the windows of a text are keyed by, those of a large key, and those of what is still large; then single windows.
SEEDS: list[list[int]] = [[0], [1, 2, 3], list(range(4, 16))]
#: Window places that are keyed at once, and windows of a segment.
CHUNK, LONGEST = 1 << 17, 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if getattr(_powers, "kept", None) is None or len(_powers.kept[0]) < n:
        ones = lambda x: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]))
        _powers.kept = ones(_BASE), ones(np.uint64(pow(int(_BASE), -1, 1 << 64)))
    return _powers.kept


_BYTES = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MIXERS = [np.uint64(int(x) | 1) for x in np.random.default_rng(2).integers(1 << 62, 1 << 63, 17)]


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every gram of ``size`` bytes, from sums of bytes times powers."""
    up, down = _powers(CHUNK + LEAST + GRAM if len(data) <= CHUNK + LEAST else len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)])])
    n = len(data) - size + 1
    return (total[size:] - total[:n]) * down[:n]


def _mixed(grams: np.ndarray, seed: int) -> np.ndarray:
    h = (grams ^ (grams >> np.uint64(32))) * _MIXERS[seed]
    return h ^ (h >> np.uint64(29))


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        h, done = np.minimum(h[:-done], h[done:]), done * 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :])


def segments(body: bytes, least: int, seeds: list[int] | None) -> Iterator[tuple[int, int, int, int, bool]]:
    """(key, digest, start, bytes, whether its gram stands in it twice) of all segments; without ``seeds`` each window is one."""
    size = min(GRAM, least)
    for first in range(0, len(body) - least + 1, CHUNK):
        part = body[first : first + CHUNK + least - 1]
        if seeds is None:
            for i in range(len(part) - least + 1):
                digest = xxhash.xxh3_128_intdigest(part[i : i + least])
                yield _signed(digest >> 64), _signed(digest & (1 << 64) - 1), first + i, least, False
            continue
        grams = _grams(np.frombuffer(part, np.uint8), size)
        hashes = [_mixed(grams, s) for s in seeds]
        keys = [_smallest(h, least - size + 1) for h in hashes]
        new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        sizes = np.diff(np.append(starts, len(keys[0])))
        if sizes.max() > LONGEST:
            times = -(-sizes // LONGEST)
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            starts = np.repeat(starts, times) + inner * LONGEST
            sizes = np.diff(np.append(starts, len(keys[0])))
        key = keys[0][starts]
        for k in keys[1:]:
            key = (key ^ (k[starts] >> np.uint64(7))) * _MIXERS[-1] + k[starts]
        lows = keys[0][starts].tolist()
        for i, n, k, low in zip(starts.tolist(), sizes.tolist(), key.view(np.int64).tolist(), lows):
            again = np.count_nonzero(hashes[0][i : i + n + least - size] == low) > 1
            yield k, _signed(xxhash.xxh3_64_intdigest(part[i : i + n + least - 1])), first + i, n + least - 1, again


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all rotations of ``text``, in the order of their first ``depth`` bytes at least."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | np.roll(text, -j)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    done = 8
    while done < depth:
        single = head & np.append(head[1:], True)
        place = np.flatnonzero(~single)  # whole groups of rotations that are equal so far
        if not len(place):
            break
        at = order[place]
        then = (rank[at] << 32) | rank[(at + done) % n]
        turn = np.argsort(then, kind="stable")
        order[place], then = at[turn], then[turn]
        head[place] = np.concatenate([[True], then[1:] != then[:-1]])
        rank[order[place]] = np.maximum.accumulate(np.where(head[place], place, 0))
        done *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each rotation in ``order`` with the one before, ``least`` for any of that length or more.

    An interval holds the rotations that start with one string. Those of strings of l + 1 bytes are made by putting the
    byte before each rotation in front; where such an interval ends at a border that is not set yet, the border is set
    to l and the interval goes on to the next round.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = place[order - 1]  # order - 1 is -1 for the first rotation: the last byte comes before it
    lead = text[order]
    prefix = np.full(n + 1, least, np.int32)
    prefix[[0, n]] = 0
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for done in range(least):
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - np.cumsum(size) + size, size)
        moved = np.sort((before[rows] << 32) | owner)
        row, owner = moved >> 32, moved & 0xFFFFFFFF
        cut = (row[1:] != row[:-1] + 1) | (owner[1:] != owner[:-1]) | (lead[row[1:]] != lead[row[:-1]])
        first = np.concatenate([[True], cut])
        low, high = row[first], row[np.append(cut, True)] + 1
        new = prefix[high] == least
        low, high = low[new], high[new]
        prefix[high] = done
    return prefix[:n]


def repeats(bodies: list[bytes], least: int = LEAST) -> list[list[tuple[int, int]]]:
    """Runs of bytes (start, end) of each body that strings of ``least`` bytes cover which start twice in ``bodies``."""
    text = np.frombuffer(b"".join(b + b"\xff" for b in bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes + 1) - 1
    whole = np.repeat(ends, sizes + 1) - np.arange(len(text)) >= least  # a string that starts here ends in the body
    order = rotations(text, least + 1)
    group = np.cumsum(common_prefixes(text, order, least) < least) - 1
    often = np.bincount(group[whole[order]], minlength=int(group[-1]) + 1)
    mark = np.zeros(len(text), bool)
    mark[order] = (often[group] > 1) & whole[order]
    out: list[list[tuple[int, int]]] = []
    for end, size in zip(ends.tolist(), sizes.tolist()):
        mine = np.flatnonzero(mark[end - size : end])
        fresh = np.concatenate([[True], np.diff(mine) > least]) if len(mine) else np.empty(0, bool)
        out.append(list(zip(mine[fresh].tolist(), (mine[np.append(fresh[1:], True)] + least).tolist())) if len(mine) else [])
    return out


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(bodies: DataFrame, least: int, seeds: list[int] | None) -> DataFrame:
    """Segments of every body, under the two keys of the body."""
    names = ["k1", "k2", "h", "d", "start", "n", "again"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for k1, k2, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for x in segments(body.as_py(), least, seeds):
                    out.append((k1, k2, *x))
                    if len(out) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return bodies.select("k1", "k2", "body").mapInArrow(run, "k1 bigint, k2 bigint, h bigint, d bigint, start bigint, n int, again boolean")


def _pieces(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted segments, each from the body that stands for it; a body is cut in one pass."""
    spans = wanted.groupBy(F.col("k1").alias("w1"), F.col("k2").alias("w2")).agg(F.collect_list(F.struct("h", "d", "start", "n", "times", "hot")).alias("spans"))
    both = bodies.join(spans, F.col("k1").eqNullSafe(F.col("w1")) & (F.col("k2") == F.col("w2"))).select("spans", "body")
    names = ["h", "d", "times", "hot", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spans, body in zip(batch.column(0), batch.column(1)):
                spans, body = spans.as_py(), body.as_py()
                for first in range(0, len(spans), 4096):
                    rows = [(s["h"], s["d"], s["times"], s["hot"], body[s["start"] : s["start"] + s["n"]]) for s in spans[first : first + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return both.mapInArrow(run, "h bigint, d bigint, times bigint, hot boolean, body binary")


def _expanded(pieces: DataFrame, least: int) -> DataFrame:
    """h, d, ranges: what repeats of each distinct segment of the keys that a task has, some keys to a transform."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        found = repeats([r[3] for r in rows], least)
        ranges = [[(0, len(r[3]))] if r[2] > 1 else x for r, x in zip(rows, found)]
        ranges = [[{"start": s, "end": e} for s, e in x] for x in ranges]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(ranges, _RANGES)], ["h", "d", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BUCKET and row[0] != rows[-1][0]:
                    yield made(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield made(rows)

    ordered = pieces.select("h", "d", "times", "body").repartition("h").sortWithinPartitions("h", "d")
    return ordered.mapInArrow(run, "h bigint, d bigint, ranges array<struct<start: bigint, end: bigint>>")


def repeated(bodies: DataFrame, least: int = LEAST, level: int = 0) -> DataFrame:
    """k1, k2, ranges: the runs of bytes of every body (k1, k2, body) that repeat, in order and apart; bodies without any have no row."""
    left = [all_segments := stored(_cut(bodies, least, SEEDS[level] if level < len(SEEDS) else None))]
    keys = all_segments.groupBy("h").agg(F.count("*").alias("times"), F.min("d").alias("low"), F.max("d").alias("high"), F.max("again").alias("again"))
    keys = keys.where("times > 1 or again").select("h", (F.col("again") | (F.col("low") != F.col("high"))).alias("mixed"))
    left.append(met := stored(all_segments.drop("again").join(keys, "h")))
    runs = met.where("not mixed").select("k1", "k2", F.array(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("ranges"))

    distinct = met.where("mixed").groupBy("h", "d").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "start", "n")).alias("one"))
    sizes = distinct.groupBy("h").agg((F.sum(F.col("one.n").cast("bigint")) > BUCKET).alias("hot"))
    wanted = distinct.join(sizes, "h").select("h", "d", "times", "hot", "one.k1", "one.k2", "one.start", "one.n")
    left.append(pieces := stored(_pieces(bodies, wanted)))
    left.append(found := stored(_expanded(pieces.where("not hot"), least)))
    hot = pieces.where("hot").dropDuplicates(["h", "d"])
    if not pieces.where("hot").limit(1).isEmpty():
        below = repeated(hot.select(F.col("h").alias("k1"), F.col("d").alias("k2"), "body"), least, level + 1)
        left.append(below)
        whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.length("body").cast("bigint").alias("end")))
        found = found.unionByName(below.select(F.col("k1").alias("h"), F.col("k2").alias("d"), "ranges").join(hot.where("times > 1").select("h", "d"), ["h", "d"], "left_anti"))
        found = found.unionByName(hot.where("times > 1").select("h", "d", whole.alias("ranges")))
    moved = F.transform("ranges", lambda r: F.struct((r["start"] + F.col("start")).alias("start"), (r["end"] + F.col("start")).alias("end")))
    parts = met.where("mixed").join(found.where("size(ranges) > 0"), ["h", "d"]).select("k1", "k2", moved.alias("ranges"))
    runs = stored(_merged(runs.unionByName(parts)))
    for table in left:
        discard(table)
    return runs


def _merged(runs: DataFrame) -> DataFrame:
    """One row for each body: its runs in order, those that meet or overlap as one. A body's own length bounds them."""
    grouped = runs.groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_set("ranges"))).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ranges in batch.column(2):
                spans: list[dict] = []
                for r in ranges.as_py():
                    if spans and r["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], r["end"])
                    else:
                        spans.append(r)
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _RANGES)], ["k1", "k2", "ranges"])

    return grouped.mapInArrow(run, "k1 bigint, k2 bigint, ranges array<struct<start: bigint, end: bigint>>")


def without_repeats(docs: DataFrame, least: int = LEAST, kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with ``kept`` its remaining bytes too.

    A byte goes if a string of ``least`` bytes covers it that also starts in another place, in any row. Null texts are
    empty and keep nothing; texts shorter than ``least`` stay whole; repeated rows repeat each other; null doc_ids are
    kept as null; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    text = F.coalesce("text", F.lit(""))
    bodies = docs.select(F.col("doc_id").cast("bigint").alias("k1"), F.xxhash64(text).alias("k2"), text.cast("binary").alias("body"))
    runs = repeated(bodies.where(F.octet_length("body") >= least), least)
    free(docs)
    rows = bodies.join(runs.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "ranges"), F.col("k1").eqNullSafe(F.col("w1")) & (F.col("k2") == F.col("w2")), "left").select("k1", "body", "ranges")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, body, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                body, spans = body.as_py(), ranges.as_py() or []
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(body)]
                rest = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc_id, len(body), len(body) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if kept else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)][: 5 + kept], names[: 5 + kept])

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept)
