"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest of its inner s-mers (in
hash order) lies at its first or last place. That depends on the k-mer alone,
so the same passage gives the same anchors wherever it stands, and positions
of shared anchors line up. A fingerprint is the smallest anchor hashes of the
whole text, each with its first place. Likeness matches them by position: of
the shared anchors those count that stand in one order in both texts (as many
as can), and their share is given as a Dice coefficient. It is exact for texts
of up to 128 distinct anchors (about 1,100 code points); beyond that it is an
estimate from 128 of them, whose standard error is at most 0.05.

A null text counts as empty; an empty text has an empty fingerprint, like
another empty one (1) and unlike all others (0). A text without an anchor,
mostly one shorter than k, is one anchor as a whole. A null doc_id sorts below
all others; rows of one doc_id go by their text; repeated rows are kept. Only
``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.common import bucket_of, range_bounds, slots, stored

K, S, KEPT = 24, 8, 128
_BASE = 0x9E3779B97F4A7C15
_LEAST = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(h: np.ndarray, have: int, more: np.ndarray, count: int) -> np.ndarray:
    """Rolling hashes of ``have + count`` points from those of ``have`` and of ``count``."""
    n = len(more) - have
    return h[:n] * np.uint64(pow(_BASE, count, 1 << 64)) + more[have:]


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and 32-bit hashes of the closed syncmers of a text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(points) >= K:
        one = _mix(points.astype(np.uint64) + np.uint64(1))
        two = _runs(one, 1, one, 1)
        four = _runs(two, 2, two, 2)
        eight = _runs(four, 4, four, 4)
        whole = _runs(_runs(eight, 8, eight, 8), 16, eight, 8)
        order = _mix(eight)
        least = order
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[:-1], order[K - S :])
        at = np.flatnonzero((order[: len(least)] == least) | (order[K - S :] == least))
        if len(at):
            return at, (_mix(whole[at]) >> np.uint64(32)).astype(np.uint32)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    return np.zeros(1, np.int64), np.array([xxhash.xxh32_intdigest(text.encode())], np.uint32)


#: Hashes, rising, and the first place of each.
Sketch = tuple[np.ndarray, np.ndarray]


def sketch(text: str) -> Sketch:
    at, found = anchors(text)
    kept, first = np.unique(found, return_index=True)
    return kept[:KEPT], at[first[:KEPT]]


def shown(kept: Sketch) -> str:
    """Eight hex digits of each hash and eight of its place."""
    return np.stack(kept, axis=1).astype(">u4").tobytes().hex()


def _rising(places: np.ndarray) -> int:
    """Length of the longest rising subsequence."""
    if (np.diff(places) > 0).all():
        return len(places)
    ends: list[int] = []  # the least end of a rising subsequence of each length
    for x in places.tolist():
        i = bisect_left(ends, x)
        ends[i : i + 1] = [x]
    return len(ends)


def likeness(a: Sketch, b: Sketch) -> float:
    """Dice coefficient of the anchors behind two sketches, those in one order counting as shared; exact where both hold all anchors."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    both = np.union1d(a[0], b[0])
    if len(a[0]) >= KEPT or len(b[0]) >= KEPT:
        both = both[:KEPT]
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    seen = shared <= both[-1]
    share = _rising(b[1][j[seen]][np.argsort(a[1][i[seen]])]) / len(both)
    return 2 * share / (1 + share)


def fingerprint_anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position, hash: every anchor of every text, for positional matching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                at, kept = anchors(text.as_py() or "")
                for i in range(0, len(at), 100_000):
                    part = slice(i, i + 100_000)
                    n = len(at[part])
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * n, pa.int64()), pa.array(at[part], pa.int64()), pa.array(kept[part].astype(np.int64))], ["doc_id", "position", "hash"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, position bigint, hash bigint")


def shared_runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, other_id, shift, start, end, anchors: where a document lines up with the first (smallest doc_id) that has its anchors.

    Anchors depend on their own letters alone, so those of a shared passage stand
    at one shift: positions are matched by hash, and grouped by document pair and
    shift. Each anchor meets its first holder's first place only, so the rows are
    no more than the anchors. Documents without a doc_id have no part in it.
    """
    anchors_ = stored(fingerprint_anchors(docs).where("doc_id is not null"))
    first = anchors_.groupBy("hash").agg(F.min(F.struct("doc_id", "position")).alias("one")).select("hash", F.col("one.doc_id").alias("other_id"), F.col("one.position").alias("place"))
    met = anchors_.join(first, "hash").where("doc_id > other_id").withColumn("shift", F.col("position") - F.col("place"))
    runs = met.groupBy("doc_id", "other_id", "shift").agg(F.min("position").alias("start"), (F.max("position") + K).alias("end"), F.countDistinct("position").alias("anchors"))
    return runs.where(F.col("anchors") >= least)


def _neighbours(docs: DataFrame) -> DataFrame:
    """Documents in runs of descending doc_id, each followed by a copy of the next run's first document (``extra``)."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST))
    docs = docs.select(key.alias("key"), F.col("doc_id").cast("bigint"), "text")
    bounds = range_bounds(docs, "key", 4 * slots(docs.sparkSession))
    placed = docs.withColumn("run", bucket_of(F.col("key"), bounds))
    # one row for each run: as many as the setting says, whatever the input
    firsts = sorted((r[0], r[1]) for r in placed.groupBy("run").agg(F.max("key")).collect())
    wanted = F.lit(None).cast("int")
    if firsts:
        after = {run: firsts[(i + 1) % len(firsts)][0] for i, (run, _) in enumerate(firsts)}
        lead = F.create_map(*[F.lit(x) for run, first in firsts for x in (run, first)])
        to = F.create_map(*[F.lit(x) for pair in after.items() for x in pair])
        wanted = F.when(F.element_at(lead, F.col("run")) == F.col("key"), F.element_at(to, F.col("run")))
    own = F.struct(F.col("run").alias("run"), F.lit(False).alias("extra"))
    copy = F.struct(wanted.alias("run"), F.lit(True).alias("extra"))
    rows = placed.select("key", "doc_id", "text", F.explode(F.filter(F.array(own, copy), lambda x: x["run"].isNotNull())).alias("at"))
    rows = rows.select("at.run", "at.extra", "key", "doc_id", "text").repartition("run")
    return rows.sortWithinPartitions("run", "extra", F.desc("key"), "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document in descending doc_id."""
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(doc_id, text, kept, following, following_kept):
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        changed = sketch(edited)
        return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), shown(kept), shown(changed), likeness(kept, changed), likeness(kept, following_kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last document whose next one has not come yet
        for batch in batches:
            out = []
            for extra, doc_id, text in zip(batch.column(1), batch.column(3), batch.column(4)):
                extra, text = extra.as_py(), text.as_py() or ""
                if waiting is None and extra:
                    continue
                kept = sketch(text)
                if waiting is not None:
                    out.append(row(*waiting, text, kept))
                waiting = None if extra else (doc_id.as_py(), text, kept)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in schema.split(", ")])

    return _neighbours(docs).mapInArrow(run, schema)
