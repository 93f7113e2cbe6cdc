"""Mixing sources to target weights, from packed blocks, in DataFrame operations alone.

Sources in code-point order (null last) weigh 1, 2, 3, 1, ... of all words; a
target stops at ``most`` times its source's size and the excess is shared again
by weight. Each source's documents are packed, in a pseudorandom order, into
blocks of ``block`` words. The mix is a run of output shards of ``shard`` slots.

Every slot of every shard draws its source: the slots are thrown, by a
pseudorandom permutation, on as many equal cells of the unit interval, in which
each source owns a run as wide as its weight. A shard's counts are thus a
multinomial draw without replacement: they vary from shard to shard as such
counts do, while over all shards each source gets its weight to within one
slot. The place of a slot's cell in its source's run numbers the source's slots,
so nothing is summed from shard to shard. The j-th slot of a source takes block
``perm(j)``: a pseudorandom permutation of the source's block numbers for every
pass over them. Slots and blocks meet in a join by block number.

All randomness is a hash of seed and position, so reruns agree. No source is
gathered in a task: running sums go over hashed buckets of documents, then over
the buckets, both as many as the root of the documents. Sources are expected to
be far fewer than documents: their weights are one row each.

Null texts and texts without words have size 0 and are taken 0 times; a null
source is a source; null and repeated doc_ids keep their rows; an empty table
gives none. Only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.common import cut, slots, stored

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 12
#: Slots of a source that one row stands for before they are drawn.
RUN = 2048


def n_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]")
    return (F.size(parts) - F.aggregate(parts, F.lit(0), lambda n, x: n + F.when(x == "", 1).otherwise(0))).cast("bigint")


def _uniform(*parts) -> Column:
    """A number in [0, 1) that the arguments decide."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def permuted(k: Column, n: Column, *key) -> Column:
    """Place of ``k`` in a pseudorandom permutation of 0..n-1 (swap-or-not rounds, each a bijection)."""

    def step(x, r):
        other = F.pmod(F.pmod(F.xxhash64(F.lit("turn"), r, *key), n) - x, n)
        return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(x, other), *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k, step)


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """source_key, source_size, target: the capped shares of all words. ``sizes``: source_key, source, source_size."""
    everything = Window.partitionBy()
    rows = sizes.withColumn("weight", (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(3)) + 1).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("level", F.col("cap") / F.col("weight"))
    # with the caps met first at the lowest levels, the rest shares evenly by weight at the first level that is not met
    upto = Window.orderBy("level", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    rows = rows.withColumn("shared", (F.sum("source_size").over(everything) - F.col("used")) / F.col("left"))
    water = F.min(F.when(F.col("shared") <= F.col("level"), F.struct("level", "source_key", "shared"))).over(everything)["shared"]
    return rows.select("source_key", "source_size", F.least(F.col("cap"), F.col("weight") * F.coalesce(water, F.lit(float("inf")))).alias("target"))


def _placed(docs: DataFrame, seed: int, per_bucket: int) -> DataFrame:
    """Each document's first word number in its source's packed stream (``at``)."""
    docs = docs.withColumn("spread", F.xxhash64(F.lit(seed), "doc_id", "size"))
    rows = docs.count()
    n = max(1, -(-rows // max(per_bucket, math.isqrt(rows))))
    docs = docs.withColumn("bucket", F.pmod("spread", F.lit(n)))
    sums = docs.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    before = sums.select("source_key", "bucket", (F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("words")).alias("before"))
    inner = Window.partitionBy("source_key", "bucket").orderBy("spread", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = docs.withColumn("inside", F.sum("size").over(inner) - F.col("size"))
    return inside.join(before, ["source_key", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))


def _cells(sources: DataFrame, block: int) -> DataFrame:
    """source_key, blocks, and the run of ``cells`` from ``first`` on that each source owns of all slots."""
    sources = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    order = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.round(F.sum(F.col("target") * F.col("blocks") / F.col("source_size")).over(order)).cast("bigint")
    runs = sources.withColumn("upto", upto).withColumn("first", F.coalesce(F.lag("upto").over(Window.orderBy("source_key")), F.lit(0).cast("bigint")))
    return runs.select("source_key", "blocks", "first", (F.col("upto") - F.col("first")).alias("cells"))


def mixed_blocks(sources: DataFrame, block: int = 64, shard: int = 4096, most: int = 3, seed: int = 7) -> DataFrame:
    """source_key, shard, slot (of all), nth (of the source), pass, block_no: the mix, slot by slot.

    ``sources`` holds source_key, source_size and target, one row each.
    """
    runs = cut(_cells(sources, block))
    total = runs.agg(F.sum("cells")).first()[0] or 0
    # a source's cells in parts, and parts of parts, so that no row stands for all of a large source
    far = runs.where("cells > 0").withColumn("far", F.explode(F.expr(f"sequence(0L, (cells - 1) div {RUN * RUN})")))
    parts = far.withColumn("part", F.explode(F.expr(f"sequence(far * {RUN}, least((cells - 1) div {RUN}, far * {RUN} + {RUN - 1}))")))
    # a few bytes for each part stand for thousands of slots, so their size must not decide the number of tasks
    parts = parts.withColumn("key", F.xxhash64(F.lit(seed), "source_key")).repartition(slots(sources.sparkSession), "source_key", "part")
    taken = parts.select("source_key", "key", "blocks", "first", F.explode(F.sequence(F.col("part") * RUN, F.least((F.col("part") + 1) * RUN, F.col("cells")) - 1)).alias("nth"))
    # each block at most ``most`` times; rounding may go one slot beyond
    taken = taken.where(F.col("nth") < F.col("blocks") * most).withColumn("slot", permuted(F.col("first") + F.col("nth"), F.lit(total).cast("bigint"), F.lit(seed)))
    taken = taken.withColumn("pass", F.expr("nth div blocks")).withColumn("within", F.col("nth") % F.col("blocks"))
    return taken.select("source_key", F.expr(f"slot div {shard}").alias("shard"), "slot", "nth", "pass", permuted(F.col("within"), F.col("blocks"), "key", "pass").alias("block_no"))


def _taken(docs: DataFrame, block: int, shard: int, most: int, seed: int, per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """A row for each document: its keys (doc_id, mark, source_key), size, taken, and its place (bucket, spread, row); and the sources' targets."""
    key = F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    sized = cut(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), key.alias("source_key"), "source", n_words(F.col("text")).alias("size")))
    # stored, so that its size is known: Spark joins it by broadcast while it is small
    wanted = stored(targets(sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size")), most))
    times = mixed_blocks(wanted, block, shard, most, seed).groupBy("source_key", "block_no").agg(F.count("*").alias("times"))
    placed = cut(_placed(sized.drop("source"), seed, per_bucket).withColumn("row", F.monotonically_increasing_id()))
    touched = placed.where("size > 0").select("row", "source_key", "at", "size", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block_no"))
    words = F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * block) - F.greatest(F.col("at"), F.col("block_no") * block)
    # exploded from a few rows, so Spark takes the blocks for small: they grow with the corpus and must not be broadcast
    taken = touched.withColumn("words", words).join(times.hint("merge"), ["source_key", "block_no"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = placed.join(taken.hint("merge"), "row", "left")
    return rows.select("doc_id", "mark", "source_key", "size", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "bucket", "spread", "row"), wanted


def mix(docs: DataFrame, block: int = 64, shard: int = 4096, most: int = 3, seed: int = 7, per_bucket: int = 256) -> DataFrame:
    """doc_id, mark (a hash of the text), size, source_size, target, taken (words of the document that the mix takes, repeats counted)."""
    rows, wanted = _taken(docs, block, shard, most, seed, per_bucket)
    return rows.join(wanted, "source_key").select("doc_id", "mark", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 7, per_bucket: int = 256) -> DataFrame:
    """The documents as often as the mix takes them, whole.

    A document's share (words taken, of its own) is rounded up or down so that the
    shares of its bucket add up, to within one document. Rows of equal doc_id, text
    and source stand for each other: what is taken of all of them comes from one.
    """
    share = F.coalesce(F.try_divide(F.col("taken").cast("double"), F.col("size")), F.lit(0.0))
    rows = _taken(docs, 64, 4096, 3, seed, per_bucket)[0].withColumn("share", F.round(share, 9))
    upto = Window.partitionBy("source_key", "bucket").orderBy("spread", "doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, 0)
    begin = _uniform(F.lit(seed), F.lit("begin"), "source_key", "bucket")
    rows = rows.withColumn("upto", F.sum("share").over(upto) + begin)
    rows = rows.withColumn("passes", F.floor(F.round("upto", 6)) - F.floor(F.round(F.col("upto") - F.col("share"), 6)))
    taken = rows.groupBy("doc_id", "mark", "source_key").agg(F.sum("passes").cast("int").alias("passes"), F.count("*").alias("rows")).where("passes > 0")
    taken = taken.select(F.col("doc_id").alias("taken_id"), F.col("mark").alias("taken_mark"), F.when(~F.col("source_key.missing"), F.col("source_key.name")).alias("taken_source"), "passes", "rows")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("bigint").alias("key_id"), F.xxhash64("text").alias("key_mark"), F.col("source").alias("key_source"))
    rows = rows.join(taken.hint("merge"), rows.key_id.eqNullSafe(taken.taken_id) & (rows.key_mark == taken.taken_mark) & rows.key_source.eqNullSafe(taken.taken_source))
    again = rows.where("rows > 1").dropDuplicates(["key_id", "key_mark", "key_source"])
    return rows.where("rows = 1").unionByName(again).select("doc", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("doc.*")
