"""Which record of a feature vector holds, among copies from several places.

A snapshot's authority is its first immutable record, or its first derived one where
it has none. A derived copy may differ from it by rounding (``ulps`` units in the
last place), an immutable one not at all. A group that contradicts itself fails
closed: it is a conflict with its reasons, and gives no hash to refer to; so does an
authority that is malformed, or whose vector is not the one that its hash claims.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.0**-52


def close(a: Column, b: Column, ulps: int) -> Column:
    """Whether two numbers differ by a few units in the last place at most; unknown ones are close to nothing but themselves."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= ulps * EPS * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def resolved(records: DataFrame, hash_of: Callable[[Column], Column], ulps: int = 4) -> DataFrame:
    """One row for each snapshot: authority, state (verified, invalid, conflict), reasons, copies and the verified hash.

    ``records``: snapshot_id, immutable, source, row, run_id, status, vector, claimed_count (text) and claimed_hash.
    Reasons of a conflict: ``run``, ``status``, ``immutable`` (two immutable records differ), ``derived`` (a copy differs
    from an immutable authority, or leaves out what a complete one has) and ``contradiction`` (copies without authority).
    Reasons of an invalid authority: ``count``, ``incomplete``, ``hash`` and ``status``.
    """
    whole = F.forall("vector", lambda x: x.isNotNull())
    proved = F.when(whole, hash_of(F.col("vector")))
    faults = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("claimed_count").try_cast("int") == F.size("vector"), F.lit(False)), "count"), F.when((F.col("status") == "ok") & ~F.coalesce(whole, F.lit(False)), "incomplete"),
        F.when((F.col("status") == "ok") & whole & ~F.coalesce(F.col("claimed_hash") == proved, F.lit(False)), "hash"), F.when(~F.coalesce(F.col("status") == "ok", F.lit(False)), "status")))
    rows = records.withColumns({"faults": faults, "proved": proved}).select("snapshot_id", F.struct((~F.col("immutable")).cast("int").alias("kind"), "source", "row", "run_id", "status", "vector", "faults", "proved").alias("x"))
    # authority and number of hashes are found beside the copies, so no copy is joined or repeated, and no group is gathered
    group = Window.partitionBy("snapshot_id")
    fresh = F.col("x.proved").isNotNull() & ~F.col("x.proved").eqNullSafe(F.lag("x.proved").over(group.orderBy("x.proved")))
    both = rows.withColumns({"a": F.min_by("x", F.struct("x.kind", "x.source", "x.row")).over(group), "fresh": fresh})
    a, x = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"x.{c}"))
    other = ~(x("kind").eqNullSafe(a("kind")) & x("source").eqNullSafe(a("source")) & x("row").eqNullSafe(a("row")))
    same = F.coalesce(F.forall(F.zip_with(x("vector"), a("vector"), lambda u, v: u.eqNullSafe(v)), lambda t: t), F.lit(False))
    near = F.coalesce(F.forall(F.zip_with(x("vector"), a("vector"), lambda u, v: close(u, v, ulps)), lambda t: t), F.lit(False))
    overlap = F.coalesce(F.forall(F.zip_with(x("vector"), a("vector"), lambda u, v: u.isNull() | v.isNull() | close(u, v, ulps)), lambda t: t), F.lit(False))
    ok = F.coalesce(a("status") == "ok", F.lit(False))
    against = {
        "contradiction": (a("kind") == 1) & ((F.size(x("faults")) > 0) | (F.size(a("faults")) > 0) | ~near | ~x("proved").eqNullSafe(a("proved"))),
        "derived": (x("kind") == 1) & (a("kind") == 0) & F.when(ok, ~near).otherwise(~overlap),
        "immutable": (x("kind") == 0) & F.when(ok, ~same).otherwise(~overlap),
        "run": ~x("run_id").eqNullSafe(a("run_id")),
        "status": ~x("status").eqNullSafe(a("status")),
    }
    g = both.groupBy("snapshot_id").agg(F.count("*").alias("copies"), F.first("a").alias("a"), *[F.bool_or(other & c).alias(name) for name, c in against.items()], F.count_if("fresh").alias("hashes"))
    g = g.withColumn("conflicts", F.array_compact(F.array(*[F.when(F.col(name), name) for name in against])))
    state = F.when(F.size("conflicts") > 0, "conflict").when(F.size("a.faults") > 0, "invalid").otherwise("verified")
    reasons = F.array_join(F.when(F.size("conflicts") > 0, F.col("conflicts")).otherwise(F.array_sort("a.faults")), ",")
    return g.select("snapshot_id", (F.col("a.kind") == 0).alias("immutable"), F.col("a.source").alias("source"), F.col("a.row").alias("row"), state.alias("state"), reasons.alias("reasons"), "copies", "hashes", F.when(state == "verified", F.col("a.proved")).alias("vector_hash"))
