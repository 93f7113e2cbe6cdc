"""Connected components of an edge list by alternating star steps.

Every round rewrites each node's edges towards its smallest neighbour, as a
partial aggregation and a join, so a hub's neighbours are never gathered in
one place. Rounds grow with the logarithm of the longest path. What is left of few
edges (``SMALL``) is one partition, whose rounds need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.common import cut

#: Edges (16 bytes each) that are one task's work: dealing them out would cost eight stages a round.
SMALL = 100_000


def _star(edges: DataFrame, both: bool, small: bool = False) -> DataFrame:
    """One star step over edges (a < b); ``both``: large star, else small star. ``small``: they are one partition."""
    arc = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    edge = lambda v: F.struct(F.col("m").alias("a"), F.col(v).alias("b"))
    # both ways by one pass each, not by unions, which would not keep a single partition
    arcs = edges.select(F.inline(F.array(arc("a", "b"), arc("b", "a")))) if both else edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # a window takes a single partition as it is, a join would shuffle it
    joined = arcs.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))) if small else arcs.join(least, "u")
    moved = joined.where("v > u").select(edge("v").alias("e")) if both else joined.select(F.explode(F.array(edge("v"), edge("u"))).alias("e"))
    moved = moved.select("e.*")
    return moved.where("a < b").distinct()


def _round(edges: DataFrame, count: int) -> DataFrame:
    """A large and a small star; at most ``SMALL`` edges are one partition."""
    small = count <= SMALL
    return _star(_star(edges.coalesce(1) if small else edges, True, small), False, small)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    state = _state(edges)
    while state[0]:
        edges = cut(_round(edges, state[0]))
        before, state = state, _state(edges)
        if before == state:
            break
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
