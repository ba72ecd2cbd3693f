"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges (sums of 32-bit halves don't overflow)."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first())


def _to_least(edges: DataFrame) -> DataFrame:
    """Each edge ``(u, v)`` with the least neighbour of u, or u itself if less.

    The minima are written before the join, so that both sides are plain
    shuffles and a node with very many edges is split by the skew join.
    """
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("least")), "least")
    return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; a component is named by its least node.

    A large star links each node's greater neighbours to its least neighbour, a
    small star its lesser ones; repeated until nothing changes (a logarithmic
    number of rounds in practice) every component is a star around its least
    node.  Neighbours are only ever reduced to a minimum, never gathered.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    now = materialise(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = materialise(large, "large-star")
        small = _to_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u <> v").distinct(), "small-star")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
