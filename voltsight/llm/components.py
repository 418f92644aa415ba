"""Connected components by alternating large-star and small-star steps.

Published as "Connected Components in MapReduce and Beyond" (Kiveris et al.,
2014): every step is one aggregate and one join over the edges, labels never
leave the executors, and star-shaped input converges in a few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def _towards_least(directed: DataFrame, keep_all: bool) -> DataFrame:
    """For each ``u`` with least neighbour-or-self ``m``: links of its
    neighbours to ``m`` - only of those above ``u`` (large star), or of all of
    them and of ``u`` itself (small star)."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = directed.join(least, "u")
    if keep_all:
        return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
    return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` for every node of an edge; root is the component's least node.

    Edges need not be distinct or ordered; self-links and nulls are ignored."""
    e = materialised(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both, keep_all=False)
        e = materialised(_towards_least(large, keep_all=True))
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    """Edge count and an order-free digest of the edges: equal when nothing moved."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
