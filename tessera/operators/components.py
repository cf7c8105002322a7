"""Connected components by alternating star contraction.

Every round replaces each edge by an edge to the smallest known neighbour
(large star, then small star) until the edge set is a forest of stars. All
work is grouped minima and equi-joins; nothing is collected on the driver, and
each round is written to the shared folder so that lost executors cost one
round at most. Rounds grow with the logarithm of the longest chain. A round over
:data:`FEW` edges or fewer is one task without a shuffle, so that it costs no more than its
rows, whatever the number of shuffle partitions; larger ones are dealt over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.storage import discard, materialize

#: Edges that one task takes, some tens of bytes each.
FEW = 1 << 18


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Write edges, and take their number and an order-free digest on the way."""
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b").cast("long")).alias("s")]
    table = materialize(edges.observe(seen, *metrics), "cc")
    return table, (seen.get["n"], seen.get["x"], seen.get["s"])


def _star(edges: DataFrame, large: bool, one: bool = False) -> DataFrame:
    """One star step over edges (a, b) with a > b, in ``one`` task or over the cluster."""
    kept = lambda df: df.coalesce(1) if one else df
    edges = kept(edges)
    if large:
        both = kept(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(low, "a").where(F.col("b") > F.col("a"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(low, "a")
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
    return kept(moved.unionByName(low.select("a", F.col("m").alias("b"))))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50, few: int = FEW) -> DataFrame:
    """Label the nodes of an undirected edge list.

    Returns ``(node, component)`` for every node that has an edge to another
    node; ``component`` is the smallest node of its component. Self loops,
    nulls and repeated edges are ignored; an empty edge list gives no rows.
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    state, before = _written(pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    if before[0]:
        one = False
        for _ in range(max_rounds):
            if not one and before[0] <= few:
                one, many = True, state
                state = materialize(many.coalesce(1), "cc")  # one file: a round reads it several times
                discard(many)
            step = _star(state, large=True, one=one).distinct()
            following, after = _written(_star(step, large=False, one=one).distinct())
            discard(state)
            state = following
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
