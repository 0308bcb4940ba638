"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanweave.llm.base import stored


def _summary(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the smallest node reachable.

    Each round points the larger neighbours of a node at its smallest one (large star), then all smaller
    neighbours (small star). Minima combine before they are shuffled and the joins back to a node with many
    edges have one row on the other side, so that a hub is split by adaptive skew handling. The edges of a
    round are stored, never collected. No edges: an empty result. Raises if ``max_rounds`` don't suffice.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = _summary(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e = stored(small)
        now = _summary(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
