"""Connected components of an edge table, by alternating stars over the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.session import materialise

#: More rounds than any chain needs: each round at least halves the depth of the trees.
MAX_ROUNDS = 200


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node that has an edge to another one, with the smallest node it is connected to.

    ``edges`` may be in either direction and hold loops and repeats. Each round links the larger neighbours of every
    node to its smallest one, then its smaller ones, until the edges no longer change. A round's edges are at most
    those before, and go through files in the shared folder, so lineage stays short. A hot node is never gathered:
    rounds are joins with the smallest neighbour of each node, an aggregate that combines before the shuffle. It is
    written before the join, for Spark splits a hot key only where both sides of a join come from a plain shuffle.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    now = materialise(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        near = both(now)
        least = materialise(near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = near.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a <> b").distinct(), "large")
        own = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "own")
        small = large.join(own, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.unionAll(own.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
