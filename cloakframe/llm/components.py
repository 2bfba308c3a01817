"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join, so that nothing about the whole graph
reaches the driver but two numbers that tell whether the edges still change.
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.scratch import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge has a > b here
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns ``a``, ``b``, long).

    ``component`` is the smallest node reachable.  Self loops, repeated edges and either
    direction are allowed; a null end drops the edge; no edges give no rows.  Only the
    last round's edges stay written.  Raises after ``rounds`` rounds, far above the logarithmic number needed.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialize(e.filter("a <> b").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(e)
    for _ in range(rounds):
        if not before[0]:
            break
        old, e = e, materialize(_small_star(_large_star(e)), "edges")
        discard(old)
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
