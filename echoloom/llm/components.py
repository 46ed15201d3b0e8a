"""Connected components by alternating star contraction, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node it can reach.

    A round links all larger neighbours of a node to its smallest neighbour (large star), then all
    smaller ones (small star). Rounds grow with the logarithm of the longest path. The smallest
    neighbours are written before they are joined, so both sides of a join are plain shuffles that
    adaptive execution can split at a node with very many neighbours. Every round is a table in
    the shared folder: a lost executor costs no earlier round.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = stored(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
