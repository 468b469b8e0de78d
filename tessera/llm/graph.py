"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (the smallest node of its component), for every node that an edge names; stands on a staged table.

    edges: columns a, b. Alternates large-star and small-star steps until all edges lead straight
    to roots; both only take minima per node and join them back, so a node with very many edges
    needs no list of them, and joins on it can be split. Each step is written to the shared folder. The steps needed
    grow with the logarithm of the nodes; more than `most` raise an error.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage(pairs, "edges")
    for _ in range(most):
        # large star: every larger neighbour of a node moves to the node's smallest neighbour (or itself)
        both = pairs.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(pairs.select(F.col("v").alias("n"), F.col("u").alias("o")))
        low = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
        large = both.filter("o > n").join(low, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: every smaller neighbour, and the node itself, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        before, pairs = pairs, stage(small, "edges")
        unstage(before)
        # done when every edge leads straight to a root: no node has two edges, and no edge's end has an edge itself
        many = pairs.groupBy("u").count().filter("count > 1").select(F.col("u").alias("n"))
        further = pairs.select(F.col("v").alias("n")).distinct().join(pairs.select(F.col("u").alias("n")), "n", "left_semi")
        if not many.unionByName(further).take(1):
            out = pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            out._staged = pairs._staged
            return out
    raise RuntimeError(f"components aren't finished after {most} steps")
