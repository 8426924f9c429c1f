"""Connected components of an edge list by repeated minimum labels with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the edges (a long, b long): the smallest node each can reach.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round is two aggregations, a hub's
    neighbours are reduced to minima on the map side, and the rounds grow with the logarithm of the longest chain.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    both = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = common.materialize(both, "edges")
    while True:
        # large star: each neighbour above the node links to the least of the node and its neighbours
        around = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its smaller neighbours link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        done = low.select("a", F.col("m").alias("b")).unionByName(small).where(F.col("a") != F.col("b")).distinct()
        following = common.materialize(done, "edges")
        if following.exceptAll(current).isEmpty() and following.count() == current.count():
            break
        current = following
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
