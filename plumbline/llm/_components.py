"""Connected components of a graph of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) pairs to (node, root): the smallest node of each component, for every node but the roots.

    Alternates large and small stars (each node hands its larger, then its
    smaller neighbours to the smallest) until the links are stars; the number of
    rounds grows with the logarithm of the longest path.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = stored(small)
        # stars: no node has two links down, and no root has a link down
        tops = small.groupBy("a").count()
        if small.join(tops.select("a").withColumnRenamed("a", "b"), "b", "left_semi").isEmpty() and tops.where("count > 1").isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = small
