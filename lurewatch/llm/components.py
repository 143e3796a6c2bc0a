"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of the nodes in ``links (a, b)``.

    Alternating star steps: first every node ties its larger neighbours to the
    smallest node it sees, then its smaller ones.  The number of links never
    grows, long chains halve, and each round is written to the shared folder.
    The loop ends, perhaps before its first round, when the links are stars.
    """
    edges = links.select("a", "b").filter("a <> b")
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while not _stars(edges):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        small = (small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edges = stored(small, "cc")
    # Every node is now tied to its smallest one alone.
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every larger node ``a`` has one smaller node ``b``, and no node is both."""
    ends = (edges.select(F.col("a").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("root"))
            .union(edges.select("b", F.lit(0), F.lit(1))))
    both = ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("root").alias("root")).filter("tied + root > 1")
    return both.agg(F.count(F.lit(1))).first()[0] == 0
