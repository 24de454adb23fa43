"""Connected components by alternating large and small stars, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import cut


def _settled(edges: DataFrame) -> bool:
    """Whether each node of a has one edge and none of them stands in b, so that the edges are stars already."""
    ends = edges.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    twice = ends.where("n > 1").select("node")
    inner = ends.join(edges.select(F.col("b").alias("node")), "node", "left_semi").select("node")
    return not twice.unionByName(inner).limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs, to (node, component): the smallest node that links reach.

    Nodes of no edge don't appear. A node's neighbours are never gathered: each step takes their
    minimum by a pre-aggregated group and joins it back. Loops, repeated edges and no edges at all are allowed.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = cut(small)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
