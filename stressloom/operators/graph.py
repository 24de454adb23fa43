"""Edges, nodes and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.cuts import cut, numbered


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, src < dst, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def nodes_of(edges: DataFrame) -> DataFrame:
    return mirrored(edges).select(F.col("src").alias("node_id")).distinct()


def complete_nodes(n: int, edges: DataFrame) -> DataFrame:
    """Nodes 0 .. n - 1, those without an edge among them, and their degrees."""
    found = degrees(edges)
    return edges.sparkSession.range(n).withColumnRenamed("id", "node_id").join(found, "node_id", "left").na.fill(0, ["degree"])


def adjacency(edges: DataFrame) -> DataFrame:
    return mirrored(edges).groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    return mirrored(edges).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def relabel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense ids from 0 in the order of the old ones: nodes (node_id, orig_label) and the edges by them."""
    labels = numbered(nodes_of(edges).withColumnRenamed("node_id", "orig_label"), "new_id", "orig_label").select("new_id", "orig_label")
    out = edges.select("src", "dst")
    for side in ("src", "dst"):
        out = out.join(labels.select(F.col("orig_label").alias(side), F.col("new_id").alias(f"_{side}")), side)
    return labels.withColumnRenamed("new_id", "node_id"), canonical_edges(out.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node reachable. Labels spread over edges and jump over labels until
    none changes; each step is cut, so plans stay short."""
    both = cut(mirrored(edges))
    now = cut(nodes_of(edges).select("node_id", F.col("node_id").alias("component")))
    while True:
        offered = both.join(now, both["dst"] == now["node_id"]).groupBy("src").agg(F.min("component").alias("near"))
        nearer = now.join(offered, now["node_id"] == offered["src"], "left").select("node_id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = now.select(F.col("node_id").alias("component"), F.col("component").alias("further"))
        after = cut(nearer.join(jump, "component", "left").select("node_id", "old", F.least("component", "further").alias("component")))
        if not after.where("old <> component").limit(1).count():
            return after.select("node_id", "component")
        now = after.select("node_id", "component")
