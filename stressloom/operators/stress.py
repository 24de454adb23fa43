"""How far a layout is from its distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stress(pairs: DataFrame, positions: DataFrame, half: bool = False) -> DataFrame:
    """One row: the sum of wij * (length - dij)^2 over pairs u < v, or half of it. A pair of a node without a position is an error."""
    at = lambda c: positions.select(F.col("node_id").alias(c), F.struct("x", "y").alias(f"at{c}"))
    rows = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left")
    place = lambda c, i: F.coalesce(F.col(f"at{c}"), F.raise_error(F.concat(F.lit("no position of node "), F.col(c).cast("string"))))[i].alias(f"{i}{c}")
    rows = rows.select("dij", "wij", *(place(c, i) for c in "uv" for i in "xy"))
    dx, dy = F.col("xu") - F.col("xv"), F.col("yu") - F.col("yv")
    off = F.sqrt(dx * dx + dy * dy) - F.col("dij")
    return rows.agg(F.coalesce(F.sum((0.5 if half else 1.0) * F.col("wij") * off * off), F.lit(0.0)).alias("stress"))


def status(value: DataFrame, positions: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: status ('value', or 'disconnected' for several nodes without an edge), stress (that of value; null then) and n_components,
    nodes without an edge among them."""
    n = positions.agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    c = components.agg(F.countDistinct("component").alias("joined"), F.count(F.lit(1)).alias("inside"))
    rows = value.crossJoin(n).crossJoin(e).crossJoin(c)
    apart = (F.col("n_edges") == 0) & (F.col("n_nodes") > 1)
    return rows.select(F.when(apart, "disconnected").otherwise("value").alias("status"), F.when(~apart, F.col("stress")).alias("stress"), (F.col("joined") + F.col("n_nodes") - F.col("inside")).alias("n_components"))


def stress_status(pairs: DataFrame, positions: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """The status of a layout whose pairs are a table."""
    return status(stress(pairs, positions), positions, edges, components)
