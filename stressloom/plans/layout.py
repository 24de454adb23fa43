"""From edges to a layout: distances, pairs, rates, start, refinement, centring."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.distance import all_pairs, extrema, pair_table
from ..operators.graph import canonical_edges, components
from ..operators.layout import centred, refine, start_positions
from ..operators.schedule import learning_rates
from ..operators.stress import stress
from .cuts import cut

_log = logging.getLogger(__name__)


@dataclass
class Prepared:
    """What refinement starts from. Node ids are 0 .. n - 1."""

    n: int
    edges: DataFrame
    pairs: DataFrame
    etas: list[float]
    positions: DataFrame
    components: DataFrame


def prepare(edges: DataFrame, n: int, iterations: int = 15, epsilon: float = 0.1, seed: int = 0, center: bool = True) -> Prepared:
    edges = cut(canonical_edges(edges))
    pairs = cut(pair_table(all_pairs(edges, n)))
    etas = [r["eta"] for r in learning_rates(extrema(pairs), iterations, epsilon).orderBy("t").collect()]
    positions = start_positions(edges.sparkSession.range(n).withColumnRenamed("id", "node_id"), seed)
    return Prepared(n, edges, pairs, etas, centred(positions) if center else positions, components(edges))


def lay_out(edges: DataFrame, n: int, iterations: int = 15, epsilon: float = 0.1, seed: int = 0, center: bool = True, strategy: str = "auto", order: str = "shuffled", block: int = 1024) -> tuple[Prepared, DataFrame]:
    """What was prepared, and the final positions. Without pairs the start stays."""
    ready = prepare(edges, n, iterations, epsilon, seed, center)
    if not ready.etas:
        return ready, ready.positions
    final = refine(ready.pairs, ready.positions, ready.components, ready.etas, strategy, order, seed, block)
    return ready, centred(final) if center else final


def quality(ready: Prepared, final: DataFrame, half: bool = False) -> DataFrame:
    """One row: stress before and after."""
    before = stress(ready.pairs, ready.positions, half).select(F.col("stress").alias("stress_before"))
    return before.crossJoin(stress(ready.pairs, final, half).select(F.col("stress").alias("stress_after")))


def measured(name: str, edges: DataFrame, n: int, iterations: int = 15, epsilon: float = 0.1, seed: int = 0, center: bool = True, strategy: str = "auto", order: str = "shuffled", block: int = 1024) -> tuple[Prepared, DataFrame, DataFrame]:
    """A layout whose phases are timed apart: what was prepared, the final positions, and one row of metrics. stress is of factor 1."""
    spark = edges.sparkSession
    began = [time.perf_counter()]
    seconds = lambda: began.append(time.perf_counter()) or round(began[-1] - began[-2], 3)
    edges = cut(canonical_edges(edges))
    told = {"graph": name, "n_nodes": n, "load_s": seconds()}
    ready = prepare(edges, n, iterations, epsilon, seed, center)
    told |= {"n_edges": ready.edges.count(), "n_pairs": ready.pairs.count(), "distance_s": seconds()}
    final = ready.positions
    if ready.etas:
        final = refine(ready.pairs, final, ready.components, ready.etas, strategy, order, seed, block)
        final = cut(centred(final) if center else final)
    told |= {"n_updates": told["n_pairs"] * len(ready.etas), "refine_s": seconds()}
    told |= quality(ready, final).first().asDict() | {"stress_s": seconds()}
    told["updates_per_s"] = round(told["n_updates"] / max(told["refine_s"], 1e-9), 1)
    for key, value in told.items():
        _log.info("%s: %s %s", name, key, value)
    schema = "graph string, n_nodes long, load_s double, n_edges long, n_pairs long, distance_s double, n_updates long, refine_s double, stress_before double, stress_after double, stress_s double, updates_per_s double"
    return ready, final, spark.createDataFrame([told], schema)
