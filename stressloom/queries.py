"""Registered queries over graphs of the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import sinks, sources
from .functions import rounded
from .operators import distance, graph, layout, render, schedule, stress
from .plans import sql as plans_sql
from .plans.cuts import cut, kept_until_the_end, shared_folder
from .plans.layout import lay_out, measured, prepare, quality
from .sinks.result import save_result
from .sources import mtx as mtx_data_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SIZE = (256, 256)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    labels, edges = graph.relabel(sources.customers(spark, sf_dir))
    return cut(edges), labels.count()


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The neighbourhoods of customers: a component for every 20 of them."""
    labels, edges = graph.relabel(sources.neighbourhoods(spark, sf_dir))
    return cut(edges), labels.count()


def _places(spark: SparkSession, n: int) -> DataFrame:
    return layout.start_positions(spark.range(n).withColumnRenamed("id", "node_id"))


FOREST = """raw AS (
  SELECT n_regionkey::BIGINT AS a, 1000000000 + n_nationkey::BIGINT AS b FROM nation
  UNION ALL SELECT 1000000000 + c_nationkey::BIGINT, 2000000000 + c_custkey FROM customer
), nodes AS (
  SELECT v AS orig_label, row_number() OVER (ORDER BY v) - 1 AS node_id FROM (SELECT a AS v FROM raw UNION SELECT b FROM raw)
), edges AS (
  SELECT DISTINCT least(x.node_id, y.node_id) AS src, greatest(x.node_id, y.node_id) AS dst
  FROM raw JOIN nodes x ON a = x.orig_label JOIN nodes y ON b = y.orig_label WHERE a <> b
), both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""
NEAR = """own AS (SELECT c_custkey::BIGINT AS k, c_nationkey::BIGINT AS n FROM customer), raw AS (
  SELECT a.k AS a, b.k AS b FROM own a JOIN own b ON b.k = a.k + 1 AND a.k % 20 < 19
  UNION ALL SELECT a.k, b.k FROM own a JOIN own b ON b.k = a.k - a.k % 20 + a.n % 20
), nodes AS (
  SELECT v AS orig_label, row_number() OVER (ORDER BY v) - 1 AS node_id FROM (SELECT a AS v FROM raw WHERE a <> b UNION SELECT b FROM raw WHERE a <> b)
), edges AS (
  SELECT DISTINCT least(x.node_id, y.node_id) AS src, greatest(x.node_id, y.node_id) AS dst
  FROM raw JOIN nodes x ON a = x.orig_label JOIN nodes y ON b = y.orig_label WHERE a <> b
), both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""
DIST = """walk AS (
  SELECT node_id AS u, node_id AS v, 0 AS d FROM nodes
  UNION SELECT u, dst, d + 1 FROM walk JOIN both_ways ON v = src WHERE d < {depth}
), dist AS (SELECT u, v, min(d)::INT AS d FROM walk GROUP BY u, v HAVING u < v),
pairs AS (SELECT u, v, d::DOUBLE AS dij, 1.0::DOUBLE / (d::DOUBLE * d::DOUBLE) AS wij FROM dist)"""
START = "start AS (SELECT node_id, ((node_id * 2654435761 + 12345) % 4294967296) / 4294967296.0::DOUBLE AS x, ((node_id * 2246822519 + 6789) % 4294967296) / 4294967296.0::DOUBLE AS y FROM nodes)"
NEAR_DIST = f"WITH RECURSIVE {NEAR}, {DIST.format(depth=19)}, {START} "
FOREST_DIST = f"WITH RECURSIVE {FOREST}, {DIST.format(depth=5)} "


@query(f"WITH {NEAR} SELECT src, dst FROM edges")
def edges_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)[0]


@query(f"WITH {FOREST} SELECT src, dst FROM both_ways")
def edges_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mirrored(_forest(spark, sf_dir)[0])


@query(f"WITH {FOREST} SELECT src AS node_id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbours FROM both_ways GROUP BY src")
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_forest(spark, sf_dir)[0]).select("node_id", F.concat_ws(",", F.transform("neighbours", lambda v: v.cast("string"))).alias("neighbours"))


@query(f"WITH {FOREST} SELECT node_id, orig_label FROM nodes")
def node_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relabel(sources.customers(spark, sf_dir))[0]


@query(f"WITH {FOREST} SELECT node_id, count(src)::BIGINT AS degree FROM (SELECT node_id FROM nodes UNION ALL SELECT (SELECT max(node_id) + 1 FROM nodes)) LEFT JOIN both_ways ON node_id = src GROUP BY node_id")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _forest(spark, sf_dir)
    return graph.complete_nodes(n + 1, edges)


@query(f"{FOREST_DIST} SELECT node_id, least(node_id, min(u)) AS component FROM nodes LEFT JOIN dist ON v = node_id GROUP BY node_id")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_forest(spark, sf_dir)[0])


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, 1000000000 + l_partkey AS b FROM lineitem)
SELECT count(*)::BIGINT AS n_edges, count(DISTINCT a)::BIGINT AS n_suppliers, count(DISTINCT b)::BIGINT AS n_parts FROM e""")
def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.canonical_edges(sources.supply(spark, sf_dir))
    return edges.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_suppliers"), F.countDistinct("dst").alias("n_parts"))


@query("""WITH f AS (
  SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)
SELECT src, dst FROM f WHERE n > (SELECT avg(n) FROM f)""")
def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.trade(spark, sf_dir)


@query(f"{FOREST_DIST} SELECT CASE WHEN u = 0 THEN v ELSE u END AS node_id, d FROM dist WHERE u = 0 OR v = 0")
def bfs_single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _forest(spark, sf_dir)
    return distance.all_pairs(edges, n, [0]).select(F.col("v").alias("node_id"), "d")


@query(f"{FOREST_DIST} SELECT u, v, d FROM dist")
def apsp_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.all_pairs(*_forest(spark, sf_dir))


@query(f"{NEAR_DIST} SELECT u, v, d FROM dist")
def apsp_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.all_pairs_by_joins(*_near(spark, sf_dir))


@query(f"{FOREST_DIST} SELECT u, v, d FROM dist")
def apsp_by_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the forest as graphs find them that no task holds: frontiers of 64 sources a row."""
    return distance.all_pairs_by_masks(_forest(spark, sf_dir)[0])


@query(f"{FOREST_DIST} SELECT d, count(*)::BIGINT AS n_pairs FROM dist GROUP BY d")
def histogram_by_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.histogram_by_masks(_forest(spark, sf_dir)[0])


@query(f"{FOREST_DIST} SELECT d, count(*)::BIGINT AS n_pairs FROM dist GROUP BY d")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.histogram(sources.customers(spark, sf_dir))


@query(f"{FOREST_DIST} SELECT u::INT AS u, v::INT AS v, dij::FLOAT AS dij, wij::FLOAT AS wij FROM pairs")
def pairs_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.narrowed(distance.pair_table(distance.all_pairs(*_forest(spark, sf_dir))))


@query(f"{NEAR_DIST} SELECT u, v, dij, wij FROM pairs")
def pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.pair_table(distance.all_pairs(*_near(spark, sf_dir)))


EXTREMES = "extremes AS (SELECT min(dij) AS dmin, max(dij) AS dmax, 1.0::DOUBLE / (max(dij) * max(dij)) AS wmin, 1.0::DOUBLE / (min(dij) * min(dij)) AS wmax FROM pairs)"


@query(f"{FOREST_DIST}, {EXTREMES} SELECT * FROM extremes")
def weight_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of the distances that occur; no pair becomes a row."""
    return distance.extrema(distance.histogram(_forest(spark, sf_dir)[0]).select(F.col("d").cast("double").alias("dij")))


@query(f"{NEAR_DIST}, {EXTREMES} SELECT t, round((1.0 / wmin) * exp(-(ln((1.0 / wmin) / (0.1 / wmax)) / 14.0) * t), 6) + 0.0 AS eta FROM extremes, (SELECT unnest(range(15))::INT AS t)")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = distance.pair_table(distance.all_pairs(*_near(spark, sf_dir)))
    return schedule.learning_rates(distance.extrema(pairs)).select("t", rounded(F.col("eta")).alias("eta"))


@query(f"WITH {FOREST}, {START} SELECT node_id, x, y FROM start")
def init_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, _forest(spark, sf_dir)[1])


@query(f"WITH {FOREST}, {START} SELECT node_id, round(x - avg(x) OVER (), 6) + 0.0 AS x, round(y - avg(y) OVER (), 6) + 0.0 AS y FROM start")
def centered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = layout.centred(_places(spark, _forest(spark, sf_dir)[1]))
    return places.select("node_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


STRESS = "SELECT round({half} * sum(wij * (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) - dij) * (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) - dij)), 4) + 0.0 AS stress FROM pairs JOIN {places} a ON u = a.node_id JOIN {places} b ON v = b.node_id"


def _stress(spark: SparkSession, sf_dir: str, half: bool) -> DataFrame:
    edges, n = _near(spark, sf_dir)
    return stress.stress(distance.pair_table(distance.all_pairs(edges, n)), _places(spark, n), half).select(rounded(F.col("stress"), 4).alias("stress"))


@query(NEAR_DIST + STRESS.format(half="1.0", places="start"))
def stress_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stress(spark, sf_dir, False)


@query(NEAR_DIST + STRESS.format(half="0.5", places="start"))
def stress_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stress(spark, sf_dir, True)


@query(f"WITH RECURSIVE {FOREST}, {DIST.format(depth=5)}, {START}, s AS ({STRESS.format(half='1.0', places='start')}) SELECT 'value' AS status, stress, (SELECT count(*) FROM (SELECT node_id FROM nodes LEFT JOIN dist ON v = node_id GROUP BY node_id HAVING count(u) = 0))::BIGINT AS n_components FROM s")
def stress_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress is summed by the search; no pair becomes a row."""
    edges, n = _forest(spark, sf_dir)
    places = _places(spark, n)
    out = stress.status(distance.stress_of(edges, n, places), places, edges, graph.components(edges))
    return out.select("status", rounded(F.col("stress"), 4).alias("stress"), "n_components")


CIRCLE = """circle AS (
  SELECT CASE WHEN n % 2 = 0 AND v = n - 1 THEN u ELSE (u + v) * ((m + 1) // 2) % m END AS round, u, v
  FROM (SELECT n, n - 1 + n % 2 AS m, unnest(range(n))::BIGINT AS u FROM (SELECT ({n})::BIGINT AS n)), LATERAL (SELECT unnest(range(u + 1, n))::BIGINT AS v))"""


@query(f"WITH {FOREST}, {CIRCLE.format(n='(SELECT count(*) FROM supplier)')} SELECT round::INT AS round, u, v FROM circle")
def circle_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier meets each other once."""
    return schedule.circle_rounds(spark, spark.read.parquet(f"{sf_dir}/supplier.parquet").count())


TILES = """across AS (SELECT round::INT AS round, u::INT AS bi, v::INT AS bj FROM circle), own AS (
  SELECT ((CASE WHEN {n} > 1 THEN {n} + {n} % 2 - 1 ELSE 0 END) + b // greatest(1, {n} // 2))::INT AS round, b::INT AS bi, b::INT AS bj FROM (SELECT unnest(range(0, {n})) AS b)),
tiles AS (SELECT * FROM across UNION ALL SELECT * FROM own)"""


#: Blocks of 256 and of 64 nodes of the forest.
_BLOCKS, _SMALL = (f"(SELECT (count(*) + {n - 1}) // {n} FROM nodes)" for n in (256, 64))


@query(f"WITH {FOREST}, {CIRCLE.format(n=_BLOCKS)}, {TILES.format(n=_BLOCKS)} SELECT round, bi, bj FROM tiles")
def tile_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.tile_rounds(spark, -(-_forest(spark, sf_dir)[1] // 256))


@query(f"WITH {FOREST}, {CIRCLE.format(n=_SMALL)}, {TILES.format(n=_SMALL)} SELECT round, count(*)::BIGINT AS n_tiles FROM tiles GROUP BY round")
def tile_round_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.tile_rounds(spark, -(-_forest(spark, sf_dir)[1] // 64)).groupBy("round").agg(F.count(F.lit(1)).alias("n_tiles"))


@query(f"WITH {FOREST}, {CIRCLE.format(n=_SMALL)}, {TILES.format(n=_SMALL)} SELECT max(n)::BIGINT AS most_tiles FROM (SELECT count(*) AS n FROM tiles GROUP BY round)")
def tile_round_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.most_tiles(schedule.tile_rounds(spark, -(-_forest(spark, sf_dir)[1] // 64)))


@query(f"WITH {FOREST}, {CIRCLE.format(n=_SMALL)}, {TILES.format(n=_SMALL)}, l AS (SELECT (node_id // 64)::INT AS b, count(*)::INT AS len FROM nodes GROUP BY 1) SELECT round, bi, bj, i.len AS li, j.len AS lj FROM tiles JOIN l i ON bi = i.b JOIN l j ON bj = j.b")
def tile_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _forest(spark, sf_dir)[1]
    return schedule.tile_shapes(schedule.tile_rounds(spark, -(-n // 64)), schedule.block_lengths(spark, n, 64))


@query(f"WITH {FOREST} SELECT node_id, (node_id // 64)::INT AS b, (node_id % 64)::INT AS place FROM nodes")
def node_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    block, place = schedule.in_block(F.col("node_id"), 64)
    return spark.range(_forest(spark, sf_dir)[1]).withColumnRenamed("id", "node_id").select("node_id", block, place)


@query(f"WITH {FOREST} SELECT (node_id // 64)::INT AS b, min(node_id)::BIGINT AS start, count(*)::INT AS len FROM nodes GROUP BY 1")
def block_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.block_lengths(spark, _forest(spark, sf_dir)[1], 64)


#: The places of nodes inside a stretch of customers, of which there are n.
SEATS = "seats AS (SELECT node_id, orig_label // 20 AS stretch, row_number() OVER (PARTITION BY orig_label // 20 ORDER BY node_id) - 1 AS seat, count(*) OVER (PARTITION BY orig_label // 20) AS n FROM nodes)"
#: Rounds inside a stretch.
STRETCHES = f"""{SEATS},
circle AS (SELECT CASE WHEN n % 2 = 0 AND b = n - 1 THEN a ELSE (a + b) * ((m + 1) // 2) % m END AS round, u, v, stretch FROM (
  SELECT x.stretch, x.node_id AS u, y.node_id AS v, x.seat AS a, y.seat AS b, x.n, x.n - 1 + x.n % 2 AS m FROM seats x JOIN seats y ON x.stretch = y.stretch AND x.seat < y.seat))"""


def _sgd(steps: str, rounds: str = STRETCHES, turns: int = 19, at: str = "s.step % {turns}", graph: str = NEAR, depth: int = 19) -> str:
    """The whole refinement by fixed rounds, of which a sweep has `turns`, as a recursive table of positions. at: the round of a step."""
    return f"""WITH RECURSIVE {graph}, {DIST.format(depth=depth)}, {START}, {EXTREMES}, {rounds},
half AS (SELECT round AS r, c.u AS node, c.v AS other, d FROM circle c JOIN dist USING (u, v) UNION ALL SELECT round, c.v, c.u, d FROM circle c JOIN dist USING (u, v)),
rate AS (SELECT 1.0 / wmin AS high, 0.1 / wmax AS low FROM extremes),
st AS (
  SELECT 0 AS step, node_id AS node, x, y FROM start
  UNION ALL
  SELECT step + 1, node,
    x + CASE WHEN d IS NULL THEN 0.0 ELSE least(eta / (d * d), 1.0) * ((nrm - d) / 2.0) * ((xo - x) / nrm) END,
    y + CASE WHEN d IS NULL THEN 0.0 ELSE least(eta / (d * d), 1.0) * ((nrm - d) / 2.0) * ((yo - y) / nrm) END
  FROM (
    SELECT s.step, s.node, s.x, s.y, o.x AS xo, o.y AS yo, h.d::DOUBLE AS d, high * exp(-(ln(high / low) / 14.0) * (s.step // {turns})) AS eta,
      greatest(sqrt((o.x - s.x) * (o.x - s.x) + (o.y - s.y) * (o.y - s.y)), 1e-12) AS nrm
    FROM st s LEFT JOIN half h ON h.node = s.node AND h.r = {at.format(turns=turns)} LEFT JOIN st o ON o.node = h.other CROSS JOIN rate
    WHERE s.step < {steps})
), final AS (SELECT node AS node_id, x, y FROM st WHERE step = {steps}) """


PLACES = "SELECT node_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM final"


def _refined(spark: SparkSession, sf_dir: str, audit: bool = False, iterations: int | None = None):
    ready = prepare(*_near(spark, sf_dir), center=False)
    return ready, layout.refine(ready.pairs, ready.positions, ready.components, ready.etas[:iterations], order="fixed", audit=audit)


@query(_sgd("285") + PLACES)
def sgd_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: 15 sweeps over the neighbourhoods of customers by fixed rounds."""
    return _refined(spark, sf_dir)[1].select("node_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query(_sgd("19") + PLACES)
def sgd_one_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir, iterations=1)[1].select("node_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query(_sgd("1") + PLACES)
def sgd_one_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round of each component as joins and a sum of deltas: its pairs are disjoint."""
    ready = prepare(*_near(spark, sf_dir), center=False)
    stretch = Window.partitionBy("component")
    seats = ready.components.select("node_id", (F.row_number().over(stretch.orderBy("node_id")) - 1).alias("seat"), F.count(F.lit(1)).over(stretch).alias("n"))
    of = lambda c: seats.select(F.col("node_id").alias(c), F.col("seat").alias(f"{c}_seat"), *(["n"] if c == "u" else []))
    even_last = (F.col("n") % 2 == 0) & (F.col("v_seat") == F.col("n") - 1)
    starts = F.when(even_last, F.col("u_seat") == 0).otherwise((F.col("u_seat") + F.col("v_seat")) % (F.col("n") - 1 + F.col("n") % 2) == 0)
    first = ready.pairs.join(of("u"), "u").join(of("v"), "v").where(starts).select(*ready.pairs.columns)
    deltas = layout.pair_deltas(first, ready.positions, ready.etas[0])
    return layout.scatter_add(ready.positions, deltas).select("node_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


AUDIT = """, log AS (SELECT 0::INT AS iteration, row_number() OVER (PARTITION BY stretch ORDER BY round, c.u) - 1 AS record_idx, c.u, c.v, d, round(a.x, 6) + 0.0 AS xi, round(a.y, 6) + 0.0 AS yi, round(b.x, 6) + 0.0 AS xj, round(b.y, 6) + 0.0 AS yj
  FROM circle c JOIN dist USING (u, v) JOIN st a ON a.step = round AND a.node = c.u JOIN st b ON b.step = round AND b.node = c.v) """


@query(_sgd("19") + AUDIT + "SELECT iteration, record_idx, u, v, xi, yi, xj, yj FROM log")
def sgd_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _refined(spark, sf_dir, audit=True, iterations=1)[1]
    return log.select("iteration", "record_idx", "u", "v", *(rounded(F.col(c)).alias(c) for c in ("xi", "yi", "xj", "yj")))


@query(_sgd("19") + AUDIT + ", numbers AS (SELECT u, v, dij, wij, row_number() OVER (ORDER BY u, v) - 1 AS pair_idx FROM pairs) SELECT record_idx, pair_idx, u, v, dij, wij, xi, yi, xj, yj FROM log JOIN numbers USING (u, v)")
def sgd_audit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a sweep joined to its pairs."""
    ready, log = _refined(spark, sf_dir, audit=True, iterations=1)
    joined = layout.audit_pairs(log, distance.indexed(ready.pairs))
    return joined.select("record_idx", "pair_idx", "u", "v", "dij", "wij", *(rounded(F.col(c)).alias(c) for c in ("xi", "yi", "xj", "yj")))


@query(f"{NEAR_DIST} SELECT t AS iteration, (SELECT count(*) FROM dist)::BIGINT AS n_updates FROM (SELECT unnest(range(15))::INT AS t)")
def sgd_update_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir, audit=True)[1].groupBy("iteration").agg(F.count(F.lit(1)).alias("n_updates"))


@query(_sgd("285") + STRESS.format(half="1.0", places="final"))
def sgd_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, final = _refined(spark, sf_dir)
    return stress.stress(ready.pairs, final).select(rounded(F.col("stress"), 4).alias("stress"))


@query(f"""{NEAR_DIST}, moves AS (
  SELECT u, v, least(wij * 16.0, 1.0) * ((n - dij) / 2.0) * (dx / n) AS sx, least(wij * 16.0, 1.0) * ((n - dij) / 2.0) * (dy / n) AS sy FROM (
    SELECT u, v, dij, wij, a.x - b.x AS dx, a.y - b.y AS dy, greatest(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 1e-12) AS n
    FROM pairs JOIN start a ON u = a.node_id JOIN start b ON v = b.node_id)
), moved AS (SELECT u AS node_id, -sx AS dx, -sy AS dy FROM moves UNION ALL SELECT v, sx, sy FROM moves)
SELECT node_id, round(x + sum(dx), 6) + 0.0 AS x, round(y + sum(dy), 6) + 0.0 AS y FROM start JOIN moved USING (node_id) GROUP BY node_id, x, y""")
def scatter_add_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _near(spark, sf_dir)
    places = _places(spark, n)
    deltas = layout.pair_deltas(distance.pair_table(distance.all_pairs(edges, n)), places, 16.0)
    return layout.scatter_add(places, deltas).select("node_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


VIEW = "view_port AS (SELECT min(x) - greatest(max(x) - min(x), 1e-6) * 0.05 AS x_min, max(x) + greatest(max(x) - min(x), 1e-6) * 0.05 AS x_max, min(y) - greatest(max(y) - min(y), 1e-6) * 0.05 AS y_min, max(y) + greatest(max(y) - min(y), 1e-6) * 0.05 AS y_max FROM start)"
SQUARE = "square AS (SELECT node_id, 2.0 * (x - x_min) / (x_max - x_min) - 1.0 AS nx, 2.0 * (y - y_min) / (y_max - y_min) - 1.0 AS ny FROM start, view_port)"
PIXELS = "pix AS (SELECT node_id, floor((nx + 1.0) / 2.0 * 255 + 0.5)::INT AS px, floor((1.0 - ny) / 2.0 * 255 + 0.5)::INT AS py FROM square)"
LINES = """ends AS (SELECT a.px AS x0, a.py AS y0, b.px AS x1, b.py AS y1 FROM edges JOIN pix a ON src = a.node_id JOIN pix b ON dst = b.node_id),
steps AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS s FROM ends), along AS (SELECT *, unnest(range(0, s + 1)) AS i FROM steps),
line_pixels AS (SELECT floor(x0 + (x1 - x0) * i / greatest(s, 1)::DOUBLE + 0.5)::INT AS px, floor(y0 + (y1 - y0) * i / greatest(s, 1)::DOUBLE + 0.5)::INT AS py, count(*)::BIGINT AS n FROM along GROUP BY 1, 2)"""
DOTS = "dots AS (SELECT DISTINCT (px + ox)::INT AS px, (py + oy)::INT AS py FROM pix, (SELECT unnest(range(-4, 5)) AS ox), (SELECT unnest(range(-4, 5)) AS oy) WHERE ox * ox + oy * oy <= 16 AND px + ox BETWEEN 0 AND 255 AND py + oy BETWEEN 0 AND 255)"
LAYERS = "SELECT px, py, floor((0.122 + (1.0 - 0.122) * pow(1.0 - 0.7, n)) * 255.0 + 0.5)::INT AS r, floor((0.467 + (1.0 - 0.467) * pow(1.0 - 0.7, n)) * 255.0 + 0.5)::INT AS g, floor((0.706 + (1.0 - 0.706) * pow(1.0 - 0.7, n)) * 255.0 + 0.5)::INT AS b, 255 AS a FROM line_pixels"
DRAWN = f"WITH {FOREST}, {START}, {VIEW}, {SQUARE}, {PIXELS}, {LINES}, {DOTS} "


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges, n = _forest(spark, sf_dir)
    places = _places(spark, n)
    square = render.to_square(places, render.viewport(places))
    return edges, places, render.to_pixels(square, *SIZE)


@query(f"{DRAWN} SELECT x_min, x_max, y_min, y_max FROM view_port")
def viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.viewport(_drawn(spark, sf_dir)[1])


@query(f"{DRAWN} SELECT node_id, round(nx, 6) + 0.0 AS nx, round(-ny, 6) + 0.0 AS ny FROM square")
def ndc_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _drawn(spark, sf_dir)[1]
    return render.to_square(places, render.viewport(places), y_up=False).select("node_id", rounded(F.col("nx")).alias("nx"), rounded(F.col("ny")).alias("ny"))


@query(f"{DRAWN} SELECT src, dst, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edges JOIN start a ON src = a.node_id JOIN start b ON dst = b.node_id")
def edge_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, places, _ = _drawn(spark, sf_dir)
    return render.edge_vertices(edges, places)


@query(f"{DRAWN} SELECT px, py, n FROM line_pixels")
def edge_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, pixels = _drawn(spark, sf_dir)
    return render.edge_pixels(edges, pixels)


@query(f"{DRAWN} SELECT px, py FROM dots")
def node_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.node_pixels(_drawn(spark, sf_dir)[2], 4, *SIZE)


@query(f"{DRAWN} {LAYERS}")
def pixel_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, pixels = _drawn(spark, sf_dir)
    return render.blend(render.edge_pixels(edges, pixels))


@query(f"{DRAWN} {LAYERS} ANTI JOIN dots USING (px, py) UNION ALL SELECT px, py, 31, 119, 180, 255 FROM dots")
def picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, places, _ = _drawn(spark, sf_dir)
    return render.picture(edges, places, *SIZE)


#: The supply graph on 2048 by 2048 pixels.
SUPPLY = """raw AS (SELECT DISTINCT l_suppkey AS a, 1000000000 + l_partkey AS b FROM lineitem), nodes AS (
  SELECT v AS orig_label, row_number() OVER (ORDER BY v) - 1 AS node_id FROM (SELECT a AS v FROM raw UNION SELECT b FROM raw)
), edges AS (SELECT DISTINCT least(x.node_id, y.node_id) AS src, greatest(x.node_id, y.node_id) AS dst FROM raw JOIN nodes x ON a = x.orig_label JOIN nodes y ON b = y.orig_label)"""
LARGE = f"WITH {SUPPLY}, {START}, {VIEW}, {SQUARE}, {PIXELS}, {LINES}, {DOTS}".replace("2.0 * 255", "2.0 * 2047").replace("AND 255", "AND 2047")


@query(f"""{LARGE}, pixels AS ({LAYERS} ANTI JOIN dots USING (px, py) UNION ALL SELECT px, py, 31, 119, 180, 255 FROM dots)
SELECT (px // 256)::INT AS tx, (py // 256)::INT AS ty, count(*)::BIGINT AS n_pixels, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b, sum((px * 31 + py) % 1009 * r)::BIGINT AS placed FROM pixels GROUP BY 1, 2""")
def picture_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of 2048 by 2048 pixels of all that suppliers and parts share, summed by image tile."""
    labels, edges = graph.relabel(sources.supply(spark, sf_dir))
    drawn = render.picture(edges, layout.start_positions(labels.select("node_id")))
    sums = [F.sum(c).alias(c) for c in "rgb"]
    placed = F.sum((F.col("px") * 31 + F.col("py")) % 1009 * F.col("r")).alias("placed")
    return drawn.groupBy(F.floor(F.col("px") / 256).cast("int").alias("tx"), F.floor(F.col("py") / 256).cast("int").alias("ty")).agg(F.count(F.lit(1)).alias("n_pixels"), *sums, placed)


HASH = """(((h % 65536) * 40503 + (h // 65536) * 30011 + 977) % 2147483648)"""


@query(f"""WITH v AS (SELECT unnest(range(5 * (SELECT count(*) FROM supplier)))::BIGINT AS id), p AS (SELECT a.id AS src, b.id AS dst, ((a.id * 1103515245 + 12345 + 34) % 2147483648) AS h FROM v a JOIN v b ON a.id < b.id),
q AS (SELECT src, dst, ((h + dst) * 1103515245 + 12345) % 2147483648 AS h FROM p)
SELECT src, dst FROM q WHERE {HASH} / 2147483648.0::DOUBLE < 0.005""")
def gnp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random graph of five nodes a supplier."""
    return sources.gnp_graph(spark, 5 * spark.read.parquet(f"{sf_dir}/supplier.parquet").count())


@query("SELECT k AS src, (k + 1) % n AS dst FROM (SELECT n, unnest(range(n))::BIGINT AS k FROM (SELECT count(*) AS n FROM customer))")
def ring_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of as many nodes as there are customers."""
    return sources.ring_graph(spark, spark.read.parquet(f"{sf_dir}/customer.parquet").count())


@query(f"""WITH {FOREST}, {START} SELECT 0 AS section, i AS ordinal, line FROM (SELECT unnest(range(5))::BIGINT AS i, unnest(['# forest', '# Timestamp: 2024-01-01 00:00:00', '# Node count: ' || (SELECT count(*) FROM nodes), '# Edge count: ' || (SELECT count(*) FROM edges), '']) AS line)
UNION ALL SELECT 1, 0, '# Edges (source target)' UNION ALL SELECT 2, row_number() OVER (ORDER BY src, dst) - 1, src || ' ' || dst FROM edges
UNION ALL SELECT 3, 0, '' UNION ALL SELECT 3, 1, '# Positions (x y)' UNION ALL SELECT 4, node_id, printf('%.9f %.9f', x, y) FROM start""")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _forest(spark, sf_dir)
    return sinks.result_rows(edges, _places(spark, n), "forest", "2024-01-01 00:00:00")


@query(f"WITH {FOREST}, {START} SELECT 'edge' AS part, row_number() OVER (ORDER BY src, dst) - 1 AS ordinal, src::DOUBLE AS a, dst::DOUBLE AS b FROM edges UNION ALL SELECT 'position', node_id, round(printf('%.9f', x)::DOUBLE, 6) + 0.0, round(printf('%.9f', y)::DOUBLE, 6) + 0.0 FROM start")
def result_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a result file, read back."""
    rows = result_lines(spark, sf_dir).select((F.col("section").cast("long") * 1_000_000_000 + F.col("ordinal")).alias("line_id"), "line")
    return sources.parse_result(rows).select("part", "ordinal", rounded(F.col("a")).alias("a"), rounded(F.col("b")).alias("b"))


def _mtx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest as lines of a MatrixMarket file, with loops and values in it."""
    edges, n = _forest(spark, sf_dir)
    every = edges.select("src", "dst").unionByName(spark.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst")))
    body = every.select((F.col("dst") * 1_000_000 + F.col("src") + 10).alias("line_id"), F.format_string("%d %d %s", F.col("dst") + 1, F.col("src") + 1, F.lit(".5e-3")).alias("line"))
    count = every.agg(F.lit(2).cast("long").alias("line_id"), F.format_string("%d %d %d", F.lit(n), F.lit(n), F.count(F.lit(1))).alias("line"))
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real symmetric"), (1, "% a comment")], "line_id long, line string")
    return head.unionByName(count).unionByName(body)


@query(f"WITH {FOREST} SELECT src, dst FROM edges")
def mtx_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical_edges(sources.parse_mtx(_mtx(spark, sf_dir)))


@query(f"WITH {FOREST} SELECT src, dst FROM edges")
def mtx_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest written as a MatrixMarket folder and read by ranges of 10,000 bytes."""
    mtx_data_source.register(spark)
    path = f"{shared_folder(spark)}/stressloom-{uuid.uuid4().hex}"
    lines = _mtx(spark, sf_dir)
    lines.repartitionByRange("line_id").sortWithinPartitions("line_id").select("line").write.text(path)
    kept_until_the_end(spark, path)
    return graph.canonical_edges(spark.read.format("mtx").option("bytes", 10_000).load(path))


@query(f"WITH {FOREST}, c AS (SELECT count(*)::BIGINT AS n FROM nodes), e AS (SELECT count(*)::BIGINT AS e FROM edges) SELECT n AS n_rows, n AS n_cols, n + e AS nnz, n + e AS n_entries FROM c, e")
def mtx_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.probe_mtx(_mtx(spark, sf_dir))


@query()
def layout_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress before and after over the neighbourhoods of customers, in a shuffled order: rows only."""
    labels, edges = graph.relabel(sources.neighbourhoods(spark, sf_dir))
    ready, final = lay_out(edges, labels.count(), seed=7)
    return quality(ready, final)


#: Tiles of blocks of 512 nodes: r and s are a pair's round and sub-round. As stretches don't touch, only the order inside each counts: it has at most 80 different (r, s).
TILED = f"""{SEATS}, met AS (SELECT x.stretch, x.node_id AS u, y.node_id AS v, x.node_id // 512 AS bi, y.node_id // 512 AS bj FROM seats x JOIN seats y ON x.stretch = y.stretch AND x.node_id < y.node_id),
blocks AS (SELECT k, k - 1 + k % 2 AS m FROM (SELECT max(node_id) // 512 + 1 AS k FROM nodes)),
ends AS (SELECT bi, bj, u AS node, bi <> bj AND false AS side FROM met UNION SELECT bi, bj, v, bi <> bj FROM met),
ranks AS (SELECT *, row_number() OVER (PARTITION BY bi, bj, side ORDER BY node) - 1 AS place, count(*) OVER (PARTITION BY bi, bj, side) AS n FROM ends),
placed AS (SELECT met.*, a.place AS a, b.place AS b, a.n AS na, b.n AS nb FROM met JOIN ranks a ON a.bi = met.bi AND a.bj = met.bj AND a.node = u AND NOT a.side JOIN ranks b ON b.bi = met.bi AND b.bj = met.bj AND b.node = v AND b.side = (met.bi <> met.bj)),
timed AS (SELECT stretch, u, v, bi, bj,
    CASE WHEN bi = bj THEN CASE WHEN k > 1 THEN m ELSE 0 END + bi // greatest(1, k // 2) WHEN k % 2 = 0 AND bj = k - 1 THEN bi ELSE (bi + bj) * ((m + 1) // 2) % m END AS r,
    CASE WHEN bi <> bj THEN (a - b + greatest(na, nb)) % greatest(na, nb) WHEN na % 2 = 0 AND b = na - 1 THEN a ELSE (a + b) * ((na + na % 2) // 2) % (na - 1 + na % 2) END AS s FROM placed, blocks),
circle AS (SELECT dense_rank() OVER (PARTITION BY stretch ORDER BY bi = bj, s) - 1 AS round, u, v, bi, bj, r, s FROM timed)"""


@query(_sgd("1200", TILED, 80) + PLACES)
def layout_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 sweeps of the tiled strategy, which no single task holds, in a fixed order."""
    final = lay_out(*_near(spark, sf_dir), center=False, strategy="tiles", order="fixed", block=512)[1]
    return final.select("node_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query(_sgd("160", TILED, 80) + """, told AS MATERIALIZED (SELECT t, t * 80 + round AS step, row_number() OVER (ORDER BY t, r, c.bi, c.bj, s, c.u, c.v) - 1 AS record_idx, c.u, c.v FROM circle c JOIN dist USING (u, v), (SELECT unnest(range(2)) AS t))
SELECT t::INT AS iteration, record_idx, told.u, told.v, round(a.x, 6) + 0.0 AS xi, round(a.y, 6) + 0.0 AS yi, round(b.x, 6) + 0.0 AS xj, round(b.y, 6) + 0.0 AS yj
  FROM told JOIN st a ON a.step = told.step AND a.node = told.u JOIN st b ON b.step = told.step AND b.node = told.v""")
def tile_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of two sweeps of tiles: each pair once a sweep, with tickets that run on over rounds and tiles."""
    ready = prepare(*_near(spark, sf_dir), center=False)
    log = layout.refine(ready.pairs, ready.positions, ready.components, ready.etas[:2], strategy="tiles", order="fixed", block=512, audit=True)
    return log.select("iteration", "record_idx", "u", "v", *(rounded(F.col(c)).alias(c) for c in ("xi", "yi", "xj", "yj")))


#: The order of a stretch's sweep by a hash of its pairs, at most 190, a pair a step; the second sweep has another.
HASHED = f"""{SEATS}, circle AS (SELECT t * 190 + row_number() OVER (PARTITION BY t, stretch ORDER BY {HASH}, u, v) - 1 AS round, u, v FROM (
  SELECT t, stretch, u, v, ((h + v) * 1103515245 + 12345) % 2147483648 AS h FROM (SELECT t, x.stretch, x.node_id AS u, y.node_id AS v, (x.node_id * 1103515245 + 12345 + 5 + t) % 2147483648 AS h
    FROM (SELECT unnest(range(2)) AS t), seats x JOIN seats y ON x.stretch = y.stretch AND x.node_id < y.node_id)))"""


@query(_sgd("380", HASHED, 190, "s.step") + PLACES)
def sgd_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sweeps of each component's pairs one by one in the order of a hash, by levels of pairs that don't depend on each other."""
    ready = prepare(*_near(spark, sf_dir), center=False)
    final = layout.refine(ready.pairs, ready.positions, ready.components, ready.etas[:2], strategy="sequential", order="hash", seed=5)
    return final.select("node_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query(_sgd("38") + PLACES)
def sgd_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sweeps over the neighbourhoods of customers: a group a component, as many as the table gives."""
    ready = prepare(*_near(spark, sf_dir), center=False)
    final = layout.refine(ready.pairs, ready.positions, ready.components, ready.etas[:2], strategy="rounds", order="fixed")
    return final.select("node_id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query(_sgd("38") + PLACES)
def layout_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function, called in SQL on a row a node, which holds the node's pairs with larger ones."""
    plans_sql.register(spark)
    ready = prepare(*_near(spark, sf_dir), center=False)
    of = ready.pairs.groupBy("u").agg(F.collect_list(F.struct("v", "dij")).alias("p")).select("u", "p.v", "p.dij")
    joined = of.join(ready.components.withColumnRenamed("node_id", "u"), "u").select("component", "u", "v", "dij")
    joined.createOrReplaceTempView("stressloom_pairs")
    rates = ", ".join(f"{eta!r}D" for eta in ready.etas[:2])
    return spark.sql(f"SELECT node_id, round(x, 6) + 0.0D AS x, round(y, 6) + 0.0D AS y FROM lay_out(TABLE(stressloom_pairs), array({rates}))")


@query(_sgd("285") + f"""SELECT (SELECT count(*) FROM nodes)::BIGINT AS n_nodes, (SELECT count(*) FROM edges)::BIGINT AS n_edges, (SELECT count(*) FROM dist)::BIGINT AS n_pairs, (SELECT 15 * count(*) FROM dist)::BIGINT AS n_updates,
  ({STRESS.format(half="1.0", places="start")}) AS stress_before, ({STRESS.format(half="1.0", places="final")}) AS stress_after""")
def layout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics row of a layout of the neighbourhoods of customers, without its seconds."""
    told = measured("neighbourhoods", *_near(spark, sf_dir), center=False, strategy="rounds", order="fixed")[2]
    return told.select("n_nodes", "n_edges", "n_pairs", "n_updates", rounded(F.col("stress_before"), 4).alias("stress_before"), rounded(F.col("stress_after"), 4).alias("stress_after"))


@query(f"WITH {FOREST}, {START} SELECT 'edge' AS part, row_number() OVER (ORDER BY src, dst) - 1 AS ordinal, src::DOUBLE AS a, dst::DOUBLE AS b FROM edges UNION ALL SELECT 'position', node_id, round(printf('%.9f', x)::DOUBLE, 6) + 0.0, round(printf('%.9f', y)::DOUBLE, 6) + 0.0 FROM start")
def result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest and its start positions as a result file that tasks write, read back."""
    edges, n = _forest(spark, sf_dir)
    path = f"{shared_folder(spark)}/stressloom-{uuid.uuid4().hex}.txt"
    save_result(edges, _places(spark, n), path, "forest")
    kept_until_the_end(spark, path)
    return sources.parse_result(sources.result_lines(spark, path)).select("part", "ordinal", rounded(F.col("a")).alias("a"), rounded(F.col("b")).alias("b"))
