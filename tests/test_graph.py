from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stressloom import sinks, sources
from stressloom.operators import distance, graph, layout, render, schedule, stress
from stressloom.plans import cuts
from stressloom.plans.layout import lay_out, measured, quality


def test_ring_has_closed_form_distances(spark):
    d = distance.all_pairs(sources.ring_graph(spark, 10), 10)
    assert dict(d.groupBy("d").count().collect()) == {1: 10, 2: 10, 3: 10, 4: 10, 5: 5}
    assert d.agg(F.sum("d")).first()[0] == 125


@pytest.mark.parametrize(("blocks", "rounds", "widest"), [(1, 1, 1), (2, 3, 1), (3, 6, 1), (4, 5, 2), (5, 8, 2), (6, 7, 3), (7, 10, 3), (8, 9, 4), (30, 31, 15)])
def test_tiles_once_each_and_no_block_twice(spark, blocks, rounds, widest):
    rows = schedule.tile_rounds(spark, blocks).collect()
    assert len({(r["bi"], r["bj"]) for r in rows}) == len(rows) == blocks * (blocks + 1) // 2
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["round"], []).extend({r["bi"], r["bj"]})
    assert len(by) == rounds
    assert all(len(x) == len(set(x)) for x in by.values())
    assert max(sum(r["round"] == k for r in rows) for k in by) == widest


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_circle_rounds_hold_each_pair_once(spark, n):
    rows = schedule.circle_rounds(spark, n).collect()
    assert sorted((r["u"], r["v"]) for r in rows) == [(u, v) for u in range(n) for v in range(u + 1, n)]


@pytest.mark.parametrize("n", [2, 3, 8, 9])
def test_rounds_are_half_of_sums(spark, n):
    """By the formula of the SQL, in columns without nulls."""
    found = schedule.circle_rounds(spark, n)
    assert not any(c.nullable for c in found.schema)
    m = n - 1 + n % 2
    for r in found.collect():
        assert r["round"] == (r["u"] if n % 2 == 0 and r["v"] == n - 1 else (r["u"] + r["v"]) * ((m + 1) // 2) % m)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 48, 67])
def test_blocks_hold_each_pair_once(spark, n):
    for itself in (False, True):
        rows = schedule.pairs_by_blocks(spark, n, itself, block=16, strip=8).collect()
        assert sorted((r["u"], r["v"]) for r in rows) == [(u, v) for u in range(n) for v in range(u if itself else u + 1, n)]


def test_rows_of_pairs_stay_small_in_files(spark, tmp_path):
    """18 million rows each, which took 2.8 bytes a row and more the more nodes there are."""
    n = 6000
    for name, rows in (("circle", schedule.circle_rounds(spark, n)), ("tiles", schedule.tile_rounds(spark, n))):
        rows.write.parquet(str(tmp_path / name))
        assert sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet")) < 0.6 * n * n / 2
    found = spark.read.parquet(str(tmp_path / "circle"))
    ends = found.select("round", F.explode(F.array("u", "v")).alias("node"))
    assert found.agg(F.count(F.lit(1)), F.countDistinct("round"), F.max("round")).first()[:] == (n * (n - 1) // 2, n - 1, n - 2)
    assert ends.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x")).select("n", "x").distinct().count() == 1


@pytest.mark.parametrize("blocks", [84_375, 84_376])
def test_rounds_of_many_tiles(spark, blocks):
    """As many blocks as 5.4 million nodes have; (bi + bj) * (blocks + 1) / 2 takes more than 32 bits."""
    tiles = spark.createDataFrame([(blocks - 3, blocks - 2), (0, 1), (blocks - 2, blocks - 2)], "bi int, bj int")
    m = blocks - 1 + blocks % 2
    wanted = [(2 * blocks - 5) * ((m + 1) // 2) % m, (m + 1) // 2, m + (blocks - 2) // (blocks // 2)]
    assert [r[0] for r in tiles.select(schedule.tile_round(F.col("bi"), F.col("bj"), blocks)).collect()] == wanted


@pytest.mark.parametrize(("strategy", "order"), [("rounds", "shuffled"), ("rounds", "fixed"), ("sequential", "shuffled"), ("tiles", "shuffled")])
def test_strategies_lower_stress_and_centre(spark, strategy, order):
    ready, final = lay_out(sources.ring_graph(spark, 12), 12, iterations=10, seed=3, strategy=strategy, order=order, block=5)
    row = quality(ready, final).first()
    assert row["stress_after"] < 0.2 * row["stress_before"]
    mean = final.agg(F.avg("x"), F.avg("y")).first()
    assert max(abs(mean[0]), abs(mean[1])) < 1e-9


@pytest.mark.parametrize(("n", "block"), [(11, 4), (12, 5), (7, 7), (16, 4)])
def test_tiles_update_every_pair_once(spark, monkeypatch, n, block):
    """Each pair of a sweep moves once, and no node twice in a step."""
    steps = []
    monkeypatch.setattr(layout, "_step", lambda p, a, b, d, eta: steps.append((p[a, 0].astype(int), p[b, 0].astype(int))))
    nodes = np.arange(n)
    done = []
    for tile in schedule.tile_rounds(spark, -(-n // block)).collect():
        u, v = (x.ravel() for x in np.meshgrid(nodes, nodes, indexing="ij"))
        own = (u < v) & (u // block == tile["bi"]) & (v // block == tile["bj"])
        size = int(own.sum())
        if size:
            table = pa.table({"u": u[own], "v": v[own], "dij": np.ones(size), "bi": np.full(size, tile["bi"]), "bj": np.full(size, tile["bj"])})
            held = np.flatnonzero(np.isin(nodes // block, [tile["bi"], tile["bj"]])).astype(np.int64)
            places = pa.table({"node_id": held, "x": held.astype(float), "y": held.astype(float)})
            layout._tile_kernel(1.0, [0, 0, 0], True, None)(table, places)
    for a, b in steps:
        assert len({*a.tolist(), *b.tolist()}) == 2 * len(a)
        done += zip(a.tolist(), b.tolist())
    assert sorted(tuple(sorted(x)) for x in done) == [(u, v) for u in range(n) for v in range(u + 1, n)]


def test_coincident_nodes_part(spark):
    pairs = spark.createDataFrame([(0, 1, 1.0, 1.0)], "u long, v long, dij double, wij double")
    places = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.5, 0.5)], "node_id long, x double, y double")
    for guard in ("fixed", "angle", "normal"):
        moved = sorted(map(tuple, layout.scatter_add(places, layout.pair_deltas(pairs, places, 1.0, guard)).collect()))
        assert abs(np.hypot(moved[0][1] - moved[1][1], moved[0][2] - moved[1][2]) - 1) < 1e-3
    parts = spark.createDataFrame([(0, 0), (1, 0)], "node_id long, component long")
    kernel = sorted(map(tuple, layout.refine(pairs, places, parts, [1.0]).collect()))
    fixed = sorted(map(tuple, layout.scatter_add(places, layout.pair_deltas(pairs, places, 1.0)).collect()))
    assert np.allclose(kernel, fixed)


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k", "id % 3 AS rest").repartition(7)
    got = cuts.numbered(rows, "at", "k").collect()
    assert sorted((r["at"], r["k"]) for r in got) == [(i, i) for i in range(5000)]
    assert cuts.numbered(rows.limit(0), "at", "k").count() == 0


def test_tables_cut_on_the_way_are_deleted(spark):
    held = len(cuts._tables(spark))
    out = cuts.finished(spark, lambda: cuts.cut(cuts.cut(spark.range(5)).where("id > 1")))
    assert out.count() == 3 and len(cuts._tables(spark)) == held + 1


def test_metrics_and_titles(spark, tmp_path):
    ready, final, told = measured("ring", sources.ring_graph(spark, 10), 10)
    row = told.first()
    assert (row["n_nodes"], row["n_edges"], row["n_pairs"], row["n_updates"]) == (10, 10, 45, 675)
    assert row["stress_after"] < row["stress_before"] and row["updates_per_s"] > 0
    image = sinks.image(render.picture(ready.edges, final, 32, 32, 2), 32, 32)
    titles = [sinks.stress_title("ring", row[c]) for c in ("stress_before", "stress_after")]
    sinks.write_side_by_side(str(tmp_path / "two.png"), image, image, titles)
    assert all(t.encode() in (tmp_path / "two.png").read_bytes() for t in titles)
    assert sinks.picture_size("64x48") == (64, 48) and sinks.picture_radius("2.5") == 2.5
    for bad in ("64", "0x4", "axb"):
        with pytest.raises(ValueError):
            sinks.picture_size(bad)


def test_names_of_files(tmp_path):
    (tmp_path / "ring-1.txt").write_text("")
    (tmp_path / "ring-2.txt").write_text("")
    assert sources.result_path("ring", str(tmp_path)).name == "ring-2.txt"
    assert sources.result_path("ring-1", str(tmp_path)).name == "ring-1.txt"
    assert sources.result_path("none", str(tmp_path)).name == "none.txt"
    assert str(sources.result_path("a/b.txt")) == "a/b.txt"
    assert str(sources.matrix_path("bus")) == "data/bus.mtx"


def test_skips_draw_as_many_edges(spark):
    edges = sources.gnp_by_skips(spark, 400, 0.05, 3).collect()
    assert len(set(edges)) == len(edges) and all(0 <= u < v < 400 for u, v in edges)
    assert abs(len(edges) - 0.05 * 400 * 399 / 2) < 5 * (0.05 * 0.95 * 400 * 399 / 2) ** 0.5


def test_bad_rows_are_errors(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "line_id long, line string")
    for bad in ("1", "0 2", "a 2", "1 -2"):
        with pytest.raises(Exception):  # noqa: B017
            sources.parse_mtx(lines("%%MatrixMarket", "3 3 1", bad)).collect()
    pairs = spark.createDataFrame([(0, 9, 1.0, 1.0)], "u long, v long, dij double, wij double")
    places = layout.start_positions(spark.range(3).withColumnRenamed("id", "node_id"))
    with pytest.raises(Exception):  # noqa: B017
        stress.stress(pairs, places).collect()
    with pytest.raises(Exception):  # noqa: B017
        render.edge_vertices(spark.createDataFrame([(0, 9)], "src long, dst long"), places).collect()


def test_isolated_nodes_stay_and_edgeless_graphs_are_disconnected(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    ready, final = lay_out(edges, 5, iterations=3, center=False)
    before = {r["node_id"]: (r["x"], r["y"]) for r in ready.positions.collect()}
    after = {r["node_id"]: (r["x"], r["y"]) for r in final.collect()}
    assert set(after) == set(range(5))
    assert after[4] == before[4] and after[0] != before[0]
    none = edges.limit(0)
    ready, final = lay_out(none, 3)
    row = stress.stress_status(ready.pairs, final, none, graph.components(none)).first()
    assert (row["status"], row["stress"], row["n_components"]) == ("disconnected", None, 3)


def test_one_iteration_takes_the_first_rate(spark):
    pairs = distance.pair_table(distance.all_pairs(sources.ring_graph(spark, 6), 6))
    rates = schedule.learning_rates(distance.extrema(pairs), 1)
    assert [tuple(r) for r in rates.collect()] == [(0, 9.0)]
    with pytest.raises(ValueError):
        schedule.learning_rates(distance.extrema(pairs), 0)


def test_mtx_reads_any_triangle_and_drops_loops(spark, tmp_path):
    path = tmp_path / "g.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real symmetric\n% ünïcode\n4 4 4\n1 1 .5e-3\n2 1 1\n3 4 -2.5\n4 2 7\n", encoding="utf-8")
    edges = graph.canonical_edges(sources.read_mtx(spark, str(path)))
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 3), (2, 3)]
    assert tuple(sources.probe_mtx(sources.mtx_lines(spark, str(path))).first()) == (4, 4, 4, 4)


def test_result_round_trip_and_errors(spark, tmp_path):
    edges = sources.ring_graph(spark, 6)
    places = layout.start_positions(spark.range(6).withColumnRenamed("id", "node_id"))
    path = str(tmp_path / "out" / "r.txt")
    sinks.write_result(edges, places, path, "ring")
    read_edges, read_places = sources.read_result(spark, path)
    assert sorted(map(tuple, read_edges.collect())) == sorted(map(tuple, edges.collect()))
    want = {r["node_id"]: r["x"] for r in places.collect()}
    assert all(abs(want[r["node_id"]] - r["x"]) < 1e-8 for r in read_places.collect())
    bad = tmp_path / "bad.txt"
    bad.write_text("# Edges (source target)\n0 9\n\n# Positions (x y)\n0 0\n")
    with pytest.raises(ValueError):
        sources.read_result(spark, str(bad))
    bad.write_text("# Edges (source target)\n\n# Positions (x y)\n0 x\n")
    with pytest.raises(Exception):  # noqa: B017
        sources.read_result(spark, str(bad))[1].collect()


def test_picture_and_png(spark, tmp_path):
    edges = sources.ring_graph(spark, 5)
    places = layout.start_positions(spark.range(5).withColumnRenamed("id", "node_id"))
    image = sinks.image(render.picture(edges, places, 64, 48, 2), 64, 48)
    assert image.shape == (48, 64, 4) and (image[..., 0] == 31).any() and (image[..., 0] == 255).any()
    sinks.write_png(str(tmp_path / "p.png"), image)
    assert (tmp_path / "p.png").read_bytes().startswith(b"\x89PNG")


def test_distance_strategies_agree(spark):
    edges = graph.canonical_edges(sources.gnp_graph(spark, 40, 0.06, 1))
    a = sorted(map(tuple, distance.all_pairs(edges, 40).collect()))
    assert a == sorted(map(tuple, distance.all_pairs_by_joins(edges, 40).collect()))
    assert dict(distance.histogram(edges, 40).collect()) == dict(Counter(d for _, _, d in a))
    some = sorted(map(tuple, distance.all_pairs(edges, 40, [7, 3]).collect()))
    assert some == sorted(map(tuple, distance.all_pairs_by_joins(edges, 40, [7, 3]).collect()))
    parts = {r["node_id"]: r["component"] for r in graph.components(edges).collect()}
    assert all(parts[u] == parts[v] for u, v, _ in a)


def test_geography_joins_nations_to_regions_and_in_a_ring(spark):
    labels, edges = graph.relabel(sources.geography(spark, "/root/testdata/sf0.001"))
    assert (labels.count(), edges.count()) == (30, 50)
    assert graph.components(edges).select("component").distinct().count() == 1
