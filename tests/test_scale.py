"""What graphs need that no task or driver holds: mask frontiers, fused stress, tiles in the cluster, dependency levels, tiled pictures, data sources."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stressloom import sinks, sources
from stressloom.operators import distance, graph, layout, render, schedule, stress, text
from stressloom.plans import sql as plans_sql
from stressloom.plans.layout import prepare
from stressloom.sinks import result
from stressloom.sources import mtx


def rows(df):
    return sorted(map(tuple, df.collect()))


# distances


def star(spark, centres, leaves):
    return spark.range(centres * leaves).select((F.col("id") % centres).alias("src"), (F.col("id") + centres).alias("dst"))


def test_masks_find_what_searches_find(spark):
    edges = graph.canonical_edges(sources.gnp_graph(spark, 90, 0.02, 1))
    want = rows(distance.all_pairs(edges, 90))
    assert rows(distance.all_pairs_by_masks(edges)) == want
    assert rows(distance.histogram_by_masks(edges)) == rows(distance.histogram(edges, 90))
    some = [7, 3, 7, 200]
    assert rows(distance.all_pairs_by_masks(edges, some)) == rows(distance.all_pairs_by_joins(edges, 90, [7, 3]))
    none = edges.limit(0)
    assert rows(distance.all_pairs_by_masks(none)) == rows(distance.histogram_by_masks(none)) == []


def test_64_sources_share_a_row(spark):
    edges = star(spark, 2, 640)
    levels = distance.mask_levels(edges, distance.source_blocks(edges))
    sent = sum(level.count() for level in levels[1:])
    pairs = distance.all_pairs(edges, 1282).count()
    assert pairs == 2 * (640 * 641 // 2)
    assert 2 * pairs / sent > 40


def test_lone_nodes_dont_fill_a_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 10**9), (10**9, 5)], "src long, dst long")
    assert rows(distance.all_pairs(edges, 10**9 + 1)) == [(0, 5, 2), (0, 10**9, 1), (5, 10**9, 1)]
    assert rows(distance.histogram(edges, 10**9 + 1)) == [(1, 2), (2, 1)]


def test_any_labels_are_counted(spark, monkeypatch):
    edges = spark.createDataFrame([(7, -3), (-3, 10**15), (7, -3), (-3, 7), (5, 5)], "src long, dst long")
    want = [(1, 2), (2, 1)]
    assert rows(distance.histogram(edges)) == want
    assert rows(distance.histogram(edges.limit(0))) == []
    monkeypatch.setattr(distance, "MOST_BROADCAST", 0)
    assert rows(distance.histogram(edges)) == want


def test_stress_is_summed_by_the_search(spark, monkeypatch):
    edges = graph.canonical_edges(sources.gnp_graph(spark, 80, 0.03, 2))
    places = layout.start_positions(spark.range(80).withColumnRenamed("id", "node_id"))
    want = stress.stress(distance.pair_table(distance.all_pairs(edges, 80)), places).first()[0]
    for half in (False, True):
        assert np.isclose(distance.stress_of(edges, 80, places, half).first()[0], want * (0.5 if half else 1))
    with pytest.raises(Exception):  # noqa: B017
        distance.stress_of(edges, 80, places.where("node_id <> 3")).collect()
    monkeypatch.setattr(distance, "MOST_BROADCAST", 0)
    assert np.isclose(distance.stress_of(edges, 80, places).first()[0], want)
    assert distance.stress_of(edges.limit(0), 80, places).first()[0] == 0


def test_twins_are_searched_once(spark, monkeypatch):
    """Stars on a path, a star of its own and loops: pairs, counts and stress by classes, in chunks of 3 nodes, are those of all nodes."""
    ends = [(0, 1), (1, 2), (2, 3), (5, 5)] + [(k % 3, 10 + k) for k in range(60)] + [(80, 81 + k) for k in range(12)]
    edges = spark.createDataFrame(ends, "src long, dst long")
    places = layout.start_positions(spark.range(93).withColumnRenamed("id", "node_id"))
    plain = graph.canonical_edges(edges)
    want = rows(distance._pairs_by_search(plain, 93))
    of, small = distance.twins(edges)
    assert of.count() == 77 and of.select("rep").distinct().count() == 8 and small.count() == 6
    monkeypatch.setattr(distance, "_CHUNK", 3)
    assert rows(distance.all_pairs(edges, 93)) == rows(distance.all_pairs_by_masks(edges)) == want
    counts = sorted((d, sum(x[2] == d for x in want)) for d in {x[2] for x in want})
    assert rows(distance.histogram(edges)) == rows(distance.histogram(plain, 93)) == rows(distance.histogram_by_masks(edges)) == counts
    told = stress.stress(distance.pair_table(distance.all_pairs(edges, 93)), places).first()[0]
    assert distance.stress_of(plain, 93, places).first()[0] == pytest.approx(told, rel=1e-12)
    with pytest.raises(Exception, match="no position"):
        distance.stress_of(plain, 93, places.where("node_id <> 20")).collect()


def test_rows_of_twins_stay_small_in_files(spark, tmp_path):
    """4.5 million pairs of two classes whose ids lie among each other, which took 0.9 bytes a row and more the larger classes are."""
    half, n = 1500, 3002
    edges = star(spark, 2, half).unionByName(spark.createDataFrame([(0, 1)], "src long, dst long"))
    distance.all_pairs(edges, n).write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * n * n / 2
    found = spark.read.parquet(str(tmp_path / "pairs"))
    assert found.where(f"0 <= u and u < v and v < {n}").select("u", "v").distinct().count() == found.count() == n * (n - 1) // 2
    assert rows(found.groupBy("d").count()) == [(1, n - 1), (2, half * (half - 1) + 2 * half), (3, half * half)]


@pytest.mark.parametrize(("n", "p", "seed"), [(700, 0.005, 34), (300, 0.02, 0), (2, 0.01, 1)])
def test_sparse_random_graphs_look_up_their_edges(spark, monkeypatch, n, p, seed):
    """The same edges as by all pairs, without a pair that is none."""
    found = sources.gnp_graph(spark, n, p, seed)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(sources, "_SPARSE", 0.0)
    assert rows(found) == rows(sources.gnp_graph(spark, n, p, seed))


def test_searches_leave_their_arrays_blank():
    offsets, targets = np.array([0, 1, 3, 4, 4]), np.array([1, 0, 2, 1], dtype=np.int32)
    blank = distance._blank(4)
    for _ in range(2):
        assert [(d, nodes.tolist()) for d, nodes, _ in distance._search(offsets, targets, np.array([0]), blank)] == [(1, [1]), (2, [2])]
    assert not blank[0].any() and not blank[1].any()


# refinement


def test_levels_are_the_fold_bit_for_bit():
    rng = np.random.default_rng(3)
    n = 60
    u, v = (x.astype(np.int32) for x in np.triu_indices(n, 1))
    order = rng.permutation(len(u))
    u, v, d = u[order], v[order], rng.uniform(1, 5, len(u))
    start = rng.uniform(size=(n, 2))
    start[7] = start[3]  # coincident nodes too
    fold, levels, log, turns = start.copy(), start.copy(), [], []
    for k in range(len(u)):
        turns.append((fold[u[k]].copy(), fold[v[k]].copy()))
        layout._step(fold, u[k : k + 1], v[k : k + 1], d[k : k + 1], 3.0)
    layout._one_by_one(levels, u, v, d, 3.0, log)
    assert (fold == levels).all()
    assert all((a == x).all() and (b == y).all() for a, b, (x, y) in zip(log[0][2], log[0][3], turns))
    level = layout.dependency_levels(u, v, n)
    assert level.max() < len(u) / 5  # vector steps, and not one a pair
    for k in range(1, level.max() + 1):
        ends = np.r_[u[level == k], v[level == k]]
        assert len(np.unique(ends)) == len(ends)


def test_hash_order_is_the_column_function(spark):
    from stressloom.functions import hash_uniform, hash_uniform_of

    pairs = spark.range(200).selectExpr("id * 37 AS u", "id * 53 + 1 AS v")
    got = [r[0] for r in pairs.select(hash_uniform(F.col("u"), F.col("v"), 9)).collect()]
    u, v = np.arange(200) * 37, np.arange(200) * 53 + 1
    assert got == (hash_uniform_of(u, v, 9) / 2**31).tolist()


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 5, 8])
def test_blocks_know_their_tile(spark, blocks):
    of = {}
    for r in schedule.tile_rounds(spark, blocks).collect():
        of.setdefault(r["round"], {}).update(dict.fromkeys((r["bi"], r["bj"]), (r["bi"], r["bj"])))
    b = F.col("id").cast("int")
    for r, tiles in of.items():
        first, second = schedule.tile_in_round(b, r, blocks)
        got = {x["b"]: (x["i"], x["j"]) for x in spark.range(blocks).select(b.alias("b"), first.alias("i"), second.alias("j")).collect()}
        assert got == {k: tiles.get(k, (k, k)) for k in range(blocks)}


def test_tiles_log_each_step_with_a_ticket(spark):
    """The log of all tiles is an order in which the steps, one by one, give the positions that it names."""
    ready = prepare(sources.ring_graph(spark, 13), 13, center=False)
    etas = ready.etas[:2]
    log = layout.refine(ready.pairs, ready.positions, ready.components, etas, strategy="tiles", seed=4, block=4, audit=True)
    steps = sorted(log.collect(), key=lambda r: r["record_idx"])
    assert [r["record_idx"] for r in steps] == list(range(2 * 78))
    for t in (0, 1):
        assert len({(r["u"], r["v"]) for r in steps if r["iteration"] == t}) == 78
    p = np.array([(r["x"], r["y"]) for r in ready.positions.orderBy("node_id").collect()])
    far = {(r["u"], r["v"]): r["dij"] for r in ready.pairs.collect()}
    for r in steps:
        u, v = r["u"], r["v"]
        assert tuple(p[u]) == (r["xi"], r["yi"]) and tuple(p[v]) == (r["xj"], r["yj"])
        layout._step(p, np.array([u]), np.array([v]), np.array([far[u, v]]), etas[r["iteration"]])
    final = layout.refine(ready.pairs, ready.positions, ready.components, etas, strategy="tiles", seed=4, block=4)
    assert np.allclose(p, np.array([(r["x"], r["y"]) for r in final.orderBy("node_id").collect()]), atol=0)
    assert layout.refine(ready.pairs.limit(0), ready.positions, ready.components, etas, strategy="tiles", audit=True).count() == 0


@pytest.fixture(scope="module")
def mixed(spark):
    """Rings of 3 to 8 nodes and a node without an edge, prepared."""
    ends, at = [], 0
    for n in (3, 8, 5):
        ends += [(at + k, at + (k + 1) % n) for k in range(n)]
        at += n
    return prepare(spark.createDataFrame(ends, "src long, dst long"), at + 1, iterations=2, center=False)


@pytest.mark.parametrize("order", ["fixed", "shuffled"])
@pytest.mark.parametrize(("strategy", "name", "alone"), [("rounds", "SHARED", 0), ("tiles", "TILES_IN_TASK", 0), ("tiles", "TILES_IN_TASK", 6)])
def test_components_share_tasks(spark, monkeypatch, mixed, order, strategy, name, alone):
    """Bit for bit what each component, or the jobs by rounds of tiles, give; the log too. A pair's tile, which components share, gives its turn."""
    ask = lambda audit: rows(layout.refine(mixed.pairs, mixed.positions, mixed.components, mixed.etas, strategy, order, seed=6, block=5, audit=audit))
    together = ask(False), ask(True)
    monkeypatch.setattr(layout, name, alone)
    assert (ask(False), ask(True)) == together
    assert len(together[0]) == mixed.n and len(together[1]) == 2 * mixed.pairs.count()


def test_small_components_need_no_jobs_by_rounds(spark, monkeypatch, mixed):
    cuts = []
    monkeypatch.setattr(layout, "cut", lambda df, *parts: cuts.append(1) or distance.cut(df, *parts))
    assert layout.refine(mixed.pairs, mixed.positions, mixed.components, mixed.etas, "tiles", "fixed", block=2).count() == mixed.n
    assert len(cuts) <= 3


def test_orders_and_strategies_are_known(spark):
    ready = prepare(sources.ring_graph(spark, 4), 4)
    for bad in ({"strategy": "tiles", "order": "hash"}, {"strategy": "rounds", "order": "random"}, {"strategy": "none"}):
        with pytest.raises(ValueError):
            layout.refine(ready.pairs, ready.positions, ready.components, ready.etas, **bad)


def test_seeds_give_starts_of_their_own(spark):
    nodes = spark.range(2000).withColumnRenamed("id", "node_id")
    at = {s: np.array([(r["x"], r["y"]) for r in layout.start_positions(nodes, s).orderBy("node_id").collect()]) for s in (0, 1, 1000)}
    for a, b in ((0, 1), (0, 1000), (1, 1000)):
        for i in (0, 1):
            assert abs(np.corrcoef(at[a][:, i], at[b][:, i])[0, 1]) < 0.1
    assert all(0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.03 for x in at.values())


def test_pairs_found_dont_go_through_the_driver(spark):
    """Pairs that a search finds count as small as its sources, but none is sent to every task."""
    pairs = distance.pair_table(distance.all_pairs(sources.ring_graph(spark, 60), 60))
    places = layout.start_positions(spark.range(60).withColumnRenamed("id", "node_id"))
    deltas = layout.pair_deltas(pairs, places, 16.0)
    plan = deltas._jdf.queryExecution().executedPlan().toString()
    sent = [x.split("BroadcastHashJoin")[1] for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert "MapInArrow" in plan and not any("BuildLeft" in x for x in sent)
    assert deltas.count() == 2 * pairs.count() == 60 * 59


def test_lengths_go_to_the_tiles(spark):
    """Tiles, of which there are as many as pairs of blocks, are neither sent to every task nor shuffled."""
    tiles = schedule.tile_shapes(schedule.tile_rounds(spark, 300), schedule.block_lengths(spark, 300 * 64, 64))
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    sent = plan[plan.index("BroadcastExchange") :] if "BroadcastExchange" in plan else plan
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("Generate ") == 1
    assert "Generate " not in sent or plan.index("Generate ") < plan.index("BroadcastExchange")
    assert tiles.count() == 300 * 301 // 2


# pictures


@pytest.mark.parametrize("most", [256, 1])
def test_tiles_count_what_edges_draw(spark, monkeypatch, most):
    rng = np.random.default_rng(5)
    places = rng.integers(-300, 900, (60, 2))
    pixels = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(places)], "node_id long, px int, py int")
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2))] + [(4, 4)] * 3, "src long, dst long")
    want = rows(render.edge_pixels(edges, pixels).where("px between 0 and 599 and py between 0 and 499"))
    monkeypatch.setattr(render, "_MOST_TILES", most)
    monkeypatch.setattr(render, "_AT_ONCE", 500)
    assert rows(render.edge_counts(edges, pixels, 600, 500)) == want


@pytest.mark.parametrize("thick", [1, 2, 5])
@pytest.mark.parametrize("size", [(300, 170), (40, 200), (1, 30)])
def test_edges_are_drawn_column_by_column(monkeypatch, size, thick):
    """Edges inside the picture, of any slope and from either end, are counted without an entry per pixel, as the tiles count them."""
    rng = np.random.default_rng(6)
    ends = [rng.integers(0, size[i % 2], 3000) for i in range(4)]
    batch = pa.record_batch(ends, ["x0", "y0", "x1", "y1"])
    by_tiles = np.zeros(size[::-1], dtype=np.int64)
    for b in render._draw(*size, thick, False)(iter([batch])):
        by_tiles[b.column("py").to_numpy(), b.column("px").to_numpy()] += b.column("n").to_numpy()
    monkeypatch.setattr(render, "_EDGES", 1000)
    monkeypatch.setattr(render._Whole, "add", lambda self, px, py: pytest.fail("a pixel of its own") if len(px) else None)
    whole = np.zeros(size[::-1], dtype=np.int64)
    for b in render._draw(*size, thick, True)(iter([batch.slice(0, 1700), batch.slice(1700)])):
        whole[b.column("py").to_numpy()] = np.stack(b.column("counts").to_pylist())
    assert (whole == by_tiles).all()


@pytest.mark.parametrize("whole", [0, 1 << 22])
def test_large_and_small_pictures_count_alike(spark, monkeypatch, whole):
    rng = np.random.default_rng(5)
    pixels = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(-300, 900, (60, 2)))], "node_id long, px int, py int")
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2))], "src long, dst long")
    monkeypatch.setattr(render, "_WHOLE", whole)
    want = rows(render.edge_pixels(edges, pixels).where("px between 0 and 599 and py between 0 and 499"))
    assert rows(render.edge_counts(edges, pixels, 600, 500)) == want


def test_thick_edges_are_as_wide(spark):
    pixels = spark.createDataFrame([(0, 5, 10), (1, 25, 10), (2, 15, 2)], "node_id long, px int, py int")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    got = rows(render.edge_counts(edges, pixels, 40, 40, 3))
    assert got == [(x, y, 1) for x in range(5, 26) for y in (9, 10, 11)]
    down = rows(render.edge_counts(spark.createDataFrame([(2, 0)], "src long, dst long"), pixels, 40, 40, 2))
    assert len(down) == 2 * 11


def test_edges_under_a_pixel_and_fractional_radii(spark):
    edges = sources.ring_graph(spark, 5)
    places = layout.start_positions(spark.range(5).withColumnRenamed("id", "node_id"))
    thin, full = (sinks.image(render.picture(edges, places, 64, 64, 2.5, edge_width=w), 64, 64) for w in (0.5, 1.0))
    assert (thin >= full).all() and (thin > full).any()
    dots = render.node_pixels(spark.createDataFrame([(0, 20, 20)], "node_id long, px int, py int"), 2.5, 64, 64)
    assert rows(dots) == sorted((20 + x, 20 + y) for x in range(-2, 3) for y in range(-2, 3) if x * x + y * y <= 6.25)


def decoded(path):
    """The pixels of a PNG of 8-bit RGBA with unfiltered lines."""
    data, at, body, texts = path.read_bytes(), 8, b"", []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + chunk)
        if kind == b"IHDR":
            width, height = struct.unpack(">II", chunk[:8])
        body += chunk if kind == b"IDAT" else b""
        texts += [chunk] if kind == b"iTXt" else []
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * 4 + 1)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(height, width, 4), texts


def test_bands_are_the_picture(spark, tmp_path):
    edges = sources.ring_graph(spark, 9)
    places = layout.start_positions(spark.range(9).withColumnRenamed("id", "node_id"))
    pixels = render.picture(edges, places, 90, 70, 2)
    want = sinks.image(pixels, 90, 70)
    sinks.draw_png(str(tmp_path / "a.png"), pixels, 90, 70, rows=16)
    assert (decoded(tmp_path / "a.png")[0] == want).all()
    sinks.draw_png(str(tmp_path / "b.png"), pixels, 90, 70, title="Ring, stress 1.5", scale=1)
    got, texts = decoded(tmp_path / "b.png")
    top = text.title_height(1)
    assert (got[top:] == want).all() and texts == [b"Title\0\0\0\0\0Ring, stress 1.5"]
    black = {(int(x), int(y)) for y, x in np.argwhere((got[:top] == [0, 0, 0, 255]).all(axis=2))}
    assert black == {(x + 1, y + 1) for x, y in text.cells("Ring, stress 1.5")}
    assert (got[:top][~(got[:top] == [0, 0, 0, 255]).all(axis=2)] == 255).all()
    sinks.draw_side_by_side(str(tmp_path / "c.png"), pixels, pixels.limit(0), 90, 70, ("before", "after"), scale=1)
    both, _ = decoded(tmp_path / "c.png")
    assert both.shape == (70 + top, 180, 4) and (both[top:, :90] == want).all() and (both[top:, 90:] == 255).all()
    assert (both[:top, 90:] == 0).any()


def test_checksums_are_joined():
    a, b = b"some text" * 9000, b"more of it" * 7000
    assert sinks.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


# files


def test_ranges_hold_each_entry_once(spark, tmp_path, monkeypatch):
    path = tmp_path / "g.mtx"
    body = "%%MatrixMarket matrix coordinate real symmetric\n% two\n\n  % three\n 5 5 6 \n1 1 .5e-3\n2 1 1\n\n%late\n  3   4 -2.5\n00004 2 7\r\n5 1\n5 2 " + "9" * 40
    for end in ("", "\n"):
        path.write_text(body + end)
        want = rows(sources.read_mtx(spark, str(path)))
        assert len(want) == 5
        reader = mtx.MtxReader({"path": str(path)})
        for size in (1, 2, 3, 5, 8, 13, 21, 1000):
            for at_once in (1 << 20, 7):
                monkeypatch.setattr(mtx, "_AT_ONCE", at_once)
                reader.bytes = size
                got = [tuple(r.values()) for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
                assert sorted(got) == want, (size, at_once)
    monkeypatch.undo()
    mtx.register(spark)
    assert rows(spark.read.format("mtx").option("bytes", 9).load(str(path))) == want
    path.write_text("%%MatrixMarket\n3 3 1\n0 1\n")
    with pytest.raises(Exception, match="not an entry"):
        spark.read.format("mtx").load(str(path)).collect()
    path.write_text("%%MatrixMarket\n% nothing else\n")
    assert spark.read.format("mtx").load(str(path)).count() == 0


def test_tasks_write_the_result_file(spark, tmp_path):
    edges = sources.ring_graph(spark, 400)
    places = layout.start_positions(spark.range(400).withColumnRenamed("id", "node_id"))
    one, many = tmp_path / "one.txt", tmp_path / "new" / "many.txt"
    sinks.write_result(edges, places, str(one), "ring", "2024-01-01 00:00:00")
    result.save_result(edges, places, str(many), "ring", "2024-01-01 00:00:00")
    assert one.read_bytes() == many.read_bytes()
    assert [x.name for x in many.parent.iterdir()] == ["many.txt"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    result.register(spark)
    bad = spark.range(20).select(F.lit(0).alias("section"), F.col("id").alias("ordinal"), F.when(F.col("id") == 19, F.raise_error(F.lit("no line"))).otherwise("x").cast("string").alias("line"))
    with pytest.raises(Exception, match="no line"):
        bad.repartition(4).write.format("stress_result").mode("overwrite").save(str(tmp_path / "r.txt"))
    assert list(tmp_path.iterdir()) == []


def test_components_are_laid_out_in_sql(spark):
    plans_sql.register(spark)
    edges = sources.ring_graph(spark, 8).unionByName(sources.ring_graph(spark, 6).select((F.col("src") + 8).alias("src"), (F.col("dst") + 8).alias("dst")))
    ready = prepare(edges, 14, iterations=4, center=False)
    pairs = ready.pairs.join(ready.components.withColumnRenamed("node_id", "u"), "u").select("u", "v", "dij", "component", F.lit("west").alias("side"))
    pairs.createOrReplaceTempView("some_pairs")
    rates = ", ".join(f"{x!r}D" for x in ready.etas)
    for strategy in ("rounds", "sequential"):
        got = spark.sql(f"SELECT * FROM lay_out(TABLE(some_pairs), array({rates}), '{strategy}')")
        assert got.columns == ["component", "side", "node_id", "x", "y"]
        want = layout.refine(ready.pairs, ready.positions, ready.components, ready.etas, strategy=strategy, order="fixed")
        assert np.allclose(rows(got.select("node_id", "x", "y")), rows(want), atol=1e-12)
    for bad in (f"TABLE(SELECT u, v FROM some_pairs), array({rates})", f"TABLE(some_pairs), array({rates}), 'none'"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(f"SELECT * FROM lay_out({bad})").collect()


def test_a_row_may_hold_a_nodes_pairs(spark):
    """Pairs packed by node, in any order inside, are laid out bit for bit as pairs a row each, by fewer rows."""
    plans_sql.register(spark)
    edges = sources.ring_graph(spark, 9).unionByName(sources.ring_graph(spark, 7).select((F.col("src") + 9).alias("src"), (F.col("dst") + 9).alias("dst")))
    ready = prepare(edges, 16, iterations=3, center=False)
    pairs = ready.pairs.join(ready.components.withColumnRenamed("node_id", "u"), "u").select("component", "u", "v", "dij")
    pairs.createOrReplaceTempView("plain_pairs")
    held = F.sort_array(F.collect_list(F.struct("v", "dij")), asc=False).alias("held")
    packed = pairs.groupBy("component", "u").agg(held).select("component", "u", F.col("held.v").alias("v"), F.col("held.dij").alias("dij"))
    packed.createOrReplaceTempView("packed_pairs")
    assert packed.count() == 14 < pairs.count() == 36 + 21
    rates = ", ".join(f"{x!r}D" for x in ready.etas)
    for strategy in ("rounds", "sequential"):
        plain, fewer = (rows(spark.sql(f"SELECT * FROM lay_out(TABLE({t}), array({rates}), '{strategy}')")) for t in ("plain_pairs", "packed_pairs"))
        assert plain == fewer and len(plain) == 16
    for bad in ("SELECT u, v, dij[0] AS dij FROM packed_pairs", "SELECT u, v, array(1.0D) AS dij FROM packed_pairs"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(f"SELECT * FROM lay_out(TABLE({bad}), array({rates}))").collect()
