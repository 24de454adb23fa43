"""Hop distances over undirected edges with dense node ids.

Where the adjacency fits into a task, tasks search from 64 sources at a time. Else frontiers are rows (node, block of 64 sources, mask), and a step is a join
and a bitwise or.

Nodes with the same neighbours (twins, as all leaves of a star are) have the same distances to all others, and 2 between them. Where most nodes are such, the search runs on one
node a class, and its pairs are written out, counted or summed by chunks of two classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..plans.cuts import cut, numbered
from .graph import canonical_edges, mirrored, relabel

#: Bytes of adjacency that may be sent to every task: 8 a node for the offsets, 4 an edge and way. A search holds 16 more a node.
MOST_BROADCAST = 96 << 20


#: Sources that one search takes together, a bit each.
_TOGETHER = 64


def _blank(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What a task's searches of n nodes share: they leave it as blank as they found it."""
    return np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)


def _search(offsets: np.ndarray, targets: np.ndarray, sources: np.ndarray, blank: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(distance, nodes, masks) of the nodes that are met at each distance, with a bit for each of at most 64 sources that meets them there. Only
    nodes met in the last step are looked at in the next, and only those that were met are wiped at the end, so a search costs what it reaches."""
    n = len(offsets) - 1
    seen, met = blank
    reached = [sources]
    np.bitwise_or.at(seen, sources, np.uint64(1) << np.arange(len(sources), dtype=np.uint64))
    front = np.unique(sources)
    mask = seen[front]
    d = 0
    while len(front):
        d += 1
        count = offsets[front + 1] - offsets[front]
        at = np.repeat(offsets[front] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        to = targets[at]
        np.bitwise_or.at(met, to, np.repeat(mask, count))
        if len(to) > n:
            front = np.flatnonzero(met)
        else:
            front = np.unique(to)
        mask = met[front] & ~seen[front]
        met[front] = 0
        fresh = mask != 0
        front, mask = front[fresh], mask[fresh]
        seen[front] |= mask
        if len(front):
            reached.append(front)
            yield d, front, mask
    for nodes in reached:
        seen[nodes] = 0


def _adjacency(edges: DataFrame, n: int):
    """The neighbours of each node as two arrays, sent to every task; None above MOST_BROADCAST, whether by edges or by nodes."""
    count = edges.count()
    if 8 * (n + 1) + 8 * count > MOST_BROADCAST:
        return None
    rows = mirrored(edges).toArrow() if count else pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
    src, dst = rows.column("src").to_numpy(), rows.column("dst").to_numpy()
    by = np.argsort(src, kind="stable")
    return edges.sparkSession.sparkContext.broadcast((np.searchsorted(src[by], np.arange(n + 1)), dst[by].astype(np.int32)))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i in range(0, len(ids), _TOGETHER):
            yield ids[i : i + _TOGETHER]


#: Nodes of a class that are written out together, and how many nodes a class must have on average to be worth it.
_CHUNK, _WORTH = 8192, 8


def twins(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(node, rep) of all nodes with an edge, rep being the smallest node with the same neighbours, and the edges between such; None where nodes are fewer than _WORTH times the classes. Neighbours are told apart by their number and 128 bits."""
    edges = canonical_edges(edges)
    mark = lambda i: F.bit_xor(F.xxhash64(F.lit(i), "dst")).alias(f"_{i}")
    seen = cut(mirrored(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_n"), mark(1), mark(2)))
    key = ["_n", "_1", "_2"]
    classes = cut(seen.groupBy(*key).agg(F.min("node").alias("rep")))
    n = classes.count()
    if not n or seen.count() < _WORTH * n:
        return None
    of = cut(seen.join(classes, key).select("node", "rep"))
    for side in ("src", "dst"):
        edges = edges.join(classes.select(F.col("rep").alias(side)), side, "left_semi")
    return of, cut(edges.select("src", "dst"))


def _class_pairs(edges: DataFrame, by_masks: bool = False) -> DataFrame:
    """(a, b, d): the pairs a < b of a graph with few nodes, whatever their labels."""
    if by_masks:
        found = _pairs_by_masks(edges)
    else:
        labels, dense = relabel(edges)
        found = _pairs_by_search(cut(dense), labels.count())
        name = lambda c: labels.select(F.col("node_id").alias(c), F.col("orig_label").alias(f"_{c}"))
        # pairs that a search finds are estimated at the size of its sources, so they are told to be merged
        found = found.hint("merge").join(name("u"), "u").join(name("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"), "d")
    return found.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "d")


def _chunk_pairs(of: DataFrame, pairs: DataFrame, *values: str) -> DataFrame:
    """(d, same, a, b): two chunks of nodes, as arrays of (node, values) by node, all of whose pairs are d apart; same: the chunk with itself, where a pair counts once.

    of: (node, rep, values). Chunks have up to _CHUNK nodes of a class. Which two meet is told by numbers first; their nodes come by joins, so that no task and not the driver holds a class.
    """
    placed = numbered(of, "_at", "rep", "node").withColumn("k", F.floor(F.col("_at") / _CHUNK))
    chunks = cut(placed.groupBy("rep", "k").agg(F.array_sort(F.collect_list(F.struct("node", *values))).alias("nodes")))
    ids = chunks.select("rep", "k")
    name = lambda c: ids.select(F.col("rep").alias(c), F.col("k").alias(f"k{c}"))
    across = pairs.join(name("a"), "a").join(name("b"), "b")
    inside = name("a").join(name("b"), (F.col("a") == F.col("b")) & (F.col("ka") <= F.col("kb"))).withColumn("d", F.lit(2))
    met = cut(across.select("a", "ka", "b", "kb", "d").unionByName(inside.select("a", "ka", "b", "kb", "d")))
    held = lambda c: chunks.select(F.col("rep").alias(c), F.col("k").alias(f"k{c}"), F.col("nodes").alias(f"n{c}"))
    parts = max(of.sparkSession.sparkContext.defaultParallelism, min(16_000, met.count() // 2))
    # a chunk and its partners are dealt to all tasks before they are written out
    full = met.join(held("a").hint("merge"), ["a", "ka"]).join(held("b").hint("merge"), ["b", "kb"])
    same = ((F.col("a") == F.col("b")) & (F.col("ka") == F.col("kb"))).alias("same")
    return full.select("d", same, F.col("na").alias("a"), F.col("nb").alias("b")).repartition(parts)


#: No nulls, which files take room and writers time for.
_STRIPS = StructType([StructField("u", LongType(), False), StructField("strip", ArrayType(LongType(), False), False), StructField("d", IntegerType(), False)])
#: Nodes whose pairs with one node come as one row before they are written out, and pairs in a batch of such rows.
_STRIP, _BATCH = 256, 1 << 15


def _written_out(of: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, d), u < v: the pairs of all nodes, from those of their classes.

    The order keeps files small: strips of _STRIP nodes v, the whole strip for each u below it, so that u and d stay the same for a strip and v repeats with it."""
    rows = _chunk_pairs(of, pairs).select("d", "same", F.col("a.node").alias("a"), F.col("b.node").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                d, same = batch.column("d")[k].as_py(), batch.column("same")[k].as_py()
                a, b = (batch.column(c)[k].values.to_numpy() for c in "ab")
                # ids of two classes lie among each other, so either chunk has the smaller node of some pairs
                for lower, upper in [(a, b)] if same else [(a, b), (b, a)]:
                    for i in range(0, len(upper), _STRIP):
                        strip = upper[i : i + _STRIP]
                        below = lower[: np.searchsorted(lower, strip[-1])]
                        for j in range(0, len(below), _BATCH // _STRIP):
                            u = below[j : j + _BATCH // _STRIP]
                            first = np.searchsorted(strip, u, side="right")
                            v = np.tile(strip, len(u))
                            if first[-1]:
                                v = v[np.repeat(u, len(strip)) < v]
                            ends = np.r_[0, np.cumsum(len(strip) - first)].astype(np.int32)
                            yield pa.record_batch([pa.array(u), pa.ListArray.from_arrays(ends, v), pa.array(np.full(len(u), d, dtype=np.int32))], ["u", "strip", "d"])

    whole = rows.mapInArrow(run, _STRIPS)
    return whole.select("u", F.explode("strip").alias("v"), "d")


def _counted(of: DataFrame, pairs: DataFrame) -> DataFrame:
    """(d, n_pairs) from the pairs and sizes of classes."""
    sizes = cut(of.groupBy("rep").agg(F.count(F.lit(1)).alias("n")))
    name = lambda c: sizes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"))
    across = pairs.join(name("a"), "a").join(name("b"), "b").select("d", (F.col("na") * F.col("nb")).alias("n"))
    inside = sizes.where("n > 1").select(F.lit(2).alias("d"), F.expr("n * (n - 1) div 2").alias("n"))
    return across.unionByName(inside).groupBy("d").agg(F.sum("n").alias("n_pairs"))


def all_pairs(edges: DataFrame, n: int, sources: list[int] | None = None) -> DataFrame:
    """(u, v, d) with u < v for all pairs that a path joins; with sources, (u, v, d) from these to all others. Where most nodes are twins, their classes are searched."""
    found = twins(edges) if sources is None else None
    if found:
        return _written_out(found[0], _class_pairs(found[1]))
    return _pairs_by_search(edges, n, sources)


def _pairs_by_search(edges: DataFrame, n: int, sources: list[int] | None = None) -> DataFrame:
    """Sources are spread over tasks that hold the adjacency as two arrays, so no row is shuffled. Above
    MOST_BROADCAST the distances come from frontiers of source masks instead.
    """
    spark = edges.sparkSession
    shared = _adjacency(edges, n)
    if shared is None:
        return _pairs_by_masks(edges, sources)
    upper = sources is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, targets = shared.value
        blank, held, count = _blank(len(offsets) - 1), [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x)) for x in zip(*held, strict=True)]
            held.clear()
            return pa.record_batch(columns, ["u", "v", "d"])

        for own in _groups(batches):
            for d, nodes, masks in _search(offsets, targets, own, blank):
                for i in range(0, len(nodes), 1 << 14):
                    bits = np.unpackbits(masks[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(own)]
                    row, source = np.nonzero(bits)
                    u, v = own[source], nodes[i + row].astype(np.int64)
                    if upper:
                        u, v = u[u < v], v[u < v]
                    held.append((u, v, np.full(len(u), d, dtype=np.int32)))
                    count += len(u)
                    if count >= 1 << 16:
                        yield batch()
                        count = 0
        if count:
            yield batch()

    start = spark.range(n) if upper else spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], "id long")
    return start.mapInArrow(run, "u long, v long, d int")


def _compact(edges: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Offsets and neighbours of a graph whose nodes have any labels, numbered on the way; None above MOST_BROADCAST."""
    if 24 * edges.count() > MOST_BROADCAST:
        return None
    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").toArrow()
    labels, ends = np.unique(np.r_[rows.column("src").to_numpy(), rows.column("dst").to_numpy()], return_inverse=True)
    a, b = np.split(ends.astype(np.int64), 2)
    n = len(labels)
    once = np.unique(np.r_[a * n + b, b * n + a])
    return np.searchsorted(once // max(n, 1), np.arange(n + 1)), (once % max(n, 1)).astype(np.int32)


def histogram(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(d, n_pairs): pairs u < v at each distance, counted where they are found. n: nodes are 0 .. n - 1; without it labels may be any longs, and loops and repeated
    edges are ignored."""
    if found := twins(edges):
        return _counted(found[0], _class_pairs(found[1]))
    if n is not None:
        shared = _adjacency(edges, n)
    else:
        small = _compact(edges)
        n, shared = (len(small[0]) - 1, edges.sparkSession.sparkContext.broadcast(small)) if small else (0, None)
    if shared is None:
        return _counted_by_masks(canonical_edges(edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, targets = shared.value
        counts: dict[int, int] = {}
        blank = _blank(len(offsets) - 1)
        for own in _groups(batches):
            for d, _, masks in _search(offsets, targets, own, blank):
                counts[d] = counts.get(d, 0) + int(np.bitwise_count(masks).sum(dtype=np.int64))
        yield pa.record_batch([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["d", "n"])

    found = edges.sparkSession.range(n).mapInArrow(run, "d int, n long")
    # each pair is found from both of its ends
    return found.groupBy("d").agg((F.sum("n") / 2).cast("long").alias("n_pairs"))


def all_pairs_by_joins(edges: DataFrame, n: int, sources: list[int] | None = None) -> DataFrame:
    """The same by frontiers: join with the edges, until nothing is new. A neighbour of a node at distance d is at
    d - 1, d or d + 1, so a step is compared with the last two frontiers only, and each is written once."""
    spark = edges.sparkSession
    both = cut(mirrored(edges))
    start = spark.range(n) if sources is None else spark.createDataFrame([(s,) for s in sources], "id long")
    front = cut(start.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0).alias("d")))
    before, reached = front.limit(0), [front]
    while True:
        step = front.join(both, front["v"] == both["src"]).select("u", F.col("dst").alias("v")).distinct()
        known = before.select("u", "v").unionByName(front.select("u", "v"))
        before, front = front, cut(step.join(known, ["u", "v"], "left_anti").withColumn("d", F.lit(len(reached))))
        if not front.limit(1).count():
            break
        reached.append(front)
    return reduce(DataFrame.unionByName, reached).where("u < v" if sources is None else "d > 0")


def source_blocks(edges: DataFrame, sources: list[int] | None = None) -> DataFrame:
    """(node, block, bit): sources, all nodes with an edge if none are named, dealt to blocks of 64. Nodes with the same least neighbour are near each other, so that the sources of a
    block tend to reach the same nodes and share their rows."""
    both = mirrored(edges)
    near = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
    if sources is not None:
        near = near.join(edges.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(sources)], "node long"), "node")
    dense = numbered(near, "number", "near", "node")
    return dense.select("node", F.shiftright("number", 6).alias("block"), F.col("number").bitwiseAND(F.lit(63)).cast("int").alias("bit"))


def mask_levels(edges: DataFrame, blocks: DataFrame) -> list[DataFrame]:
    """(node, block, mask) for each distance from 0 on: a bit for each source of the block that meets the node there.

    A step joins the frontier with the edges and takes the bitwise or of what arrives at a (node, block). A neighbour of a node at distance d is at d - 1, d or d + 1, so what is new is
    what the last two frontiers don't have. Up to 64 sources share a row, and no task holds anything of the graph's size.
    """
    both = cut(mirrored(edges))
    front = cut(blocks.select("node", "block", F.expr("shiftleft(1L, bit)").alias("mask")))
    before, levels = front.limit(0), [front]
    zero = F.lit(0).cast("long")
    while True:
        arriving = front.join(both, front["node"] == both["src"]).select(F.col("dst").alias("node"), "block", F.col("mask").alias("new"), zero.alias("old"))
        known = front.unionByName(before).select("node", "block", zero.alias("new"), F.col("mask").alias("old"))
        met = arriving.unionByName(known).groupBy("node", "block").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        fresh = met.select("node", "block", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("mask")).where("mask <> 0")
        before, front = front, cut(fresh)
        if front.isEmpty():
            return levels
        levels.append(front)


def all_pairs_by_masks(edges: DataFrame, sources: list[int] | None = None) -> DataFrame:
    """The same rows as all_pairs, by frontiers of source masks, those of classes where most nodes are twins."""
    found = twins(edges) if sources is None else None
    if found:
        return _written_out(found[0], _class_pairs(found[1], by_masks=True))
    return _pairs_by_masks(edges, sources)


def _pairs_by_masks(edges: DataFrame, sources: list[int] | None = None) -> DataFrame:
    """Pairs are written out only at the end, from the ids of each block's sources."""
    blocks = cut(source_blocks(edges, sources))
    ids = blocks.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bit", "node"))).alias("_s")).select("block", "_s.bit", "_s.node")
    ids = cut(ids.withColumnRenamed("node", "ids").withColumnRenamed("bit", "bits"))  # at most 64 of each
    here = "true" if sources is not None else "x < node"
    rows = [level.withColumn("d", F.lit(d)) for d, level in enumerate(mask_levels(edges, blocks)) if d]
    if not rows:
        return edges.sparkSession.createDataFrame([], "u long, v long, d int")
    found = reduce(DataFrame.unionByName, rows).join(ids, "block")
    found = found.withColumn("u", F.explode(F.expr(f"filter(ids, (x, i) -> {here} and (shiftright(mask, bits[i]) & 1) = 1)")))
    return found.select("u", F.col("node").alias("v"), "d")


def histogram_by_masks(edges: DataFrame) -> DataFrame:
    """(d, n_pairs) by frontiers of source masks, those of classes where most nodes are twins."""
    if found := twins(edges):
        return _counted(found[0], _class_pairs(found[1], by_masks=True))
    return _counted_by_masks(edges)


def _counted_by_masks(edges: DataFrame) -> DataFrame:
    """(d, n_pairs) by counting bits; no pair becomes a row."""
    levels = mask_levels(edges, source_blocks(edges))
    none = levels[0].limit(0).withColumn("d", F.lit(0))
    found = reduce(DataFrame.unionByName, [level.withColumn("d", F.lit(d)) for d, level in enumerate(levels) if d], none)
    return found.groupBy("d").agg((F.sum(F.bit_count("mask")) / 2).cast("long").alias("n_pairs"))


def stress_of(edges: DataFrame, n: int, positions: DataFrame, half: bool = False) -> DataFrame:
    """One row: the stress of positions (node_id 0 .. n - 1, x, y), summed where the search meets a pair, so that no pair becomes a row. Graphs or layouts too large for
    a task go by the pair table. A node without a position is an error where a pair has it."""
    from .stress import stress

    if found := twins(edges):
        return _stress_of_classes(*found, positions, half)
    shared = _adjacency(edges, n) if 16 * n <= MOST_BROADCAST else None
    if shared is None:
        return stress(pair_table(_pairs_by_masks(edges)), positions, half)
    table = positions.select("node_id", "x", "y").where(f"node_id between 0 and {n - 1}").toArrow()
    at = np.full((n, 2), np.nan)
    at[table.column("node_id").to_numpy()] = np.column_stack([table.column(c).to_numpy() for c in "xy"])
    places = edges.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (offsets, targets), p = shared.value, places.value
        total = 0.0
        blank = _blank(len(offsets) - 1)
        for own in _groups(batches):
            here = p[own]
            for d, nodes, masks in _search(offsets, targets, own, blank):
                for i in range(0, len(nodes), 1 << 14):
                    part = nodes[i : i + (1 << 14)]
                    bits = np.unpackbits(masks[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(own)].view(bool)
                    off = np.hypot(p[part, 0, None] - here[:, 0], p[part, 1, None] - here[:, 1]) - d
                    total += float((off[bits] ** 2).sum()) / (d * d)
        yield pa.record_batch([pa.array([total])], ["part"])

    found = edges.sparkSession.range(n).mapInArrow(run, "part double")
    return _stress_told(found, 0.25 if half else 0.5)  # each pair is met from both of its ends


def _stress_of_classes(of: DataFrame, edges: DataFrame, positions: DataFrame, half: bool) -> DataFrame:
    """stress_of where most nodes are twins: chunks of two classes meet in matrices of a few MB."""
    placed = of.join(positions.select(F.col("node_id").alias("node"), "x", "y"), "node", "left").na.fill(float("nan"), ["x", "y"])
    rows = _chunk_pairs(placed, _class_pairs(edges), "x", "y").select("d", "same", *(F.col(f"{c}.{i}").alias(f"{i}{c}") for c in "ab" for i in "xy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for k in range(batch.num_rows):
                d, same = batch.column("d")[k].as_py(), batch.column("same")[k].as_py()
                xa, ya, xb, yb = (batch.column(c)[k].values.to_numpy() for c in ("xa", "ya", "xb", "yb"))
                for i in range(0, len(xa), 32):
                    # in a chunk's own matrix, the rows' pairs with what comes after them
                    first = i if same else 0
                    off = xa[i : i + 32, None] - xb[None, first:]
                    off *= off
                    aside = ya[i : i + 32, None] - yb[None, first:]
                    aside *= aside
                    off += aside
                    np.sqrt(off, out=off)
                    off -= d
                    off *= off
                    if same:
                        off = off[np.triu_indices(len(off), 1, off.shape[1])]
                    total += float(off.sum()) / (d * d)
        yield pa.record_batch([pa.array([total])], ["part"])

    return _stress_told(rows.mapInArrow(run, "part double"), 0.5 if half else 1.0)


def _stress_told(parts: DataFrame, share: float) -> DataFrame:
    total = parts.agg((F.coalesce(F.sum("part"), F.lit(0.0)) * share).alias("stress"))
    return total.select(F.when(F.isnan("stress"), F.raise_error(F.lit("no position of a node"))).otherwise(F.col("stress")).alias("stress"))


def pair_table(distances: DataFrame) -> DataFrame:
    """(u, v, dij, wij) of reachable pairs u < v: weight 1 / d^2."""
    d = F.col("d").cast("double")
    return distances.where("u < v and d > 0").select("u", "v", d.alias("dij"), (1.0 / (d * d)).alias("wij"))


def extrema(pairs: DataFrame) -> DataFrame:
    """One row: dmin, dmax, wmin, wmax; nulls without pairs."""
    out = pairs.agg(F.min("dij").alias("dmin"), F.max("dij").alias("dmax"))
    return out.select("dmin", "dmax", (1.0 / (F.col("dmax") * F.col("dmax"))).alias("wmin"), (1.0 / (F.col("dmin") * F.col("dmin"))).alias("wmax"))


def indexed(pairs: DataFrame) -> DataFrame:
    """Pairs with pair_idx, from 0 in the order of (u, v)."""
    return numbered(pairs, "pair_idx", "u", "v")


def narrowed(pairs: DataFrame) -> DataFrame:
    """Pairs in half the bytes: int ids, single-precision distances and weights."""
    return pairs.select(F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.col("dij").cast("float").alias("dij"), F.col("wij").cast("float").alias("wij"))
