"""Near-duplicate embeddings by sorted projection passes (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import cut, internal_id, public_id

_WIDTH = 48  # hash bits that a pass concatenates
_WIDEST = 512  # places that a window grows to
_TILE = 4096  # classes of a block, where all pairs of a label are compared
_MISSED = 0.001  # share of pairs at the least cosine that passes may be expected to miss
_FEW_BYTES = 32 << 20  # of labels' means that may go to every task


def _planes(dimension: int, turn: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([dimension, turn])).standard_normal((dimension, _WIDTH))


def effort(n: int, spread: float, least: float, passes: int, window: int) -> tuple[int, int]:
    """Passes and window for a label of n classes, whose unit vectors have mean squared distance `spread` from their mean; no
    passes: compare all pairs, in tiles.

    Centred, two vectors at the least cosine have a cosine of about 1 - (1 - least) / spread. The window is the expected number of
    classes that share so many bits that each pass has an even chance to keep such a pair together, between window and _WIDEST; where that
    isn't enough, passes grow until at most _MISSED of such pairs are expected to be missed, or tiles send fewer copies of the vectors.
    """
    near = 1 - (1 - least) / spread if spread > 0 else -1.0
    same = min(max(1 - np.arccos(np.clip(near, -1.0, 1.0)) / np.pi, 1e-9), 1 - 1e-9)
    wide = int(np.clip(np.ceil(n * 2.0 ** (np.log(2) / np.log(same))), window, _WIDEST))
    chance = min(same ** max(np.log2(n / wide), 0.0), 1 - 1e-9)
    turns = max(passes, int(min(np.ceil(np.log(_MISSED) / np.log1p(-chance)), 1 << 30)))
    return (0, wide) if turns > passes and -(-n // _TILE) <= turns else (turns, wide)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors to sums of unit vectors by group; a group may come more than once."""
    held: dict[int, list] = {}

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].tobytes() for v in held.values()], pa.binary())], ["group", "n", "total"])

    for batch in batches:
        for group, v in zip(batch.column("group").to_pylist(), batch.column("embedding"), strict=True):
            x = np.asarray(v.values, dtype=np.float64)
            x = x / np.sqrt(x @ x)
            if group in held:
                held[group][0] += 1
                held[group][1] += x
            else:
                held[group] = [1, x]
        if len(held) > 4096:
            yield out()
            held = {}
    if held:
        yield out()


def _plan(least: float, passes: int, window: int):
    """Sums of one group to its mean and effort."""

    def run(table: pa.Table) -> pa.Table:
        n = sum(table.column("n").to_pylist())
        mean = sum(_unit(table.column("total").combine_chunks())) / n
        turns, wide = effort(n, 1 - float(mean @ mean), least, passes, window)
        return pa.table({"group": table.column("group")[:1], "n": pa.array([n], pa.int64()), "turns": pa.array([turns], pa.int32()), "wide": pa.array([wide], pa.int32()), "mean": pa.array([mean.tobytes()], pa.binary())})

    return run


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one class each to (pass, group, code, class, wide, vector): the code joins sign hashes of the centred vector."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    names = ["pass", "group", "code", "class", "wide", "vector"]
    weights = np.int64(1) << np.arange(_WIDTH - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column("embedding").offsets))
        for d in np.unique(sizes).tolist():
            part = batch.take(pa.array(np.flatnonzero(sizes == d)))
            x = np.asarray(part.column("embedding").flatten(), dtype=np.float64).reshape(-1, d)
            vectors = pa.array([v.tobytes() for v in x], pa.binary())
            centred = x / np.sqrt((x * x).sum(axis=1))[:, None] - np.array(_unit(part.column("mean")))
            turns = part.column("turns").to_numpy()
            for p in range(int(turns.max())):
                if (d, p) not in planes:
                    planes[d, p] = _planes(d, p)
                rows = np.flatnonzero(turns > p)
                codes = (centred[rows] @ planes[d, p] >= 0) @ weights
                at = pa.array(rows)
                yield pa.record_batch([pa.array(np.full(len(rows), p, np.int32)), part.column("group").take(at), pa.array(codes), part.column("class").take(at), part.column("wide").take(at), vectors.take(at)], names)


def _unit(vectors: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=np.float64) for v in vectors]


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Unit vectors; shorter ones are padded."""
    x = np.zeros((len(vectors), max(len(v) for v in vectors)))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.column_stack([np.maximum(a, b), np.minimum(a, b)]), axis=0)
    return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])


_EDGE = ["part", "side", "place", "pass", "group", "class", "wide", "vector"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_FOUND = "a long, b long, part int, side int, place long, pass int, group long, class long, wide int, vector binary"
#: Sides of a partition: its first rows, its last rows, and how many it has.
_HEAD, _TAIL, _SIZE = range(3)


def _neighbours(least: float):
    """Rows in order of (pass, group, code) to the pairs within `wide` places whose cosine reaches least. A partition's first and last rows, as far as
    windows reach over its ends, follow as rows without a pair, with their places in it, and then its size."""

    def edge_rows(part: int, side: int, place: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        told = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, side, np.int32)), pa.array(place.astype(np.int64))]
        return pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *told, *(rows.column(c) for c in _EDGE[3:])], ["a", "b", *_EDGE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        tail: tuple[np.ndarray, np.ndarray] | None = None
        last: pa.RecordBatch | None = None
        seen = 0
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                if own and seen < _WIDEST:
                    place = seen + np.arange(batch.num_rows)
                    near = place < batch.column("wide").to_numpy()
                    yield edge_rows(own, _HEAD, place[near], batch.filter(pa.array(near)))
                seen += batch.num_rows
                last = batch if last is None else pa.concat_batches([last, batch])
                last = last.slice(max(0, last.num_rows - _WIDEST))
                x = _matrix(_unit(batch.column("vector")))
                keys = np.column_stack([batch.column("pass").to_numpy(), batch.column("group").to_numpy(), batch.column("class").to_numpy(), batch.column("wide").to_numpy()])
                new = len(x)
                if tail is not None:
                    wide = max(x.shape[1], tail[0].shape[1])
                    x = np.concatenate([np.pad(y, ((0, 0), (0, wide - y.shape[1]))) for y in (tail[0], x)])
                    keys = np.concatenate([tail[1], keys])
                reach = int(keys[-new:, 3].max())
                first = max(0, len(x) - new - reach)
                i, j = np.nonzero(x[-new:] @ x[first:].T >= least)
                i, j = i + len(x) - new, j + first
                good = (j < i) & (i - j <= keys[i, 3]) & (keys[i, 0] == keys[j, 0]) & (keys[i, 1] == keys[j, 1])
                if good.any():
                    pairs = _pair_rows(keys[i[good], 2], keys[j[good], 2])
                    yield pa.record_batch([*pairs.columns, *(pa.nulls(pairs.num_rows, k) for k in _KINDS)], ["a", "b", *_EDGE])
                tail = (x[-_WIDEST:].copy(), keys[-_WIDEST:].copy())
        if last is not None:
            place = seen - last.num_rows + np.arange(last.num_rows)
            near = seen - place <= last.column("wide").to_numpy()
            yield edge_rows(own, _TAIL, place[near], last.filter(pa.array(near)))
            size = [pa.array([own], pa.int32()), pa.array([_SIZE], pa.int32()), pa.array([seen], pa.int64())]
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *size, *(pa.nulls(1, k) for k in _KINDS[3:])], ["a", "b", *_EDGE])

    return run


def _to_borders(sizes):
    """Edge rows to the ends of partitions that windows reach over from them, (border, far, ...): far is how far off the end a row stands, below 0 for those before it. First
    rows go to all ends of earlier partitions that are nearer than their window, so that windows reach over partitions shorter than themselves, and over empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ends = sizes.value
        for batch in batches:
            at = np.searchsorted(parts, batch.column("part").to_numpy())
            start = np.r_[0, ends][at]
            place = start + batch.column("place").to_numpy()
            head = batch.column("side").to_numpy() == _HEAD
            first = np.where(head, np.searchsorted(ends, place - batch.column("wide").to_numpy(), side="right"), at)
            count = np.where(head, np.maximum(at - first, 0), 1)
            rows = np.repeat(np.arange(batch.num_rows), count)
            border = first[rows] + np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
            kept = batch.select(_EDGE[3:]).take(pa.array(rows))
            yield pa.record_batch([pa.array(border.astype(np.int32)), pa.array((place[rows] - ends[border]).astype(np.int32)), *kept.columns], ["border", "far", *_EDGE[3:]])

    return run


def _over_border(least: float):
    """The rows on both sides of a border to the pairs that a window over it finds."""

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(_unit(table.column("vector").combine_chunks()))
        far, turn, group, own, wide = (table.column(c).to_numpy() for c in ("far", "pass", "group", "class", "wide"))
        before, after = np.flatnonzero(far < 0), np.flatnonzero(far >= 0)
        i, j = np.nonzero(x[after] @ x[before].T >= least)
        i, j = after[i], before[j]
        good = (far[i] - far[j] <= wide[i]) & (turn[i] == turn[j]) & (group[i] == group[j])
        return pa.Table.from_batches([_pair_rows(own[i[good]], own[j[good]])])

    return run


def _window_links(ordered: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that windows over the rows in order find, inside partitions and over their borders. Of each partition only its size goes through the driver."""
    found = cut(ordered.mapInArrow(_neighbours(least), _FOUND))
    sizes = found.where(F.col("side") == _SIZE).select("part", "place").orderBy("part").collect()
    shared = ordered.sparkSession.sparkContext.broadcast((np.array([r["part"] for r in sizes]), np.cumsum([r["place"] for r in sizes])))
    edges = found.where(F.col("side") < _SIZE).select(*_EDGE)
    edges = edges.mapInArrow(_to_borders(shared), "border int, far int, pass int, group long, class long, wide int, vector binary")
    links = found.where("side is null").select("a", "b")
    return links.unionByName(edges.groupBy("border").applyInArrow(_over_border(least), "a long, b long"))


def _tile(least: float):
    """Two blocks of a label (or one, when i = j) to the pairs whose cosine reaches least."""

    def run(table: pa.Table) -> pa.Table:
        x = _matrix(_unit(table.column("vector").combine_chunks()))
        own, side = table.column("class").to_numpy(), table.column("side").to_numpy()
        ask, told = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if table.column("i")[0] == table.column("j")[0]:
            told = ask
        found = [np.zeros((0, 2), np.int64)]
        for k in range(0, len(ask), 256):
            rows = ask[k : k + 256]
            i, j = np.nonzero(x[rows] @ x[told].T >= least)
            found.append(np.column_stack([own[rows[i]], own[told[j]]]))
        pairs = np.concatenate(found)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.Table.from_batches([_pair_rows(pairs[:, 0], pairs[:, 1])])

    return run


def _all_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Links among all classes of each group, in tiles of two blocks."""
    blocks = F.ceil(F.col("n") / F.lit(_TILE)).cast("int")
    dealt = rows.withColumns({"own": F.pmod(F.xxhash64("class"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    # a class asks in the tiles of its block with later ones, and is told in those with earlier ones
    dealt = dealt.select("group", "class", "embedding", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    binary = dealt.mapInArrow(_tile_rows, "group long, class long, i int, j int, side int, vector binary")
    return binary.groupBy("group", "i", "j").applyInArrow(_tile(least), "a long, b long")


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["group", "class", "i", "j", "side"]
    for batch in batches:
        vectors = pa.array([np.asarray(v.values, dtype=np.float64).tobytes() for v in batch.column("embedding")], pa.binary())
        yield pa.record_batch([*(batch.column(c) for c in names), vectors], [*names, "vector"])


def _degrees(least: float):
    """Members of a component, or of two blocks of one (side 0 counts against all, side 1 is counted), to links per class."""

    def run(table: pa.Table) -> pa.Table:
        vectors = _unit(table.column("vector").combine_chunks() if table.num_rows else [])
        x = np.array(vectors)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        own, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        side, core = table.column("side").to_numpy(), table.column("core").to_numpy(zero_copy_only=False)
        links = np.zeros(len(own), dtype=np.int64)
        ask = np.flatnonzero(side == 0)
        told = np.flatnonzero(side == 1)
        for a in range(0, len(ask), 256):
            rows = ask[a : a + 256]
            near = (x[rows] @ x[told].T >= least) & (own[rows][:, None] != own[told][None, :])
            links[rows] += near @ copies[told]
            links[told] += np.where(core[told], copies[rows] @ near, 0)
        return pa.table({"class": own, "links": links})

    return run


def link_embeddings(vectors: DataFrame, least: float = 0.98, passes: int = 10, window: int = 16, block: int = 2048) -> DataFrame:
    """Link vectors of equal, non-null label whose cosine, in double precision, is at least `least`.

    vectors: vec_id, embedding (array of float or double), label. Returns vec_id, n_links (other rows linked directly), component_id
    (smallest vec_id reachable), kept (vec_id = component_id); one row per row of vectors.

    Equal vectors of one label are one class, all linked. Each pass orders the classes of a label by sign hashes of the vectors less the
    label's mean, joined to a code, its own in each pass, and compares each with the next `window`; both grow with the label's size and
    crowding (see effort), and all pairs of a crowded label are compared. Verified pairs of all passes are united. Links are then
    counted among the members of each component: in one task up to `block` members; in larger ones the members within half the
    angle of the centre are linked without comparing, and only the others are compared with all, block by block.

    A vector that is null, empty, zero or holds null or non-finite components, or has a null label, links with nothing. Vectors of different
    length don't link. Null vec_id: takes part, and comes before all others. Repeated rows are equal vectors. Other columns are ignored. An empty
    table gives an empty result. A pair is missed only if no pass sorts it within the window and nothing else joins it; windows reach
    over the borders of sort partitions, of short and empty ones too.
    """
    rows = vectors.select(internal_id("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(usable, F.lit(False)))
    group = F.xxhash64("label", F.size("embedding")).alias("group")
    # equal vectors are told by 128 bits; a class gets a number of its own
    keys = [F.xxhash64("label", "embedding").alias("_key"), F.xxhash64(F.lit(1), "label", "embedding").alias("_check")]
    good = rows.where("good").select("id", group, *keys, "embedding")
    copies = good.groupBy("_key", "_check").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("group").alias("group"), F.first("embedding").alias("embedding"))
    copies = cut(copies.withColumn("class", F.monotonically_increasing_id()))
    planned = copies.select("group", "embedding").mapInArrow(_sums, "group long, n long, total binary").groupBy("group")
    planned = cut(planned.applyInArrow(_plan(least, passes, window), "group long, n long, turns int, wide int, mean binary").where("n > 1"))
    few = (planned.agg(F.sum(F.octet_length("mean"))).first()[0] or 0) <= _FEW_BYTES
    placed = copies.select("group", "class", "embedding").join(F.broadcast(planned) if few else planned, "group")
    coded = placed.where("turns > 0").mapInArrow(_coded, "pass int, group long, code long, class long, wide int, vector binary")
    ordered = coded.repartitionByRange("pass", "group", "code", "class").sortWithinPartitions("pass", "group", "code", "class")
    links = _window_links(ordered, least)
    if planned.where("turns = 0").limit(1).count():
        links = links.unionByName(_all_pairs(placed.where("turns = 0"), least))
    links = cut(links.distinct())
    united = cut(components(links))

    sizes = united.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    inside = united.join(sizes, "component").select(F.col("node").alias("class"), "component", "members")
    members = cut(copies.select("class", "copies", "embedding").join(inside, "class"))
    binary = members.mapInArrow(_as_binary, "class long, copies long, component long, members long, vector binary")
    schema = "class long, links long"
    small = binary.where(F.col("members") <= block).withColumn("core", F.lit(False))
    small = small.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    counted = small.groupBy("component").applyInArrow(_degrees(least), schema)
    counted = counted.unionByName(_large_components(members.where(F.col("members") > block), binary.where(F.col("members") > block), least, block, schema))
    counted = counted.groupBy("class").agg(F.sum("links").alias("links"))

    named = copies.select("class", "_key", "_check", "class_id", "copies").join(inside.select("class", "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(smallest, "component").join(counted, "class", "left").select("_key", "_check", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", *(F.when(F.col("good"), k).alias(c) for k, c in zip(keys, ("_key", "_check"), strict=True))).join(named, ["_key", "_check"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(public_id("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(component != F.lit(-(2**63)), component).alias("component_id"), (F.col("id") == component).alias("kept"))


def _as_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = pa.array([np.asarray(v.values, dtype=np.float64).tobytes() for v in batch.column("embedding")], pa.binary())
        yield pa.record_batch([*(batch.column(c) for c in ("class", "copies", "component", "members")), vectors], ["class", "copies", "component", "members", "vector"])


def _large_components(members: DataFrame, binary: DataFrame, least: float, block: int, schema: str) -> DataFrame:
    """Links per class in components of more than `block` members."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda n, v: n + v * v))
    unit = members.select("class", "component", "copies", "members", F.transform("embedding", lambda v: v / norm).alias("unit"))
    centre = unit.select("component", F.posexplode("unit")).groupBy("component", "pos").agg(F.avg("col").alias("c"))
    centre = centre.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("centre"))
    dot = F.aggregate(F.zip_with("unit", "centre", lambda a, b: a * b), F.lit(0.0), lambda n, v: n + v)
    length = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda n, v: n + v * v))
    limit = float(np.cos(np.arccos(least) / 2)) + 1e-9
    core = F.coalesce(dot / F.when(length > 0, length) >= limit, F.lit(False))
    placed = unit.join(centre, "component").select("class", core.alias("core"))
    sums = placed.join(members.select("class", "component", "copies"), "class")
    total = sums.where("core").groupBy("component").agg(F.sum("copies").alias("total"))
    among = sums.where("core").join(total, "component").select("class", (F.col("total") - F.col("copies")).alias("links"))
    full = binary.join(placed, "class")
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    asked = full.where("not core").select("*", F.lit(0).alias("side"), own.alias("i"), F.explode(every).alias("j"))
    told = full.select("*", F.lit(1).alias("side"), F.explode(every).alias("i"), own.alias("j"))
    grid = asked.unionByName(told).groupBy("component", "i", "j").applyInArrow(_degrees(least), schema)
    return among.unionByName(grid)
