"""Positions and their refinement by pairwise gradient steps.

A round of pairs without a common node has no order inside, so it is one vector operation, and a schedule of such
rounds gives the same result on any machine. Strategies: "rounds" (one task per component), "sequential" (the result of taking pairs one by one
in some order, by vector steps over pairs that don't depend on each other), "tiles" (disjoint tiles of two node blocks in parallel; positions and pairs stay in the cluster).
"""

from __future__ import annotations

import logging
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hash_position, hash_uniform, hash_uniform_of
from ..plans.cuts import cut, numbered
from .schedule import in_block, tile_in_round, tile_round

_log = logging.getLogger(__name__)
#: Nodes nearer than this coincide, and are taken as _APART from each other in x and y.
_NEAR, _APART = 1e-12, 1e-6
#: Nodes of a component whose pairs one task may hold: 200 MB of them.
ONE_TASK = 5_000
#: Nodes of a component that shares a group with others, and pairs that such a group is to have; nodes of a component that tiles leave to one task.
SHARED, _A_GROUP, TILES_IN_TASK = 256, 50_000, 2_000


def start_positions(nodes: DataFrame, seed: int = 0) -> DataFrame:
    node = F.col("node_id")
    return nodes.select("node_id", hash_position(node, "x", seed).alias("x"), hash_position(node, "y", seed).alias("y"))


def centred(positions: DataFrame) -> DataFrame:
    mean = positions.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return positions.crossJoin(F.broadcast(mean)).select("node_id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))


def _parted(dx: Column, dy: Column, u: Column, v: Column, guard: str, seed: int) -> tuple[Column, Column]:
    """Differences, where coincident nodes are taken as _APART from each other: in a fixed direction, at an angle that the pair's hash draws, or by two normal draws."""
    close = F.sqrt(dx * dx + dy * dy) < _NEAR
    if guard == "angle":
        angle = hash_uniform(u, v, seed) * (2.0 * math.pi)
        apart = F.cos(angle) * _APART, F.sin(angle) * _APART
    elif guard == "normal":
        # two uniform draws give two normal ones
        far = F.sqrt(-2.0 * F.ln(1.0 - hash_uniform(u, v, seed))) * _APART
        angle = hash_uniform(v, u, seed + 1) * (2.0 * math.pi)
        apart = far * F.cos(angle), far * F.sin(angle)
    else:
        apart = F.lit(_APART), F.lit(_APART)
    return F.when(close, apart[0]).otherwise(dx), F.when(close, apart[1]).otherwise(dy)


def pair_deltas(pairs: DataFrame, positions: DataFrame, eta: float, guard: str = "fixed", seed: int = 0) -> DataFrame:
    """(node_id, dx, dy): the step of each pair on both of its nodes, from one snapshot of positions. guard: how coincident nodes part, "fixed" as in the
    kernels, "angle" or "normal".

    Pairs that a search finds are estimated at the size of its sources, so they are told to be merged, and never go through the driver."""
    at = lambda c: positions.select(F.col("node_id").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}"))
    rows = pairs.hint("merge").join(at("u"), "u").join(at("v"), "v")
    dx, dy = _parted(F.col("xv") - F.col("xu"), F.col("yv") - F.col("yu"), F.col("u"), F.col("v"), guard, seed)
    norm = F.sqrt(dx * dx + dy * dy)
    step = F.least(F.col("wij") * eta, F.lit(1.0)) * ((norm - F.col("dij")) / 2.0)
    rows = rows.select("u", "v", (step * (dx / norm)).alias("sx"), (step * (dy / norm)).alias("sy"))
    both = F.explode(F.array(F.struct(F.col("u").alias("node_id"), F.col("sx").alias("dx"), F.col("sy").alias("dy")), F.struct(F.col("v").alias("node_id"), (-F.col("sx")).alias("dx"), (-F.col("sy")).alias("dy"))))
    return rows.select(both.alias("e")).select("e.*")


def scatter_add(positions: DataFrame, deltas: DataFrame) -> DataFrame:
    total = deltas.groupBy("node_id").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
    moved = lambda p, d: (F.col(p) + F.coalesce(F.col(d), F.lit(0.0))).alias(p)
    return positions.join(total, "node_id", "left").select("node_id", moved("x", "dx"), moved("y", "dy"))


def _step(p: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, eta: float) -> None:
    """Move the disjoint pairs (a, b), a before b, towards their distances d. Coincident nodes part in a fixed direction."""
    delta = p[b] - p[a]
    norm = np.sqrt((delta * delta).sum(axis=1))
    close = norm < _NEAR
    if close.any():
        delta[close] = _APART
        norm[close] = np.sqrt(2.0) * _APART
    move = (np.minimum(eta / (d * d), 1.0) * ((norm - d) / 2.0))[:, None] * (delta / norm[:, None])
    p[a] += move
    p[b] -= move


def _rounds(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The round of each pair, as schedule.round_of has it, and how many there are."""
    m = n if n % 2 else n - 1
    r = (u.astype(np.int64) + v) * ((m + 1) // 2) % max(m, 1)
    return (r if n % 2 else np.where(v == n - 1, u, r)), m


def dependency_levels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The level of each pair, from 1: one more than the larger last level of its two nodes. Pairs of a level share no node, and all that a pair's nodes went through before it is on lower
    levels, so steps by levels give bit for bit what pairs one by one give."""
    last, out = [0] * n, []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        level = max(last[a], last[b]) + 1
        last[a] = last[b] = level
        out.append(level)
    return np.array(out, dtype=np.int64)


def _one_by_one(p: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray, eta: float, log: list | None) -> None:
    """All pairs in order, by levels; the log keeps the order."""
    level = dependency_levels(u, v, len(p))
    by = np.argsort(level, kind="stable")
    begin = np.searchsorted(level[by], np.arange(1, (level[by[-1]] if len(by) else 0) + 2))
    before = np.empty((2, len(u), 2)) if log is not None else None
    for low, high in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        rows = by[low:high]
        if before is not None:
            before[0, rows], before[1, rows] = p[u[rows]], p[v[rows]]
        _step(p, u[rows], v[rows], d[rows], eta)
    if before is not None:
        log.append((u, v, before[0], before[1]))


ORDERS = ("shuffled", "fixed", "hash")


def _refine(p: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray, etas: list[float], strategy: str, order: str, seed: int, log: list | None, ids: np.ndarray) -> None:
    """u < v: places in p of the pairs, in order; d: their distances."""
    random = np.random.Generator(np.random.PCG64([seed, int(ids[0])]))
    if strategy == "sequential":
        for t, eta in enumerate(etas):
            if order == "hash":
                turn = np.lexsort((v, u, hash_uniform_of(ids[u], ids[v], seed + t)))
            else:
                turn = random.permutation(len(u)) if order == "shuffled" else np.arange(len(u))
            steps: list | None = [] if log is not None else None
            _one_by_one(p, u[turn], v[turn], d[turn], eta, steps)
            for a, b, pa_, pb in steps or ():
                log.append((np.full(len(a), t, np.int32), ids[a], ids[b], pa_, pb))
        return
    of, turns = _rounds(u, v, len(p))
    by = np.argsort(of, kind="stable")
    u, v, d = u[by], v[by], d[by]
    begin = np.searchsorted(of[by], np.arange(turns + 1))
    for t, eta in enumerate(etas):
        for r in random.permutation(turns).tolist() if order == "shuffled" else range(turns):
            at = slice(begin[r], begin[r + 1])
            a, b = u[at], v[at]
            if not len(a):
                continue
            if log is not None:
                log.append((np.full(len(a), t, np.int32), ids[a], ids[b], p[a], p[b]))
            _step(p, a, b, d[at], eta)


def _component_kernel(etas: list[float], strategy: str, order: str, seed: int, audit: bool):
    """A component's pairs and positions, as one group, to its new positions or to its log."""

    def run(pairs: pa.Table, places: pa.Table) -> pa.Table:
        ids = places.column("node_id").to_numpy()
        by = np.argsort(ids)
        ids = ids[by]
        p = np.column_stack([places.column(c).to_numpy() for c in "xy"])[by].astype(np.float64)
        u, v = (np.searchsorted(ids, pairs.column(c).to_numpy()).astype(np.int32) for c in "uv")
        far = pairs.column("dij").to_numpy().astype(np.float64)
        by = np.lexsort((v, u))
        log: list | None = [] if audit else None
        if len(ids):
            _refine(p, u[by], v[by], far[by], etas, strategy, order, seed, log, ids)
        if log is not None:
            none = (np.zeros(0, np.int32), ids[:0], ids[:0], p[:0], p[:0])
            t, a, b, pa_, pb = (np.concatenate(x) for x in zip(*(log or [none]), strict=True))
            cols = [t, np.arange(len(t)), a, b, *(np.ascontiguousarray(x[:, i]) for x in (pa_, pb) for i in (0, 1))]
            return pa.table(dict(zip(["iteration", "record_idx", "u", "v", "xi", "yi", "xj", "yj"], cols, strict=True)))
        return pa.table({"node_id": ids, "x": np.ascontiguousarray(p[:, 0]), "y": np.ascontiguousarray(p[:, 1])})

    return run


def _levels(component: np.ndarray, turn: np.ndarray) -> list[np.ndarray]:
    """Rows of pairs in steps: a component takes its turns in order, and components, which share no node, take theirs side by side."""
    by = np.lexsort((turn, component))
    c, t = component[by], turn[by]
    begins = np.r_[True, c[1:] != c[:-1]]
    number = np.cumsum(begins | np.r_[True, t[1:] != t[:-1]])
    level = number - number[begins][np.cumsum(begins) - 1]
    order = np.argsort(level, kind="stable")
    return np.split(by[order], np.flatnonzero(np.diff(level[order])) + 1)


def _group_kernel(etas: list[float], order: str, seed: int, audit: bool, rounds: list[int] | None = None):
    """Pairs (component, u, v, dij) and positions (component, node_id, x, y) of some components, as one group, to their new positions or their log: what _component_kernel gives by rounds for each of them. With rounds, those of all tiles in
    their order, pairs have (bi, bj, round, sub, turns) too and take the turns that tiles give."""

    def run(pairs: pa.Table, places: pa.Table) -> pa.Table:
        ids = places.column("node_id").to_numpy()
        by = np.argsort(ids)
        ids, p = ids[by], np.column_stack([places.column(c).to_numpy() for c in "xy"])[by].astype(np.float64)
        of, u, v, d = (pairs.column(c).to_numpy() for c in ("component", "u", "v", "dij"))
        by = np.lexsort((v, u))
        of, u, v, d = of[by], u[by], v[by], d[by].astype(np.float64)
        a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
        if len(u) and (not len(ids) or (ids[np.minimum(a, len(ids) - 1)] != u).any() or (ids[np.minimum(b, len(ids) - 1)] != v).any()):
            raise ValueError("a pair names a node without a position")
        log = []
        if rounds is None:
            held = places.column("component").to_numpy()
            turns = _turns_inside(a, b, of, np.sort(held), np.lexsort((places.column("node_id").to_numpy(), held)), places.column("node_id").to_numpy(), order, seed)
        else:
            turns = _turns_of_tiles(*(pairs.column(c).to_numpy()[by] for c in ("bi", "bj", "round", "sub", "turns")), rounds, order, seed)
        steps = None
        for t, eta in enumerate(etas if len(u) else []):
            turn, sub = turns(t)
            if steps is None or order == "shuffled":
                steps = _levels(of, turn * (int(sub.max()) + 1) + sub)
            before = np.empty((2, len(u), 2)) if audit else None
            for rows in steps:
                if before is not None:
                    before[0, rows], before[1, rows] = p[a[rows]], p[b[rows]]
                _step(p, a[rows], b[rows], d[rows], eta)
            if before is not None:
                log.append((t, turn, sub, before))
        if not audit:
            return pa.table({"node_id": ids, "x": np.ascontiguousarray(p[:, 0]), "y": np.ascontiguousarray(p[:, 1])})
        return _told(log, of, u, v, None if rounds is None else [pairs.column(c).to_numpy()[by] for c in ("bi", "bj")])

    return run


def _turns_inside(a: np.ndarray, b: np.ndarray, of: np.ndarray, held: np.ndarray, by: np.ndarray, nodes: np.ndarray, order: str, seed: int):
    """The turn of each pair in a sweep by the rounds of its component. a, b: places among the sorted nodes; held: the components of nodes, sorted; by: nodes in the order of (component, node)."""
    parts, first, size = np.unique(held, return_index=True, return_counts=True)
    seat = np.empty(len(nodes), dtype=np.int64)
    seat[np.argsort(np.argsort(nodes))[by]] = np.arange(len(nodes)) - np.repeat(first, size)
    mine = np.searchsorted(parts, of)
    n = size[mine]
    m = np.where(n % 2, n, n - 1)
    r = (seat[a] + seat[b]) * ((m + 1) // 2) % np.maximum(m, 1)
    r = np.where((n % 2 == 0) & (seat[b] == n - 1), seat[a], r)
    none = np.zeros(len(r), dtype=np.int64)
    if order != "shuffled":
        return lambda t: (r, none)
    least = nodes[by][first]
    random = [np.random.Generator(np.random.PCG64([seed, int(i)])) for i in least]
    begin = np.r_[0, np.cumsum(size)]

    def drawn(t: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.empty(begin[-1], dtype=np.int64)
        for i, generator in enumerate(random):
            turns = int(size[i] if size[i] % 2 else size[i] - 1)
            place[begin[i] + generator.permutation(turns)] = np.arange(turns)
        return place[begin[mine] + r], none

    return drawn


def _orders(rounds: list[int], order: str, seed: int):
    """The order of the rounds of tiles, sweep after sweep."""
    random = np.random.Generator(np.random.PCG64(seed))
    while True:
        yield random.permutation(rounds).tolist() if order == "shuffled" else rounds


def _turns_of_tiles(bi: np.ndarray, bj: np.ndarray, of: np.ndarray, sub: np.ndarray, turns: np.ndarray, rounds: list[int], order: str, seed: int):
    """The turn of each pair in a sweep: of its tile's round among the rounds, and of its sub-round inside the tile."""
    at = np.searchsorted(rounds, of)
    if order != "shuffled":
        return lambda t: (at, sub)
    orders = _orders(rounds, order, seed)
    tiles, first, mine = np.unique(np.column_stack([bi, bj]), axis=0, return_index=True, return_inverse=True)
    mine = mine.reshape(-1)
    begin = np.r_[0, np.cumsum(turns[first])]

    def drawn(t: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.empty(len(rounds), dtype=np.int64)
        place[np.searchsorted(rounds, next(orders))] = np.arange(len(rounds))
        inside = np.empty(begin[-1], dtype=np.int64)
        for k, ((i, j), f) in enumerate(zip(tiles.tolist(), first.tolist(), strict=True)):
            inside[begin[k] + np.random.Generator(np.random.PCG64([seed, t, int(of[f]), i, j])).permutation(int(turns[f]))] = np.arange(turns[f])
        return place[at], inside[begin[mine] + sub]

    return drawn


def _told(log: list, of: np.ndarray, u: np.ndarray, v: np.ndarray, tile: list[np.ndarray] | None) -> pa.Table:
    """A log (sweep, turn, sub, positions before) as rows: with the tickets of each component, or with what tickets of tiles go by."""
    empty = np.zeros(0, np.int64)
    parts = []
    for t, turn, sub, before in log:
        by = np.lexsort((v, u, sub, turn, of))
        parts.append((np.full(len(by), t, np.int32), turn[by], sub[by], of[by], u[by], v[by], *(before[e, by, i] for e in (0, 1) for i in (0, 1)), *(x[by] for x in tile or ())))
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [empty.astype(np.int32), *[empty] * 5, *[np.zeros(0)] * 4, *[empty] * len(tile or ())]
    told = dict(zip(["iteration", "turn", "step", "component", "u", "v", "xi", "yi", "xj", "yj", "bi", "bj"][: len(cols)], cols, strict=True))
    if tile is not None:
        return pa.table({c: told[c].astype(np.int32) if c in ("turn", "bi", "bj") else told[c] for c in ("iteration", "turn", "bi", "bj", "step", "u", "v", "xi", "yi", "xj", "yj")})
    # tickets of a component run on over its sweeps
    by = np.lexsort((told["iteration"], told["component"])) if len(cols[0]) else empty
    begins = np.flatnonzero(np.r_[True, np.diff(told["component"][by]) != 0])[: len(by)]
    ticket = np.empty(len(by), dtype=np.int64)
    ticket[by] = np.arange(len(by)) - np.repeat(begins, np.diff(np.r_[begins, len(by)]))
    return pa.table({"iteration": told["iteration"], "record_idx": ticket} | {c: told[c] for c in ("u", "v", "xi", "yi", "xj", "yj")})


def _own(*names: str) -> list[Column]:
    """Columns that a cogroup tells from those of the other side."""
    return [F.col(c).alias(c) for c in names]


def _groups(components: DataFrame) -> DataFrame:
    """(node_id, component, n, part): the nodes of each component and the group that it belongs to, which is its own above SHARED nodes."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.where(F.col("n") <= SHARED).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
    shared = -1 - F.pmod(F.xxhash64("component"), F.lit(1 + int(pairs) // _A_GROUP))
    sizes = sizes.withColumn("part", F.when(F.col("n") <= SHARED, shared).otherwise(F.col("component")))
    return components.select("node_id", "component").join(sizes, "component")


_PLACED = "node_id long, x double, y double"
AUDIT = "iteration int, record_idx long, u long, v long, xi double, yi double, xj double, yj double"


def refine(pairs: DataFrame, positions: DataFrame, components: DataFrame, etas: list[float], strategy: str = "auto", order: str = "shuffled", seed: int = 0, block: int = 1024, audit: bool = False) -> DataFrame:
    """New positions (node_id, x, y), or with audit a row per step with the positions before it; record_idx counts the steps of a component, with tiles those of all.

    Layouts of components don't touch, so each is a group of its own; rates are global. order: "shuffled" by the
    seed, "fixed", or with "sequential" also "hash", which SQL can compute too. A node outside `components` is alone and stays. With "rounds" and "sequential" a component's pairs are held by its task, 16 bytes each;
    "auto" takes "rounds" where no component has more than ONE_TASK nodes, and "tiles" beyond.
    """
    if strategy == "auto":
        largest = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        strategy = "tiles" if (largest or 0) > ONE_TASK else "rounds"
    if strategy not in ("rounds", "sequential", "tiles"):
        raise ValueError(f"no strategy {strategy}")
    if order not in ORDERS or (order == "hash" and strategy != "sequential"):
        raise ValueError(f"no order {order} for {strategy}")
    if strategy == "tiles":
        return _refine_tiles(pairs, positions, components, etas, seed, block, order, audit)
    schema = AUDIT if audit else _PLACED
    if strategy == "sequential":
        of = components.select("node_id", "component")
        places = positions.join(of, "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))
        grouped = pairs.join(of.withColumnRenamed("node_id", "u"), "u").select("component", "u", "v", "dij")
        return grouped.groupBy("component").cogroup(places.groupBy("component")).applyInArrow(_component_kernel(etas, strategy, order, seed, audit), schema)
    of = cut(_groups(components))
    places = positions.join(of, "node_id", "left").select("node_id", "x", "y", "component", "part")
    grouped = pairs.join(of.select(F.col("node_id").alias("u"), *_own("component", "part")), "u").select("part", "component", "u", "v", "dij")
    small, large = _group_kernel(etas, order, seed, audit), _component_kernel(etas, strategy, order, seed, audit)
    kernel = lambda pairs, places: (small if not pairs.num_rows or pairs.column("part")[0].as_py() < 0 else large)(pairs, places)
    done = grouped.groupBy("part").cogroup(places.where("part is not null").groupBy("part")).applyInArrow(kernel, schema)
    return done if audit else done.unionByName(places.where("part is null").select("node_id", "x", "y"))


def audit_pairs(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """Log rows with pair_idx, by which they join their pairs (pair_idx, u, v, dij, wij)."""
    marked = log.join(pairs.select("u", "v", "pair_idx"), ["u", "v"]).drop("u", "v")
    return marked.join(pairs, "pair_idx")


_TOLD = "iteration int, turn int, bi int, bj int, step long, u long, v long, xi double, yi double, xj double, yj double"
_LOGGED = f"part int, {_PLACED}, {_TOLD}"


def _sub_rounds(a: np.ndarray, b: np.ndarray, n: int, inside: bool) -> tuple[np.ndarray, int]:
    """The sub-round of each pair of a tile, whose n nodes are numbered, and how many there are: inside a block by _rounds, across two blocks by the difference of places along the longer one."""
    if inside:
        return _rounds(np.minimum(a, b), np.maximum(a, b), n)
    left, right = np.unique(a), np.unique(b)
    turns = max(len(left), len(right))
    return (np.searchsorted(left, a) - np.searchsorted(right, b)) % turns, turns


def _with_sub_rounds(pairs: pa.Table) -> pa.Table:
    """A tile's pairs with their sub-rounds and how many it has."""
    u, v = (pairs.column(c).to_numpy() for c in "uv")
    own, at = np.unique(np.r_[u, v], return_inverse=True)
    sub, turns = _sub_rounds(at[: len(u)], at[len(u) :], len(own), pairs.column("bi")[0].as_py() == pairs.column("bj")[0].as_py())
    return pairs.append_column("sub", pa.array(sub.astype(np.int64))).append_column("turns", pa.array(np.full(len(u), turns, np.int64)))


def _tile_kernel(eta: float, seed: list[int], shuffled: bool, audit: tuple[int, int] | None):
    """A tile's pairs and the positions of its blocks to the new positions, and with audit (sweep, turn) to its log too. Blocks without a tile stay as they are."""

    def run(pairs: pa.Table, places: pa.Table) -> pa.Table:
        nodes = places.column("node_id").to_numpy()
        by = np.argsort(nodes)
        nodes, p = nodes[by], np.column_stack([places.column(c).to_numpy() for c in "xy"])[by].astype(np.float64)
        log = []
        if pairs.num_rows:
            ends = [pairs.column(c).to_numpy() for c in "uv"]
            order = np.lexsort((ends[1], ends[0]))
            u, v = ends[0][order], ends[1][order]
            i, j = pairs.column("bi")[0].as_py(), pairs.column("bj")[0].as_py()
            far = pairs.column("dij").to_numpy()[order].astype(np.float64)
            own, at = np.unique(np.r_[u, v], return_inverse=True)
            where = np.minimum(np.searchsorted(nodes, own), max(len(nodes) - 1, 0))
            if not len(nodes) or (nodes[where] != own).any():
                raise ValueError("a pair names a node without a position")
            local = p[where]
            a, b = at[: len(u)], at[len(u) :]
            if "sub" in pairs.column_names:
                sub, turns = pairs.column("sub").to_numpy()[order], pairs.column("turns")[0].as_py()
            else:
                sub, turns = _sub_rounds(a, b, len(own), i == j)
            turn = np.random.Generator(np.random.PCG64([*seed, i, j])).permutation(turns) if shuffled else np.arange(turns)
            by = np.argsort(sub, kind="stable")
            begin = np.searchsorted(sub[by], np.arange(turns + 1))
            for step, s in enumerate(turn.tolist()):
                rows = by[begin[s] : begin[s + 1]]
                if len(rows):
                    if audit:
                        log.append((u[rows], v[rows], local[a[rows]], local[b[rows]], np.full(len(rows), step)))
                    _step(local, a[rows], b[rows], far[rows], eta)
            p[where] = local
        column = lambda x: np.ascontiguousarray(x)
        placed = {"node_id": nodes, "x": column(p[:, 0]), "y": column(p[:, 1])}
        if not audit:
            return pa.table(placed)
        rows = sum(len(x[0]) for x in log)
        both = lambda n, own, first: pa.array(np.r_[np.zeros(n, own.dtype), own] if not first else np.r_[own, np.zeros(n, own.dtype)])
        done = [np.concatenate(x) for x in zip(*log, strict=True)] if log else [np.zeros(0, np.int64)] * 2 + [np.zeros((0, 2))] * 2 + [np.zeros(0, np.int64)]
        told = {"u": done[0], "v": done[1], "xi": column(done[2][:, 0]), "yi": column(done[2][:, 1]), "xj": column(done[3][:, 0]), "yj": column(done[3][:, 1])}
        fixed = {"iteration": audit[0], "turn": audit[1], "bi": i if rows else 0, "bj": j if rows else 0}
        out = {"part": both(len(nodes), np.ones(rows, np.int32), False)} | {c: both(rows, x, True) for c, x in placed.items()}
        out |= {c: both(len(nodes), np.full(rows, x, np.int32), False) for c, x in fixed.items()} | {"step": both(len(nodes), done[4], False)}
        return pa.table(out | {c: both(len(nodes), x, False) for c, x in told.items()})

    return run


#: Rounds that follow each other in one job, before positions are cut.
_ROUNDS_A_JOB = 6


def _refine_tiles(pairs: DataFrame, positions: DataFrame, components: DataFrame, etas: list[float], seed: int, block: int, order: str, audit: bool) -> DataFrame:
    """Positions are a table by node, pairs a table parted by round. In a round each block belongs to one tile at most, so the round is one cogroup of the positions, keyed by
    their block's tile, with the pairs of the tiles. Nothing of the graph's size passes through the driver, which knows the numbers of the rounds alone; a task holds a tile.

    Components don't touch, so one of up to TILES_IN_TASK nodes takes all of its turns, which the tiles give, in one task; jobs by rounds are left to larger ones.
    """
    (bi, _), (bj, _) = in_block(F.col("u"), block), in_block(F.col("v"), block)
    blocks = (positions.agg(F.max("node_id")).first()[0] or 0) // block + 1
    dealt = pairs.select("u", "v", F.col("dij").cast("double").alias("dij"), bi.alias("bi"), bj.alias("bj"))
    dealt = dealt.withColumn("round", tile_round(F.col("bi"), F.col("bj"), blocks))
    dealt = dealt.groupBy("bi", "bj").applyInArrow(_with_sub_rounds, "u long, v long, dij double, bi int, bj int, round int, sub long, turns long")
    of = cut(_groups(components).withColumn("small", F.col("n") <= TILES_IN_TASK))
    dealt = dealt.join(of.select(F.col("node_id").alias("u"), *_own("component", "part", "small")), "u", "left")
    dealt = cut(dealt.withColumn("small", F.coalesce("small", F.lit(False))))
    rounds = sorted(r[0] for r in dealt.select("round").distinct().collect())
    places = positions.select("node_id", "x", "y").join(of, "node_id", "left").select("node_id", "x", "y", "component", "part", F.coalesce("small", F.lit(False)).alias("small"))
    kernel = _group_kernel(etas, order, seed, audit, rounds)
    asked, held = dealt.where("small").drop("small"), places.where("small").drop("small")
    done = asked.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(kernel, _TOLD if audit else _PLACED)
    rest, logs = places.where("not small").select("node_id", "x", "y"), [done] if audit else []
    large = dealt.where("not small").select("round", "u", "v", "dij", "bi", "bj", "sub", "turns")
    busy = {r[0] for r in large.select("round").distinct().collect()}
    if busy:
        large = cut(large.repartition("round", "bi", "bj"), "round")
        rest = _by_rounds(large, cut(rest), busy, rounds, blocks, etas, seed, block, order, logs if audit else None)
    if not audit:
        return done.unionByName(rest)
    told = reduce(DataFrame.unionByName, logs)
    tickets = numbered(told, "record_idx", "iteration", "turn", "bi", "bj", "step", "u", "v")
    return tickets.select("iteration", "record_idx", "u", "v", "xi", "yi", "xj", "yj")


def _by_rounds(dealt: DataFrame, now: DataFrame, busy: set[int], rounds: list[int], blocks: int, etas: list[float], seed: int, block: int, order: str, logs: list[DataFrame] | None) -> DataFrame:
    """Positions after the busy rounds of all sweeps, a job for a few of them."""
    audit, since = logs is not None, 0
    own, _ = in_block(F.col("node_id"), block)
    orders = _orders(rounds, order, seed)
    for t, eta in enumerate(etas):
        for turn, r in enumerate(next(orders)):
            if r not in busy:
                continue
            first, second = tile_in_round(own, r, blocks)
            tile = now.select("node_id", "x", "y", first.alias("bi"), second.alias("bj"))
            asked = dealt.where(F.col("round") == r).select("u", "v", "dij", "bi", "bj", "sub", "turns")
            kernel = _tile_kernel(eta, [seed, t, r], order == "shuffled", (t, turn) if audit else None)
            now = asked.groupBy("bi", "bj").cogroup(tile.groupBy("bi", "bj")).applyInArrow(kernel, _LOGGED if audit else _PLACED)
            since += 1
            if audit:
                whole = cut(now)
                logs.append(whole.where("part = 1").select("iteration", "turn", "bi", "bj", "step", "u", "v", "xi", "yi", "xj", "yj"))
                now = whole.where("part = 0").select("node_id", "x", "y")
            elif since % _ROUNDS_A_JOB == 0:
                now = cut(now)
        _log.info("sweep %d of %d: %d rounds at rate %.6g", t + 1, len(etas), len(busy), eta)
    return now
