"""Pictures as sparse pixels (px, py, r, g, b, a), from the top left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Colour of edges and nodes, and how much of an edge's pixel is edge.
COLOUR = (0.122, 0.467, 0.706)
ALPHA = 0.7


def viewport(positions: DataFrame) -> DataFrame:
    """One row: the bounding box and 5 % of its extent, of 1e-6 at least, on each side."""
    box = positions.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    pad = lambda c: F.greatest(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(1e-6)) * 0.05
    side = lambda c: [(F.col(f"{c}0") - pad(c)).alias(f"{c}_min"), (F.col(f"{c}1") + pad(c)).alias(f"{c}_max")]
    return box.select(*side("x"), *side("y"))


def to_square(positions: DataFrame, view: DataFrame, y_up: bool = True) -> DataFrame:
    """Positions from -1 to 1 within the view; y_up: larger y at the top."""
    at = lambda c: 2.0 * (F.col(c) - F.col(f"{c}_min")) / (F.col(f"{c}_max") - F.col(f"{c}_min")) - 1.0
    return positions.crossJoin(F.broadcast(view)).select("node_id", at("x").alias("nx"), (at("y") if y_up else -at("y")).alias("ny"))


def node_radius(radius: float, width: int, height: int) -> tuple[float, float]:
    """A radius of pixels in units of the square."""
    return 2.0 * radius / width, 2.0 * radius / height


def to_pixels(square: DataFrame, width: int, height: int) -> DataFrame:
    px = F.floor((F.col("nx") + 1.0) / 2.0 * (width - 1) + 0.5)
    py = F.floor((1.0 - F.col("ny")) / 2.0 * (height - 1) + 0.5)
    return square.select("node_id", px.cast("int").alias("px"), py.cast("int").alias("py"))


def edge_vertices(edges: DataFrame, positions: DataFrame, columns: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Edges with the coordinates of both ends: (src, dst, x0, y0, x1, y1). An edge to a node without a position is an error."""
    at = lambda c: positions.select(F.col("node_id").alias(c), F.struct(*columns).alias(f"at_{c}"))
    rows = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    place = lambda c, i: F.coalesce(F.col(f"at_{c}"), F.raise_error(F.concat(F.lit("no position of node "), F.col(c).cast("string"))))[columns[i]]
    return rows.select("src", "dst", place("src", 0).alias("x0"), place("src", 1).alias("y0"), place("dst", 0).alias("x1"), place("dst", 1).alias("y1"))


def edge_pixels(edges: DataFrame, pixels: DataFrame) -> DataFrame:
    """(px, py, n): how many edges draw each pixel, stepping along the longer axis."""
    rows = edge_vertices(edges, pixels, ("px", "py"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = rows.withColumn("steps", F.greatest(F.abs(dx), F.abs(dy))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    along = lambda a, d: F.floor(F.col(a) + d * F.col("i") / F.greatest(F.col("steps"), F.lit(1)).cast("double") + 0.5).cast("int")
    return rows.select(along("x0", dx).alias("px"), along("y0", dy).alias("py")).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))


#: Sides of an image tile, in pixels; tiles whose counts a task holds; pixels of edges that it makes at a time.
TILE, _MOST_TILES, _AT_ONCE = 256, 256, 1 << 20
#: Pixels and longest side of a picture that a task counts in whole matrices, edges that it draws there at a time, and columns for which it looks up which edges cross them.
_WHOLE, _LONGEST, _EDGES, _COLUMNS = 1 << 22, 8192, 1 << 16, 64


class _Counts:
    """How often pixels are drawn, as a matrix for each image tile that is touched."""

    def __init__(self, width: int, height: int):
        self.across = -(-width // TILE)
        self.size = width, height
        self.tiles: dict[int, np.ndarray] = {}

    def add(self, px: np.ndarray, py: np.ndarray) -> None:
        inside = (px >= 0) & (py >= 0) & (px < self.size[0]) & (py < self.size[1])
        px, py = px[inside], py[inside]
        if not len(px):
            return
        tile = py // TILE * self.across + px // TILE
        by = np.argsort(tile, kind="stable")
        place = (py % TILE * TILE + px % TILE)[by]
        found, begin = np.unique(tile[by], return_index=True)
        for t, low, high in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(by)], strict=True):
            counts = np.bincount(place[low:high], minlength=TILE * TILE)
            self.tiles[t] = self.tiles[t] + counts if t in self.tiles else counts

    def drawn(self) -> Iterator[pa.RecordBatch]:
        """Their pixels that are drawn; then they are empty."""
        while self.tiles:
            t, counts = self.tiles.popitem()
            place = np.flatnonzero(counts)
            px, py = t % self.across * TILE + place % TILE, t // self.across * TILE + place // TILE
            yield pa.record_batch([pa.array(px.astype(np.int32)), pa.array(py.astype(np.int32)), pa.array(counts[place])], ["px", "py", "n"])


def _clipped(start: np.ndarray, step: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last i at which start + step * i may be inside 0 .. size - 1, give or take one."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (-1.0 - start) / step, (size - start) / step
    flat = step == 0
    never = flat & ((start < 0) | (start >= size))
    low = np.where(flat, np.where(never, 1.0, -np.inf), np.minimum(a, b))
    high = np.where(flat, np.where(never, 0.0, np.inf), np.maximum(a, b))
    return low, high


def _cross(counts: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> None:
    """Add to counts[x, y + _COLUMNS] the pixels (x, y) of edges that lie inside, no steeper than one, at each of their columns x.

    At a column those that began by then are counted and those that ended before are taken off again, so that both are the first of a sorted array. Heights are above a half by
    1e-6, which is more than their errors and less than the next fraction of a step, so that halves round up, from either end.
    """
    turned = x0 > x1
    x0, y0, x1, y1 = np.where(turned, x1, x0), np.where(turned, y1, y0), np.where(turned, x0, x1), np.where(turned, y0, y1)
    by = np.argsort(x0, kind="stable")
    x0, y0, x1, y1 = x0[by], y0[by], x1[by], y1[by]
    slope = (y1 - y0) / np.maximum(x1 - x0, 1)
    level = y0 + (0.5 + 1e-6 + _COLUMNS) - slope * x0
    for first in range(int(x0[0]), int(x1.max()) + 1, _COLUMNS):
        columns = np.arange(first, min(first + _COLUMNS, len(counts)))
        on = np.flatnonzero(x1[: np.searchsorted(x0, first + _COLUMNS)] >= first)
        begun = np.searchsorted(x0[on], columns, side="right")
        step, at = slope[on], level[on] + slope[on] * first
        over = np.flatnonzero(x1[on] < columns[-1])
        over = over[np.argsort(x1[on][over], kind="stable")]
        ended = np.searchsorted(x1[on][over], columns)
        over_step, over_at = step[over], at[over]
        for x, plus, minus in zip(columns.tolist(), begun.tolist(), ended.tolist(), strict=True):
            counts[x] += np.bincount(at[:plus].astype(np.int64), minlength=counts.shape[1])
            if minus:
                counts[x] -= np.bincount(over_at[:minus].astype(np.int64), minlength=counts.shape[1])
            at += step
            over_at += over_step


class _Whole:
    """How often pixels of a picture are drawn, as matrices of all of it."""

    def __init__(self, width: int, height: int, thick: int):
        self.size, self.thick = (width, height), thick
        self.flat, self.steep = (np.zeros((a, b + 2 * _COLUMNS), dtype=np.int64) for a, b in ((width, height), (height, width)))
        self.counts = np.zeros((height, width), dtype=np.int64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, px: np.ndarray, py: np.ndarray) -> None:
        inside = (px >= 0) & (py >= 0) & (px < self.size[0]) & (py < self.size[1])
        np.add.at(self.counts, (py[inside], px[inside]), 1)

    def lines(self, *ends: np.ndarray) -> None:
        """Edges (x0, y0, x1, y1) that lie inside the picture."""
        self.held.append(ends)
        self.rows += len(ends[0])
        if self.rows >= _EDGES:
            self._draw_held()

    def _draw_held(self) -> None:
        if not self.rows:
            return
        x0, y0, x1, y1 = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.rows = [], 0
        flat = abs(x1 - x0) >= abs(y1 - y0)
        if flat.any():
            _cross(self.flat, x0[flat], y0[flat], x1[flat], y1[flat])
        if not flat.all():
            _cross(self.steep, y0[~flat], x0[~flat], y1[~flat], x1[~flat])

    def drawn(self) -> Iterator[pa.RecordBatch]:
        """The counts of each row of pixels that has any."""
        self._draw_held()
        width, height = self.size
        flat, steep = self.flat[:, _COLUMNS : _COLUMNS + height].T, self.steep[:, _COLUMNS : _COLUMNS + width]
        for aside in range(-((self.thick - 1) // 2), self.thick // 2 + 1):
            up, down = max(0, -aside), max(0, aside)
            if up + down < height:
                self.counts[down : height - up] += flat[up : height - down]
            if up + down < width:
                self.counts[:, down : width - up] += steep[:, up : width - down]
        rows = np.flatnonzero(self.counts.any(axis=1))
        for i in range(0, len(rows), 64):
            some = self.counts[rows[i : i + 64]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(some.reshape(-1)))
            yield pa.record_batch([pa.array(rows[i : i + 64].astype(np.int32)), lists], ["py", "counts"])


def _row_total(rows: pa.Table) -> pa.Table:
    """The counts of one row of pixels, by all tasks, to its pixels that are drawn."""
    total = sum(chunk.flatten().to_numpy().reshape(len(chunk), -1).sum(axis=0) for chunk in rows.column("counts").chunks)
    px = np.flatnonzero(total)
    return pa.table({"px": px.astype(np.int32), "py": np.full(len(px), rows.column("py")[0].as_py(), np.int32), "n": total[px]})


def _draw(width: int, height: int, thick: int, whole: bool):
    """Edges (x0, y0, x1, y1 in pixels) to the counts of the pixels that they draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Whole(width, height, thick) if whole else _Counts(width, height)
        for batch in batches:
            x0, y0, x1, y1 = (batch.column(c).to_numpy().astype(np.int64) for c in ("x0", "y0", "x1", "y1"))
            if whole:
                inside = (np.minimum(x0, x1) >= 0) & (np.minimum(y0, y1) >= 0) & (np.maximum(x0, x1) < width) & (np.maximum(y0, y1) < height)
                counts.lines(x0[inside], y0[inside], x1[inside], y1[inside])
                x0, y0, x1, y1 = x0[~inside], y0[~inside], x1[~inside], y1[~inside]
            dx, dy = x1 - x0, y1 - y0
            steps = np.maximum(abs(dx), abs(dy))
            # only the part of an edge that may be inside the picture
            per = np.maximum(steps, 1).astype(np.float64)
            (lx, hx), (ly, hy) = _clipped(x0 + thick, dx / per, width + 2 * thick), _clipped(y0 + thick, dy / per, height + 2 * thick)
            low = np.maximum(0, np.floor(np.maximum(lx, ly)))
            high = np.minimum(steps, np.ceil(np.minimum(hx, hy)))
            length = np.maximum(0, high - low + 1).astype(np.int64)
            low = np.where(length > 0, low, 0).astype(np.int64)
            begin, total = 0, np.cumsum(length)
            while begin < len(length):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + _AT_ONCE, side="right")))
                rows = np.repeat(np.arange(begin, end), length[begin:end])
                i = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(length[begin:end])[:-1]], length[begin:end]) + low[rows]
                px = np.floor(x0[rows] + dx[rows] * i / per[rows] + 0.5).astype(np.int64)
                py = np.floor(y0[rows] + dy[rows] * i / per[rows] + 0.5).astype(np.int64)
                flat = abs(dx[rows]) >= abs(dy[rows])
                for aside in range(-((thick - 1) // 2), thick // 2 + 1):
                    counts.add(px + np.where(flat, 0, aside), py + np.where(flat, aside, 0))
                begin = end
                if not whole and len(counts.tiles) > _MOST_TILES:
                    yield from counts.drawn()
        yield from counts.drawn()

    return run


def edge_counts(edges: DataFrame, pixels: DataFrame, width: int, height: int, thick: int = 1) -> DataFrame:
    """edge_pixels inside the picture, without a row per pixel and edge. Of a picture of up to _WHOLE pixels a task counts its edges column by column in matrices of all of it, and
    sends a row of pixels as one row. Of a larger one it clips its edges and counts them in a matrix for each image tile, and what it sends are the pixels that it
    has drawn, at most one row each. thick: pixels across an edge."""
    ends = edge_vertices(edges, pixels, ("px", "py")).select("x0", "y0", "x1", "y1")
    whole = width * height <= _WHOLE and max(width, height) <= _LONGEST
    if whole:
        drawn = ends.mapInArrow(_draw(width, height, thick, whole), "py int, counts array<long>")
        return drawn.groupBy("py").applyInArrow(_row_total, "px int, py int, n long")
    drawn = ends.mapInArrow(_draw(width, height, thick, whole), "px int, py int, n long")
    return drawn.groupBy("px", "py").agg(F.sum("n").alias("n"))


def node_pixels(pixels: DataFrame, radius: float, width: int, height: int) -> DataFrame:
    """Pixels within radius of a node, each once, inside the picture."""
    span = F.sequence(F.lit(-int(radius)), F.lit(int(radius)))
    rows = pixels.select("px", "py").distinct().withColumn("ox", F.explode(span)).withColumn("oy", F.explode(span)).where(f"ox * ox + oy * oy <= {radius * radius}")
    rows = rows.select((F.col("px") + F.col("ox")).cast("int").alias("px"), (F.col("py") + F.col("oy")).cast("int").alias("py")).distinct()
    return rows.where(f"px >= 0 and py >= 0 and px < {width} and py < {height}")


def _byte(c: Column) -> Column:
    return F.floor(c * 255.0 + 0.5).cast("int")


def blend(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Edge pixels over white: n layers of one colour leave (1 - alpha)^n of the ground."""
    rest = F.pow(F.lit(1.0 - alpha), F.col("n"))
    return counts.select("px", "py", *(_byte(F.lit(c) + (1.0 - c) * rest).alias(name) for c, name in zip(COLOUR, "rgb", strict=True)), F.lit(255).alias("a"))


def picture(edges: DataFrame, positions: DataFrame, width: int = 2048, height: int = 2048, radius: float = 4, y_up: bool = True, edge_width: float = 1.0) -> DataFrame:
    """Nodes over edges over white; pixels that stay white are left out. radius and edge_width are in pixels; an edge of less than one covers that share of its pixels."""
    pixels = to_pixels(to_square(positions, viewport(positions), y_up), width, height)
    dots = node_pixels(pixels, radius, width, height)
    lines = blend(edge_counts(edges, pixels, width, height, max(1, round(edge_width))), ALPHA * min(1.0, edge_width)).join(dots, ["px", "py"], "left_anti")
    return lines.unionByName(dots.select("px", "py", *(_byte(F.lit(c)).alias(n) for c, n in zip(COLOUR, "rgb", strict=True)), F.lit(255).alias("a")))
