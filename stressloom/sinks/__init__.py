"""Result files and pictures."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.text import text_pixels, title_height
from ..plans.cuts import numbered


def result_rows(edges: DataFrame, positions: DataFrame, title: str, stamp: str, places: int = 9) -> DataFrame:
    """(section, ordinal, line) of a result file; by section and ordinal they are in order."""
    spark = edges.sparkSession
    n, e = positions.agg(F.count(F.lit(1)).alias("n")), edges.agg(F.count(F.lit(1)).alias("e"))
    head = n.crossJoin(e).select(F.posexplode(F.array(F.lit(f"# {title}"), F.lit(f"# Timestamp: {stamp}"), F.concat(F.lit("# Node count: "), "n"), F.concat(F.lit("# Edge count: "), "e"), F.lit(""))))
    head = head.select(F.lit(0).alias("section"), F.col("pos").cast("long").alias("ordinal"), F.col("col").alias("line"))
    fixed = lambda section, lines: spark.createDataFrame([(section, i, x) for i, x in enumerate(lines)], "section int, ordinal long, line string")
    edge = numbered(edges, "ordinal", "src", "dst").select(F.lit(2).alias("section"), "ordinal", F.concat_ws(" ", "src", "dst").alias("line"))
    place = positions.select(F.lit(4).alias("section"), F.col("node_id").alias("ordinal"), F.format_string(f"%.{places}f %.{places}f", "x", "y").alias("line"))
    return head.unionByName(fixed(1, ["# Edges (source target)"])).unionByName(edge).unionByName(fixed(3, ["", "# Positions (x y)"])).unionByName(place)


def result_name(label: str, graph: str, stamp: datetime, state: int) -> str:
    """state 0: before refinement, 1: after."""
    return f"{label}-{graph}-{stamp:%Y%m%d_%H%M%S}-{state}.txt"


def write_result(edges: DataFrame, positions: DataFrame, path: str, title: str, stamp: str | None = None) -> None:
    """One text file at path, written by the driver line by line, so no part of it is gathered at once. result.save_result writes the same by tasks."""
    rows = result_rows(edges, positions, title, stamp or f"{datetime.now():%Y-%m-%d %H:%M:%S}").orderBy("section", "ordinal")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        for row in rows.toLocalIterator():
            out.write(f"{row['line']}\n")


def image(pixels: DataFrame, width: int, height: int) -> np.ndarray:
    """Pixels on white as an array (height, width, 4); at most one row a pixel comes to the driver."""
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    table = pixels.where(f"px between 0 and {width - 1} and py between 0 and {height - 1}").toArrow()
    at = table.column("py").to_numpy(), table.column("px").to_numpy()
    for i, c in enumerate("rgba"):
        out[(*at, i)] = table.column(c).to_numpy()
    return out


def picture_size(text: str) -> tuple[int, int]:
    """Width and height of a text like 2048x1024."""
    width, _, height = text.lower().partition("x")
    if not (width.isdecimal() and height.isdecimal() and int(width) and int(height)):
        raise ValueError(f"not a size like 2048x2048: {text}")
    return int(width), int(height)


def picture_radius(text: str) -> float:
    """A node's radius in pixels, above 0."""
    radius = float(text)
    if not 0 < radius < float("inf"):
        raise ValueError(f"not a radius: {text}")
    return radius


def stress_title(name: str, stress: float | None) -> str:
    return f"{name}, stress {stress:.2f}" if stress is not None else f"{name}, disconnected"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


_SIGNED = b"\x89PNG\r\n\x1a\n"


def _head(width: int, height: int, title: str, dpi: int) -> bytes:
    metre = round(dpi / 0.0254)
    told = _chunk(b"iTXt", b"Title\0\0\0\0\0" + title.encode()) if title else b""
    return _SIGNED + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"pHYs", struct.pack(">IIB", metre, metre, 1)) + told


def joined_adler(first: int, second: int, length: int) -> int:
    """The Adler-32 checksum of two texts one after the other, from those of both and the length of the second."""
    low, high = first & 0xFFFF, first >> 16
    low2, high2 = second & 0xFFFF, second >> 16
    return (low + low2 - 1) % 65521 | ((high + high2 + length % 65521 * (low - 1)) % 65521) << 16


def _band(width: int, height: int, rows: int):
    """The pixels of a band to its part of the compressed stream, which ends on a whole byte and is no last part, and to what its checksum is joined by."""

    def run(bands: pa.Table, pixels: pa.Table) -> pa.Table:
        band = bands.column("band")[0].as_py()
        high = min(rows, height - band * rows)
        out = np.full((high, width, 4), 255, dtype=np.uint8)
        at = pixels.column("py").to_numpy() - band * rows, pixels.column("px").to_numpy()
        for i, c in enumerate("rgba"):
            out[(*at, i)] = pixels.column(c).to_numpy()
        lines = np.concatenate([np.zeros((high, 1), np.uint8), out.reshape(high, width * 4)], axis=1).tobytes()
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = deflate.compress(lines) + deflate.flush(zlib.Z_FULL_FLUSH)
        return pa.table({"band": pa.array([band], pa.int32()), "data": pa.array([data], pa.binary()), "adler": [zlib.adler32(lines)], "length": [len(lines)]})

    return run


def png_bands(pixels: DataFrame, width: int, height: int, rows: int = 64) -> DataFrame:
    """(band, data, adler, length): the picture in bands of `rows` lines, each compressed by a task of its own; bands without a pixel are white."""
    inside = pixels.where(f"px between 0 and {width - 1} and py between 0 and {height - 1}").withColumn("band", F.floor(F.col("py") / rows).cast("int"))
    bands = pixels.sparkSession.range(-(-height // rows)).select(F.col("id").cast("int").alias("band"))
    return bands.groupBy("band").cogroup(inside.groupBy("band")).applyInArrow(_band(width, height, rows), "band int, data binary, adler long, length long")


def _draw_whole(path: str, pixels: DataFrame, width: int, height: int, title: str, dpi: int, rows: int = 64) -> None:
    """Bands as they come, in order; the driver holds one compressed band at a time."""
    check = 1
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as out:
        out.write(_head(width, height, title, dpi) + _chunk(b"IDAT", b"\x78\x9c"))
        for row in png_bands(pixels, width, height, rows).orderBy("band").toLocalIterator():
            out.write(_chunk(b"IDAT", bytes(row["data"])))
            check = joined_adler(check, row["adler"], row["length"])
        out.write(_chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", check)) + _chunk(b"IEND", b""))


def draw_png(path: str, pixels: DataFrame, width: int, height: int, title: str = "", dpi: int = 150, scale: int = 3, rows: int = 64) -> None:
    """A picture of pixels (px, py, r, g, b, a) on white as PNG, under its title, which is drawn above it and kept as PNG text."""
    top = title_height(scale) if title else 0
    whole = pixels.select((F.col("px")).alias("px"), (F.col("py") + top).alias("py"), "r", "g", "b", "a").where(f"py >= {top}")
    if title:
        whole = whole.unionByName(text_pixels(pixels.sparkSession, title, scale, 0, width, scale))
    _draw_whole(path, whole, width, height + top, title, dpi, rows)


def draw_side_by_side(path: str, left: DataFrame, right: DataFrame, width: int, height: int, titles: tuple[str, str] = ("", ""), dpi: int = 150, scale: int = 3) -> None:
    """Before and after in one picture, each under its own title."""
    spark = left.sparkSession
    top = title_height(scale) if any(titles) else 0
    within = f"px between 0 and {width - 1} and py between 0 and {height - 1}"
    moved = lambda df, by: df.where(within).select((F.col("px") + by).alias("px"), (F.col("py") + top).alias("py"), "r", "g", "b", "a")
    whole = moved(left, 0).unionByName(moved(right, width))
    for i, title in enumerate(titles):
        if title:
            whole = whole.unionByName(text_pixels(spark, title, i * width + scale, 0, (i + 1) * width, scale))
    _draw_whole(path, whole, 2 * width, height + top, " | ".join(filter(None, titles)), dpi)


def write_png(path: str, picture: np.ndarray, title: str = "", dpi: int = 150) -> None:
    """An array (height, width, 4) with its title as PNG text and its dots per inch."""
    height, width, _ = picture.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), picture.reshape(height, width * 4)], axis=1)
    Path(path).write_bytes(_head(width, height, title, dpi) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b""))


def write_side_by_side(path: str, left: np.ndarray, right: np.ndarray, titles: tuple[str, str] = ("", ""), dpi: int = 150) -> None:
    """Before and after in one picture, with both titles."""
    write_png(path, np.concatenate([left, right], axis=1), " | ".join(filter(None, titles)), dpi)
