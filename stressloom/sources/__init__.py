"""Graphs from files, generators and tables. Edges are (src, dst), longs."""

from __future__ import annotations

import functools
import glob
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import hash_uniform
from ..plans.cuts import numbered


def mtx_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a MatrixMarket file with ids that grow in file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.trim("value").alias("line"))


def _entries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The size line and the entry lines; comments and blank lines are left out. The size line is the first
    that is no comment, whatever it looks like."""
    body = lines.where((F.col("line") != "") & ~F.col("line").startswith("%"))
    first = body.agg(F.min("line_id").alias("first_id"))
    marked = body.crossJoin(F.broadcast(first))
    return marked.where("line_id = first_id"), marked.where("line_id <> first_id")


def parse_mtx(lines: DataFrame) -> DataFrame:
    """0-based edges (src, dst) of lines (line_id, line); loops dropped, values ignored. A line that doesn't begin with two positive numbers is an error."""
    parts = F.split("line", r"\s+")
    _, entries = _entries(lines)
    good = F.col("line").rlike(r"^0*[1-9]\d*\s+0*[1-9]\d*(\s|$)")
    node = lambda i: (F.when(good, parts[i].cast("long")).otherwise(F.raise_error(F.concat(F.lit("not an entry: "), F.col("line")))) - 1)
    edges = entries.select(node(0).alias("src"), node(1).alias("dst"))
    return edges.where("src <> dst")


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    return parse_mtx(mtx_lines(spark, path))


def probe_mtx(lines: DataFrame) -> DataFrame:
    """One row: declared rows, columns and entries, and the entries found."""
    head, entries = _entries(lines)
    parts = F.split("line", r"\s+")
    declared = head.select(*(parts[i].cast("long").alias(c) for i, c in enumerate(("n_rows", "n_cols", "nnz"))))
    return declared.crossJoin(entries.agg(F.count(F.lit(1)).alias("n_entries")))


#: Share of pairs up to which a random graph's edges are looked up: its steps take 4 * p * 2^31 bytes of a worker.
_SPARSE = 0.02


@functools.cache
def _steps_below(p: float) -> np.ndarray:
    """The sorted g of 0 .. 2^31 - 1 for which hash_uniform falls below p: its first step gives h of u, and the rest depends on g = h + v modulo 2^31 alone.

    The last step is linear in the low 16 bits of its argument with a slope of 40503, so for each of the 2^15 high parts the arguments below p are one or two runs of them.
    """
    m, most = 1 << 31, math.ceil(p * (1 << 31))  # h / m < p where h < most
    high = np.arange(1 << 15, dtype=np.int64)
    base = high * 30011 + 977
    found = []
    for wrap in range(3):
        # low parts with wrap * m <= low * 40503 + base < wrap * m + most
        first = np.clip(-((base - wrap * m) // 40503), 0, 1 << 16)
        last = np.clip(-((base - wrap * m - most) // 40503), 0, 1 << 16)
        count = last - first
        low = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        found.append(np.repeat(high << 16, count) + low)
    back = pow(1103515245, -1, m)
    g = (np.concatenate(found) - 12345).astype(np.uint64) * np.uint64(back) & np.uint64(m - 1)
    return np.sort(g.astype(np.uint32))


def _gnp_by_steps(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """The edges of gnp_graph: a node's larger neighbours are what the sorted steps hold from h + u + 1 to h + n - 1, around 2^31."""
    m = 1 << 31
    if n >= m:
        raise ValueError("at most 2^31 - 1 nodes")

    def run(batches):
        steps = _steps_below(p)
        for batch in batches:
            held, count = [], 0
            for u in batch.column(0).to_pylist():
                h = (u * 1103515245 + 12345 + seed) % m
                low, high = h + u + 1, h + n
                for turn in range(low // m, (high - 1) // m + 1):
                    a, b = np.searchsorted(steps, np.array([max(low - turn * m, 0), min(high - turn * m, m)], dtype=np.int64).astype(np.uint32))
                    dst = steps[a:b].astype(np.int64) + (turn * m - h)
                    held.append((np.full(len(dst), u, np.int64), dst))
                    count += len(dst)
                if count >= 1 << 16:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["src", "dst"])
                    held, count = [], 0
            if count:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["src", "dst"])

    # small nodes have most larger neighbours
    parts = max(spark.sparkContext.defaultParallelism, n // 4096)
    return spark.range(0, n, 1, parts).mapInArrow(run, "src long, dst long")


def gnp_graph(spark: SparkSession, n: int = 500, p: float = 0.005, seed: int = 34) -> DataFrame:
    """Random graph: each pair u < v is an edge where its hash falls below p. Up to _SPARSE, nodes look up their edges, so that the work grows with the edges; above, all pairs are
    looked at, at most 1 / p of them an edge."""
    if 0 < p <= _SPARSE:
        return _gnp_by_steps(spark, n, p, seed)
    u, v = spark.range(n).select(F.col("id").alias("src")), spark.range(n).select(F.col("id").alias("dst"))
    return u.join(v, F.col("src") < F.col("dst")).where(hash_uniform(F.col("src"), F.col("dst"), seed) < p)


def gnp_by_skips(spark: SparkSession, n: int, p: float, seed: int = 34) -> DataFrame:
    """Random graph for large n: each node's larger neighbours by geometric skips, so that the work grows with the edges and not with the
    pairs. Other edges than gnp_graph, of the same distribution; the same for a seed on any partitioning."""

    def run(batches):
        for batch in batches:
            for u in batch.column(0).to_pylist():
                random, found, at = np.random.Generator(np.random.PCG64([seed, u])), [], u
                while at < n and p > 0:
                    ahead = at + np.cumsum(random.geometric(p, 64 + int(2 * p * (n - at))))
                    found.append(ahead[ahead < n])
                    at = int(ahead[-1])
                dst = np.concatenate(found) if found else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array(np.full(len(dst), u, np.int64)), pa.array(dst.astype(np.int64))], ["src", "dst"])

    return spark.range(n).mapInArrow(run, "src long, dst long")


def ring_graph(spark: SparkSession, n: int = 10) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))


#: Parts of a result file, by the line that begins them.
_EDGES, _POSITIONS = "# Edges (source target)", "# Positions (x y)"


def result_lines(spark: SparkSession, path: str) -> DataFrame:
    return mtx_lines(spark, path)


def parse_result(lines: DataFrame) -> DataFrame:
    """Lines (line_id, line) of a result file to rows (part, ordinal, a, b): edges as they stand, positions by node.

    A line of a part must be two numbers, else it is an error; blank lines and other # lines are skipped.
    """
    part = F.when(F.col("line") == _EDGES, "edge").when(F.col("line") == _POSITIONS, "position")
    # the lines that begin a part, a few in any file, go to every task
    begins = lines.where(part.isNotNull()).agg(F.array_sort(F.collect_list(F.struct("line_id", part.alias("part")))).alias("begins"))
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).crossJoin(F.broadcast(begins))
    above = F.filter("begins", lambda b: b["line_id"] < F.col("line_id"))
    rows = rows.withColumn("part", F.try_element_at(above, F.lit(-1))["part"]).where(F.col("part").isNotNull()).select("part", "line_id", "line")
    rows = numbered(rows, "at", "part", "line_id")
    first = rows.groupBy("part").agg(F.min("at").alias("first"))
    rows = rows.join(F.broadcast(first), "part").withColumn("ordinal", F.col("at") - F.col("first"))
    tokens = F.split(F.trim("line"), r"\s+")
    value = lambda i: F.when(F.size(tokens) == 2, tokens[i].cast("double")).otherwise(F.raise_error(F.concat(F.lit("not two numbers: "), F.col("line"))))
    return rows.select("part", "ordinal", value(0).alias("a"), value(1).alias("b"))


def read_result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) and positions (node_id, x, y) of a result file; an edge beyond the nodes is an error."""
    rows = parse_result(result_lines(spark, path))
    edges = rows.where("part = 'edge'").select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"))
    positions = rows.where("part = 'position'").select(F.col("ordinal").alias("node_id"), F.col("a").alias("x"), F.col("b").alias("y"))
    nodes = positions.count()
    if not nodes:
        raise ValueError(f"no positions in {path}")
    if edges.where((F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= nodes)).limit(1).count():
        raise ValueError(f"an edge beyond the {nodes} nodes in {path}")
    return edges, positions


def result_path(name: str, folder: str = "output") -> Path:
    """A bare name stands for a file in folder: of that name, with .txt after it, or the only or last by name that begins with it. Others are paths."""
    path = Path(name)
    if path.parent != Path("."):
        return path
    whole = Path(folder) / (name if path.suffix else f"{name}.txt")
    begun = sorted(Path(folder).glob(f"{glob.escape(name)}*.txt")) if not whole.exists() else []
    return begun[-1] if begun else whole


def matrix_path(name: str, folder: str = "data") -> Path:
    """A bare name stands for the MatrixMarket file of that name in folder; others are paths."""
    path = Path(name)
    return path if path.parent != Path(".") else Path(folder) / (name if path.suffix else f"{name}.mtx")


def graph_edges(spark: SparkSession, name: str, folder: str = "data") -> DataFrame:
    """The edges of a named matrix; a blank name stands for the random graph."""
    return read_mtx(spark, str(matrix_path(name.strip(), folder))) if name.strip() else gnp_graph(spark)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations to their regions (100 + key), and a ring of nations."""
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    return nation.select(F.col("n").alias("src"), (F.col("r") + 100).alias("dst")).unionByName(nation.select(F.col("n").alias("src"), ((F.col("n") + 1) % 25).alias("dst")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest of regions, nations and customers; ids by kind: 0, 1 and 2 billion and the key."""
    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    far = 1_000_000_000
    a = nation.select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + F.lit(far).cast("long")).alias("dst"))
    return a.unionByName(customer.select((F.col("c_nationkey") + F.lit(far).cast("long")).alias("src"), (F.col("c_custkey") + 2 * far).alias("dst")))


def neighbourhoods(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    """Customers by their own keys in stretches of `size`: each to the next, and to the one at its nation's place in the stretch. A component a stretch, however many
    customers there are."""
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("n"))
    base = F.col("src") - F.pmod("src", F.lit(size))
    ends = F.explode(F.array(F.when(F.pmod("src", F.lit(size)) < size - 1, F.col("src") + 1), base + F.pmod("n", F.lit(size))))
    rows = customer.select("src", ends.alias("dst")).where("dst is not null and src <> dst")
    return rows.join(customer.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations with more lineitems between them than the mean pair has."""
    line, order = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    customer, supplier = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    flows = (
        line.select("l_orderkey", "l_suppkey")
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(order.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .where("c_nationkey <> s_nationkey")
        .groupBy(F.least("c_nationkey", "s_nationkey").cast("long").alias("src"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("dst"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # a row for each pair of nations, so one task may hold them
    return flows.withColumn("mean", F.avg("n").over(Window.partitionBy())).where("n > mean").select("src", "dst")


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts (1 billion and the key) joined by lineitems."""
    line = _table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"))
