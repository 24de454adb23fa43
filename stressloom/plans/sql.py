"""Layouts in SQL: a table function that lays out each component of a table of pairs."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

from ..functions import AXES
from ..operators.layout import ORDERS, _refine

_PAIR = ("u", "v", "dij")


class LayOut:
    """lay_out(TABLE(pairs), rates [, strategy [, ordering [, seed]]]): pairs (u, v, dij) and any other columns, which tell components apart and come again in the result, before node_id, x and y. v and dij may be arrays, of some pairs of
    u each: Python takes rows one at a time, so a row a node and not a pair is what large tables need.

    Rows of one component are one partition; a table without other columns is one component. Nodes start at their hash positions. rates: the learning rate of each sweep. strategy:
    "rounds" or "sequential"; ordering as refine's order. A component's pairs are held by its task, 24 bytes each.
    """

    @staticmethod
    def analyze(pairs: AnalyzeArgument, rates: AnalyzeArgument, strategy: AnalyzeArgument | None = None, ordering: AnalyzeArgument | None = None, seed: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pairs.isTable:
            raise ValueError("the first argument is a table")
        names = pairs.dataType.names
        if missing := [c for c in _PAIR if c not in names]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        if isinstance(pairs.dataType["v"].dataType, ArrayType) != isinstance(pairs.dataType["dij"].dataType, ArrayType):
            raise ValueError("v and dij are both arrays or neither")
        if strategy is not None and strategy.value not in ("rounds", "sequential"):
            raise ValueError(f"no strategy {strategy.value}")
        if ordering is not None and ordering.value not in ORDERS:
            raise ValueError(f"no order {ordering.value}")
        rest = [f for f in pairs.dataType.fields if f.name not in _PAIR]
        schema = StructType([*rest, StructField("node_id", LongType()), StructField("x", DoubleType()), StructField("y", DoubleType())])
        return AnalyzeResult(schema, withSinglePartition=not rest, partitionBy=[PartitioningColumn(f.name) for f in rest], orderBy=[OrderingColumn("u"), OrderingColumn("v")])

    def __init__(self) -> None:
        self.u, self.many, self.v, self.d = array("q"), array("q"), array("q"), array("d")
        self.at: list[int] = []
        self.rest: tuple = ()
        self.settings: tuple = ()

    def eval(self, pairs: Row, rates: list[float], strategy: str = "rounds", ordering: str = "fixed", seed: int = 0) -> None:
        if not self.at:
            self.at = [pairs.__fields__.index(c) for c in _PAIR]
            self.rest = tuple(x for i, x in enumerate(pairs) if i not in self.at)
            self.settings = list(rates), strategy, ordering, seed
        u, v, d = (pairs[i] for i in self.at)
        if not isinstance(v, list):
            v, d = [v], [d]
        if len(v) != len(d):
            raise ValueError(f"{len(v)} nodes and {len(d)} distances from node {u}")
        self.u.append(u)
        self.many.append(len(v))
        self.v.extend(v)
        self.d.extend(d)

    def terminate(self) -> Iterator[tuple]:
        if not self.v:
            return
        rates, strategy, ordering, seed = self.settings
        u, v, d = np.repeat(np.array(self.u), np.array(self.many)), np.array(self.v), np.array(self.d)
        by = np.lexsort((v, u))
        u, v, d = u[by], v[by], d[by]
        ids = np.unique(np.r_[u, v])
        p = np.column_stack([(ids * a + b) % 2**32 / 2**32 for a, b in (AXES["x"], AXES["y"])])
        _refine(p, np.searchsorted(ids, u), np.searchsorted(ids, v), d, rates, strategy, ordering, seed, None, ids)
        for node, (x, y) in zip(ids.tolist(), p.tolist(), strict=True):
            yield (*self.rest, node, x, y)


def register(spark: SparkSession, name: str = "lay_out") -> UserDefinedTableFunction:
    return spark.udtf.register(name, udtf(LayOut))
