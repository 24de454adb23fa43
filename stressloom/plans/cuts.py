"""Cut points of long plans: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(spark.sparkContext, "_stressloom_folder", None)
    if known is None:
        known = spark.sparkContext._stressloom_folder = tempfile.mkdtemp(prefix="stressloom-")
    return known


def _tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that this application has cut and not deleted."""
    context = spark.sparkContext
    if not hasattr(context, "_stressloom_tables"):
        context._stressloom_tables = []
    return context._stressloom_tables


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def kept_until_the_end(spark: SparkSession, path: str) -> None:
    """A folder that was written goes when the application ends."""
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)


def cut(df: DataFrame, *parts: str) -> DataFrame:
    """Write df as a table in the shared folder, parted by columns if any are named, and read it back: lineage ends there, and the
    rows survive lost executors. The table goes when the application ends, or earlier by `finished`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stressloom-{uuid.uuid4().hex}"
    _tables(spark).append(path)
    df.write.partitionBy(*parts).parquet(path)
    kept_until_the_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that make() describes, written as a table; tables that were cut on the way are deleted."""
    known = len(_tables(spark))
    out = cut(make())
    gone = _tables(spark)[known:-1]
    del _tables(spark)[known:-1]
    for path in gone:
        files, at = _file_system(spark, path)
        files.delete(at, True)
    return out


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a column `name` of longs from 0 in the order of columns, without gaps; rows equal in them come in any order.

    Rows are dealt by ranges and numbered inside each; only the ranges' sizes, one row a range, go through the driver.
    """
    spark = df.sparkSession
    inside = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.select("*", F.shiftright(inside, 33).alias("_range"), inside.bitwiseAND(F.lit((1 << 33) - 1)).alias("_inside")))
    start, starts = 0, []
    for row in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        starts.append((row["_range"], start))
        start += row["n"]
    offsets = spark.createDataFrame(starts, "_range long, _start long")
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")
