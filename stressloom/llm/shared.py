"""What the text operators share: row identity, cut points, size estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.cuts import cut as cut

#: Stands for a null id inside the operators; results show null again.
NULL_ID = -(2**63)

#: A word: a run of anything but space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"


def internal_id(name: str) -> Column:
    """The id as a long, with null as NULL_ID, so that joins keep rows without one."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def public_id(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_key(half: int = 0, bits: int = 64) -> Column:
    """64 bits that stand for a whole text (null counts as empty); both halves tell texts apart by 128."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(F.lit(half), text) if half else F.xxhash64(text)
    return key if bits == 64 else key.bitwiseAND(F.lit((1 << bits) - 1))


#: So many rows of a few short values may go to every task.
FEW = 1_000_000


def to_all_if_few(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows; else the join deals both sides by the key."""
    return F.broadcast(df) if df.count() <= FEW else df


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of texts can hold; texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
