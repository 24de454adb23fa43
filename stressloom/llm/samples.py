"""Bounded, repeatable samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window


def fold(of: int) -> Column:
    """crc32 of the doc_id as text, modulo `of`; a null doc_id counts as an empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def sample(docs: DataFrame, labels: DataFrame | None, per_label: int, longest: int, most_labels: int = 256) -> DataFrame:
    """At most per_label rows (doc_id, label, rank, text) of each label, the first by a hash of doc_id, rank from 1; texts over `longest` bytes and empty
    ones are left out. docs: doc_id, text, and without labels (doc_id, label) a column label too. Of more than most_labels labels, those of most rows
    are sampled, at equal rows the first in order.

    Only ids and hashes are joined and ranked, with a limit per task before the shuffle. The ids chosen, per_label * most_labels
    at most, go through the driver, and only their texts are read; no text is shuffled.
    """
    usable = docs.where("doc_id is not null").where(F.octet_length("text").between(1, longest))
    known = usable.select("doc_id").join(labels.select("doc_id", "label"), "doc_id") if labels is not None else usable.select("doc_id", "label")
    known = known.where("label is not null")
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")
    first = [r["label"] for r in sizes.limit(most_labels + 1).collect()]
    if len(first) > most_labels:
        known = known.where(F.col("label").isin(first[:most_labels]))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label)
    chosen = ids.select("doc_id", "label", "rank").collect()
    schema = StructType([*known.select("doc_id", "label").schema.fields, StructField("rank", IntegerType())])
    # bounded above by per_label * most_labels rows of three short values
    bounded = docs.sparkSession.createDataFrame([tuple(x) for x in chosen], schema).dropDuplicates(["doc_id"])
    return usable.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").select("doc_id", "label", "rank", "text")


def settled(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label 0 or 1); labels that repeat a doc_id count once, by their mean."""
    known = labels.where(F.col(name).isin(0, 1)).groupBy("doc_id").agg((F.avg(name) >= 0.5).cast("int").alias("label"))
    return known.where("doc_id is not null")
