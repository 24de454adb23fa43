"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .shared import WORD, cut, to_all_if_few

#: Turns of weights over the sources in code point order.
CYCLE = (5, 2, 1)
#: A source, and so a document, is taken at most so many times.
MOST = 3
#: Ranges of the keys; documents within one are ordered exactly.
RANGES = 4096


def size_in_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """From 0.25 to 1: how much of the text is letters and spaces between words."""
    chars = F.char_length(text)
    odd = F.char_length(F.regexp_replace(F.col(text), r"[\p{L}\s.,]+", ""))
    return F.coalesce(F.lit(1.0) - F.lit(0.75) * odd / F.when(chars > 0, chars), F.lit(0.25))


def uniform(*parts: Column) -> Column:
    """Above 0 and below 1, from a hash of the parts."""
    low = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double")
    return (low + 0.5) / float(16**12)


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST) -> DataFrame:
    """(source, source_size) to targets: shares by weight of all sizes, none above most times its
    source; what is cut off goes to the others by weight, until none is above.

    In the order of size per weight the capped sources come first, so one pass over prefix sums
    finds the level at which the rest is filled. One row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    turn = (F.row_number().over(order) - 1) % len(cycle)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in cycle)), turn.cast("int") + 1))
    weighed = weighed.withColumn("cap", (F.col("source_size") * most).cast("double"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    every = Window.partitionBy()
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("out"),
        F.sum("source_size").over(every).cast("double").alias("total"),
        F.sum("weight").over(every).alias("weights"),
        F.row_number().over(filled).alias("rank"),
    )
    # the level if this source and all after it stay below their caps
    level = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("out"))
    fits = F.when(level * F.col("weight") <= F.col("cap"), F.struct("rank", level.alias("level")))
    level = F.min(fits).over(every)["level"]
    return weighed.withColumn("level", level).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 0, cycle: tuple[int, ...] = CYCLE, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of each document, repeats counted.

    docs: doc_id, text, source. Returns doc_id, source, size, source_size, target, taken and the columns
    named in carry, one row per row of docs. Whole epochs first: each document floor(target /
    source_size) times. The rest of the target goes to documents in the order of Efraimidis-Spirakis
    keys, -ln(u) / quality, where u hashes the doc_id; the last of them is taken in part. Keys are
    ranged, sums are taken by source and range, and only the range in which a budget ends is ordered
    document by document; the rest needs no order.

    Null source: a source of its own, the last. Null or blank text: size 0, taken 0. Null doc_id:
    hashes as an empty string. Rows that repeat a doc_id share u; size and then a hash of the text order
    them, and rows equal in all of that are alike. A very long text counts whole. Columns of docs with clashing names are ignored. Empty table: empty result.
    """
    key = -F.ln(uniform(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) / quality_weight()
    rows = docs.select("doc_id", "source", size_in_words().alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"), *carry)
    rows = rows.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int"))
    # the texts are counted and hashed once; only columns to carry are read again
    slim = cut(rows.drop(*carry))
    rows = rows if carry else slim
    sums = slim.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, cycle, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long"))
    targets = targets.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    # each source's ranges in order; the source alone bounds this group: RANGES rows
    so_far = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranged = sums.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    same = lambda left, right: left["source"].eqNullSafe(right["source"])
    ends = ranged.join(targets, same(ranged, targets), "inner").where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    ends = ends.select(ranged["source"].alias("end_source"), F.col("range").alias("end_range"), F.col("before").alias("end_before"))
    plan = targets.join(ends, targets["source"].eqNullSafe(ends["end_source"]), "left").drop("end_source").withColumnRenamed("source", "plan_source")
    # a row for each source: to every task while they are few, so that no text is dealt by source
    plan = to_all_if_few(cut(plan))

    joined = rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"])).drop("plan_source")
    inside = F.col("range") == F.col("end_range")
    # a budget that no range ends is used up by whole ranges, or is 0
    whole = F.when(F.col("end_range").isNull(), F.col("rest") > 0).otherwise(F.col("range") < F.col("end_range"))
    done = joined.where(F.coalesce(~inside, F.lit(True))).withColumn("more", F.when(whole, F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    last = joined.where(inside).withColumn("ahead", F.col("end_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("ahead")))).drop("ahead")
    taken = (F.col("epochs") * F.col("size") + F.col("more")).cast("long").alias("taken")
    return done.unionByName(last).select("doc_id", "source", "size", "source_size", "target", taken, *carry)
