"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stressloom.llm import decontam, jaccard, language, mixing, run_length_dedup
from stressloom.llm.samples import fold
from stressloom.llm.shared import internal_id, text_key, to_all_if_few
from stressloom.plans.cuts import cut, finished

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a repeated string: about 35 words, so that passages of 50 short words are seen.
REPEATED = 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is rejected go: null texts, texts without a letter, and narrow margins. Learns from the documents with a lang outside the held-out
    fold. Each row is judged by its own text; repeated rows stay or go together, a null doc_id is kept, other columns than those of documents are dropped."""
    model = language.learn_languages(docs.where(fold(4) != 2))
    found = language.flag_rejected(docs, model)
    return found.where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of least doc_id. Five words a shingle, similarity from 0.8.

    A null doc_id comes before all others. Of rows that share the least doc_id, repeated rows among them, one stays, the first by a
    hash of the text. Rows without a shingle, null and empty texts among them, are groups of their own. Very long texts count whole; an empty table
    gives an empty result.
    """
    same = ["_id", "_key", "_check"]  # rows alike in these are copies with one id

    def gone() -> DataFrame:
        """The rows that go, by what is alike in them, with how many like them stay."""
        rows = cut(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", internal_id("doc_id").alias("_id"), text_key().alias("_key"), text_key(1).alias("_check")))
        groups = jaccard.similar_texts(rows, jaccard.Similarity(words=5, at_least=80)).select("doc_id", "component_id")
        rows = rows.drop("text")
        first = groups.join(rows, "doc_id").groupBy("component_id").agg(F.min(F.struct(*same, "doc_id")).alias("first"))
        stay = first.select("first.*").groupBy(*same).agg(F.count(F.lit(1)).alias("_stay"))
        every = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_rows"))
        return every.join(stay, same, "left").na.fill(0, ["_stay"]).where("_stay < _rows").select(*same, "_stay")

    found = finished(spark, gone)
    keyed = docs.select(*COLUMNS, internal_id("doc_id").alias("_id"), text_key().alias("_key"), text_key(1).alias("_check"))
    out = keyed.join(to_all_if_few(found), same, "left_anti")
    some = found.where("_stay > 0")
    if some.limit(1).count():
        rank = F.row_number().over(Window.partitionBy(*same).orderBy("lang", "source", "n_chars"))
        out = out.unionByName(keyed.join(to_all_if_few(some), same).withColumn("_rank", rank).where("_rank <= _stay").select(*keyed.columns))
    return out.select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of REPEATED bytes that also start earlier go, so that the first place of each stays: in the document of least doc_id, or the
    first place in one document. A document of which nothing is left goes too; one that was empty stays.

    A null doc_id comes before all others and stays null; rows that repeat an id and its text keep one whole. Null texts stay as they are. n_chars is counted anew.
    """
    marked = docs.select("doc_id", "text", "lang", "source", F.col("text").isNull().alias("_null"))
    out = run_length_dedup.remove_repeats(marked, window=REPEATED, carry=("lang", "source", "_null"), keep_first=True)
    out = out.withColumn("text", F.when(~F.col("_null"), run_length_dedup.whole_characters("kept")))
    out = out.where((F.size("spans") == 0) | (F.col("text") != "")).select("doc_id", "text", "lang", "source")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, each judged by its own text: no others that share their doc_id, or have none like them. Null and empty texts stay."""
    return decontam.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with the words that the mix takes of it; those of which it takes none go, null and empty texts among them. A null source is one of its own; rows that
    share a doc_id share their draw and are ordered by size and a hash of the text."""
    mixed = mixing.mix_sources(docs, carry=("text", "lang"))
    return mixed.where("taken > 0").select("doc_id", "text", "lang", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: SQL doesn't express the compressed sizes that the first stage decides by.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; between two of them the rows are written as Parquet in the shared folder and read again, and what a stage
    wrote on its way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
