"""Language ID by compression with per-language dictionaries (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from .samples import fold, sample
from .shared import small_batches

UNKNOWN = "und"
#: A text whose margin is not above this is rejected. Fitted at sf0.1 with crc32(doc_id) mod 4 in 0 or 1 as learning rows, on those
#: where it is 3: 0.5 % of rightly named texts are at or below it, and of texts whose own language was left out 97.4 % or more.
NARROW = 0.05
#: Put at the end of each dictionary and before a text on which sizes tie: with it a short text is never stored
#: raw, so that what little of it the dictionaries hold shows.
_FILLER = b"531807264990317264580193"
_letter = re.compile(r"[^\W\d_]")
_other = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """Lower case, with one space for each run of anything but letters."""
    return _other.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class Languages:
    """names and their dictionaries, in the same order."""

    names: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def learn_languages(docs: DataFrame, per_language: int = 96, dictionary_bytes: int = 112 << 10, longest: int = 64 << 10, piece: int = 2048, most_languages: int = 256) -> Languages:
    """One raw-content dictionary per non-null lang of docs (doc_id, text, lang), from the middle `piece` bytes of at most per_language texts of at most
    `longest` bytes each; of more than most_languages, those of most rows are learned. The sample is bounded by these parameters (the driver holds
    most_languages * per_language * piece bytes at most, 48 MB) and the same on each run. Null ids aren't learned from; a repeated row counts again."""
    from .compression import dictionary, pieces

    rows = sample(docs.select("doc_id", "text", F.col("lang").alias("label")), None, per_language, longest, most_languages)
    kind = StructType([StructField("label", rows.schema["label"].dataType), StructField("rank", IntegerType()), StructField("text", BinaryType())])
    by: dict[str, list[tuple[int, bytes]]] = {}
    for row in rows.select("label", "rank", "text").mapInArrow(pieces(piece, letters_only), kind).collect():
        by.setdefault(row["label"], []).append((row["rank"], bytes(row["text"])))
    names = tuple(sorted(by))
    return Languages(names, tuple(dictionary([t for _, t in sorted(by[x])], dictionary_bytes) for x in names))


def _predict(model, keep_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .compression import Sizes

        own = model.value
        sizes = Sizes(list(own.dictionaries), level=6) if own.names else None
        fine = Sizes([x + _FILLER for x in own.dictionaries], level=19, chunk=1 << 20) if own.names else None
        for batch in batches:
            names, scores, margins = [], [], []
            for text in batch.column("text").to_pylist():
                if not text or sizes is None or not _letter.search(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    margins.append(0.0)
                    continue
                data = letters_only(text).encode()
                n = sizes.of(data)
                if len(n) > 1 and (n == n.min()).sum() > 1:
                    n = fine.of(_FILLER + data)
                order = np.argsort(n, kind="stable")
                best = int(n[order[0]])
                margin = 1.0 if len(n) == 1 else float(n[order[1]] - best) / float(n[order[1]])
                names.append(own.names[order[0]])
                scores.append(margin / (margin + 0.02))
                margins.append(margin)
            rest = [c for c in batch.schema.names if keep_text or c != "text"]
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], [*rest, "lang_pred", "score", "margin"])

    return run


def identify_languages(docs: DataFrame, model: Languages, narrow: float = NARROW) -> DataFrame:
    """docs (doc_id, text) to doc_id, lang_pred, score, margin, rejected; one row per row of docs.

    lang_pred is the language whose dictionary compresses the whole text to the fewest bytes; margin is the share by
    which the second needs more, and score grows with it from 0 to 1. rejected: `und`, or margin <= narrow.

    Null text, or a text without a letter: `und`, score 0, rejected. Ties: the first name by code point, margin 0,
    rejected. No learned language: `und`. One: margin 1. Null doc_id and repeated rows: rows like others. Other columns,
    lang and source among them, aren't read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double, margin double")
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") <= narrow))


def flag_rejected(docs: DataFrame, model: Languages, narrow: float = NARROW) -> DataFrame:
    """docs with a column `rejected` added, as identify_languages has it; only the text is read for it."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("margin", DoubleType())])
    out = docs.mapInArrow(_predict(shared, keep_text=True), schema)
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") <= narrow)).drop("lang_pred", "score", "margin")


def held_out(docs: DataFrame) -> DataFrame:
    """The query: learn where crc32(doc_id) mod 4 is not 2, predict all."""
    model = learn_languages(docs.where(fold(4) != 2))
    out = identify_languages(docs, model)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")
