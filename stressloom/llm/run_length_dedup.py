"""Suffix-array dedup of bytes by a run-length index (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bytescan as scan
from .repeats import Plan, mark_with_run_length_index, marked_texts
from .shared import public_id


def covered(n: int, first: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Units of a text of n units that lie in a window starting in one of the runs [first, end)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, end - 1 + window, -1)
    return np.cumsum(step[:-1]) > 0


def _removed(window: int):
    schema = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = scan.strings(batch.column("text"))
            marks, whole = batch.column("marks"), batch.column("whole").to_pylist()
            kept, spans, sizes = [], [], []
            for r in range(batch.num_rows):
                text = data[offsets[r] : offsets[r + 1]]
                n = len(text)
                sizes.append(n)
                if whole[r] and n >= window:
                    kept.append(b"")
                    spans.append([{"start": 0, "end": n}])
                elif marks[r].is_valid:
                    runs = marks[r].values
                    gone = covered(n, runs.field("first").to_numpy(), runs.field("end").to_numpy(), window)
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    kept.append(text[~gone].tobytes())
                    spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                else:
                    kept.append(text.tobytes())
                    spans.append([])
            rest = batch.schema.names[4:]
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(schema)), *(batch.column(c) for c in rest)], ["id", "n_bytes", "kept", "spans", *rest])

    return run


def remove_repeats(docs: DataFrame, window: int = 400, gram: int = 64, hot: int = 8192, carry: tuple[str, ...] = (), keep_first: bool = False, key_bits: int = 64) -> DataFrame:
    """Remove each byte covered by a `window`-byte string that also starts anywhere else, or with keep_first, that also starts earlier: in a
    document of smaller doc_id, or before in the same one.

    Whole texts as UTF-8; matches never cross documents, may overlap, and are judged on the input.
    Returns doc_id, n_bytes, kept (binary: the remaining bytes) and spans (maximal removed runs of
    bytes [start, end)), and the columns of docs named in carry; one row per row of docs.

    Null or empty text: nothing to remove. Texts under `window` bytes: kept. Repeated rows and
    equal texts are copies of each other: all of their bytes go once they have `window` bytes; with keep_first, one row, of the least doc_id, stays. Null
    doc_id: the row is a document like others, comes before them and keeps its null. Rows of one doc_id with different texts are ordered by a
    hash of the text. A very long text is scanned in slices. Other columns are ignored. An empty table gives an empty result.
    """
    plan = Plan(words=False, window=window, gram=gram, hot=hot, key_bits=key_bits)
    whole = F.col("copy") if keep_first else F.col("copies") > 1
    found = marked_texts(docs, plan, mark_with_run_length_index(plan, keep_first), carry).select("id", "text", whole.alias("whole"), "marks", *carry)
    schema = "id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"
    schema = ", ".join([schema, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)])
    out = found.mapInArrow(_removed(window), schema)
    return out.select(public_id("id").alias("doc_id"), "n_bytes", "kept", "spans", *carry)


def whole_characters(kept: str) -> Column:
    """The kept bytes as text, without what is left of characters that a removed run cut."""
    text = F.col(kept).cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def digest(result: DataFrame) -> DataFrame:
    """The columns of the query, from remove_repeats."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
