"""Substring dedup of words by compressed FM-indexes (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytescan as scan
from .repeats import Plan, mark_with_fm_index, marked_texts
from .run_length_dedup import covered
from .shared import public_id


def _kept_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = batch.column("copy").to_pylist()
            marks = batch.column("marks")
            data, offsets = scan.strings(batch.column("text"))
            start, end, _, of_rows = scan.words(data, offsets, hashes=False)
            kept, counts, removed = [], [], []
            for r in range(batch.num_rows):
                a, b = int(of_rows[r]), int(of_rows[r + 1])
                n = b - a
                counts.append(n)
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                if copy[r] and n >= window:
                    kept.append(b"")
                    removed.append(n)
                    continue
                gone = np.zeros(n, dtype=bool)
                if marks[r].is_valid:
                    runs = marks[r].values
                    gone = covered(n, runs.field("first").to_numpy(), runs.field("end").to_numpy(), window)
                removed.append(int(gone.sum()))
                if gone.any():
                    base = int(offsets[r])
                    s, e = (start[a:b][~gone] - base).tolist(), (end[a:b][~gone] - base).tolist()
                    kept.append(b" ".join([text[i:j] for i, j in zip(s, e, strict=True)]))
                else:
                    kept.append(b" ".join(text.split()))
            yield pa.record_batch([batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    return run


def remove_later_repeats(docs: DataFrame, window: int = 20, gram: int = 4, hot: int = 8192, key_bits: int = 64) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts earlier.

    Words are runs of anything but space and the ASCII line and tab controls, unchanged. Earlier:
    in a document of smaller doc_id, or before in the same one; windows are judged on the input.
    Returns doc_id, n_words, n_removed and kept (binary: the kept words joined by one space).

    Null or blank text: no words. Texts under `window` words: kept. Equal texts: the one of least doc_id
    counts as first, the others go whole. Rows that repeat a doc_id and its text count as later
    copies, but for one; rows of one doc_id with different texts are ordered by a hash of the text.
    Null doc_id comes before all others. Other columns are ignored. An empty table gives an empty result.
    """
    plan = Plan(words=True, window=window, gram=gram, hot=hot, key_bits=key_bits)
    found = marked_texts(docs, plan, mark_with_fm_index(plan)).select("id", "text", "copy", "marks")
    out = found.mapInArrow(_kept_words(window), "id long, n_words long, n_removed long, kept binary")
    return out.select(public_id("id").alias("doc_id"), "n_words", "n_removed", "kept")


def digest(result: DataFrame) -> DataFrame:
    """The columns of the query, from remove_later_repeats."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
