"""Quality by compression against good and bad dictionaries (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .samples import fold, sample, settled
from .shared import small_batches


@dataclass(frozen=True)
class Quality:
    """Dictionaries of bad and good text, and the calibration: score = 1 / (1 + exp(-(slope * x + offset))), where x is
    the size under the bad dictionary less that under the good one, over the text's own."""

    bad: bytes
    good: bytes
    slope: float
    offset: float


def _difference(sizes, text: str | None) -> float:
    if not text:
        return 0.0
    data = text.encode()
    bad, good = sizes.of(data).tolist()
    return (bad - good) / len(data)


def _rows(model, score: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .compression import Sizes

        own = model.value
        sizes = Sizes([own.bad, own.good], level=6, chunk=512)
        for batch in batches:
            x = np.array([_difference(sizes, t) for t in batch.column("text").to_pylist()], dtype=np.float64)
            if score:
                x = 1.0 / (1.0 + np.exp(-np.clip(own.slope * x + own.offset, -40, 40)))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(x)], [*rest, "score"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset by Newton's method with a slight pull to 0, so that separable rows stay finite."""
    spread = float(x.std()) or 1.0
    z = np.column_stack([x / spread, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -40, 40)))
        g = z.T @ (weight * (p - y)) + 1e-2 * beta
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1])


def learn_quality(docs: DataFrame, labels: DataFrame, per_label: int = 2000, for_dictionary: int = 200, dictionary_bytes: int = 400 << 10, longest: int = 64 << 10, piece: int = 2048) -> Quality:
    """From docs (doc_id, text) and labels (doc_id, label 0 or 1): of a sample of at most per_label rows of each label, of at most `longest` bytes, every other one of the first
    2 * for_dictionary gives its middle `piece` bytes to its label's dictionary, and all others calibrate, weighed so that labels count as in all labels. So half of few rows
    calibrate too. Both dictionaries have as many bytes, those of the label with less. With one label missing, the score is that of the other label alone; without labels it is 0.5; with one row of a label, which
    leaves none to calibrate by, slope and offset are 10 and 0."""
    from .compression import dictionary, pieces

    small_batches(docs.sparkSession)
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Quality(b"", b"", 0.0, {0: -5.0, 1: 5.0}.get(next(iter(counts), None), 0.0))
    chosen = sample(docs, labels, per_label, longest)
    gives = (F.col("rank") <= 2 * for_dictionary) & (F.col("rank") % 2 == 1)
    first: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
    for row in chosen.where(gives).select("label", "rank", "text").mapInArrow(pieces(piece), "label int, rank int, text binary").collect():
        first[row["label"]].append((row["rank"], bytes(row["text"])))
    most = min(dictionary_bytes, *(sum(len(t) for _, t in own) for own in first.values()))
    bad, good = (dictionary([t for _, t in sorted(first[y])], most) for y in (0, 1))
    model = docs.sparkSession.sparkContext.broadcast(Quality(bad, good, 0.0, 0.0))
    rest = chosen.where(~gives).select("label", "text").mapInArrow(_rows(model, False), "label int, score double").collect()
    x, y = np.array([r["score"] for r in rest]), np.array([r["label"] for r in rest], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return Quality(bad, good, 10.0, 0.0)
    total = sum(counts.values())
    weight = np.where(y == 1, counts[1] / total / (y == 1).mean(), counts[0] / total / (y == 0).mean())
    return Quality(bad, good, *fit_logistic(x, y, weight))


def score_quality(docs: DataFrame, model: Quality) -> DataFrame:
    """docs (doc_id, text) to doc_id, score (0 to 1, higher: label 1 likelier); one row per row of docs.

    Whole texts. Null or empty text: the calibrated score of no evidence. Null doc_id and repeated rows: rows like others.
    Other columns aren't read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_rows(shared, True), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: learn where crc32(doc_id) mod 3 is not 1, score all."""
    model = learn_quality(docs.where(fold(3) != 1), settled(labels, "quality").where(fold(3) != 1))
    return score_quality(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
