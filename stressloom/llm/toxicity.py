"""Toxicity by multiple-instance learning (operator 2).

A document is a bag of sentences. A sentence scores p = 1 / (1 + exp(-(bias + sum of its features' weights))), and the
document 1 - prod(1 - p), a noisy-or. Only documents are labelled; the gradient of their log likelihood reaches
each sentence by its share in the noisy-or, so training finds the sentences that account for the label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .samples import fold, sample, settled
from .shared import small_batches

_sentence = re.compile(r"[^.!?\n]+")
_word = re.compile(r"[^\W\d_]+")
#: Features of a word: itself, and its first letters.
STEMS = (3, 4, 5, 6)


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in STEMS if len(word) >= k)]


@dataclass(frozen=True)
class Toxicity:
    bias: float
    weights: dict[str, float]


def _bags(texts: list[str], y: np.ndarray) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, in how many texts of each label each is, and the entries (feature, sentence) with the document of each sentence."""
    known: dict[str, int] = {}
    of_word: dict[str, list[int]] = {}
    columns, sizes, docs = [], [], []
    for d, text in enumerate(texts):
        own: list[int] = []
        for sentence in _sentence.findall(text.lower()):
            before = len(own)
            for w in set(_word.findall(sentence)):
                found = of_word.get(w)
                if found is None:
                    found = of_word[w] = [known.setdefault(f, len(known)) for f in features(w)]
                own += found
            if len(own) > before:
                sizes.append(len(own) - before)
                docs.append(d)
        columns.append(np.array(own, dtype=np.int32))
    seen = np.zeros((2, len(known)))
    for own, label in zip(columns, y, strict=True):
        seen[int(label), np.unique(own)] += 1
    sizes = np.array(sizes, dtype=np.int64)
    return known, seen, np.concatenate(columns), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.array(docs, dtype=np.int64)


def telling(seen: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How much a feature tells of the label: the likelihood ratio of its presence in texts; half of it where it stands for label 0."""
    of = np.array([(y == 0).sum(), (y == 1).sum()], dtype=np.float64)[:, None]
    out = np.zeros(seen.shape[1])
    for count in (seen, of - seen):
        expected = count.sum(axis=0) * of / of.sum()
        out += (count * np.log(np.where(count > 0, count / np.maximum(expected, 1e-9), 1.0))).sum(axis=0)
    return np.where(seen[1] * of[0] > seen[0] * of[1], out, out / 2)


def train(texts: list[str], y: np.ndarray, share: float, most_features: int = 1000, epochs: int = 160, rate: float = 0.15, decay: float = 3e-5) -> Toxicity:
    """Fit on the driver, over a bounded sample. share: the weight of the toxic texts of all, 1 less it that of the others. Of the features in 4 texts or more, the most_features that tell most of the label are weighed; decay times the sum of the
    squared weights is added to the mean loss."""
    none = Toxicity(float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), {})
    known, seen, column, sentence, doc = _bags(texts, y)
    if not len(doc):
        return none
    n, at = len(texts), len(doc)
    usable = np.flatnonzero(seen.sum(axis=0) >= 4)
    if not len(usable):
        return none
    best = usable[np.argsort(-telling(seen[:, usable], y), kind="stable")[:most_features]]
    kept = np.zeros(seen.shape[1], dtype=bool)
    kept[best] = True
    number = (np.cumsum(kept) - 1).astype(np.int32)
    inside = kept[column]
    column, sentence = number[column[inside]], sentence[inside]
    vocabulary = {f: int(number[i]) for f, i in known.items() if kept[i]}
    del known
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / n
    w, bias = np.zeros(len(vocabulary)), -4.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, epochs + 1):
        z = bias + np.bincount(sentence, weights=w[column], minlength=at)
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
        whole = np.maximum(-np.expm1(clean), 1e-9)
        # derivative of the negative log likelihood by z of a sentence
        pull = np.where(y == 1, -np.exp(clean) / whole, 1.0) * weight
        g = pull[doc] * p
        grad = np.r_[np.bincount(column, weights=g[sentence], minlength=len(w)) + 2 * decay * w, g.sum()]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return Toxicity(float(bias), {f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 1e-2})


def _score(model, spans: bool):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Toxicity = model.value
        weights, bias = own.weights, own.bias
        known: dict[str, float] = {}
        empty = 1.0 / (1.0 + np.exp(-bias))
        for batch in batches:
            scores, places = [], []
            for text in batch.column("text").to_pylist():
                low = text.lower() if text else ""
                z: list[float] = []
                where: list[tuple[int, int]] = []
                for found in _sentence.finditer(low):
                    words = set(_word.findall(found[0]))
                    if not words:
                        continue
                    total = bias
                    for w in words:
                        value = known.get(w)
                        if value is None:
                            value = 0.0
                            for f in features(w):
                                value += weights.get(f, 0.0)
                            if len(known) < 500_000:
                                known[w] = value
                        total += value
                    z.append(total)
                    where.append(found.span())
                if z:
                    p = 1.0 / (1.0 + np.exp(-np.clip(np.array(z), -30, 30)))
                    scores.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())))
                    if spans:
                        places.append([{"start": a, "end": b, "p": float(x)} for (a, b), x in zip(where, p, strict=True) if x >= 0.5])
                else:
                    scores.append(float(empty))
                    places.append([])
            rest = [c for c in batch.schema.names if c != "text"]
            cols, names = [*(batch.column(c) for c in rest), pa.array(scores, pa.float64())], [*rest, "score"]
            if spans:
                cols, names = [*cols, pa.array(places, kind)], [*names, "sentences"]
            yield pa.record_batch(cols, names)

    return run


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 2500, longest: int = 16 << 10, share: float = 0.5) -> Toxicity:
    """From docs (doc_id, text) and labels (doc_id, label 0 or 1); the sample is bounded by per_label rows of each label, of at most `longest`
    bytes. share: as train has it; with 0.5 the two labels count alike, however rare one is. It and the defaults of train were chosen by four-fold cross-validation among rows that learn. With one label only, the score is near that label; without rows it is 0.5."""
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Toxicity({0: -30.0, 1: 30.0}.get(next(iter(counts), None), 0.0), {})
    chosen = [(r["label"], r["text"]) for r in sample(docs, labels, per_label, longest).orderBy("label", "rank").select("label", "text").collect()]
    return train([t for _, t in chosen], np.array([y for y, _ in chosen], dtype=np.float64), share)


def score_toxicity(docs: DataFrame, model: Toxicity) -> DataFrame:
    """docs (doc_id, text) to doc_id, score (0 to 1), sentences: places [start, end) in characters of the lower-cased text
    and p of the sentences with p >= 0.5. One row per row of docs.

    Sentences end at . ! ? and line ends; words are runs of letters in lower case. Very long texts are scored whole. Null, empty or wordless text: the score of one sentence without
    features, no places. Null doc_id and repeated rows: rows like others. Other columns aren't read. An empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_score(shared, True), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, sentences array<struct<start:int,end:int,p:double>>")


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: learn where crc32(doc_id) mod 5 is not 0, score all."""
    model = learn_toxicity(docs.where(fold(5) != 0), settled(labels, "toxic").where(fold(5) != 0))
    return score_toxicity(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
