"""Packing of documents into windows of tokens by non-negative least squares over length combinations (operator 11).

Whole windows of a long document are sequences of their own. What is left of each document, its rest, is shorter than a window. Shallow combinations of
lengths that fill a window are enumerated; how often to repeat each is solved against the histogram of rests, rounded down and topped up greedily. Rests that no combination takes are
laid end to end and cut at window borders, and the last window is cut at powers of two, so that nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.cuts import numbered
from .shared import cut, small_batches

WINDOW = 1024
#: Lengths of a triple differ by a multiple of this, so that the combinations stay some ten thousands.
_STRIDE = 8
_ITERATIONS = 300


def encoder(vocabulary: str, special: str = "<|endoftext|>"):
    """Texts to ids. The ranks in `vocabulary` and the pattern are those of the tokenizer of the same name, and the special token's own string gives its id, so ids are
    equal to that tokenizer's; this library makes them five times faster."""
    import base64

    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokens(vocabulary: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            n, whole, crc, rest = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.append(own.encode_to_numpy(text or "", allowed_special="all").astype("<u4"), np.uint32(end)).astype("<u4")
                full = len(ids) // window
                n.append(len(ids))
                whole.append([_crc(ids[i * window : (i + 1) * window]) for i in range(full)])
                crc.append(_crc(ids[full * window :]))
                rest.append(ids[full * window :].tobytes())
            cols = [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(crc, pa.int64()), pa.array(rest, pa.binary())]
            yield pa.record_batch(cols, ["row", "doc_id", "n", "whole", "crc", "rest_ids"])

    return run


def combinations(window: int = WINDOW) -> list[tuple[tuple[int, int], ...]]:
    """Combinations of up to three different lengths that fill a window, as ((length, times), ...): all pairs, triples of lengths that differ by multiples of
    _STRIDE, and one length as often as it fits with what is then left."""
    found = []
    for a in range(1, window // 2 + 1):
        found.append(((a, 1), (window - a, 1)) if 2 * a != window else ((a, 2),))
        for b in range(a, (window - a) // 2 + 1, _STRIDE):
            times: dict[int, int] = {}
            for length in (a, b, window - a - b):
                times[length] = times.get(length, 0) + 1
            found.append(tuple(sorted(times.items())))
    for a in range(1, window // 3 + 1):
        times, left = divmod(window, a)
        found.append(((a, times), (left, 1)) if left else ((a, times),))
    return list(dict.fromkeys(found))


def least_squares(rows: np.ndarray, columns: np.ndarray, times: np.ndarray, want: np.ndarray, n: int, iterations: int = _ITERATIONS) -> np.ndarray:
    """x >= 0 of least |A x - want|, where A has `times` at (rows, columns) and n columns: projected gradient steps with momentum."""
    apply = lambda x: np.bincount(rows, weights=times * x[columns], minlength=len(want))
    back = lambda r: np.bincount(columns, weights=times * r[rows], minlength=n)
    probe = np.ones(n)
    for _ in range(20):
        probe = back(apply(probe))
        probe /= np.linalg.norm(probe)
    rate = 1.0 / (1.05 * np.linalg.norm(back(apply(probe))))
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(iterations):
        after = np.maximum(0.0, y - rate * back(apply(y) - want))
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = after + (t - 1) / further * (after - x), after, further
    return x


@dataclass(frozen=True)
class Plan:
    """Slots by the first of the numbers of the rests that they take: starts ascending; a combination's slot gives the sequence `base` + (number - start) and its
    offset; a residual slot (offset -1) lays rests of one length from `base` of the residual stream. The stream's sequences begin at `first`, its last, shorter ones end
    at `ends`."""

    window: int
    starts: np.ndarray
    bases: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    first: int
    tokens: int
    ends: np.ndarray

    @property
    def n_sequences(self) -> int:
        """Of combinations and the stream."""
        return self.first + self.tokens // self.window + len(self.ends)

    def segment(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, begin and end of the stretches of the stream that hold these places."""
        full = self.tokens // self.window
        begin = np.r_[full * self.window, self.ends]
        short = np.searchsorted(self.ends, at, side="right")
        inside = at < full * self.window
        sequence = self.first + np.where(inside, at // self.window, full + short)
        left = np.where(inside, at // self.window * self.window, begin[np.minimum(short, len(begin) - 1)])
        right = np.where(inside, left + self.window, begin[np.minimum(short + 1, len(begin) - 1)])
        return sequence, left, right


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Where rests go that are numbered by length, with how many there are of each length (0: documents of whole windows only). All of it depends on the window and not on the number of documents."""
    have = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    first = np.r_[0, np.cumsum(have)[:-1]]  # the number of the first rest of each length
    known = [c for c in combinations(window) if all(have[length] >= times for length, times in c)]
    used, taken = np.zeros(window + 1, dtype=np.int64), []
    if known:
        sizes = [len(c) for c in known]
        rows = np.array([length for c in known for length, _ in c])
        times = np.array([t for c in known for _, t in c], dtype=np.float64)
        columns = np.repeat(np.arange(len(known)), sizes)
        want = have.astype(np.float64)
        want[0] = 0
        x = least_squares(rows, columns, times, want, len(known))
        left = have.copy()
        left[0] = 0
        order = np.argsort(-x, kind="stable")
        for most in (np.floor(x + 1e-6).astype(np.int64), np.full(len(known), np.iinfo(np.int64).max)):
            for i in order.tolist():
                often = min(int(most[i]), *(int(left[length]) // t for length, t in known[i]))
                if often > 0:
                    taken.append((i, often))
                    for length, t in known[i]:
                        left[length] -= often * t
    slots, sequences = [], 0
    for i, often in taken:
        offset = 0
        for length, t in known[i]:
            for _ in range(t):
                slots.append((int(first[length] + used[length]), sequences, offset, length))
                used[length] += often
                offset += length
        sequences += often
    stream = 0
    for length in range(1, window):
        rest = int(have[length] - used[length])
        if rest:
            slots.append((int(first[length] + used[length]), stream, -1, length))
            stream += rest * length
    slots.sort()
    short, ends, at = stream % window, [], stream - stream % window
    for bit in range(window.bit_length(), -1, -1):
        if short >> bit & 1:
            at += 1 << bit
            ends.append(at)
    cols = np.array(slots, dtype=np.int64).reshape(-1, 4)
    return Plan(window, cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3], sequences, stream, np.array(ends, dtype=np.int64))


_PIECE = ("start", "length", "crc", "sequence_id", "offset")


def _place(shared):
    """Numbered rests to their pieces: crc is null where a rest is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Plan = shared.value
        for batch in batches:
            number, n = batch.column("number").to_numpy(), batch.column("n").to_numpy()
            crc = batch.column("crc").to_numpy()
            slot = np.searchsorted(own.starts, number, side="right") - 1
            length, begin = n % own.window, n - n % own.window
            after = number - own.starts[slot]
            combined = own.offsets[slot] >= 0
            out = [(np.flatnonzero(combined), begin, length, own.bases[slot] + after, own.offsets[slot], np.ones(len(n), dtype=bool))]
            place = own.bases[slot] + after * length
            end, at = place + length, place.copy()
            open_ = ~combined
            while open_.any():
                sequence, left, right = own.segment(at)
                upto = np.minimum(right, end)
                out.append((np.flatnonzero(open_), begin + (at - place), upto - at, sequence, at - left, (upto - at) == length))
                at = np.where(open_, upto, at)
                open_ = open_ & (at < end)
            for rows, start, size, sequence, offset, whole in out:
                if len(rows):
                    kept = batch.select(["row", "doc_id", "n"]).take(pa.array(rows))
                    checks = pa.array(crc[rows], mask=~whole[rows])
                    yield pa.record_batch([*kept.columns, *(pa.array(np.ascontiguousarray(c[rows])) for c in (start, size)), checks, *(pa.array(np.ascontiguousarray(c[rows])) for c in (sequence, offset))], ["row", "doc_id", "n", *_PIECE])

    return run


def _checked(window: int):
    """The checksums of cut pieces, from the ids of their rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ids, start, length in zip(*(batch.column(c).to_pylist() for c in ("rest_ids", "start", "length")), strict=True):
                at = start % window * 4
                found.append(zlib.crc32(ids[at : at + length * 4]))
            names = [c for c in batch.schema.names if c not in ("crc", "rest_ids")]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(found, pa.int64())], [*names, "crc"])

    return run


def tokenised(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", window: int = WINDOW, end: int = 0) -> DataFrame:
    """A row per row of docs: row, doc_id, n (its ids and the id `end`), whole (a checksum for each whole window), crc and rest_ids (of what is left). Cut, so that each text is encoded once."""
    small_batches(docs.sparkSession, 256)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInArrow(_tokens(vocabulary, window, end), f"row long, doc_id {kind}, n long, whole array<long>, crc long, rest_ids binary"))


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", window: int = WINDOW, end: int = 0) -> DataFrame:
    """docs (doc_id, text) to a row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit numbers),
    doc_tokens, sequence_id and offset. A sequence holds `window` ids, or a power of two of them, and no padding. window: a power of two.

    Null and empty texts are the id `end` alone. Whole texts, very long ones in whole windows. Null doc_id and repeated rows: rows like others, told apart inside by a number of their own. Other columns
    aren't read. An empty table gives an empty result. To the driver go the counts of rests by length, at most `window`, and the sizes of ranges; the plan that tasks get has a size
    that depends on the window alone.
    """
    if window < 4 or window & (window - 1):
        raise ValueError("a window is a power of two from 4 on")
    spark = docs.sparkSession
    known = tokenised(docs, vocabulary, window, end)
    by_length = known.groupBy((F.col("n") % window).alias("length")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("whole")).alias("most")).collect()
    made = plan({r["length"]: r["rows"] for r in by_length}, window)
    most = max((r["most"] for r in by_length), default=0)
    kind = known.schema["doc_id"].dataType.simpleString()
    order = known.select("row", "doc_id", "n", "whole", "crc", (F.col("n") % window).alias("length"))
    order = numbered(order, "number", "length", "row")
    columns = f"row long, doc_id {kind}, n long, start long, length long, crc long, sequence_id long, offset long"
    placed = cut(order.where("length > 0").select("row", "doc_id", "n", "crc", "number").mapInArrow(_place(spark.sparkContext.broadcast(made)), columns))
    parts = placed.where("crc is null").join(known.select("row", "rest_ids"), "row")
    parts = parts.select("row", "doc_id", "n", "start", "length", "sequence_id", "offset", "rest_ids")
    parts = parts.mapInArrow(_checked(window), f"row long, doc_id {kind}, n long, start long, length long, sequence_id long, offset long, crc long")
    full = order.where(F.size("whole") > 0).select("doc_id", "n", "number", F.posexplode("whole").alias("i", "crc"))
    full = full.select("doc_id", "n", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "crc", (F.lit(made.n_sequences) + F.col("number") * most + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = placed.where("crc is not null").drop("row").unionByName(parts.drop("row")).unionByName(full)
    return pieces.select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
