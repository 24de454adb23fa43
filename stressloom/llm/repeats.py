"""Find windows of text that stand more than once in a corpus, shard by shard.

1. Every window gets an anchor that its content alone decides (bytescan.anchors). Equal windows
   have anchors of equal hash at equal distance, so a window can only repeat if its anchor's
   hash does: one pre-aggregated count over hashes leaves the places worth a look.
2. The text around each such place, a segment, goes to the shard of its anchor's hash. A
   task sends equal segments once, with the least place where they stand; at their other places they are marked at once.
3. A shard sorts its segments by anchor and indexes them block by block, never cutting an anchor
   apart; blocks are a few MB, so memory doesn't depend on the shard's size.

Anchors at more places than `hot` are dealt out by content instead: their windows are split
into runs of `fine` neighbours, and a run's key also hashes the content that all windows of the run
share. Equal windows still meet; near copies of one passage no longer gather in one block.

Texts are known by (id, key): the row's id and 64 bits of its content. Copies of a whole text are
collapsed to the one of least id before step 2; the caller settles the rest of them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bytescan as scan
from .shared import cut, internal_id, small_batches, text_key


#: Hashes at most whose places are salted.
HEAVY = 100_000


@dataclass(frozen=True)
class Plan:
    """words: units are words, else bytes. window: units that make a repeat. gram: units of an
    anchor, a power of two. block: bytes of segments to index at once."""

    words: bool
    window: int
    gram: int
    hot: int = 8192
    fine: int = 16
    block: int = 2 << 20
    #: Bits of the first half of a text's 128 that tell copies; fewer than 64 only make unequal halves likelier to clash.
    key_bits: int = 64


def _tokens(plan: Plan, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units for hashing, and the rows' offsets into them."""
    if plan.words:
        _, _, h, of_rows = scan.words(data, offsets)
        return h, of_rows
    return scan.letters(data), offsets


def _gram_rows(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text) to the distinct anchor hashes of each text, with the number of their places. A hash with more than one place in a text
    comes with a second key that no text has, and no places there, so that one text alone makes it shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for a, b, data, offsets in scan.slices(*scan.strings(batch.column("text"))):
                row, h, *_ = scan.anchors(*_tokens(plan, data, offsets), plan.window, plan.gram)
                if not len(row):
                    continue
                by = np.lexsort((h, row))
                row, h = row[by], h[by]
                head = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
                size = np.diff(np.r_[head, len(h)])
                gram, key = scan.signed(h[head]), keys[a:b][row[head]]
                again = size > 1
                places = np.r_[size, np.zeros(np.count_nonzero(again), np.int64)]
                yield pa.record_batch([pa.array(np.r_[gram, gram[again]]), pa.array(np.r_[key, ~key[again]]), pa.array(places)], ["gram", "key", "places"])

    return run


def _place_rows(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """where: first window, distance of the anchor from it, number of windows; the latter two in 10 bits each, as windows have under 1024 units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
            for a, b, data, offsets in scan.slices(*scan.strings(batch.column("text"))):
                row, h, place, first, size = scan.anchors(*_tokens(plan, data, offsets), plan.window, plan.gram)
                if len(row):
                    yield pa.record_batch([pa.array(x) for x in (scan.signed(h), ids[a:b][row], keys[a:b][row], first << 20 | (place - first) << 10 | size)], ["gram", "id", "key", "where"])

    return run


def _segment_rows(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts with their places to distinct segments, each with the least place that it stands at here and whether it stands at others. Those others are marked at once, as the segment stands
    earlier: rows without a segment, whose stands are runs (id, key, first and length in one number), under keys of their own. So a passage of any number of places sends one row a task and batch."""

    def part(units: list[bytes] | bytes, a: int, b: int) -> bytes:
        return b" ".join(units[a:b]) if plan.words else units[a:b]

    def flush(kept: dict) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[int, bytes], list] = {}
        for (gram, segment, lead, hot), where in kept.items():
            n = (segment.count(b" ") + 1 if plan.words else len(segment)) - plan.window + 1
            if not hot:
                out.setdefault((gram, segment), []).extend(where)
                continue
            units = segment.split() if plan.words else segment
            for j in range((lead - n + 1) // plan.fine, lead // plan.fine + 1):
                # the run's windows start at head .. tail, of which a .. b - 1 are here; all share the core
                head, tail = lead - (j + 1) * plan.fine + 1, lead - j * plan.fine
                a, b = max(0, head), min(n, tail + 1)
                core = part(units, tail, head + plan.window)
                own = int.from_bytes(blake2b(core + j.to_bytes(4, "little"), digest_size=8, key=gram.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
                out.setdefault((own, part(units, a, b - 1 + plan.window)), []).extend((i, k, f + a) for i, k, f in where)
        items, runs = [], []
        for (key, segment), where in out.items():
            least, more = where[0], 0
            if len(where) > 1:
                places = sorted(set(where))
                least, more = places[0], int(len(places) > 1)
                n = (segment.count(b" ") + 1 if plan.words else len(segment)) - plan.window + 1
                runs += [(i, k, f, f + n) for i, k, f in places[1:]]
            items.append((key, segment, struct.pack("=3q", least[0], least[1], least[2] << 1 | more)))
        for at in range(0, len(runs), 2048):
            stands = np.array([(i, k, f << 20 | e - f) for i, k, f, e in runs[at : at + 2048]], dtype=np.int64)
            items.append((int(stands[0] @ np.array([1, 3, 5])), None, stands.tobytes()))
        for at in range(0, len(items), 2048):
            keys, segments, stands = zip(*items[at : at + 2048], strict=True)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(segments, pa.binary()), pa.array(stands, pa.binary())], ["shard_key", "segment", "stands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        held = 0
        for batch in batches:
            ids, keys, places = batch.column("id").to_numpy(), batch.column("key").to_numpy(), batch.column("places")
            data, offsets = scan.strings(batch.column("text"))
            for r in range(len(ids)):
                if not places[r].is_valid:
                    continue
                own = places[r].values
                text = data[offsets[r] : offsets[r + 1]]
                text = text.tobytes().split() if plan.words else text.tobytes()
                who = (int(ids[r]), int(keys[r]))
                fields = [own.field(x).to_pylist() for x in ("gram", "where", "hot")]
                for gram, place, hot in dict.fromkeys(zip(*fields, strict=True)):
                    first, lead, n = place >> 20, place >> 10 & 1023, place & 1023
                    segment = part(text, first, first + n - 1 + plan.window)
                    at = (gram, segment, lead if hot else 0, hot)
                    where = kept.get(at)
                    if where is None:
                        kept[at] = [(*who, first)]
                        held += len(segment) + 200
                    else:
                        where.append((*who, first))
                        held += 100
                if held > 24 << 20:
                    yield from flush(kept)
                    kept, held = {}, 0
        yield from flush(kept)

    return run


def _mark_rows(plan: Plan, mark: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments sorted by shard key to runs of marked windows: (id, key, first, end). Runs that are marked already pass through. A segment that is alone under its
    key and stands once is not indexed: its windows have one anchor at different distances, so none equals another."""

    def told(out: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.ascontiguousarray(out[:, i])) for i in range(4)], ["id", "key", "first", "end"])

    def flush(segments: dict) -> Iterator[pa.RecordBatch]:
        out = mark(segments)
        if len(out):
            yield told(out)

    def gather(segments: dict, group: dict) -> int:
        if len(group) == 1:
            (stands,) = group.values()
            if len(stands) == 1 and not struct.unpack("=3q", stands[0])[2] & 1:
                return 0
        for segment, stands in group.items():
            segments.setdefault(segment, []).extend(stands)
        return sum(map(len, group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[bytes, list] = {}
        group: dict[bytes, list] = {}
        held, last = 0, None
        for batch in batches:
            for key, segment, stands in zip(batch.column("shard_key").to_pylist(), batch.column("segment").to_pylist(), batch.column("stands").to_pylist(), strict=True):
                if segment is None:
                    runs = np.frombuffer(stands, dtype=np.int64).reshape(-1, 3)
                    first = runs[:, 2] >> 20
                    yield told(np.column_stack([runs[:, :2], first, first + (runs[:, 2] & (1 << 20) - 1)]))
                    continue
                if key != last:
                    held += gather(segments, group)
                    group, last = {}, key
                    if held >= plan.block:
                        yield from flush(segments)
                        segments, held = {}, 0
                group.setdefault(segment, []).append(stands)
        gather(segments, group)
        if segments:
            yield from flush(segments)

    return run


def _stands(stands: list[bytes]) -> tuple[np.ndarray, bool]:
    """The least places, of all tasks, where a segment stands: (id, key, first) in order; and whether it stands at several places in all. Rows that repeat an id and its text give a place more
    than once; it counts once."""
    where = np.frombuffer(b"".join(stands), dtype=np.int64).reshape(-1, 3).copy()
    more = bool((where[:, 2] & 1).any())
    where[:, 2] >>= 1
    if len(where) > 1:
        where = where[np.lexsort((where[:, 2], where[:, 1], where[:, 0]))]
        where = where[np.r_[True, (where[1:] != where[:-1]).any(axis=1)]]
    return where, more or len(where) > 1


def mark_with_run_length_index(plan: Plan, keep_first: bool = False) -> Callable[[dict[bytes, list]], np.ndarray]:
    """Every window that also starts elsewhere, or with keep_first, earlier: in a text of smaller (id, key), or before in the same."""

    def mark(segments: dict[bytes, list]) -> np.ndarray:
        from .suffixes import RunLengthIndex

        w, out, items = plan.window, [], []
        for segment, stands in segments.items():
            where, several = _stands(stands)
            again = where[1:] if keep_first else where
            if several and len(again):
                out.append(np.column_stack([again, again[:, 2] + len(segment) - w + 1]))
            items.append((*where[0].tolist(), segment, keep_first or not several))
        items.sort()
        gap = np.zeros(1, np.uint8)
        text = np.concatenate([x for i in items for x in (np.frombuffer(i[3], dtype=np.uint8) + np.uint8(1), gap)])
        ends = np.cumsum([len(i[3]) + 1 for i in items])
        begins = np.r_[0, ends[:-1]]
        index = RunLengthIndex(text)
        marked = index.earlier(w) if keep_first else index.matching_statistics() >= w
        # what starts too near to the end of its segment may match on across the gap
        whole = np.zeros(len(text) + 1, dtype=np.int8)
        whole[begins] = 1
        whole[ends - w] = -1
        marked &= np.cumsum(whole[:-1], dtype=np.int8) > 0
        edge = np.flatnonzero(np.diff(np.r_[False, marked, False].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i = int(np.searchsorted(begins, a, side="right")) - 1
            who, key, first, _, asked = items[i]
            if asked:
                out.append(np.array([[who, key, first + a - begins[i], first + b - begins[i]]]))
        return np.concatenate(out) if out else np.zeros((0, 4), np.int64)

    return mark


def mark_with_fm_index(plan: Plan) -> Callable[[dict[bytes, list]], np.ndarray]:
    """Every window that also starts earlier: in a text of smaller (id, key), or before in the same."""

    def mark(segments: dict[bytes, list]) -> np.ndarray:
        from .suffixes import FMIndex

        w, out, items = plan.window, [], []
        for segment, stands in segments.items():
            where, _ = _stands(stands)
            if len(where) > 1:  # all but the first stand later as a whole
                out.append(np.column_stack([where[1:], where[1:, 2] + segment.count(b" ") + 1 - w + 1]))
            items.append((*where[0].tolist(), segment))
        items.sort()
        data = b"\n".join(x[3] for x in items)
        ends = np.cumsum([len(x[3]) + 1 for x in items])
        _, _, hashes, of_items = scan.words(np.frombuffer(data, dtype=np.uint8), np.r_[0, ends[:-1], len(data)])
        length = np.diff(of_items)
        symbols = np.unique(hashes, return_inverse=True)[1] + 1
        start = np.cumsum(length + 1) - length - 1
        text = np.zeros(int(length.sum()) + len(items), dtype=np.int64)
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(items)), length)] = symbols
        count, first = FMIndex(text, w).stream(text, start, start + length)
        later = (count > 1) & (first < np.arange(len(text)))
        edge = np.flatnonzero(np.diff(np.r_[False, later, False].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i = int(np.searchsorted(start, a, side="right")) - 1
            out.append(np.array([[items[i][0], items[i][1], items[i][2] + a - start[i], items[i][2] + b - start[i]]]))
        return np.concatenate(out) if out else np.zeros((0, 4), np.int64)

    return mark


def marked_texts(docs: DataFrame, plan: Plan, mark: Callable, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) to one row per row of docs: id, text, copies of its whole text (told by 128 bits), copy (whether it is another than the
    first of them, which has the least id), and marks: runs [first, end) of windows found by mark, in the first among copies. Columns of docs named in
    carry follow."""
    small_batches(docs.sparkSession)
    named = [internal_id("doc_id").alias("id"), text_key(bits=plan.key_bits).alias("key"), text_key(1).alias("check"), "text"]
    every = docs.select(*named, *carry)
    texts = every.select("id", "key", "text")
    keys = cut(every.select("id", "key", "check"))
    same = keys.groupBy("key", "check").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    rows = keys.groupBy("id", "key", "check").agg(F.count(F.lit(1)).alias("rows"))

    grams = every.select(F.col("check").alias("key"), "text").mapInArrow(_gram_rows(plan), "gram long, key long, places long")
    shared = grams.groupBy("gram").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.sum("places").alias("places"))
    shared = cut(shared.where("least <> most").select("gram", "places"))
    # the places of a heavy hash are salted; at most HEAVY hashes have more than a HEAVY-th of all, so they may go to every task
    total = shared.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    heavy = F.col("places") > max(plan.hot, total // HEAVY)
    salts = F.when(heavy, F.ceil(F.col("places") / plan.hot)).otherwise(1).cast("int")
    dealt = shared.select("gram", (F.col("places") > plan.hot).alias("hot"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    places = (
        texts.mapInArrow(_place_rows(plan), "gram long, id long, key long, where long")
        .join(F.broadcast(shared.where(heavy).select("gram", salts.alias("salts"))), "gram", "left")
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "where"), F.col("salts")), F.lit(0)).cast("int"))
        .join(dealt, ["gram", "salt"])
        .groupBy("id", "key")
        .agg(F.collect_list(F.struct("gram", "where", "hot")).alias("places"))
    )
    firsts = same.select(F.col("first_id").alias("id"), "key").distinct()
    places = places.join(firsts, ["id", "key"], "left_semi")

    # texts are dealt once, by (id, key): both joins below read that shuffle, so both name all of its columns
    every_text = every.repartition("id", "key")
    located = every_text.join(places.hint("shuffle_hash"), ["id", "key"], "left").select(*every.columns, "places")
    segments = located.mapInArrow(_segment_rows(plan), "shard_key long, segment binary, stands binary")
    marks = (
        segments.repartition("shard_key")
        .sortWithinPartitions("shard_key")
        .mapInArrow(_mark_rows(plan, mark), "id long, key long, first long, end long")
        .groupBy("id", "key")
        .agg(F.collect_list(F.struct("first", "end")).alias("marks"))
    )
    # copies carry the marks of the first among them, whose id they learn through both keys
    marks = marks.select(F.col("id").alias("first_id"), "key", "marks")
    known = rows.join(same, ["key", "check"]).join(marks, ["first_id", "key"], "left")
    known = known.groupBy("id", "key").agg(F.collect_list(F.struct("check", "first_id", "copies", "marks")).alias("_known"))
    found = every_text.join(known.hint("shuffle_hash"), ["id", "key"], "left")
    found = found.withColumn("_own", F.filter("_known", lambda k: k["check"] == F.col("check"))[0])
    found = found.select(*every.columns, *(F.col(f"_own.{c}").alias(c) for c in ("first_id", "copies", "marks")))
    copy = F.col("id") != F.col("first_id")
    if rows.where("rows > 1").limit(1).count():  # of rows that repeat an id and its text, one is the first
        rank = F.row_number().over(Window.partitionBy("id", "key", "check").orderBy(F.lit(1)))
        copy = copy | (rank > 1)
    return found.select("id", "text", "copies", copy.alias("copy"), "marks", *carry)
