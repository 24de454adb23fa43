"""Point-in-time features of sales by merge-sort trees over each client's events (operator 12).

An event has a time, and a time from which it can be known. A probe asks for the events of a window of event time that are known by its own time t. The events of a
client, by event time, make a tree of dyadic blocks; each block holds its events by the time they are known, with prefix sums and the prefix maximum of the clicks' places. A window is
a few blocks, and a binary search in each finds what is known by t.

Clients of up to `most` events are trees inside tasks, as many in a batch as fit. The others, and those alone, have their time cut into leaves of 2^fine microseconds, each again a
tree inside a task, which answers for the ends of windows; blocks of several leaves are rows of a table sorted by (client, level, block, known) over all tasks, where prefix sums run on from range to
range. So no task holds all of a client.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import NULL_ID, cut, internal_id, public_id, small_batches

_SECOND = 1_000_000
_DAY = 86_400 * _SECOND
#: The windows in days, how far the label looks ahead, what passes until an arrival can be used, and the spread of the probes' delay.
WINDOWS = (2, 14)
AHEAD = 7 * _DAY
LATENCY = 240 * 60 * _SECOND
SPREAD = 259_200
_NEVER = 1 << 62
#: What an event adds to: bits of its kind.
CLICK, PURCHASE, SALE, LINE, ITEM = 1, 2, 4, 8, (16, 32)
MEASURES = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "items_0", "items_1")
#: Windows of a probe: those of WINDOWS, then the label's.
_LABEL = len(WINDOWS)
#: No window holds a block of more than 2^_TOP microseconds. Leaves of 2^fine are looked for in these ranges of fine, from cells of the least of each.
_TOP = 40
_FINE = ((32, _TOP), (20, 31), (8, 19), (0, 7))
_CELL = 32  # 2^32 microseconds, 71 minutes
_CHUNK = 1 << 18  # rows that a task takes together
#: Columns of what trees are made from. Probes: e is t, or the last place of a piece; a is what it must be known by; v the place before the first; id the sale.
_ROWS = "client long, leaf long, probe int, e long, a long, kind int, n long, v long, id long"


def micros(name: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def cents(name: str) -> Column:
    return F.coalesce(F.floor(F.lit(100.0) * F.col(name) + 0.5).cast("long"), F.lit(0).cast("long"))


def probes(sales: DataFrame) -> DataFrame:
    """Sales with a client and a time: row, sale_id, client, e (sold), known (null if it never arrived), v (cents) and t."""
    delay = F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % SPREAD * _SECOND
    rows = sales.where("client_id is not null and sold_at is not null")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), internal_id("sale_id").alias("sale_id"), F.col("client_id").cast("long").alias("client"), micros("sold_at").alias("e"), (micros("arrived_at") + LATENCY).alias("known"), cents("total").alias("v"), delay.alias("_delay"))
    return rows.select("row", "sale_id", "client", "e", "known", "v", (F.col("e") + F.col("_delay")).alias("t"))


def events(asked: DataFrame, clicks: DataFrame, lines: DataFrame) -> DataFrame:
    """(client, e, a, kind, n, v, id) of clicks, sales and lines: at e, known from a, of n rows worth v cents; id is a click's or an item's. What no window can hold is left out."""
    long = lambda x: F.lit(x).cast("long")
    known = clicks.where("client_id is not null and ts is not null and arrived_at is not null")
    once = ["click_id", "ts", "arrived_at", "client_id", "kind", "value"]
    known = known.select(*once, F.xxhash64("props").alias("_p"), F.xxhash64(F.lit(1), "props").alias("_q"), F.col("props").isNull().alias("_r")).distinct()
    kind = F.when(F.col("kind") == "purchase", CLICK | PURCHASE).otherwise(CLICK)
    known = known.select(F.col("client_id").cast("long").alias("client"), micros("ts").alias("e"), (micros("arrived_at") + LATENCY).alias("a"), kind.alias("kind"), long(1).alias("n"), cents("value").alias("v"), internal_id("click_id").alias("id"))
    sold = asked.select("client", "e", F.coalesce("known", F.lit(_NEVER)).alias("a"), F.lit(SALE).alias("kind"), long(1).alias("n"), "v", long(0).alias("id"))
    shipped = lines.where("sale_id is not null and shipped_at is not null").select(F.col("sale_id").cast("long").alias("sale_id"), micros("shipped_at").alias("shipped"), F.col("item_id").cast("long").alias("id"), cents("amount").alias("_v"))
    sent = asked.where("known is not null").select("sale_id", "client", "e", "known").join(shipped, "sale_id")
    sent = sent.select("client", "e", F.greatest("known", "shipped").alias("a"), F.lit(LINE).alias("kind"), long(1).alias("n"), F.col("_v").alias("v"), "id")
    every = known.unionByName(sold).unionByName(sent).withColumn("a", F.greatest("a", "e"))
    return every.where((F.col("kind") == SALE) | (F.col("a") < F.col("e") + max(WINDOWS) * _DAY))


def _many(every: DataFrame, most: int) -> DataFrame:
    """Clients of more than `most` events."""
    return cut(every.groupBy("client").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("client"))


def collapsed(every: DataFrame) -> DataFrame:
    """Lines of one client, item and time that are known at once as one event."""
    lines = every.where(F.col("kind") == LINE).groupBy("client", "id", "e", "a").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).withColumn("kind", F.lit(LINE))
    return every.where(F.col("kind") != LINE).unionByName(lines.select(*every.columns))


def leaves(every: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(client, fine) of each client: leaves of 2^fine microseconds hold `most` events and ends of windows at most, where any do. Counts are summed up from cells of time, coarse ones first and
    finer ones for clients alone that need them."""
    ends = asked.select("client", F.explode(F.array(*(F.col("t") - d * _DAY for d in (0, *WINDOWS)), F.col("t") + AHEAD)).alias("e"))
    at, known = every.select("client", "e").unionByName(ends), None
    for low, high in _FINE:
        own = at if known is None else at.join(known, "client", "left_anti")
        cells = own.groupBy("client", F.shiftright("e", low).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        levels = cells.withColumn("fine", F.explode(F.sequence(F.lit(low), F.lit(high))))
        sizes = levels.groupBy("client", "fine", F.expr(f"shiftright(cell, fine - {low})").alias("leaf")).agg(F.sum("n").alias("n")).groupBy("client", "fine").agg(F.max("n").alias("n"))
        found = cut(sizes.groupBy("client").agg(F.max(F.when(F.col("n") <= most, F.col("fine"))).alias("fine")))
        good = found.na.fill(0, ["fine"]) if low == 0 else found.where("fine is not null")
        known = good if known is None else known.unionByName(good)
        if low == 0 or found.where("fine is null").isEmpty():
            break
    return cut(known)


def _with_items(lines: DataFrame, later: Column) -> DataFrame:
    """Lines, and where they make the number of items larger by one.

    By window length d, an item is there while some line of it is: from a until e + d. Of lines there at once the one of latest e counts, so a line counts until
    min(e + d, later), where later is the least a of the lines of this client and item after it. That is an event at that end less d, known from a; where later doesn't cut it
    short, it is the line itself."""
    end = [F.least(F.col("e") + d * _DAY, F.coalesce(later, F.lit(_NEVER))) - d * _DAY for d in WINDOWS]
    there = [(F.col("id").isNotNull()) & (end[i] + WINDOWS[i] * _DAY > F.col("a")) for i in range(len(WINDOWS))]
    own = F.lit(LINE)
    for i in range(len(WINDOWS)):
        own = own + F.when(there[i] & (end[i] == F.col("e")), ITEM[i]).otherwise(0)
    zero = F.lit(0).cast("long")
    rows = [F.struct(F.col("e").alias("e"), own.cast("int").alias("kind"), F.col("n").alias("n"), F.col("v").alias("v"))]
    for i in range(len(WINDOWS)):
        rows.append(F.when(there[i] & (end[i] != F.col("e")), F.struct(end[i].alias("e"), F.lit(ITEM[i]).alias("kind"), zero.alias("n"), zero.alias("v"))))
    out = lines.select("client", "a", *(["fine"] if "fine" in lines.columns else []), F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("_x"))
    return out.select("*", "_x.*", zero.alias("id")).drop("_x")


def _after(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy(F.desc("e"), F.desc("a")).rowsBetween(Window.unboundedPreceding, -1)


def light_rows(every: DataFrame) -> DataFrame:
    """Events with item counts, of clients that a task may hold."""
    lines = every.where(F.col("kind") == LINE)
    named = lines.where("id is not null").withColumn("later", F.min("a").over(_after("client", "id")))
    bare = lines.where("id is null").withColumn("later", F.lit(None).cast("long"))
    return every.where(F.col("kind") != LINE).unionByName(_with_items(named.unionByName(bare), F.col("later")))


def heavy_rows(every: DataFrame) -> DataFrame:
    """The same of clients of many events, whose lines are collapsed, with `fine`: later lines are found by cells of time."""
    lines = every.where(F.col("kind") == LINE)
    named = lines.where("id is not null").withColumn("cell", F.shiftright("e", _CELL))
    in_cell = F.min("a").over(_after("client", "id", "cell"))
    cells = named.groupBy("client", "id", "cell").agg(F.min("a").alias("a"))
    # a row a cell of time: their number is bounded by the time that the tables span
    beyond = F.min("a").over(Window.partitionBy("client", "id").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1))
    named = named.withColumn("_in", in_cell).join(cells.select("client", "id", "cell", beyond.alias("_beyond")), ["client", "id", "cell"])
    named = named.withColumn("later", F.least("_in", "_beyond")).drop("cell", "_in", "_beyond")
    bare = lines.where("id is null").withColumn("later", F.lit(None).cast("long"))
    return every.where(F.col("kind") != LINE).unionByName(_with_items(named.unionByName(bare), F.col("later")))


class Trees:
    """Merge-sort trees of many groups at once. Events come by group, then by time, then by id: their places. Blocks are dyadic stretches of places."""

    def __init__(self, group: np.ndarray, e: np.ndarray, a: np.ndarray, kind: np.ndarray, n: np.ndarray, v: np.ndarray, ids: np.ndarray):
        self.e, self.ids = e, ids
        self.times = np.unique(e)
        self.places = group * (len(self.times) + 1) + np.searchsorted(self.times, e)
        self.by_known = np.argsort(a, kind="stable")
        self.known = a[self.by_known]
        self.rank = np.empty(len(a), dtype=np.int64)
        self.rank[self.by_known] = np.arange(len(a))
        bit = lambda b: (kind & b > 0).astype(np.int64)
        click, line = bit(CLICK), bit(LINE)
        self.measures = np.column_stack([click, bit(PURCHASE), click * v, bit(SALE), bit(SALE) * v, line * n, line * v, bit(ITEM[0]), bit(ITEM[1])])
        self.clicks = np.where(click > 0, np.arange(len(a)), -1)

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of blocks of 2^k places: keys (block, rank by known) in order, prefix sums, and the largest place of a click so far."""
        bits = len(self.rank).bit_length()
        keys = np.sort(((np.arange(len(self.rank)) >> k) << bits) | self.rank)
        at = self.by_known[keys & ((1 << bits) - 1)]
        sums = np.zeros((len(at) + 1, self.measures.shape[1]), dtype=np.int64)
        np.cumsum(self.measures[at], axis=0, out=sums[1:])
        return keys, sums, np.maximum.accumulate(self.clicks[at])

    def ask(self, group: np.ndarray, after: np.ndarray, upto: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the events of a group with after < e <= upto and a <= by, and the place of the last click among them, or -1. All that is asked is asked at once, so that
        one level is held at a time."""
        out, last = np.zeros((len(group), self.measures.shape[1]), dtype=np.int64), np.full(len(group), -1, dtype=np.int64)
        if not len(self.rank):
            return out, last
        wide = len(self.times) + 1
        left = np.searchsorted(self.places, group * wide + np.searchsorted(self.times, after, side="right"))
        right = np.searchsorted(self.places, group * wide + np.searchsorted(self.times, upto, side="right"))
        cut_at = np.searchsorted(self.known, by, side="right")
        bits, k = len(self.rank).bit_length(), 0
        rows = np.flatnonzero(left < right)
        left, right = left[rows], right[rows]
        while len(rows):
            ends = [(left & 1 == 1, left), (right & 1 == 1, right - 1)]
            if ends[0][0].any() or ends[1][0].any():
                keys, sums, clicks = self.level(k)
                for used, block in ends:
                    at, b = rows[used], block[used]
                    upto_rank = np.searchsorted(keys, (b << bits) | cut_at[at])
                    begin = b << k
                    out[at] += sums[upto_rank] - sums[begin]
                    found = clicks[np.maximum(upto_rank - 1, 0)]
                    last[at] = np.maximum(last[at], np.where((upto_rank > begin) & (found >= begin), found, -1))
            left, right, k = (left + 1) >> 1, right >> 1, k + 1
            on = left < right
            rows, left, right = rows[on], left[on], right[on]
        return out, last


def _grouped(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Rows by (client, leaf), whole groups of them, with the number of each row's group. Of a group with more rows than fit, the events come again with each part of the probes."""
    held: dict[str, np.ndarray] = {}
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def numbers(rows: dict[str, np.ndarray]) -> np.ndarray:
        fresh = (np.diff(rows["client"]) != 0) | (np.diff(rows["leaf"]) != 0)
        return np.r_[0, np.cumsum(fresh)] if len(rows["client"]) else np.zeros(0, dtype=np.int64)

    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        held = {c: np.concatenate([held[c], new[c]]) for c in names} if held else new
        if len(held["client"]) < chunk:
            continue
        group = numbers(held)
        border = int(np.searchsorted(group, group[-1]))
        if border:
            yield {c: x[:border] for c, x in held.items()}, group[:border]
            held = {c: x[border:] for c, x in held.items()}
        elif held["probe"][-1]:
            yield held, group
            held = {c: x[held["probe"] == 0] for c, x in held.items()}
    if held and len(held["client"]):
        yield held, numbers(held)


def _answers(split: bool, chunk: int):
    """split: probes are pieces of windows; else each probe has all its windows here, and its rows are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _grouped(batches, chunk):
            is_probe = rows["probe"] == 1
            there = ~is_probe
            trees = Trees(group[there], *(rows[c][there] for c in ("e", "a", "kind", "n", "v", "id")))
            asked = {c: x[is_probe] for c, x in rows.items()}
            own = group[is_probe]
            if not len(own):
                continue
            if split:
                sums, last = trees.ask(own, asked["v"], asked["e"], asked["a"])
                yield _batch([("row", asked["id"]), ("w", asked["kind"].astype(np.int32))], sums, last, trees)
                continue
            t = asked["e"]
            after = [*(t - days * _DAY for days in WINDOWS), t]
            sums, last = trees.ask(np.tile(own, len(after)), np.concatenate(after), np.r_[np.tile(t, len(WINDOWS)), t + AHEAD], np.r_[np.tile(t, len(WINDOWS)), np.full(len(t), _NEVER)])
            label = sums[_LABEL * len(t) :, MEASURES.index("n_sales")] > 0
            for w in range(len(WINDOWS)):
                at = slice(w * len(t), (w + 1) * len(t))
                yield _batch([("sale_id", asked["id"]), ("t_us", t), ("w", np.full(len(t), w, dtype=np.int32)), ("label", label)], sums[at], last[at], trees)

    return run


def _batch(first: list[tuple[str, np.ndarray]], sums: np.ndarray, last: np.ndarray, trees: Trees) -> pa.RecordBatch:
    none = last < 0
    at = np.where(none, 0, last)
    ends = [pa.array(x[at] if len(x) else at, mask=none) for x in (trees.e, trees.ids)]
    return pa.record_batch([*(pa.array(x) for _, x in first), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in range(sums.shape[1])), *ends], [*(name for name, _ in first), *MEASURES, "last_ts", "last_id"])


_ANSWER = ", ".join(f"{c} long" for c in MEASURES) + ", last_ts long, last_id long"


def _in_trees(rows: DataFrame, split: bool, chunk: int) -> DataFrame:
    dealt = rows.repartition("client", "leaf").sortWithinPartitions("client", "leaf", "probe", "e", "id")
    first = "row long, w int" if split else "sale_id long, t_us long, w int, label boolean"
    return dealt.mapInArrow(_answers(split, chunk), f"{first}, {_ANSWER}")


def _as_rows(rows: DataFrame, leaf: Column, probe: int, **other: Column) -> DataFrame:
    value = {"client": F.col("client"), "leaf": leaf, "probe": F.lit(probe)} | {c: F.col(c) for c in ("e", "a", "kind", "n", "v", "id")} | other
    return rows.select(*(value[name].cast(kind).alias(name) for name, kind in (c.split() for c in _ROWS.split(", "))))


def _windows(asked: DataFrame) -> DataFrame:
    """A row per window of a probe: w, after and upto (its ends), by (known by)."""
    t = F.col("t")
    each = [F.struct(F.lit(w).alias("w"), (t - d * _DAY).alias("after"), t.alias("upto"), t.alias("by")) for w, d in enumerate(WINDOWS)]
    each.append(F.struct(F.lit(_LABEL).alias("w"), t.alias("after"), (t + AHEAD).alias("upto"), F.lit(_NEVER).alias("by")))
    return asked.select("client", "fine", "row", F.explode(F.array(*each)).alias("_w")).select("client", "fine", "row", "_w.*")


def _spread(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Answers from the blocks of whole leaves that windows hold: rows of each level's blocks in order of (client, level, block, known) over all tasks, prefix sums inside ranges, and for a block
    in several ranges what the ranges before hold."""
    first, after = F.expr("shiftright(after + 1, fine) + 1"), F.expr("shiftright(upto, fine)")
    steps = windows.select("*", first.alias("_l"), after.alias("_r")).where("_l < _r").withColumn("k", F.explode(F.expr(f"sequence(0, {_TOP} - fine)")))
    steps = steps.select("*", F.expr("shiftright(_l + shiftleft(1L, k) - 1, k)").alias("_lk"), F.expr("shiftright(_r, k)").alias("_rk")).where("_lk < _rk")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1  # noqa: E731  of times before 1970 too
    blocks = F.filter(F.array(F.when(odd("_lk"), F.col("_lk")), F.when(odd("_rk"), F.col("_rk") - 1)), lambda x: x.isNotNull())
    pieces = steps.select("client", (F.col("fine") + F.col("k")).alias("level"), F.explode(blocks).alias("block"), F.col("by").alias("a"), "row", "w")
    zero = F.lit(0).cast("long")
    nothing = {"kind": F.lit(0), "n": zero, "v": zero, "e": zero, "id": zero}
    pieces = pieces.select("client", "level", "block", "a", F.lit(1).alias("probe"), *(x.alias(c) for c, x in nothing.items()), "row", "w")
    held = rows.withColumn("level", F.explode(F.expr(f"sequence(fine, {_TOP})"))).withColumn("block", F.expr("shiftright(e, level)"))
    held = held.select("client", "level", "block", "a", F.lit(0).alias("probe"), *nothing, zero.alias("row"), F.lit(0).alias("w"))
    by = ["client", "level", "block"]
    every = cut(held.unionByName(pieces))
    ranged = every.repartitionByRange(*by, "a").sortWithinPartitions(*by, "a", "probe")
    ranged = cut(ranged.withColumn("_range", F.spark_partition_id()))
    bit = lambda b: (F.col("kind").bitwiseAND(F.lit(b)) > 0).cast("long")
    parts = [bit(CLICK), bit(PURCHASE), bit(CLICK) * F.col("v"), bit(SALE), bit(SALE) * F.col("v"), bit(LINE) * F.col("n"), bit(LINE) * F.col("v"), bit(ITEM[0]), bit(ITEM[1])]
    last = F.when(bit(CLICK) > 0, F.struct("e", "id"))
    so_far = Window.partitionBy("_range", *by).orderBy("a", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.select("_range", *by, "probe", "row", "w", *(F.sum(p).over(so_far).alias(c) for c, p in zip(MEASURES, parts, strict=True)), F.max(last).over(so_far).alias("last")).where("probe = 1")
    # a row per block and range that hold each other: few more than ranges where blocks are large
    totals = ranged.where("probe = 0").groupBy("_range", *by).agg(*(F.sum(p).alias(c) for c, p in zip(MEASURES, parts, strict=True)), F.max(last).alias("last"))
    ranges = ranged.groupBy("_range", *by).agg(F.lit(1).alias("_one")).drop("_one").join(totals, ["_range", *by], "left")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("_range", *by, *(F.sum(c).over(before).alias(f"_{c}") for c in MEASURES), F.max("last").over(before).alias("_last"))
    joined = inside.join(carried, ["_range", *by])
    whole = [(F.col(c) + F.coalesce(f"_{c}", zero)).alias(c) for c in MEASURES]
    latest = F.greatest("last", "_last")
    return joined.select("row", "w", *whole, latest["e"].alias("last_ts"), latest["id"].alias("last_id"))


def _of_many(every: DataFrame, asked: DataFrame, most: int, chunk: int) -> DataFrame:
    """Answers for clients of many events."""
    rows = cut(collapsed(every))
    fine = leaves(rows, asked, most)
    rows, asked = cut(heavy_rows(rows.join(fine, "client"))), asked.join(fine, "client")
    windows = _windows(asked)
    ends = F.array_distinct(F.array(F.expr("shiftright(after + 1, fine)"), F.expr("shiftright(upto, fine)")))
    pieces = windows.withColumn("leaf", F.explode(ends))
    pieces = _as_rows(pieces, F.col("leaf"), 1, e=F.col("upto"), a=F.col("by"), kind=F.col("w"), n=F.lit(0), v=F.col("after"), id=F.col("row"))
    ends = _in_trees(_as_rows(rows, F.expr("shiftright(e, fine)"), 0).unionByName(pieces), True, chunk)
    parts = ends.unionByName(_spread(windows, rows))
    label = F.coalesce(F.max(F.when(F.col("w") == _LABEL, F.col("n_sales") > 0)), F.lit(False)).alias("label")
    each = []
    for w in range(len(WINDOWS)):
        own = F.col("w") == w
        each.append(F.struct(F.lit(w).alias("w"), *(F.sum(F.when(own, F.col(c)).otherwise(0)).alias(c) for c in MEASURES), F.max(F.when(own & F.col("last_id").isNotNull(), F.struct("last_ts", "last_id"))).alias("last")))
    summed = parts.groupBy("row").agg(label, F.array(*each).alias("_each")).select("row", "label", F.explode("_each").alias("_x"))
    found = summed.select("row", "label", "_x.*").join(asked.select("row", "sale_id", F.col("t").alias("t_us")), "row")
    return found.select("sale_id", "t_us", "w", "label", *MEASURES, F.col("last.last_ts").alias("last_ts"), F.col("last.last_id").alias("last_id"))


def point_in_time(sales: DataFrame, clicks: DataFrame, lines: DataFrame, most: int = 1 << 18, chunk: int = _CHUNK) -> DataFrame:
    """sales (sale_id, client_id, total, sold_at, arrived_at), clicks (click_id, ts, arrived_at, client_id, kind, value, props) and lines (sale_id, item_id, amount, shipped_at) to two rows
    per sale with a client and a time: sale_id, d, t_us, label and the features of the window of d days before t.

    Null arrival: never known, though a sale still counts for labels. Null amounts: 0 cents. Null item: no item. Null shipped_at, or a line without a sale: not counted. Clicks that are alike in the
    columns named count once (props are told apart by 128 bits); repeated sales and lines count each; a sale_id that several sales share gives its lines to each of them. Null sale_id: hashed as an empty string, without lines. Null click_id: below all
    others, and null in the result. Clients of more than `most` events, which take a task some 100 MB, are spread over tasks. Other columns aren't read. Empty tables give no rows, or zeros. Times with a zone are taken in the session's.
    """
    small_batches(sales.sparkSession, 1 << 16)
    asked = cut(probes(sales))
    every = cut(events(asked, clicks, lines))
    many = _many(every, most)
    few = lambda df: df.join(many, "client", "left_anti")
    rows = _as_rows(light_rows(few(every)), F.lit(0), 0)
    t = {"e": F.col("t"), "a": F.col("t"), "kind": F.lit(0), "n": F.lit(0), "v": F.lit(0), "id": F.col("sale_id")}
    found = _in_trees(rows.unionByName(_as_rows(few(asked), F.lit(0), 1, **t)), False, chunk)
    if not many.isEmpty():
        found = found.unionByName(_of_many(every.join(many, "client"), asked.join(many, "client"), most, chunk))
    days = F.element_at(F.array(*(F.lit(d) for d in WINDOWS)), F.col("w") + 1)
    items = F.when(F.col("w") == 0, F.col("items_0")).otherwise(F.col("items_1"))
    last = F.when(F.col("last_id") != NULL_ID, F.col("last_id"))
    counts = [c for c in MEASURES if not c.startswith("items")]
    return found.select(public_id("sale_id").alias("sale_id"), days.cast("int").alias("d"), "t_us", "label", *counts, items.alias("n_items"), last.alias("last_click_id"))
