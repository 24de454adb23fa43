"""Similarity join on word shingles with adaptive multi-match prefixes (operator 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from . import bytescan as scan
from .components import components
from .shared import cut, internal_id, public_id, small_batches, to_all_if_few

#: Cells of the table of shingle counts that orders prefixes; its size is fixed, so it can be broadcast.
CELLS = 1 << 20
_BLOCK = 4096
#: Pairs of one class that a task verifies.
SALTED = 2048
#: Orders among which a round's lists choose.
PICKS = 8
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Parities of a set's shingles by 512 bins.
BITS = [f"bits{i}" for i in range(8)]


@dataclass(frozen=True)
class Similarity:
    """Link when shared * of >= at_least * union, over distinct shingles of `words` words."""

    words: int = 5
    at_least: int = 80
    of: int = 100
    #: Bits of the first half of a set's 128; fewer than 64 only make unequal halves likelier to clash.
    key_bits: int = 64

    def prefix(self, n: int) -> int:
        """Places that a set of n may leave out and still link, and one more."""
        return n - -(-self.at_least * n // self.of) + 1


def shingle_sets(plan: Similarity, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row, as 64-bit hashes."""
    _, _, h, of_rows = scan.words(data, offsets, fold=True)
    s = h
    for i in range(1, plan.words):
        s = scan.mix(s[:-1] if len(s) else s) * _STEP + h[i:]
    s = scan.mix(s)
    for r in range(len(offsets) - 1):
        a, b = int(of_rows[r]), int(of_rows[r + 1])
        n = b - a
        if n >= plan.words:
            yield np.unique(s[a : b - plan.words + 1])
        elif n:
            whole = int.from_bytes(blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little")
            yield np.array([whole], dtype=np.uint64)
        else:
            yield s[:0]


def _halves(plan: Similarity, shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two longs; of the first only key_bits count."""
    both = blake2b(shingles.tobytes(), digest_size=16).digest()
    own, check = (int.from_bytes(both[i : i + 8], "little", signed=True) for i in (0, 8))
    return own if plan.key_bits == 64 else own & ((1 << plan.key_bits) - 1), check


def _class_of(plan: Similarity, shingles: np.ndarray, clash: frozenset[int]) -> int:
    """The class of a set; where unequal sets share the first half, both halves make it."""
    own, check = _halves(plan, shingles)
    return own ^ check if own in clash else own


def _summary_rows(plan: Similarity):
    """Texts to rows (id, n, both halves of the set's 128 bits, parity bits), and at the end the task's counts by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.uint32)
        names = ["id", "n", "class", "check", *BITS, "block", "counts"]
        salt = 0
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a, b, data, offsets in scan.slices(*scan.strings(batch.column("text"))):
                own, check, sizes, bits, cells = [], [], [], [], []
                for shingles in shingle_sets(plan, data, offsets):
                    halves = _halves(plan, shingles)
                    own.append(halves[0])
                    check.append(halves[1])
                    sizes.append(len(shingles))
                    bits.append(np.packbits((np.bincount((shingles & _U(511)).view(np.int64), minlength=512) & 1).astype(np.uint8)).view(np.int64))
                    cells.append(shingles)
                counts += np.bincount((np.concatenate(cells) >> _U(20) & _U(CELLS - 1)).view(np.int64), minlength=CELLS).astype(np.uint32)
                bits = np.array(bits)
                salt ^= own[0]
                yield pa.record_batch([pa.array(ids[a:b]), pa.array(sizes, pa.int64()), pa.array(own, pa.int64()), pa.array(check, pa.int64()), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(8)), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], names)
        n = CELLS // _BLOCK
        if counts.any():
            packed = [zlib.compress(x.astype(np.int64).tobytes(), 1) for x in counts.reshape(n, _BLOCK)]
            yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([salt % 256] * n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.int64()) for _ in BITS), pa.array(range(n), pa.int32()), pa.array(packed, pa.binary())], names)

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK, dtype=np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(zlib.decompress(x.as_py()), dtype=np.int64)
    return table.slice(0, 1).set_column(table.schema.get_field_index("counts"), "counts", pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()))


def cell_counts(summary: DataFrame) -> np.ndarray:
    """How often the shingles of each cell stand in the corpus; salted sums, then one per block."""
    blocks = summary.where("block is not null").select("block", F.col("class").alias("salt"), "counts")
    schema = "block int, salt long, counts binary"
    blocks = blocks.groupBy("block", "salt").applyInArrow(_add_counts, schema).groupBy("block").applyInArrow(_add_counts, schema)
    total = np.zeros((CELLS // _BLOCK, _BLOCK), dtype=np.int64)
    for row in blocks.select("block", "counts").collect():
        total[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return np.minimum(total.ravel(), (1 << 24) - 1).astype(np.uint32)


def best_length(plan: Similarity, n: int, others: np.ndarray, longest: int = 4) -> int:
    """How many shared prefix tokens to ask for: with one more, the prefix is one longer (more
    lists to read), and fewer candidates stay (a candidate is on that many of the lists)."""
    base, most = plan.prefix(n), n - plan.prefix(n) + 1
    best, least = 1, None
    for ask in range(1, min(longest, most) + 1):
        read = float(others[: base + ask - 1].sum())
        cost = read + 8.0 * read / ask
        if least is None or cost < least:
            best, least = ask, cost
    return best


def _prefix_rows(plan: Similarity, counts, clash: frozenset[int]):
    """Texts to (token, class, place, ask): the prefix of each set in the order of the cells' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        usual = float(table.mean())
        done: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in scan.slices(*scan.strings(batch.column("text"))):
                tokens, classes, places, asks = [], [], [], []
                for shingles in shingle_sets(plan, data, offsets):
                    n = len(shingles)
                    own = _class_of(plan, shingles, clash)
                    if not n or own in done:
                        continue
                    if len(done) < 1_000_000:
                        done.add(own)
                    often = table[(shingles >> _U(20) & _U(CELLS - 1)).view(np.int64)]
                    by = np.argsort(often.astype(np.uint64) << _U(40) | shingles >> _U(24), kind="stable")[: plan.prefix(n) + 3]
                    ask = best_length(plan, n, np.maximum(often[by] - usual, 1.0))
                    by = by[: plan.prefix(n) + ask - 1]
                    tokens.append(scan.signed(shingles[by]))
                    classes.append(np.full(len(by), own, dtype=np.int64))
                    places.append(np.arange(len(by), dtype=np.int32))
                    asks.append(np.full(len(by), ask, dtype=np.int32))
                if tokens:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in (tokens, classes, places, asks)], ["token", "class", "place", "ask"])

    return run


def _sent_rows(plan: Similarity, clash: frozenset[int]):
    """Texts with where their sets are wanted to (to, salt, head, class, shingles)."""
    names = ["to", "salt", "head", "class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("class").to_numpy()
            for a, b, data, offsets in scan.slices(*scan.strings(batch.column("text"))):
                sets, good = [], []
                for want, shingles in zip(wanted[a:b].tolist(), shingle_sets(plan, data, offsets), strict=True):
                    good.append(_class_of(plan, shingles, clash) == want)
                    sets.append(shingles.tobytes())
                part = pa.record_batch([*(batch.column(c).slice(a, b - a) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])
                yield part.filter(pa.array(good, pa.bool_()))

    return run


def _verified(plan: Similarity):
    """Rows in order of (to, salt), the set of `to` itself first, to the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            to, salt, head, own = (batch.column(c).to_pylist() for c in ("to", "salt", "head", "class"))
            for i, y in enumerate(batch.column("shingles")):
                y = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if head[i] == 0:
                    at, x = (to[i], salt[i]), y
                elif at == (to[i], salt[i]):
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if plan.of * shared >= plan.at_least * (len(x) + len(y) - shared):
                        found.append((own[i], to[i]))
            if found:
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return run


def differing() -> Column:
    return reduce(Column.__add__, (F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in BITS))


def may_link(plan: Similarity) -> Column:
    """Holds for all pairs that link: sizes near enough, and no more parity bits that differ than
    shingles may be in one set only. The columns are na, nb and a, b before each of BITS."""
    na, nb = F.col("na"), F.col("nb")
    return (F.least(na, nb) * plan.of >= F.greatest(na, nb) * plan.at_least) & (differing() * (plan.of + plan.at_least) <= (na + nb) * (plan.of - plan.at_least))


def may_match(plan: Similarity) -> Column:
    """Holds for the first `ask` tokens that a pair which links shares, by their places in both orders: ask and what comes after
    them must reach the shingles that the pair needs in common. The columns are also place and ask of a and b."""
    rest = F.least(F.col("na") - F.col("place_a"), F.col("nb") - F.col("place_b")) - 1
    return (F.least("ask_a", "ask_b") + rest) * (plan.of + plan.at_least) >= (F.col("na") + F.col("nb")) * plan.at_least


def may_lead(plan: Similarity) -> Column:
    """may_match for the smaller set of a pair, whatever the other."""
    return (F.col("ask_b") + F.col("nb") - F.col("place_b") - 1) * (plan.of + plan.at_least) >= 2 * F.col("nb") * plan.at_least


def _side(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    return rows.select(F.col("class").alias(name), F.col("n").alias(f"n{name}"), *(F.col(c).alias(f"{name}{c}") for c in BITS), *more)


def _left(rows: DataFrame) -> tuple[float, float]:
    """Pairs of classes of different components that stand on one list, over all lists; and places on the lists."""
    sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).cast("double").alias("n"))
    lists = sizes.groupBy("token").agg(F.sum("n").alias("n"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
    return tuple(lists.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first())


def similar_texts(docs: DataFrame, plan: Similarity = Similarity()) -> DataFrame:
    """Join docs (doc_id, text) with themselves on the Jaccard similarity of their shingle sets.

    Returns doc_id, n_shingles, class_id (smallest doc_id of an equal set), component_id
    (smallest doc_id reachable by links, itself included), one row per row of docs.

    Lower-cases A-Z; words are runs of anything but space and the ASCII line and tab controls; a
    shorter text counts as one shingle. Null, empty or blank text: no shingles, linked with
    nothing, its own component. Equal sets, repeated rows included, are one class and link. Null
    doc_id: takes part, and comes before all others. Other columns are ignored. An empty table
    gives an empty result.

    Equal sets, told by 128 bits, are joined as one class. Tokens are ordered by how often their cell stands in the
    corpus. Tokens that stand in the same classes' prefixes become one list that counts as many matches. While lists hold
    more pairs than places, a list's classes are compared with one of them only, in rounds; links found unite classes, and rounds
    go on while they halve what is left and ask about no fewer pairs than before, by a quarter. Then classes that stay apart, whose sizes, places and parities allow a link and that share as many prefix tokens
    as the lesser of the two asks for, are verified, so no link between components is lost,
    and a group of near copies doesn't become all its pairs. A very long text is one set of its distinct shingles in
    one task, 8 bytes each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(internal_id("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    longs = ", ".join(f"{c} long" for c in BITS)
    summary = cut(texts.mapInArrow(_summary_rows(plan), f"id long, n long, class long, check long, {longs}, block int, counts binary"))
    rows = summary.where("block is null").select("id", "n", "class", "check", *BITS)
    # unequal sets with one first half: about one such pair is expected among 6 billion sets, so few come to the driver
    unequal = rows.groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
    clash = frozenset(r["class"] for r in unequal.select("class").collect())
    if clash:
        rows = rows.withColumn("class", F.when(F.col("class").isin(*clash), F.col("class").bitwiseXOR(F.col("check"))).otherwise(F.col("class")))
    classes = cut(rows.groupBy("class").agg(F.min("id").alias("class_id"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in BITS)))
    counts = spark.sparkContext.broadcast(cell_counts(summary))

    by_token = Window.partitionBy("token")
    listed = cut(
        texts.select("text")
        .mapInArrow(_prefix_rows(plan, counts, clash), "token long, class long, place int, ask int")
        .withColumns({"low": F.min("class").over(by_token), "high": F.max("class").over(by_token)})
        .where("low <> high")
        .groupBy("token", "class")
        .agg(F.first("place").alias("place"), F.first("ask").alias("ask"))
    )
    # tokens of the same classes, told by 128 bits, become one: the first of them in the order, as any one class has it
    alike = listed.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("class")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("two"), F.min(F.struct("class", "place")).alias("at")
    )
    kept = alike.groupBy("size", "one", "two").agg(F.min_by("token", "at.place").alias("token"), F.count(F.lit(1)).alias("weight")).select("token", "weight")
    met = listed.groupBy("class").agg(F.count(F.lit(1)).alias("met"))
    shared = cut(listed.join(kept, "token").join(classes.select("class", "n", *BITS).join(met, "class"), "class"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that link. The set of each a goes to the task of its b; a b of many pairs is
        salted, and its set goes to each salt once."""
        pairs = cut(pairs)
        many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("pairs"))
        salted = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("pairs") / F.lit(SALTED))).alias("salt"))
        tails = salted.select(F.col("a").alias("class"), F.col("b").alias("to"), "salt", F.lit(1).alias("head"))
        heads = salted.select(F.col("b").alias("class"), F.col("b").alias("to"), "salt", F.lit(0).alias("head")).distinct()
        wanted = cut(tails.unionByName(heads).join(classes.select("class", F.col("class_id").alias("id")), "class"))
        # few of them: the texts stay where they are
        sent = texts.join(to_all_if_few(wanted), "id").select("class", "to", "salt", "head", "text")
        sent = sent.mapInArrow(_sent_rows(plan, clash), "to long, salt long, head int, class long, shingles binary")
        sent = sent.repartition("to", "salt").sortWithinPartitions("to", "salt", "head")
        return cut(sent.mapInArrow(_verified(plan), "a long, b long").distinct())

    # Rounds of stars. In each, a list's classes look at one of its own, the same for most lists that they share, and each class
    # is verified against the nearest by parity that another component holds. First it is the class with the most shared tokens, as
    # copies share fewer the more they were changed; later a few are drawn.
    now = shared.withColumn("component", F.col("class"))
    links, turn, asked = None, 0, 0
    left, places = _left(now)
    while left > places:
        order = (F.xxhash64("class", F.pmod("token", F.lit(PICKS)), F.lit(turn)) if turn else -F.col("met")).alias("order")
        picks = now.groupBy("token").agg(F.min(F.struct(order, "class", "component", "n", *BITS)).alias("pick"))
        picks = picks.select("token", F.col("pick.class").alias("b"), F.col("pick.n").alias("nb"), *(F.col(f"pick.{c}").alias(f"b{c}") for c in BITS), F.col("pick.component").alias("of_b"))
        star = _side(now, "a", F.col("token"), F.col("component").alias("of_a")).join(picks, "token").where(F.col("of_a") != F.col("of_b")).where(may_link(plan))
        star = cut(star.select("a", "b", differing().alias("near")).groupBy("a").agg(F.min_by("b", F.struct("near", "b")).alias("b")))
        last, asked = asked, star.count()
        if 4 * asked < 3 * last or not asked:
            break
        found = verified(star)
        links = found if links is None else links.unionByName(found)
        united = cut(components(links))
        now = cut(shared.join(to_all_if_few(united.withColumnRenamed("node", "class")), "class", "left").withColumn("component", F.coalesce("component", "class")))
        before, left, turn = left, _left(now)[0], turn + 1
        if 2 * left > before:
            break

    # a: the larger set of a pair
    one = _side(now, "a", F.col("token"), F.col("weight"), F.col("ask").alias("ask_a"), F.col("place").alias("place_a"), F.col("component").alias("of_a"))
    two = _side(now, "b", F.col("token").alias("token_b"), F.col("ask").alias("ask_b"), F.col("place").alias("place_b"), F.col("component").alias("of_b")).where(may_lead(plan))
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    pairs = (
        one.join(two, (F.col("token") == F.col("token_b")) & (F.col("of_a") != F.col("of_b")) & larger & may_match(plan) & may_link(plan))
        .groupBy("a", "b")
        .agg(F.sum("weight").alias("matches"), F.first(F.least("ask_a", "ask_b")).alias("ask"))
        .where("matches >= ask")
        .select("a", "b")
    )
    more = verified(pairs)
    least = components(more if links is None else links.unionByName(more)).withColumnRenamed("node", "class")
    named = classes.select("class", "class_id", "n").join(least, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(smallest, "component").select("class", "class_id", "component_id")
    out = rows.select("id", "n", "class").join(named, "class")
    own = F.col("n") == 0
    return out.select(
        public_id("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(own, public_id("id")).otherwise(public_id("class_id")).alias("class_id"),
        F.when(own, public_id("id")).otherwise(public_id("component_id")).alias("component_id"),
    )
