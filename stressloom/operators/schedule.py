"""Learning rates, and schedules in which no node, or block, stands twice in a round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def learning_rates(extremes: DataFrame, iterations: int = 15, epsilon: float = 0.1) -> DataFrame:
    """(t, eta): from 1 / wmin down to epsilon / wmax by equal factors; one iteration takes the first."""
    if iterations < 1:
        raise ValueError("at least one iteration")
    high, low = 1.0 / F.col("wmin"), epsilon / F.col("wmax")
    fall = F.ln(high / low) / float(iterations - 1) if iterations > 1 else F.lit(0.0)
    rows = extremes.where("wmin is not null").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    return rows.select("t", (high * F.exp(-fall * F.col("t"))).alias("eta"))


def round_of(u: Column, v: Column, n: int) -> Column:
    """The round of a pair u < v of 0 .. n - 1: an odd number m of seats gives the pair half of u + v, modulo m; with n even the
    last node has no seat and meets each other node in the round of that node's number."""
    m = n if n % 2 else n - 1
    total = u.cast("long") + v  # below 2 * m; half of an odd one is half of itself plus or minus m
    odd = F.when(total < m, F.shiftright(total + m, 1)).otherwise(F.shiftright(total - m, 1))
    half = F.when(total.bitwiseAND(F.lit(1).cast("long")) == 1, odd).otherwise(F.shiftright(total, 1))
    return half if n % 2 else F.when(v == n - 1, u).otherwise(half)


def pairs_by_blocks(spark: SparkSession, n: int, itself: bool = False, block: int = 4096, strip: int = 256) -> DataFrame:
    """(u, v) longs, u < v, or u <= v with itself: every pair of 0 .. n - 1 once; a task for each two blocks of nodes, and each block with itself.

    The order within a task keeps files small, as there are n^2 / 2 rows: few values a task, so that they go into dictionaries; strips of v, which repeat; and
    each eighth u, so that u + v moves on by 8 places a turn, which is whole bytes at any width in bits. `block` is a multiple of 8 and of `strip`."""
    seats, strips = -(-n // block) | 1, block // strip
    tiles = seats * (seats + 1) // 2  # an odd number of seats: each with those up to half the circle ahead
    at = lambda c, size: F.floor(c / size).cast("long")
    tile, place = at(F.col("id"), block * strips), F.col("id") % block
    seat = tile % seats
    ahead = (seat + at(tile, seats)) % seats
    turn = (place % (block // 8)) * 8 + at(place, block // 8)
    turns = spark.range(0, tiles * strips * block, 1, tiles).select((F.least(seat, ahead) * block + turn).alias("u"), (F.greatest(seat, ahead) * block + at(F.col("id"), block) % strips * strip).alias("start"))
    ranges = turns.select("u", F.greatest("start", F.col("u") + (0 if itself else 1)).alias("low"), F.least(F.col("start") + strip, F.lit(n)).alias("end")).where((F.col("u") < n) & (F.col("low") < F.col("end")))
    # no null occurs, and writers take less time for columns that can't hold one
    return ranges.select(F.coalesce("u", F.lit(0).cast("long")).alias("u"), F.explode(F.sequence("low", F.col("end") - 1)).alias("v"))


def circle_rounds(spark: SparkSession, n: int) -> DataFrame:
    """(round, u, v), u < v: every pair of 0 .. n - 1 once, each node once a round at most."""
    return pairs_by_blocks(spark, n).select(round_of(F.col("u"), F.col("v"), n).cast("int").alias("round"), "u", "v")


def tile_round(bi: Column, bj: Column, blocks: int) -> Column:
    """The round of tile bi <= bj: tiles of two blocks by round_of; after them each block with itself,
    as many a round as there are tiles in a round of two."""
    circle = blocks + blocks % 2 - 1 if blocks > 1 else 0
    return F.when(bi == bj, F.lit(circle) + F.floor(bi / max(1, blocks // 2))).otherwise(round_of(bi, bj, blocks)).cast("int")


def tile_in_round(block: Column, r: int, blocks: int) -> tuple[Column, Column]:
    """The tile (bi, bj) that a block belongs to in round r; one that rests there is alone in (b, b), which then has no pairs."""
    m = blocks + blocks % 2 - 1
    if blocks < 2 or r >= m:
        return block, block
    other = F.pmod(F.lit(2 * r) - block, F.lit(m))
    if blocks % 2 == 0:
        other = F.when(block == blocks - 1, r).when(other == block, blocks - 1).otherwise(other)
    return F.least(block, other.cast("int")), F.greatest(block, other.cast("int"))


def tile_rounds(spark: SparkSession, blocks: int) -> DataFrame:
    """(round, bi, bj), bi <= bj: every tile once, in the round of tile_round."""
    tiles = pairs_by_blocks(spark, blocks, itself=True).select(F.col("u").cast("int").alias("bi"), F.col("v").cast("int").alias("bj"))
    return tiles.select(tile_round(F.col("bi"), F.col("bj"), blocks).alias("round"), "bi", "bj")


def most_tiles(tiles: DataFrame) -> DataFrame:
    """One row: the most tiles that a round has."""
    return tiles.groupBy("round").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most_tiles"))


def tile_shapes(tiles: DataFrame, lengths: DataFrame) -> DataFrame:
    """Tiles with the lengths of both of their blocks: (round, bi, bj, li, lj). There are as many tiles as pairs of blocks, so the lengths, a row a block, go to the tiles."""
    of = lambda c, name: F.broadcast(lengths.select(F.col("b").alias(c), F.col("len").alias(name)))
    return tiles.join(of("bi", "li"), "bi").join(of("bj", "lj"), "bj").select("round", "bi", "bj", "li", "lj")


def block_lengths(spark: SparkSession, n: int, size: int) -> DataFrame:
    """(b, start, len): blocks of `size` nodes, the last one shorter."""
    return spark.range(-(-n // size)).select(F.col("id").cast("int").alias("b"), (F.col("id") * size).alias("start"), F.least(F.lit(size), n - F.col("id") * size).cast("int").alias("len"))


def in_block(node: Column, size: int) -> tuple[Column, Column]:
    """A node's block and its place there."""
    return F.floor(node / size).cast("int").alias("b"), F.pmod(node, F.lit(size)).cast("int").alias("place")
