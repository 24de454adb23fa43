"""Column functions that Spark and plain SQL compute alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

#: Multiplier and increment of the start positions, by axis.
AXES = {"x": (2654435761, 12345), "y": (2246822519, 6789)}


def hash_position(node: Column, axis: str, seed: int = 0) -> Column:
    """Uniform in [0, 1) by node; the same on any partitioning. Each seed is a draw of its own: 0 by multiples of the fixed values, others by a hash."""
    if seed:
        return F.pmod(F.xxhash64(node.cast("long"), F.lit(axis), F.lit(seed).cast("long")), F.lit(2**32)) / float(2**32)
    a, b = AXES[axis]
    return ((node * a + b) % 2**32) / float(2**32)


def hash_uniform(u: Column, v: Column, seed: int) -> Column:
    """Uniform in [0, 1) by an ordered pair: two steps of a linear congruence modulo 2 to the 31."""
    m = 2**31
    h = (u * 1103515245 + 12345 + seed) % m
    h = ((h + v) * 1103515245 + 12345) % m
    h = ((h % 65536) * 40503 + F.floor(h / 65536) * 30011 + 977) % m
    return h / float(m)


def hash_uniform_of(u: np.ndarray, v: np.ndarray, seed: int) -> np.ndarray:
    """hash_uniform of arrays, times 2 to the 31, as integers."""
    m = 2**31
    h = (u.astype(np.int64) * 1103515245 + 12345 + seed) % m
    h = ((h + v) * 1103515245 + 12345) % m
    return ((h % 65536) * 40503 + h // 65536 * 30011 + 977) % m


def rounded(c: Column, places: int = 6) -> Column:
    """For values that sums made: rounded, without a negative zero."""
    return F.round(c, places) + F.lit(0.0)
