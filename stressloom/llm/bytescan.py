"""Vectorised scans over Arrow string columns: byte spans, words, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPREAD = _U(0xD6E8FEB86659FD93)

_is_space = np.zeros(256, dtype=bool)
_is_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_letters = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_folded = _letters.copy()
_folded[ord("A") : ord("Z") + 1] = _letters[ord("a") : ord("z") + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> _U(32))
    h *= _SPREAD
    h ^= h >> _U(29)
    h *= _SPREAD
    h ^= h >> _U(32)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about limit bytes: first row, end row, their bytes, their offsets."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, hashes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Start and end byte of each word, its 64-bit hash, and n + 1 offsets of the rows' words."""
    inside = ~_is_space[data]
    edge = inside.copy()
    if len(data):
        edge[1:] &= ~inside[:-1]
        firsts = offsets[:-1][(offsets[:-1] < len(data))]
        edge[firsts] = inside[firsts]
    start = np.flatnonzero(edge)
    final = inside.copy()
    if len(data):
        final[:-1] &= ~inside[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        final[lasts] = inside[lasts]
    end = np.flatnonzero(final) + 1
    of_rows = np.searchsorted(start, offsets)
    if not hashes:
        return start, end, None, of_rows
    if not len(start):
        return start, end, np.zeros(0, np.uint64), of_rows
    length = end - start
    at = np.arange(len(data), dtype=np.int64)
    begun = np.zeros(len(data), dtype=np.int64)
    begun[start] = start
    np.maximum.accumulate(begun, out=begun)
    at -= begun
    powers = np.full(int(length.max()) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    value = (_folded if fold else _letters)[data] * powers[np.minimum(at, len(powers) - 1)]
    value[~inside] = 0
    h = mix(np.add.reduceat(value, start) ^ (length.astype(np.uint64) * _SPREAD))
    return start, end, h, of_rows


def grams(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k tokens; k is a power of two."""
    h, m, p = tokens, 1, _BASE
    while m < k:
        h = h[:-m] * _U(p) + h[m:] if len(h) > m else h[:0]
        m, p = m * 2, p * p % 2**64
    return mix(h)


def letters(data: np.ndarray) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return _letters[data]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x)
    if n < w:
        return x[:0]
    rows = -(-n // w)
    y = np.full(rows * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    y[:n] = x
    y = y.reshape(rows, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


_PLACE_BITS = 24


def anchors(tokens: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Cover every window of each row by an anchor that its content alone decides: the k-gram
    of least hash in the window, the leftmost of equals.

    Returns, for each run of neighbouring windows with one anchor: row, hash, place of the
    anchor, first window and number of windows, with places counted from the row's start.
    Windows with equal content get anchors of equal hash at equal distance.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(tokens) < window:
        return none
    parts: list[tuple[np.ndarray, ...]] = []
    step = 1 << (_PLACE_BITS - 1)
    for base in range(0, max(1, len(tokens) - window + 1), step):
        piece = tokens[base : base + step + window - 1]
        h = grams(piece, k)
        order = (h >> _U(_PLACE_BITS)) << _U(_PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        least = (sliding_min(order, window - k + 1) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        s = np.arange(len(least), dtype=np.int64) + base
        row = np.searchsorted(offsets, s, side="right") - 1
        good = s + window <= offsets[row + 1]
        s, p, row = s[good], least[good], row[good]
        if not len(s):
            continue
        cuts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (row[1:] != row[:-1])])
        size = np.diff(np.r_[cuts, len(s)])
        own = row[cuts]
        parts.append((own, h[p[cuts]], p[cuts] + base - offsets[own], s[cuts] - offsets[own], size))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
