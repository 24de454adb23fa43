"""Suffix order of a block of text, and the two indexes built on it."""

from __future__ import annotations

import numpy as np


def suffix_order(first: np.ndarray, depth: int) -> np.ndarray:
    """Sort all suffixes by prefix doubling. first orders them by depth symbols, with zeros beyond
    the end; only the groups still tied are sorted again, by the ranks depth, 2 * depth, ...
    further on. Symbols are from 1; a 0 parts segments, and no two stand side by side."""
    n = len(first)
    order = np.argsort(first, kind="stable").astype(np.int32)
    value = first[order]
    head = np.r_[True, value[1:] != value[:-1]] if n else np.zeros(0, bool)
    del value
    starts = np.flatnonzero(head)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    tied = np.flatnonzero(~(head & np.r_[head[1:], True])) if n else starts
    while len(tied) and depth <= n:
        s = order[tied].astype(np.int64)
        beyond = s + depth
        inside = beyond < n
        key = rank[s] << 32
        key[inside] |= rank[beyond[inside]] + 1
        by = np.argsort(key)
        key, s = key[by], s[by]
        order[tied] = s
        head = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(head)
        rank[s] = np.repeat(tied[starts], np.diff(np.r_[starts, len(s)]))
        tied = tied[~(head & np.r_[head[1:], True])]
        depth *= 2
    return order


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The next eight bytes at each place, as a number in their order; zeros beyond the end."""
    padded = np.zeros(len(text) + 8, dtype=np.uint64)
    padded[: len(text)] = text
    value = padded[: len(text)].copy()
    for i in range(1, 8):
        value <<= np.uint64(8)
        value |= padded[i : i + len(text)]
    return value


def common_bytes(ahead: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, eight bytes at a time."""
    n = len(ahead)
    out = np.zeros(len(a), dtype=np.int64)
    left = np.arange(len(a))
    a, b = a.astype(np.int64), b.astype(np.int64)
    most = n - np.maximum(a, b)
    while len(left):
        inside = (a < n) & (b < n)
        left, a, b = left[inside], a[inside], b[inside]
        if not len(left):
            break
        differ = ahead[a] ^ ahead[b]
        same = differ == 0
        rest = differ[~same]
        lead = np.zeros(len(rest), dtype=np.int64)
        for i in range(7, 0, -1):
            lead += (rest >> np.uint64(8 * i)) == 0
        out[left[~same]] += lead
        out[left[same]] += 8
        left, a, b = left[same], a[same] + 8, b[same] + 8
    return np.minimum(out, most)


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform with sampled run ends.

    Kept per run: its byte, its length, and at its two ends a text place with the place of the suffix across the border
    and the length of the prefix shared with it. Inside a run the neighbour of the next place in the text is
    the place next to the neighbour, and the shared length is one less, so the samples give neighbours and matching statistics everywhere.
    """

    def __init__(self, text: np.ndarray) -> None:
        n = self.n = len(text)
        ahead = eight_bytes(text)
        order = suffix_order(ahead, 8)
        before = np.where(order > 0, text[order - 1].astype(np.int16), np.int16(-1))
        heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]]) if n else np.zeros(0, np.int64)
        #: The transform: its runs.
        self.run_byte = before[heads]
        self.run_length = np.diff(np.r_[heads, n])
        inner = heads[1:]
        shared = common_bytes(ahead, order[inner - 1], order[inner])
        #: At the head of a run: the suffix before it. At its end: the one after.
        self.head_place = order[heads]
        self.head_shared = np.r_[0, shared].astype(np.int32) if n else shared
        self.end_place = order[np.r_[inner - 1, n - 1]] if n else order
        self.end_shared = np.r_[shared, 0].astype(np.int32) if n else shared

    def transform(self) -> np.ndarray:
        """The byte before each suffix in their order, -1 for the whole text."""
        return np.repeat(self.run_byte, self.run_length)

    def _stream(self, place: np.ndarray, shared: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Shared length at each place in text order, and the neighbour if asked for."""
        at = np.zeros(self.n, dtype=np.int32)
        at[place] = place
        np.maximum.accumulate(at, out=at)
        value = np.zeros(self.n, dtype=np.int32)
        value[place] = shared
        on = np.arange(self.n, dtype=np.int32) - at
        length = value[at] - on
        if near is None:
            return length, None
        value[place] = near
        return length, value[at] + on

    def matching_statistics(self) -> np.ndarray:
        """For each place in text order, the longest prefix of what follows that also starts elsewhere."""
        if not self.n:
            return np.zeros(0, np.int32)
        return np.maximum(self._stream(self.head_place, self.head_shared)[0], self._stream(self.end_place, self.end_shared)[0])

    def earlier(self, window: int) -> np.ndarray:
        """For each place, whether the `window` bytes that start there also start at an earlier place. Suffixes that share them are
        neighbours in a row; the least place of a row is found by doubling the steps along it, both ways."""
        place = np.arange(self.n, dtype=np.int32)
        least = place.copy()
        if not self.n:
            return least < place
        ways = ((self.head_place, self.head_shared, np.r_[self.head_place[:1], self.end_place[:-1]]), (self.end_place, self.end_shared, np.r_[self.head_place[1:], self.end_place[-1:]]))
        for own, shared, near in ways:
            length, step = self._stream(own, shared, near)
            step = np.where(length >= window, step, place)
            m = place.copy()
            live = np.flatnonzero(step != place)
            while len(live):
                to = step[live]
                # all read before any is written, so that a step covers twice as much as the one before
                near_m, further = m[to], step[to]
                m[live] = np.minimum(m[live], near_m)
                moved = further != to
                step[live] = further
                live = live[moved]
            np.minimum(least, m, out=least)
        return least < place


class Bits:
    """A bit vector, 64 to a word, with the number of ones before each word in 32 bits: 1.5 bits a place."""

    def __init__(self, bit: np.ndarray) -> None:
        packed = np.packbits(bit, bitorder="little")
        self.words = np.zeros(len(bit) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, end: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        word = end >> 6
        inside = self.words[word] & ((np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class WaveletTree:
    """Bit planes of a symbol sequence, each stably split by the bit above."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.planes = bits, []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.planes.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the prefix up to end lands among the sorted occurrences of each symbol."""
        at = end.astype(np.int64)
        for level, (plane, zeros) in zip(range(self.bits - 1, -1, -1), self.planes, strict=True):
            ones = plane.rank(at)
            at = np.where(symbol >> level & 1 == 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search over the Burrows-Wheeler transform held in a wavelet tree.

    text holds symbols from 1 and 0 between segments. For windows of `window` symbols it keeps the intervals of
    suffixes that share that many symbols, as a bit at the head of each, and the first place among them. The suffix order itself isn't kept.
    """

    def __init__(self, text: np.ndarray, window: int) -> None:
        n = len(text)
        self.window = window
        text = text.astype(np.int64)
        pair = text << 32
        pair[:-1] |= text[1:]
        order = suffix_order(pair, 2)
        sigma = int(text.max()) + 1 if n else 1
        before = text[order - 1]  # the symbol before place 0 is the last one: the text is read as a circle
        self.tree = WaveletTree(before, max(1, int(sigma - 1).bit_length()))
        every = np.arange(sigma)
        self.landing = self.tree.rank(every, np.zeros(sigma, np.int64))
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))[:-1]]
        linked = np.arange(1, n)
        for t in range(window):
            a, b = order[linked - 1].astype(np.int64) + t, order[linked].astype(np.int64) + t
            inside = (a < n) & (b < n)
            linked, a, b = linked[inside], a[inside], b[inside]
            linked = linked[text[a] == text[b]]
        head = np.ones(n, dtype=bool)
        head[linked] = False
        starts = np.flatnonzero(head)
        self.heads = Bits(head)
        self.bounds = np.r_[starts, n].astype(np.int32)
        self.earliest = np.minimum.reduceat(order, starts) if n else order

    def interval(self, place: np.ndarray) -> np.ndarray:
        """The number of the interval that holds a place of the suffix order."""
        return self.heads.rank(place + 1) - 1

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the interval of symbol + what [low, high) stands for."""
        base = self.below[symbol] - self.landing[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def stream(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read segments [start, end) backwards, all in step. At each place with a whole window
        ahead: how many suffixes share the window, and the first place where it stands."""
        count = np.zeros(len(text), dtype=np.int64)
        first = np.zeros(len(text), dtype=np.int64)
        if not len(start):
            return count, first
        by = np.argsort(start - end, kind="stable")
        start, end = start[by], end[by]
        length = end - start
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(text), np.int64)
        for t in range(int(length[0])):
            live = int(np.searchsorted(-length, -t, side="left"))
            low, high = low[:live], high[:live]
            at = end[:live] - 1 - t
            low, high = self.extend(text[at].astype(np.int64), low, high)
            if t + 1 >= self.window:
                # one symbol more than the window was matched at most: widen to the window's interval
                own = self.interval(low)
                low, high = self.bounds[own].astype(np.int64), self.bounds[own + 1].astype(np.int64)
                count[at] = high - low
                first[at] = self.earliest[own]
        return count, first
