"""Benchmark decontamination by the q-gram lemma (operator 7).

A passage within k edits of an item of m characters shares at least m - q + 1 - k * q of its q-grams, and these lie on
diagonals (place in the text less place in the item) at most k apart. Shared q-grams are counted in bands of
diagonals, 2 * (k + 1) wide and overlapping by half; bands that reach the bound are verified by banded alignment.
Items too short for that are found as they stand, as whole words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytescan as scan
from .shared import cut, internal_id, public_id, small_batches

_FILTER_BITS = 22
#: Diagonals whose bands are counted at once, and entries of the index that are read at once.
_SLICE, _ENTRIES = 1 << 16, 1 << 20


def normal(text: str | None) -> str:
    """Lower case, with one space for each run of white space, none at the ends."""
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    tokens = scan.mix(chars.astype(np.uint64) + np.uint64(1))
    h = tokens[: len(tokens) - q + 1].copy() if len(tokens) >= q else tokens[:0]
    for i in range(1, q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += tokens[i : len(tokens) - q + 1 + i]
    return scan.mix(h)


class ItemIndex:
    """Postings of the q-grams of benchmark items, and an automaton of the short ones."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, shortest: int) -> None:
        self.q = q
        self.ids, self.texts, self.short = [], [], None
        few = max(q, shortest)
        brief: dict[str, list[int]] = {}
        for i, text in items:
            text = normal(text)
            if len(text) >= few:
                self.ids.append(i)
                self.texts.append(codes(text))
            elif text:
                brief.setdefault(text, []).append(i)
        if brief:
            import ahocorasick

            self.short = ahocorasick.Automaton()
            for text, ids in brief.items():
                self.short.add_word(text, (len(text), ids))
            self.short.make_automaton()
        self.size = np.array([len(x) for x in self.texts], dtype=np.int64)
        #: The edits allowed; fewer where the lemma would ask for no shared q-gram.
        self.edits = np.minimum((self.size * rate).astype(np.int64), (self.size - q) // q) if len(self.size) else self.size
        self.bound = self.size - q + 1 - self.edits * q
        self.reach = int((self.size + 2 * self.edits + 2).max()) if len(self.size) else 0
        hashes = [gram_hashes(x, q) for x in self.texts]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])
        place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in hashes]) if hashes else owner
        by = np.argsort(h, kind="stable")
        self.owner, self.place = owner[by], place[by]
        self.gram, self.first, self.count = np.unique(h[by], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(self.gram >> np.uint64(64 - _FILTER_BITS)).view(np.int64)] = True

    def exact(self, text: str) -> dict[int, tuple[int, int]]:
        """Short items that stand in a normalised text with no letter or digit beside them: (length, first end) by item."""
        found: dict[int, tuple[int, int]] = {}
        for last, (n, ids) in self.short.iter(text) if self.short is not None and text else ():
            a, b = last - n + 1, last + 1
            if (a == 0 or not (text[a].isalnum() and text[a - 1].isalnum())) and (b == len(text) or not (text[last].isalnum() and text[b].isalnum())):
                for i in ids:
                    found.setdefault(i, (n, b))
        return found

    def _tally(self, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and their q-grams to bands (item and number, as one key) and how many places share a q-gram in each."""
        n = self.count[found]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(self.first[found], n) + step
        item, at = self.owner[entry].astype(np.int64), np.repeat(at, n)
        # band b holds the diagonals from b * half to (b + 2) * half - 1
        band = (at - self.place[entry]) // (self.edits[item] + 1)
        key = item << 32 | (band + (1 << 31))
        key, at = np.r_[key, key - 1], np.r_[at, at]
        by = np.lexsort((at, key))
        key, at = key[by], at[by]
        head = np.r_[True, key[1:] != key[:-1]]
        new = head | np.r_[True, at[1:] != at[:-1]]
        heads = np.flatnonzero(head)
        return key[heads], np.add.reduceat(new.astype(np.int64), heads)

    def candidates(self, chars: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Item and the least and greatest diagonal of each band that reaches its bound. Long texts are read in slices of
        diagonals, and a slice in pieces of entries, so that common q-grams of long texts don't add up."""
        if not len(self.gram) or len(chars) < self.q:
            return
        h = gram_hashes(chars, self.q)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).view(np.int64)])
        found = np.searchsorted(self.gram, h[at])
        found[found == len(self.gram)] = 0
        good = self.gram[found] == h[at]
        at, found = at[good], found[good]
        slices = -(-len(chars) // _SLICE)
        for k in range(slices):
            a, b = np.searchsorted(at, [k * _SLICE, (k + 1) * _SLICE + self.reach])
            if a == b:
                continue
            read = np.cumsum(self.count[found[a:b]])
            cuts = [a, *(a + np.flatnonzero(np.diff(read // _ENTRIES)) + 1).tolist(), b]
            parts = [self._tally(at[x:y], found[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            key, shared = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(parts) > 1:
                key, to = np.unique(key, return_inverse=True)
                shared = np.bincount(to, weights=shared).astype(np.int64)
            item = key >> 32
            half = self.edits[item] + 1
            low = ((key & 0xFFFFFFFF) - (1 << 31)) * half
            enough = shared >= self.bound[item]
            if k:
                enough &= low >= k * _SLICE
            if k < slices - 1:
                enough &= low < (k + 1) * _SLICE
            yield from zip(item[enough].tolist(), low[enough].tolist(), (low + 2 * half - 1)[enough].tolist(), strict=True)


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """Fewest edits, if at most `most`, between item and any part of text that begins on a diagonal from low to
    high; and where the part ends. Only diagonals from low - most to high + most are filled."""
    first = low - most
    width = high + most - first + 1
    far = np.int64(1 << 30)
    ramp = np.arange(width, dtype=np.int64)
    row = np.where((ramp + first >= low) & (ramp + first <= high) & (ramp + first >= 0) & (ramp + first <= len(text)), 0, far)
    padded = np.full(width + len(item) + 1, np.iinfo(np.uint32).max, dtype=np.uint32)
    a, b = max(0, first), min(len(text), first + width + len(item))
    if a < b:
        padded[a - first : b - first] = text[a:b]
    for i in range(len(item)):
        # cell d of row i: item[:i] against text that ends before place first + d + i
        cost = row + (padded[i : i + width] != item[i])
        cost[:-1] = np.minimum(cost[:-1], row[1:] + 1)
        row = np.minimum.accumulate(cost - ramp) + ramp
        if row.min() > most:
            return None
    ends = ramp + first + len(item)
    row = np.where((ends >= 0) & (ends <= len(text)), row, far)
    best = int(row.argmin())
    return (int(row[best]), int(ends[best])) if row[best] <= most else None


_known: dict[str, ItemIndex] = {}


def _index(shared) -> ItemIndex:
    """The index of a block of items, built once in each Python worker."""
    name, *rest = shared.value
    if name not in _known:
        _known.clear()
        _known[name] = ItemIndex(*rest)
    return _known[name]


def _found(own: ItemIndex, text: str | None) -> Iterator[tuple[int, int, int, int]]:
    """(item_id, edits, end, item_chars) of every item in a text; an item may come again with more edits."""
    text = normal(text)
    for i, (n, end) in sorted(own.exact(text).items()):
        yield i, 0, end, n
    chars = codes(text)
    for item, low, high in own.candidates(chars):
        found = banded_edits(own.texts[item], chars, low, high, int(own.edits[item]))
        if found is not None:
            yield own.ids[item], *found, int(own.size[item])


def _leaks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _index(shared)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                best: dict[int, tuple[int, int, int]] = {}
                for item, *found in _found(own, text):
                    best[item] = min(best.get(item, (1 << 62,)), tuple(found))
                out += [(doc, item, *found) for item, found in sorted(best.items())]
            if out:
                yield pa.record_batch([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], ["id", "item_id", "edits", "end", "item_chars"])

    return run


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _index(shared)
        for batch in batches:
            clean = [next(_found(own, text), None) is None for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, q: int, rate: float, shortest: int, block_bytes: int) -> Iterator[tuple[object, bool]]:
    """Broadcasts of the items, about block_bytes of them each and one at a time, with whether more follow."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text")
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["item_id"], r["text"]) for r in own.collect()], q, rate, shortest)), blocks > 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.06, shortest: int = 24, block_bytes: int = 8 << 20) -> DataFrame:
    """Benchmark items that stand in documents with few edits.

    docs (doc_id, text), benchmark (item_id, text). Returns doc_id, item_id, edits (fewest), ends (places in the normalised text after a part
    with that many), item_chars; one row per document and item within floor(rate * item_chars) edits (fewer for items so short
    that the lemma would need no shared q-gram). Texts are compared whole, in lower case and with white space runs as one space; very long
    ones are read in slices. Items under `shortest` normalised characters (or under q) are found without edits, where no letter or digit
    continues them.

    Null or empty texts match nothing. Null item_id: the item isn't searched. Null
    doc_id: a document like others. Repeated rows of docs give repeated rows; of benchmark, one; an item_id with several texts counts as found by any. Other columns are ignored. Empty tables give
    an empty result. The items go to every task in blocks of about block_bytes, one pass over docs each; with more than one, each pass is written before
    the next begins, so that the driver holds one block.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(internal_id("doc_id").alias("id"), "text")
    parts = []
    for shared, more in _blocks(benchmark, q, rate, shortest, block_bytes):
        part = texts.mapInArrow(_leaks(shared), "id long, item_id long, edits long, end long, item_chars long")
        parts.append(cut(part) if more else part)
        if more:
            shared.destroy()
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select(public_id("id").alias("doc_id"), "item_id", "edits", F.col("end").alias("ends"), "item_chars")


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.06, shortest: int = 24, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with all their columns, in which find_leaks finds no item. Each row is judged by its own text, whatever its doc_id; repeated
    rows stay or go together. Rows with a null or empty text stay. Empty docs give an empty result, an empty benchmark all rows."""
    small_batches(docs.sparkSession)
    for shared, more in _blocks(benchmark, q, rate, shortest, block_bytes):
        docs = docs.mapInArrow(_clean(shared), docs.schema)
        if more:
            docs = cut(docs)
            shared.destroy()
    return docs
