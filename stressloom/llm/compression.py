"""Sizes of texts under zstandard with raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard


def middle(text: str, piece: int) -> bytes:
    """The middle `piece` bytes of a text."""
    data = text.encode()
    start = max(0, (len(data) - piece) // 2)
    return data[start : start + piece]


def pieces(piece: int, prepare: Callable[[str], str] = str):
    """Rows with a text to the same rows with its prepared middle instead, so that no more than that comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            parts = pa.array([middle(prepare(t), piece) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.record_batch([parts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return run


def dictionary(parts: list[bytes], size: int) -> bytes:
    """Raw content from parts, up to size bytes. Later content is nearer to the text and cheaper
    to refer to, so the first parts stand last."""
    kept, held = [], 0
    for part in parts:
        if held + len(part) > size:
            break
        kept.append(part)
        held += len(part)
    return b"\n".join(reversed(kept))


class Sizes:
    """Compressed sizes of whole texts, by one dictionary each. A text is cut into chunks, each compressed on its own, so
    that long texts lean on the dictionary as much as short ones."""

    def __init__(self, dictionaries: list[bytes], level: int = 3, chunk: int = 2048) -> None:
        self.chunk = chunk
        self.compressors = []
        for data in dictionaries:
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def of(self, text: bytes) -> np.ndarray:
        out = np.zeros(len(self.compressors), dtype=np.int64)
        for i, c in enumerate(self.compressors):
            compress = c.compress
            out[i] = sum([len(compress(text[a : a + self.chunk])) for a in range(0, len(text), self.chunk)])
        return out
