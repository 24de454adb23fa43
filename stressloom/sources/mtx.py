"""MatrixMarket files as a Spark data source, `spark.read.format("mtx")`, read in byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_entry = re.compile(rb"0*[1-9]\d*\s+0*[1-9]\d*(\s|$)")
_AT_ONCE = 8 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """The file, or those of a folder by name, but for hidden ones, with their sizes."""
    files, at = located(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type != fs.FileType.Directory:
        return [(at, info.size)]
    found = files.get_file_info(fs.FileSelector(at))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[:1] not in "._" and x.size)


def _is_body(line: bytes) -> bool:
    line = line.strip()
    return bool(line) and not line.startswith(b"%")


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class MtxReader(DataSourceReader):
    """Finds the size line once; partitions are byte ranges of what comes after it, and a range owns the lines that begin in it."""

    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"], int(options.get("bytes", str(32 << 20)))
        self.base = located(self.path)

    def partitions(self) -> list[InputPartition]:
        files, _ = self.base
        found, out, headed = _files(self.path), [], False
        for path, size in found:
            begin = 0
            if not headed:
                with files.open_input_stream(path) as stream:
                    text, read = b"", True
                    while not headed and read:
                        read = stream.read(1 << 16)
                        text += read
                        at = 0
                        while not headed and ((end := text.find(b"\n", at)) >= 0 or not read):
                            line = text[at : end if end >= 0 else len(text)]
                            at = end + 1 if end >= 0 else len(text)
                            headed = _is_body(line)
                            if end < 0:
                                break
                        begin, text = begin + at, text[at:]
                if not headed:
                    continue
            out += [Range(path, a, min(a + self.bytes, size)) for a in range(begin, size, self.bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = self.base
        with files.open_input_file(partition.path) as stream:
            at = partition.begin
            # a line that begins before the range is another's: skip to the first that begins here
            if at:
                stream.seek(at - 1)
                while (c := stream.read(1 << 12)) and (end := c.find(b"\n")) < 0:
                    at += len(c)
                at = at + end if c else partition.end
            size, rest = stream.size(), b""
            while at < partition.end or rest:
                stream.seek(at)
                text = stream.read(min(_AT_ONCE, max(partition.end - at, 1 << 12)))
                at += len(text)
                text = rest + text
                if at >= partition.end and at < size:
                    # the last line may reach beyond the range; later lines in what was read are another's
                    begin = max(0, len(text) - (at - partition.end) - 1)
                    end = text.find(b"\n", begin)
                    text, rest = (text, text) if end < 0 else (text[: end + 1], b"")
                    if rest:
                        continue
                elif at < size:
                    end = text.rfind(b"\n") + 1
                    text, rest = text[:end], text[end:]
                else:
                    begin = max(0, len(text) - (at - partition.end) - 1)
                    end = text.find(b"\n", begin) if at > partition.end else -1
                    text, rest = text if end < 0 else text[: end + 1], b""
                yield from self._parsed(text)
                if at >= partition.end and not rest:
                    return

    @staticmethod
    def _parsed(text: bytes) -> Iterator[pa.RecordBatch]:
        found = []
        for line in text.split(b"\n"):
            line = line.strip()
            if not line or line.startswith(b"%"):
                continue
            if not _entry.match(line):
                raise ValueError(f"not an entry: {line.decode(errors='replace')}")
            found.append(line.split(None, 2)[:2])
        if found:
            ends = np.array(found).astype(np.int64) - 1
            ends = ends[ends[:, 0] != ends[:, 1]]
            yield pa.record_batch([pa.array(np.ascontiguousarray(ends[:, i])) for i in (0, 1)], ["src", "dst"])


class MtxSource(DataSource):
    """0-based edges (src, dst) of a MatrixMarket file, or of a folder whose files in order are one; loops dropped, values ignored. Option bytes: how long a range is."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "src long, dst long"

    def reader(self, schema) -> DataSourceReader:
        return MtxReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MtxSource)
