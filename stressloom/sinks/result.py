"""Result files as a Spark data source, `df.write.format("stress_result")`: tasks write ranges of lines, and the commit joins them in order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.mtx import located
from . import result_rows


@dataclass
class Part(WriterCommitMessage):
    """A task's file, and the (section, ordinal) that it begins with; no file if the task had no lines."""

    path: str
    first: tuple[int, int]


class ResultWriter(DataSourceArrowWriter):
    """Rows (section, ordinal, line), each task's in order and tasks apart by ranges, to one text file. The file appears at the commit, all of it or nothing."""

    def __init__(self, path: str, overwrite: bool):
        files, self.path = located(path)
        if not overwrite and files.get_file_info(self.path).type.name != "NotFound":
            raise FileExistsError(path)
        self.uri = path
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, _ = located(self.uri)
        at = TaskContext.get()
        path = f"{self.parts}/{at.partitionId()}-{at.taskAttemptId()}"
        stream, first = None, (0, 0)
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if stream is None:
                    files.create_dir(self.parts, recursive=True)
                    stream, first = files.open_output_stream(path), (batch.column("section")[0].as_py(), batch.column("ordinal")[0].as_py())
                stream.write("".join(f"{line}\n" for line in batch.column("line").to_pylist()).encode())
        finally:
            if stream is not None:
                stream.close()
        return Part(path if stream is not None else "", first)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = located(self.uri)
        whole = f"{self.parts}.whole"
        if "/" in whole:
            files.create_dir(whole.rpartition("/")[0], recursive=True)
        with files.open_output_stream(whole) as out:
            for part in sorted((m for m in messages if m is not None and m.path), key=lambda m: m.first):
                with files.open_input_stream(part.path) as stream:
                    while text := stream.read(4 << 20):
                        out.write(text)
        files.move(whole, self.path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = located(self.uri)
        if files.get_file_info(self.parts).type.name != "NotFound":
            files.delete_dir(self.parts)


class ResultFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stress_result"

    def schema(self) -> str:
        return "section int, ordinal long, line string"

    def writer(self, schema, overwrite: bool) -> ResultWriter:
        return ResultWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultFile)


def save_result(edges: DataFrame, positions: DataFrame, path: str, title: str, stamp: str | None = None) -> None:
    """The file that write_result writes, by tasks: lines are dealt by ranges, and the driver copies parts, a few MB at a time."""
    register(edges.sparkSession)
    rows = result_rows(edges, positions, title, stamp or f"{datetime.now():%Y-%m-%d %H:%M:%S}")
    ordered = rows.repartitionByRange("section", "ordinal").sortWithinPartitions("section", "ordinal")
    ordered.write.format("stress_result").mode("overwrite").save(path)
