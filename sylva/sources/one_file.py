"""One CSV file for a table, as a Python data source: format 'csv_file', option path.

Tasks write their rows beside the target, each attempt to a file of its own. Only when all have succeeded does the commit
put the parts of the successful attempts together, in the order of partitions, behind a byte order mark and the header, and
then names the file; a failed write leaves nothing. Bytes stream through the commit, a few at a time. The path is in a
folder that driver and executors share, or an address that pyarrow's file systems know.
"""

from __future__ import annotations

import csv
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

BOM = "﻿".encode()


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def _lines(rows: Iterator[Any]) -> Iterator[bytes]:
    """Rows with all fields quoted, null as NULL."""
    held = io.StringIO()
    out = csv.writer(held, quoting=csv.QUOTE_ALL, lineterminator="\n")
    for row in rows:
        out.writerow(["NULL" if v is None else v for v in row])
        if held.tell() > 1 << 20:
            yield held.getvalue().encode()
            held.seek(0)
            held.truncate()
    yield held.getvalue().encode()


class CsvFileWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        at = TaskContext.get()
        system, folder = _system(self.parts)
        system.create_dir(folder)
        path = f"{folder}/{at.partitionId()}-{at.taskAttemptId()}"
        with system.open_output_stream(path) as f:
            for piece in _lines(iterator):
                f.write(piece)
        return _Part(at.partitionId(), path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _system(self.parts)
        system.create_dir(folder)
        with system.open_output_stream(f"{folder}/whole") as out:
            out.write(BOM)
            for piece in _lines(iter([self.names])):
                out.write(piece)
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with system.open_input_stream(m.path) as part:
                    while piece := part.read(1 << 20):
                        out.write(piece)
        _, target = _system(self.path)
        system.move(f"{folder}/whole", target)
        system.delete_dir(folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _system(self.parts)
        if system.get_file_info(folder).type != pafs.FileType.NotFound:
            system.delete_dir(folder)


class CsvFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CsvFileWriter(self.options["path"], [f.name for f in schema.fields])


def write_csv_file(df: DataFrame, path: str) -> None:
    """df as the one file path, which is replaced if it exists."""
    from pyspark import cloudpickle

    import sylva.sources.one_file as own

    cloudpickle.register_pickle_by_value(own)
    df.sparkSession.dataSource.register(CsvFile)
    df.write.format("csv_file").mode("append").option("path", path).save()
