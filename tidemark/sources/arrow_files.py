"""Arrow (feather) files as a data source of Spark: one file for each symbol, one partition a file, read in batches of records.

``spark.dataSource.register(ArrowFiles)`` makes ``spark.read.format("arrow_files")`` known, with the options ``path`` (a folder), ``pattern`` (a regular
expression whose first group is the symbol in a file's name) and ``suffix``. Filters on ``symbol`` that compare with a value or a list leave out files unread.
Writing gives each task's rows of each symbol a file of its own, which is moved to its final name when the job commits; what a lost task wrote is deleted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

COLUMNS = "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double"


def _filesystem(uri: str):
    from pyarrow import fs

    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


@dataclass
class File(InputPartition):
    path: str
    symbol: str


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.schema = options["path"], schema
        self.pattern, self.suffix = options.get("pattern", r"^([A-Z0-9]+)_USDT"), options.get("suffix", ".feather")
        self.wanted: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = found if self.wanted is None else self.wanted & found
            else:
                yield f

    def partitions(self) -> list[File]:
        from pyarrow import fs

        system, folder = _filesystem(self.folder)
        found = []
        for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
            named = re.search(self.pattern, info.base_name)
            if info.is_file and info.base_name.endswith(self.suffix) and named and (self.wanted is None or named[1] in self.wanted):
                found.append(File(info.path, named[1]))
        return found or [File("", "")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        target = to_arrow_schema(self.schema)
        with _filesystem(self.folder)[0].open_input_file(partition.path) as file:
            stored = pa.ipc.open_file(file)
            for k in range(stored.num_record_batches):
                batch = stored.get_batch(k)
                columns = []
                for field in target:
                    if field.name == "symbol":
                        columns.append(pa.array([partition.symbol] * batch.num_rows, pa.string()))
                    elif field.name in batch.schema.names:
                        column = batch.column(field.name)
                        if pa.types.is_timestamp(column.type) and column.type.tz:
                            column = column.cast(pa.timestamp("us", "UTC")).cast(pa.timestamp("us"))  # instants as UTC times
                        columns.append(column.cast(field.type))
                    else:
                        columns.append(pa.nulls(batch.num_rows, field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=target)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Rows of each symbol in the order in which the task has them; give all rows of a symbol to one task, in order, for one file a symbol."""

    def __init__(self, options: dict) -> None:
        self.folder, self.suffix = options["path"], options.get("suffix", ".feather")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _filesystem(self.folder)
        system.create_dir(folder, recursive=True)
        open_files, files, token = {}, [], uuid.uuid4().hex
        try:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for symbol in table.column("symbol").unique().to_pylist():
                    own = table.filter(pa.compute.equal(table.column("symbol"), symbol)).drop(["symbol"])
                    if symbol not in open_files:
                        part = f"{folder}/.{symbol}-{token}"
                        sink = system.open_output_stream(part)
                        open_files[symbol] = (sink, pa.ipc.new_file(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")))
                        files.append((part, f"{folder}/{symbol}_USDT-{token}{self.suffix}"))
                    open_files[symbol][1].write_table(own)
        finally:
            for sink, out in open_files.values():
                out.close()
                sink.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _filesystem(self.folder)
        for part, final in [f for m in messages if m for f in m.files]:
            system.move(part, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _filesystem(self.folder)
        for part, _ in [f for m in messages if m for f in m.files]:
            system.delete_file(part)
