"""Topics as logs of rows with contiguous offsets, on files, for batch and stream readers.

A log is a folder of segments.  A segment is written by Spark as one range-partitioned, sorted table
of files of about a fixed number of rows; it counts as soon as Spark has marked it complete, so
an attempt that broke off is never read.  The offset of a row is its place: segments by number, files
by name, rows as they are.  Readers take any range of offsets, a task per file.  Streams admit whole
files up to ``maxRowsPerTrigger`` rows (one file at least) per micro-batch, in order.

One writer at a time may append to a log.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "cardflow_log"
# Rows of a file, and so about those of the smallest micro-batch.
FILE_ROWS = 25_000
OFFSET = "log_offset"  # filled with a row's offset if the schema asks for it
_DONE = "_SUCCESS"


def files_of(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; any that pyarrow knows by its URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class LogFile(InputPartition):
    path: str
    base: int  # offset of its first row
    rows: int
    first: int = 0  # rows to read
    last: int = 0

    def cut(self, start: int, end: int) -> LogFile | None:
        first, last = max(start - self.base, 0), min(end - self.base, self.rows)
        return LogFile(self.path, self.base, self.rows, first, last) if first < last else None


class Index:
    """Files of a log in order of offset; segments that are known are not listed again."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = files_of(path)
        self.known: set[str] = set()
        self.files: list[LogFile] = []

    def refresh(self) -> list[LogFile]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        for segment in sorted(i.base_name for i in found if i.base_name.startswith("segment-")):
            if segment in self.known:
                continue
            inside = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{segment}"))
            names = {i.base_name for i in inside}
            if _DONE not in names:
                break  # later segments have later offsets
            for name in sorted(n for n in names if n.endswith(".parquet")):
                path = f"{self.root}/{segment}/{name}"
                rows = pq.read_metadata(path, filesystem=self.fs).num_rows
                if rows:
                    self.files.append(LogFile(path, self.end, rows))
            self.known.add(segment)
        return self.files

    @property
    def end(self) -> int:
        return self.files[-1].base + self.files[-1].rows if self.files else 0


def read_part(root: str, schema: T.StructType, part: LogFile) -> Iterator[pa.RecordBatch]:
    fs, _ = files_of(root)
    wanted = to_arrow_schema(schema)
    columns = [f.name for f in wanted if f.name != OFFSET]
    at = 0
    with pq.ParquetFile(part.path, filesystem=fs) as file:
        for batch in file.iter_batches(batch_size=8192, columns=columns):
            first, last = max(part.first - at, 0), min(part.last - at, batch.num_rows)
            if first < last:
                own = batch.slice(first, last - first)
                arrays = []
                for f in wanted:
                    if f.name == OFFSET:
                        begin = part.base + at + first
                        arrays.append(pa.array(range(begin, begin + last - first), pa.int64()))
                    else:
                        arrays.append(own.column(f.name).cast(f.type, safe=False))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in wanted])
            at += batch.num_rows
            if at >= part.last:
                return


class LogReader(DataSourceReader):
    """Rows with offsets from ``startingOffset`` up to, without, ``endingOffset``."""

    def __init__(self, options: Mapping[str, str], schema: T.StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.start, self.end = int(options.get("startingOffset", 0)), options.get("endingOffset")

    def partitions(self) -> Sequence[InputPartition]:
        index = Index(self.path)
        files = index.refresh()
        end = index.end if self.end is None else int(self.end)
        # No partition at all would be read as one without a range.
        return [p for f in files if (p := f.cut(self.start, end))] or [LogFile("", 0, 0)]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        return read_part(self.path, self.schema, partition) if partition.path else iter(())


class LogStream(DataSourceStreamReader):
    """Offsets as Spark keeps them, ``{"row": n}``; see the module for what a micro-batch admits.

    Spark tells a restarted reader only which ranges to read again, so the end of the last
    planned micro-batch is kept in the file ``position``, which a limited stream needs.
    """

    def __init__(self, options: Mapping[str, str], schema: T.StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.most = int(options["maxRowsPerTrigger"]) if "maxRowsPerTrigger" in options else None
        self.start = int(options.get("startingOffset", 0))
        self.place = options.get("position")
        if self.most is not None and not self.place:
            raise ValueError("maxRowsPerTrigger needs a file for the position")
        self.index = Index(self.path)
        self.planned: int | None = None

    def initialOffset(self) -> dict:
        return {"row": self.start}

    def _position(self) -> int:
        if self.planned is None and self.place:
            fs, path = files_of(self.place)
            if fs.get_file_info(path).type == pafs.FileType.File:
                with fs.open_input_stream(path) as file:
                    self.planned = json.loads(file.read())["row"]
        return self.start if self.planned is None else self.planned

    def latestOffset(self) -> dict:
        files = self.index.refresh()
        if self.most is None:
            return {"row": max(self.index.end, self.start)}
        position = self._position()
        end = position
        for f in files:
            stop = f.base + f.rows
            if stop > position and (end == position or stop <= position + self.most):
                end = stop
        return {"row": end}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.planned = max(end["row"], self._position())
        if self.place:
            fs, path = files_of(self.place)
            with fs.open_output_stream(path) as file:
                file.write(json.dumps({"row": self.planned}).encode())
        files = self.index.refresh()
        return [p for f in files if (p := f.cut(start["row"], end["row"]))] or [LogFile("", 0, 0)]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        return read_part(self.path, self.schema, partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> LogStream:
        return LogStream(self.options, schema)


def use_logs(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LogSource)
    return spark


def append_log(df: DataFrame, path: str, *order: str, file_rows: int = FILE_ROWS, rows: int | None = None) -> None:
    """Append all rows, ordered by the columns; rows equal in the first one stay in one file.

    Files come from many tasks side by side and have about ``file_rows`` rows each.  The number of ``rows``
    is counted if it is not given.
    """
    fs, root = files_of(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    done = [int(i.base_name.rpartition("-")[2]) for i in found if i.base_name.startswith("segment-")]
    parts = max(1, math.ceil((df.count() if rows is None else rows) / file_rows))
    laid = df.repartitionByRange(parts, order[0]) if parts > 1 else df.coalesce(1)
    laid.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/segment-{max(done, default=-1) + 1:08d}")


def read_log(spark: SparkSession, path: str, schema: T.StructType, streaming: bool = False, **options) -> DataFrame:
    """A log from its start, or the rows between ``startingOffset`` and ``endingOffset``."""
    reader = use_logs(spark).readStream if streaming else use_logs(spark).read
    return reader.format(FORMAT).schema(schema).options(path=path, **options).load()
