"""Tables that grow by commits: an atomic sink on files, and its batch and stream readers.

    data/attempt=<id>/batch=<n>/   files as Spark wrote them, never moved afterwards
    commits/<producer>/<n>.json    one small object that names the attempt and its files

An attempt's files count from the moment its commit exists, all at once; the commit is one object, so
this holds on object stores too, where the rename of a folder is many steps.  A producer repeats a
micro-batch under its number: the commit it finds stands, and an attempt that broke off or lost is
named by no commit and read by no one; ``sweep`` removes it.

Each producer numbers its batches upwards and commits them in order; several may write side by side.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cardflow.sources.topic_log import LogFile, files_of, read_part

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "cardflow_commits"
_FOOTERS = 16  # footers read at a time


@dataclass(frozen=True)
class Commit:
    producer: str
    batch: int
    attempt: str
    files: tuple[tuple[str, int], ...]  # names and rows; files without rows are left out

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.files)

    @property
    def folder(self) -> str:
        return f"data/attempt={self.attempt}/batch={self.batch}"


def put_once(fs: pafs.FileSystem, path: str, content: bytes) -> bool:
    """Create an object with its whole content; False if there is one already."""
    if fs.get_file_info(path).type == pafs.FileType.File:
        return False
    fs.create_dir(path.rpartition("/")[0])
    if isinstance(fs, pafs.LocalFileSystem):
        # A local file shows before it is full, so a finished one is linked to its name.
        hidden = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with open(hidden, "wb") as file:
            file.write(content)
        try:
            os.link(hidden, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(hidden)
        return True
    with fs.open_output_stream(path) as file:
        file.write(content)
    return True


@dataclass(frozen=True)
class CommitTable:
    """Append-only rows by producer and batch."""

    path: str

    def _place(self) -> tuple[pafs.FileSystem, str]:
        return files_of(self.path)

    def producers(self) -> list[str]:
        fs, root = self._place()
        found = fs.get_file_info(pafs.FileSelector(f"{root}/commits", allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == pafs.FileType.Directory)

    def batches(self, producer: str) -> list[int]:
        """Numbers of a producer's commits, rising."""
        fs, root = self._place()
        found = fs.get_file_info(pafs.FileSelector(f"{root}/commits/{producer}", allow_not_found=True))
        return sorted(int(i.base_name[:-5]) for i in found if i.base_name.endswith(".json") and i.base_name[0] != ".")

    def commit(self, producer: str, batch: int) -> Commit:
        fs, root = self._place()
        with fs.open_input_stream(f"{root}/commits/{producer}/{batch:020d}.json") as file:
            named = json.loads(file.read())
        return Commit(producer, batch, named["attempt"], tuple((name, rows) for name, rows in named["files"]))

    def commits(self, producer: str | None = None) -> list[Commit]:
        names = self.producers() if producer is None else [producer]
        return [self.commit(p, n) for p in names for n in self.batches(p)]

    def write(self, df: DataFrame, producer: str, batch: int) -> bool:
        """Store a batch and commit it; False if it was committed before, with nothing written."""
        fs, root = self._place()
        target = f"{root}/commits/{producer}/{batch:020d}.json"
        if fs.get_file_info(target).type == pafs.FileType.File:
            return False
        made = Commit(producer, batch, uuid.uuid4().hex, ())
        df.write.parquet(f"{self.path}/{made.folder}")
        listed = fs.get_file_info(pafs.FileSelector(f"{root}/{made.folder}"))
        names = sorted(i.base_name for i in listed if i.base_name.endswith(".parquet"))
        with ThreadPoolExecutor(_FOOTERS) as pool:
            rows = pool.map(lambda n: pq.read_metadata(f"{root}/{made.folder}/{n}", filesystem=fs).num_rows, names)
        files = [f for f in zip(names, rows) if f[1]]
        return put_once(fs, target, json.dumps({"attempt": made.attempt, "files": files}).encode())

    def read(self, spark: SparkSession, schema: str | T.StructType, commits: Sequence[Commit] | None = None) -> DataFrame:
        """Rows of all or the given commits, with their ``batch``, through Spark's own scan."""
        wanted = spark.createDataFrame([], schema).schema
        full = T.StructType([*wanted.fields, T.StructField("batch", T.LongType())])
        folders = [f"{self.path}/{c.folder}" for c in (self.commits() if commits is None else commits) if c.files]
        if not folders:
            return spark.createDataFrame([], full)
        found = spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*folders)
        return found.select(*full.fieldNames())

    def stream(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Rows of each commit once, whole commits at a time; what is empty wakes no reader."""
        spark.dataSource.register(CommitSource)
        return spark.readStream.format(FORMAT).schema(schema).option("path", self.path).load()

    def rows(self) -> int:
        return sum(c.rows for c in self.commits())

    def forget(self, commits: Sequence[Commit]) -> None:
        """Remove commits, then their files; for what a later commit replaces, while no one reads."""
        fs, root = self._place()
        for c in commits:
            fs.delete_file(f"{root}/commits/{c.producer}/{c.batch:020d}.json")
            fs.delete_dir(f"{root}/data/attempt={c.attempt}")

    def sweep(self) -> int:
        """Remove attempts that no commit names, and say how many; while no one writes."""
        fs, root = self._place()
        named = {f"attempt={c.attempt}" for c in self.commits()}
        found = fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True))
        lost = [i.base_name for i in found if i.base_name.startswith("attempt=") and i.base_name not in named]
        for name in lost:
            fs.delete_dir(f"{root}/data/{name}")
        return len(lost)


class CommitStream(DataSourceStreamReader):
    """Offsets are the last batch of each producer, ``{producer: n}``."""

    def __init__(self, options: Mapping[str, str], schema: T.StructType) -> None:
        self.table, self.schema = CommitTable(options["path"]), schema
        self.filled: dict[str, int] = {}  # last batch with rows
        self.checked: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for producer in self.table.producers():
            for n in self.table.batches(producer):
                if n > self.checked.get(producer, -1):
                    self.checked[producer] = n
                    if self.table.commit(producer, n).files:
                        self.filled[producer] = n
        return dict(self.filled)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        _, root = files_of(self.table.path)
        found = [LogFile(f"{root}/{c.folder}/{name}", 0, rows, 0, rows)
                 for producer, last in sorted(end.items()) for n in self.table.batches(producer)
                 if start.get(producer, -1) < n <= last
                 for c in [self.table.commit(producer, n)] for name, rows in c.files]
        # No partition at all would be read as one without a range.
        return found or [LogFile("", 0, 0)]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        return read_part(self.table.path, self.schema, partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class CommitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: T.StructType) -> CommitStream:
        return CommitStream(self.options, schema)
