"""Session settings and lineage cuts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

UTC = {"spark.sql.session.timeZone": "UTC"}
# Stateful processors need it; its state lives on disk, not in the heap.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
# Checkpoints of state as changes since the last snapshot: small, and readable as a change feed.
CHANGELOG = {"spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}

PARTITIONS = "spark.sql.shuffle.partitions"
# Rows of a micro-batch that give a partition of a stream's state enough to do.
STATE_ROWS = 25_000


def local_session(cores: int | str = 8, **extra: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    conf = {
        **UTC,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **ROCKSDB,
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cardflow")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Zone-less test timestamps are UTC instants; pin the session to that."""
    for key, value in UTC.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def state_partitions(spark: SparkSession, rows: int) -> Iterator[int]:
    """Streams started inside keep their state in partitions for micro-batches of so many rows.

    Each partition is opened and committed by every micro-batch, whatever it holds, and Spark neither merges
    them nor changes their number later.  One a core at least, the session's number at most.
    """
    given = spark.conf.get(PARTITIONS)
    needed = max(spark.sparkContext.defaultParallelism, math.ceil(rows / STATE_ROWS))
    spark.conf.set(PARTITIONS, str(min(int(given), needed)))
    try:
        yield min(int(given), needed)
    finally:
        spark.conf.set(PARTITIONS, given)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as the session names it.

    Only a local master, whose driver and executors are one process, may fall
    back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="cardflow-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame on reliable storage; partitions and row order are kept.

    The files outlive a lost executor.  Spark removes them with the frame if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a frame once as a table in the shared folder and read it from there.

    For records that several branches read: they are computed once, and every
    branch reads only its columns and row groups.  The table outlives a lost executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{uuid.uuid4()}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
