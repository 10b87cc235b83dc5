"""Storage of the running flow: file-backed topics and keyed tables.

Both grow by commits of a producer's micro-batch.  A micro-batch that is repeated after a
failure finds its commit and leaves it alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.operators.keyed import latest_per_key
from cardflow.schemas import TOPIC_SCHEMA
from cardflow.session import CHANGELOG, ROCKSDB, state_partitions
from cardflow.sources.commits import Commit, CommitTable
from cardflow.sources.topics import read_topic, write_topic


def run_to_end(df: DataFrame, table: KeyedTable, mode: str, checkpoint: str, rows: int) -> DataFrame:
    """Run a stream until its input is used up and return the table it keeps.

    A micro-batch has about so many ``rows``; the partitions of the state are as many as these need.
    """
    spark = df.sparkSession
    for key, value in {**ROCKSDB, **CHANGELOG}.items():
        spark.conf.set(key, value)
    writer = (
        df.writeStream.outputMode(mode)
        .foreachBatch(lambda batch, n: table.write(batch, n))
        .option("checkpointLocation", checkpoint)
    )
    with state_partitions(spark, rows):
        query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return table.read(spark)


@dataclass(frozen=True)
class FileTopics:
    """Topics as tables that grow by commits, one folder each."""

    root: str

    def table(self, topic: str) -> CommitTable:
        return CommitTable(f"{self.root}/{topic}")

    def append(self, topic: str, records: DataFrame, producer: str, batch: int) -> None:
        columns = records.withColumn("topic", F.lit(topic)).select(*TOPIC_SCHEMA.fieldNames())
        self.table(topic).write(columns, producer, batch)

    def read(self, spark: SparkSession, topic: str) -> DataFrame:
        return self.table(topic).stream(spark, TOPIC_SCHEMA)

    def end(self, spark: SparkSession, topic: str) -> int:
        """Records of a topic so far, as its commits state them."""
        return self.table(topic).rows()


@dataclass(frozen=True)
class KafkaTopics:
    """The same over a broker, where Spark's Kafka connector is installed.

    The broker sets partition, offset and time of every record.  Delivery is
    at least once.
    """

    connection: dict[str, str]
    options: dict[str, str] = field(default_factory=dict)

    def append(self, topic: str, records: DataFrame, producer: str, batch: int) -> None:
        write_topic(records, topic, kafka=self.connection)

    def read(self, spark: SparkSession, topic: str) -> DataFrame:
        return read_topic(spark, topic, kafka=self.connection, streaming=True, **self.options)


@dataclass(frozen=True)
class KeyedTable:
    """Latest row per key as a log of changes, one commit per micro-batch.

    Writing costs the size of the micro-batch, whatever the size of the table.
    ``compact`` folds the log so far into one commit and removes what it replaces; run it
    while nothing reads the table.
    """

    path: str
    key: str
    schema: str

    @property
    def commits(self) -> CommitTable:
        return CommitTable(self.path)

    def write(self, changes: DataFrame, batch: int, order: Column | None = None) -> None:
        """Store a micro-batch's changes; with ``order``, only the latest per key."""
        columns = self._columns(changes.sparkSession)
        if order is not None:
            values = [c for c in columns if c != self.key]
            changes = latest_per_key(changes.withColumn("__o", order), self.key, values,
                                     F.col("__o"))
        self.commits.write(changes.select(*columns), "log", batch)

    def _columns(self, spark: SparkSession) -> list[str]:
        return spark.createDataFrame([], self.schema).columns

    def _current(self) -> list[Commit]:
        """The newest folded commit and the log after it."""
        folded = self.commits.batches("folded")[-1:]
        log = [n for n in self.commits.batches("log") if not folded or n > folded[0]]
        return [self.commits.commit("folded", n) for n in folded] + [self.commits.commit("log", n) for n in log]

    def read(self, spark: SparkSession) -> DataFrame:
        log = self.commits.read(spark, self.schema, self._current())
        values = [c for c in self._columns(spark) if c != self.key]
        return latest_per_key(log, self.key, values, F.col("batch"))

    def compact(self, spark: SparkSession) -> None:
        log = self.commits.commits("log")
        if not log:
            return
        newest = log[-1].batch
        self.commits.write(self.read(spark), "folded", newest)
        self.commits.forget(log + [c for c in self.commits.commits("folded") if c.batch < newest])
