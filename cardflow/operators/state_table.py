"""Keyed state kept in buckets of its key, for many lookups without moving it again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cardflow.operators.skew import HOT_ROWS, join_unique
from cardflow.session import checkpoint_root


@dataclass(frozen=True)
class StateTable:
    """A table with one row per key, bucketed and sorted by it.

    The state is shuffled once, when it is written.  A lookup moves the asked keys only, to the
    bucket that holds them; keys that are asked for very often meet their few rows by broadcast.
    """

    spark: SparkSession
    name: str
    key: str

    @staticmethod
    def write(state: DataFrame, key: str, name: str | None = None, buckets: int | None = None) -> StateTable:
        """Store state in ``buckets`` buckets, by default as many as the session's shuffles have."""
        spark = state.sparkSession
        name = name or f"state_{uuid.uuid4().hex}"
        count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Moved before, so that each bucket is one file.
        (state.repartition(count, key).write.bucketBy(count, key).sortBy(key)
         .option("path", f"{checkpoint_root(spark)}/tables/{name}").saveAsTable(name))
        return StateTable(spark, name, key)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, asked: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
        """State per asked key, null columns where the key is unknown."""
        return join_unique(asked, self.read(), self.key, "left", hot_rows)

    def drop(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
