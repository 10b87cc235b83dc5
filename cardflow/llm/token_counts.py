"""Token counts as a delta-maintained rollup.

Changes to documents become signed rows: an insert adds its tokens, a delete takes them
away, a revised count adds the difference.  A batch of changes is summed up by source,
language and tokenizer version before it is written; totals are the sum over
all committed batches.

A rollup is a folder with ``deltas/b-<id>`` (a batch's sums) and
``commits/b-<id>`` (one row, written last).  A batch counts once its commit row is
there.  Applying a committed batch again changes nothing; a batch that broke off before its
commit is written over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch string"
COMMITS = "n_groups long, n_tokens long, batch string"


def signed(changes: DataFrame) -> DataFrame:
    """Signed counts of changes: op (insert, delete, revise), source, lang, tokenizer,
    n_tokens (the count that is added or taken away; of a revision the new one) and old_tokens
    (the count before a revision).

    Null counts are 0; null sources and languages are groups of their own; an unknown
    or null op fails the batch.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    op = F.col("op")
    return changes.select(
        *KEYS,
        F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
        .otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null"))))).cast("long").alias("n_docs"),
        F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old).cast("long").alias("n_tokens"),
    )


@dataclass(frozen=True)
class TokenRollup:
    spark: SparkSession
    root: str

    def _read(self, what: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        return reader.parquet(f"{self.root}/{what}")

    def create(self) -> TokenRollup:
        """Write a batch without rows, so that an unused rollup can be read; repeatable."""
        for what, schema in (("deltas", DELTAS), ("commits", COMMITS)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/{what}/none")
        return self

    def committed(self, batch: str) -> bool:
        return not self._read("commits", COMMITS).filter(F.col("batch") == batch).isEmpty()

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"batch id {batch!r}: letters, digits, _ . - only")
        if self.committed(batch):
            return False
        path = f"{self.root}/deltas/b-{batch}"
        sums = signed(changes).groupBy(*KEYS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(path)
        self.spark.read.schema(DELTAS).parquet(path).agg(
            F.count("*").alias("n_groups"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
            F.lit(batch).alias("batch"),
        ).write.mode("overwrite").parquet(f"{self.root}/commits/b-{batch}")
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer; groups back at zero are left out."""
        done = self._read("commits", COMMITS).select("batch").distinct()
        kept = self._read("deltas", DELTAS).join(done, "batch", "left_semi")
        sums = kept.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")
