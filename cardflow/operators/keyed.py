"""Re-keying, splitting, merging, latest-per-key and bulk lookup."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cardflow.operators.skew import HOT_ROWS, join_unique
from cardflow.session import stored


def rekey(df: DataFrame, new_key: Column, key: str = "key") -> DataFrame:
    """Replace the key by a value field; the next grouping does the shuffle."""
    return df.withColumn(key, new_key)


def events_per_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Group by the current key; null keys drop out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def merge(*streams: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def with_branch(df: DataFrame, *predicates: Column) -> DataFrame:
    """Number of the first predicate that holds; rows that match none drop out."""
    branch = reduce(
        lambda acc, ip: acc.when(ip[1], ip[0]),
        enumerate(predicates[1:], start=1),
        F.when(predicates[0], 0),
    )
    return df.withColumn("branch", branch).filter(F.col("branch").isNotNull())


def split(df: DataFrame, *predicates: Column) -> list[DataFrame]:
    """One frame per predicate, first match wins."""
    marked = with_branch(df, *predicates)
    return [marked.filter(F.col("branch") == i).drop("branch") for i in range(len(predicates))]


@dataclass(frozen=True)
class Branches:
    """Stored rows by branch; reading some branches reads their files only."""

    table: DataFrame
    counts: dict[str, int]  # rows per branch, in order of number

    def of(self, *names: str) -> DataFrame:
        """Rows of the named branches, with the number of each row's branch."""
        return self.table.filter(F.col("branch").isin([list(self.counts).index(n) for n in names]))


def stored_branches(df: DataFrame, **predicates: Column) -> Branches:
    """Split by the first predicate that holds, in one pass: one write, a folder per branch.

    Rows are counted by branch while they are written.  Rows that match none drop out.
    """
    seen = Observation()
    marked = with_branch(df, *predicates.values()).observe(
        seen, *[F.count_if(F.col("branch") == i).alias(name) for i, name in enumerate(predicates)])
    table = stored(marked, "branch")
    return Branches(table, {name: seen.get[name] for name in predicates})


def ordering(*columns: str) -> Column:
    """One comparable value out of one or several ordering columns."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def latest_per_key(df: DataFrame, key: str, values: list[str], order: Column) -> DataFrame:
    """Latest record per key, on batch and on streaming frames.

    ``order`` must be unique within a key.  The aggregate is decomposable: each
    task sends one row per key into the shuffle, so a key that holds a large
    share of all rows costs no more there than any other.
    """
    newest = F.max_by(F.struct(*values), order) if len(values) > 1 else F.max_by(values[0], order)
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key)
    if len(values) == 1:
        return grouped.agg(newest.alias(values[0]))
    return grouped.agg(newest.alias("__newest")).select(key, "__newest.*")


def lookup(keys: DataFrame, state: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """State per asked key, null columns where the key is unknown.

    ``state`` has one row per key; a key asked for very often is no bottleneck.
    """
    return join_unique(keys, state, key, "left", hot_rows)
