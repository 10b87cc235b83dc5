"""Hot keys: found by counting, then kept out of the shuffle by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.session import cut_lineage

# Rows of one key that a single task may hold.
HOT_ROWS = 5_000_000
# Above this many hot keys their rows are joined by key, and Spark splits large partitions.
MAX_BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class HotKeys:
    keys: DataFrame  # one column
    count: int
    rows: int  # rows that have one of them


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> HotKeys | None:
    """Keys with more than ``hot_rows`` rows, if there are any.

    One count that reads the key column only and combines before its shuffle.
    """
    if df.isStreaming:
        return None
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hot = cut_lineage(sizes.filter(F.col("n") > hot_rows))
    count, rows = hot.agg(F.count("*"), F.sum("n")).first()
    return HotKeys(hot.select(key), count, rows) if count else None


def join_unique(
    left: DataFrame, right: DataFrame, key: str, how: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner or left join to a side with one row per key, safe against hot keys.

    Rows with a hot key stay where they are and meet the few matching right rows
    by broadcast, if the hot keys are few enough for that; all others join by
    shuffle.  Null keys match nothing and never meet in one task.
    """
    unmatched = left.filter(F.col(key).isNull())
    keyed = left.filter(F.col(key).isNotNull())
    found = hot_keys(left, key, hot_rows)
    if found is None or found.count > MAX_BROADCAST_KEYS:
        joined = keyed.join(right, key, how)
    else:
        hot = F.broadcast(found.keys)
        few = right.join(hot, key, "left_semi").dropDuplicates([key])
        busy = keyed.join(hot, key, "left_semi").join(F.broadcast(few), key, how)
        joined = keyed.join(hot, key, "left_anti").join(right, key, how).unionByName(busy)
    if how == "left":
        joined = joined.unionByName(unmatched, allowMissingColumns=True)
    return joined
