"""Connected components of an edge list, by alternating large-star and small-star steps.

Both steps replace edges by edges to smaller neighbours; in the end every node is tied
to the smallest of its component.  Nothing but a count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.session import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node on an edge (columns u, v); a root is tied to itself.

    Root is the smallest node of the component.  Self-loops and repeated edges do no harm.
    """
    now = stored(_small_star(edges.select("u", "v").filter("u <> v")))
    state = _state(now)
    while state[0]:
        after = stored(_small_star(_large_star(now)))
        found = _state(after)
        if found == state:
            break
        now, state = after, found
    tied = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tied.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
