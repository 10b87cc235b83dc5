"""Running totals that split hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(
    df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[str], sums: dict[str, str]
) -> DataFrame:
    """Add for each ``{value: name}`` the sum of ``value`` over all earlier rows of the group.

    Rows are ordered by ``chunk`` (no nulls, chosen so that each holds a bounded number
    of rows), then by ``order``.  Rows are sorted by (group, chunk) only; what is
    summed up over a whole group in one task are the chunks' totals.
    """
    rows = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, chunk).agg(*[F.sum(v).alias(f"_sum_{v}") for v in sums])
    starts = totals.select(
        *group, chunk,
        *[F.coalesce(F.sum(f"_sum_{v}").over(chunks), F.lit(0)).alias(f"_start_{v}") for v in sums],
    )
    inner = df.select("*", *[F.coalesce(F.sum(v).over(rows), F.lit(0)).alias(f"_in_{v}") for v in sums])
    joined = inner.join(starts, [*group, chunk])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_start_{v}") + F.col(f"_in_{v}")).alias(name) for v, name in sums.items()],
    )
