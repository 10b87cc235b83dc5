"""Current state of every order, merged from its events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.functions.rules import stored_status
from cardflow.operators.skew import HOT_ROWS, join_unique

_FIRST_FIELDS = ("account_id", "credit_card_number", "order_amount", "order_date")


def order_state(events: DataFrame, order: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per order id.

    * account, card, amount and date: first non-null value;
    * status: latest, null allowed, after the status has moved on (``stored_status``);
    * credit limit: that of the last event before the first dated event; of the
      last event if none is dated; null if the first event is dated.

    ``order`` must be unique within an order id.  Everything is one decomposable
    aggregate, so a hot order id shrinks before the shuffle.  Only orders whose
    undated events lie on both sides of the first dated one need a second look at
    their undated events; if ``order_date`` cannot be null there are none.
    """
    seq = F.col("__seq")
    dated, undated = F.col("order_date").isNotNull(), F.col("order_date").isNull()
    keyed = events.filter(F.col("order_id").isNotNull()).withColumn("__seq", order)
    base = keyed.groupBy("order_id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c) for c in _FIRST_FIELDS],
        F.max_by("payment_status", seq).alias("payment_status"),
        F.min(F.when(dated, seq)).alias("__first_dated"),
        F.min(F.when(undated, seq)).alias("__first_undated"),
        F.max(F.when(undated, seq)).alias("__last_undated"),
        F.max_by("credit_limit", F.when(undated, seq)).alias("credit_limit"),
    )
    # The step a status moves on by depends on the status alone: do it per order.
    base = base.withColumn("payment_status", stored_status(F.col("payment_status")))
    before = F.col("__first_dated").isNull() | (F.col("__last_undated") < F.col("__first_dated"))
    columns = ["order_id", *_FIRST_FIELDS, "payment_status"]
    limit = F.when(before, F.col("credit_limit")).alias("credit_limit")
    if not events.schema["order_date"].nullable:
        return base.select(*columns, limit)

    # Both branches below use every column of ``base``, so its shuffle is reused.
    mixed = F.coalesce(
        (F.col("__first_undated") < F.col("__first_dated"))
        & (F.col("__last_undated") > F.col("__first_dated")),
        F.lit(False),
    )
    settled = base.filter(~mixed).select(*columns, limit)
    candidates = keyed.filter(undated).select(
        "order_id", F.col("credit_limit").alias("__limit"), "__seq"
    )
    resolved = (
        join_unique(candidates, base.filter(mixed), "order_id", "inner", hot_rows)
        .filter(seq < F.col("__first_dated"))
        .groupBy("order_id")
        .agg(
            *[F.any_value(c).alias(c) for c in columns[1:]],
            F.max_by("__limit", seq).alias("__limit"),
            F.count("*").alias("__n"),
            F.any_value("credit_limit").alias("credit_limit"),
        )
        .select(
            *columns,
            F.when(F.col("__n") > 0, F.col("__limit"))
            .otherwise(F.col("credit_limit"))
            .alias("credit_limit"),
        )
    )
    return settled.unionByName(resolved)
