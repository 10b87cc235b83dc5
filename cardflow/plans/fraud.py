"""Fraud screen: verdict per order, cleared orders, fraud feed, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow import schemas as S
from cardflow.functions.json_text import encode_json
from cardflow.functions.rules import fraud_report, is_night, verdict
from cardflow.operators.keyed import latest_per_key, stored_branches


@dataclass(frozen=True)
class FraudScreen:
    verdicts: DataFrame
    cleared: DataFrame
    frauds: DataFrame
    dead_letters: DataFrame
    counts: dict[str, int]  # orders by outcome: clean, night, undated


def branch_orders(created: DataFrame) -> DataFrame:
    """Dated orders with branch 0 (clean) or 1 (placed at night)."""
    # The two predicates are complements on dated orders: one test gives the branch.
    dated = created.filter(F.col("order_date").isNotNull())
    return dated.withColumn("branch", is_night(F.col("order_date")).cast("int"))


def fraud_verdicts(created: DataFrame, key: str, order: Column) -> DataFrame:
    """Latest verdict per order key; the text is made after the aggregate."""
    return _latest_verdicts(branch_orders(created), key, order)


def _latest_verdicts(branched: DataFrame, key: str, order: Column) -> DataFrame:
    marked = branched.select(
        F.col(key).alias("key"), (F.col("branch") == 1).alias("is_fraud"), order.alias("seq")
    )
    latest = latest_per_key(marked, "key", ["is_fraud"], F.col("seq"))
    return latest.select("key", verdict(F.col("is_fraud")).alias("value"))


def cleared_orders(created: DataFrame) -> DataFrame:
    clean = branch_orders(created).filter("branch = 0").drop("branch")
    return _cleared(clean)


def _cleared(clean: DataFrame) -> DataFrame:
    return clean.withColumn("payment_status", F.lit(S.NOT_FRAUD))


def fraudulent_orders(created: DataFrame) -> DataFrame:
    """Orders placed at night, unchanged: they keep status CREATED."""
    return branch_orders(created).filter("branch = 1").drop("branch")


def undated_orders(created: DataFrame) -> DataFrame:
    return _undated(created.filter(F.col("order_date").isNull()))


def _undated(undated: DataFrame) -> DataFrame:
    return undated.withColumn("reason", F.lit("null_order_date"))


def frauds_output(created: DataFrame, key: str) -> DataFrame:
    """Fraud feed: order key and order text, dates as epoch milliseconds."""
    return _feed(fraudulent_orders(created), key)


def _feed(found: DataFrame, key: str) -> DataFrame:
    return found.select(
        F.col(key).alias("key"), encode_json(S.ORDER, epoch_millis=True).alias("value")
    )


def cleared_feed(created: DataFrame, key: str) -> DataFrame:
    """Cleared orders as text records for the order topic."""
    return _feed(cleared_orders(created), key)


def fraud_reports(feed: DataFrame) -> DataFrame:
    return feed.select("key", fraud_report(F.col("value")).alias("report"))


def fraud_screen(created: DataFrame, key: str, order: Column) -> FraudScreen:
    """All four outputs; the orders are decoded once and stored for them by outcome."""
    dated, night = F.col("order_date").isNotNull(), is_night(F.col("order_date"))
    parts = stored_branches(created, clean=dated & ~night, night=dated & night, undated=~dated)
    return FraudScreen(
        _latest_verdicts(parts.of("clean", "night"), key, order),
        _cleared(parts.of("clean").drop("branch")),
        _feed(parts.of("night"), key),
        _undated(parts.of("undated").drop("branch")),
        parts.counts,
    )
