"""Order flow: orders sent on for payment, finished orders, order state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow import schemas as S
from cardflow.functions.json_text import encode_json
from cardflow.functions.rules import completed, has_status
from cardflow.operators.order_state import order_state


def orders_in_progress(orders: DataFrame) -> DataFrame:
    """Orders cleared of fraud, now in status PROGRESS."""
    return orders.filter(has_status(F.col("payment_status"), S.NOT_FRAUD)).withColumn(
        "payment_status", F.lit(S.PROGRESS)
    )


def orders_finished(orders: DataFrame) -> DataFrame:
    done = has_status(F.col("payment_status"), S.EXECUTED, S.NOT_EXECUTED)
    return orders.filter(done).withColumn("payment_status", completed(F.col("payment_status")))


def orders_output(orders: DataFrame, key: str) -> DataFrame:
    """Feed to the ledger: order key and order text, dates as epoch milliseconds."""
    return orders_in_progress(orders).select(
        F.col(key).alias("key"), encode_json(S.ORDER, epoch_millis=True).alias("value")
    )


def order_flow_state(decoded: DataFrame) -> DataFrame:
    """Order table from the decoded order topic; the record key is the order id."""
    keyed = decoded.filter("is_valid").withColumn("order_id", F.col("key"))
    return order_state(keyed, F.struct("partition", "offset"))
