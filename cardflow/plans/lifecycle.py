"""The whole order lifecycle as one straight plan.

The services of the flow feed each other through one shared topic, but every
order goes round only once: created, cleared, put in progress, paid or refused.
So the loop unrolls into: screen, ledger over the clean orders and all top-ups,
and a merge of all stages into the order table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow import schemas as S
from cardflow.functions.rules import is_night
from cardflow.operators.decode import decode_topups, order_intake, valid
from cardflow.operators.keyed import merge
from cardflow.operators.ledger import as_order_events, ledger_changes, ledger_input
from cardflow.operators.order_state import order_state
from cardflow.plans.balances import timed
from cardflow.plans.fraud import cleared_orders
from cardflow.plans.orders import orders_in_progress
from cardflow.session import stored

_EVENT = ["order_id", "account_id", "credit_card_number", "order_amount", "payment_status",
          "order_date", "credit_limit"]


def ledger_feed(created: DataFrame, topups: DataFrame) -> DataFrame:
    """What reaches the ledger: clean orders in progress and all top-ups."""
    return ledger_input(orders_in_progress(cleared_orders(created)), topups)


def order_lifecycle(created: DataFrame, topups: DataFrame, **ledger_options: int) -> DataFrame:
    """Final state of every order; each top-up counts as an order of its own.

    Both inputs carry the order columns plus ``event_ts`` and ``event_seq``, which is
    unique and follows arrival within one order id.
    """
    changes = ledger_changes(ledger_feed(created, topups), **ledger_options)
    outcomes = as_order_events(changes).withColumn("stage", F.lit(2))
    events = merge(
        _screened_events(created).select(*_EVENT, "stage", "event_seq"),
        outcomes.select(*_EVENT, "stage", "event_seq"),
    )
    return order_state(events, F.struct("stage", "event_seq"))


def _screened_events(created: DataFrame) -> DataFrame:
    """Stage 0 for every created order, stage 1 for the clean ones, in one scan."""
    first = F.struct(F.lit(0).alias("stage"), F.lit(S.CREATED).alias("status"))
    second = F.struct(F.lit(1).alias("stage"), F.lit(S.NOT_FRAUD).alias("status"))
    clean = F.coalesce(~is_night(F.col("order_date")), F.lit(False))
    stages = F.when(clean, F.array(first, second)).otherwise(F.array(first))
    return (
        created.withColumn("__stage", F.explode(stages))
        .withColumn("stage", F.col("__stage.stage"))
        .withColumn("payment_status", F.col("__stage.status"))
    )


def lifecycle_from_requests(raw_orders: DataFrame, raw_topups: DataFrame) -> DataFrame:
    """The lifecycle from order and balance requests as they arrive in text form.

    Several branches read both feeds: each is decoded once and stored.
    """
    created = timed(valid(order_intake(raw_orders))).select(*_EVENT, "event_ts", "event_seq")
    topups = timed(valid(decode_topups(raw_topups)))
    return order_lifecycle(stored(created), stored(topups))
