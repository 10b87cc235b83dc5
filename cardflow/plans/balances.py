"""Balance ledger over topics: balances table and results feed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow import schemas as S
from cardflow.functions.json_text import encode_json
from cardflow.operators import ledger
from cardflow.operators.decode import dead_letters, decode_orders, decode_topups, valid
from cardflow.operators.keyed import merge
from cardflow.session import stored


@dataclass(frozen=True)
class Ledger:
    events: DataFrame
    dead_letters: DataFrame

    def changes(self, **options: int) -> DataFrame:
        return ledger.ledger_changes(self.events, **options)

    def balances(self, **options: int) -> DataFrame:
        return ledger.account_balances(self.events, **options)


def timed(decoded: DataFrame) -> DataFrame:
    """Arrival order of a topic: record time, then partition and offset."""
    return decoded.withColumns(
        {"event_ts": F.col("timestamp"), "event_seq": F.struct("partition", "offset")}
    )


def ledger_from_topics(raw_orders: DataFrame, raw_topups: DataFrame) -> Ledger:
    """Ledger over ``orders-output`` and ``balances-input`` records.

    Counting, folding and dead letters read both feeds: they are decoded once and
    stored.
    """
    orders = stored(decode_orders(raw_orders))
    topups = stored(decode_topups(raw_topups))
    events = ledger.ledger_input(timed(valid(orders)), timed(valid(topups)))
    unfit = ledger.unfit_events(events).select("key", "value", "topic", "reason")
    return Ledger(events, merge(dead_letters(orders), dead_letters(topups), unfit))


def results_feed(changes: DataFrame) -> DataFrame:
    """Outcomes as text records for the order topic, keyed by order id."""
    return ledger.as_order_events(changes).select(
        F.col("order_id").alias("key"), encode_json(S.ORDER, epoch_millis=True).alias("value")
    )
