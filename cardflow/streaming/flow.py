"""The running flow: the services as streaming queries that feed each other.

They share topics the way the services do: the order topic is read by the fraud
screen and the order table, and written by clients, fraud screen and ledger.  The
loop is bounded because each query reacts only to statuses it does not produce.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardflow import schemas as S
from cardflow.functions.json_text import encode_json
from cardflow.operators.decode import (
    created_orders, dead_letters, decode_accounts, decode_orders, decode_topups, valid,
)
from cardflow.operators.keyed import merge
from cardflow.operators.ledger import as_order_events, ledger_input, unfit_events
from cardflow.plans import accounts, fraud, orders
from cardflow.sources.commits import CommitTable
from cardflow.streaming.processors import BUCKETS
from cardflow.streaming.state import streaming_ledger, streaming_order_state
from cardflow.streaming.tables import FileTopics, KafkaTopics, KeyedTable

# Who wrote a record of the order topic, in the causal order of one order's events.
CLIENT, SCREEN, LEDGER = 0, 1, 2

_ACCOUNT = ("account_id string, account_name string, account_last_update timestamp_ntz, "
            "user_document_id string, credit_card_number bigint, security_code string, "
            "expiration_date timestamp, brand_name string")
_TEXT = "key string, value string"
_ORDER = ("order_id string, account_id string, credit_card_number bigint, "
          "order_amount decimal(38,6), payment_status string, order_date timestamp, "
          "credit_limit decimal(38,6)")
_BALANCE = ("account_id string, credit_card_number bigint, balance decimal(38,6), "
            "credit_limit decimal(38,6), order_id string, payment_status string")
REPORT = "key string, report string"
LETTER = "key string, value string, topic string, reason string"
_ARRIVAL = ("partition", "offset")


def _records(df: DataFrame, key: Column, producer: int) -> DataFrame:
    """Orders as topic records that keep the place and time of their cause."""
    return df.select(
        key.alias("key"),
        encode_json(S.ORDER, epoch_millis=True).alias("value"),
        F.lit(producer).alias("partition"),
        "offset",
        "timestamp",
    )


@dataclass(frozen=True)
class Flow:
    spark: SparkSession
    topics: FileTopics | KafkaTopics
    root: str  # tables and checkpoints, on storage that all executors share
    trigger: dict
    buckets: int = BUCKETS  # of the ledger's and the order table's state, for the life of their checkpoints

    # --- tables ---------------------------------------------------------------
    def _table(self, name: str, key: str, schema: str) -> KeyedTable:
        return KeyedTable(f"{self.root}/tables/{name}", key, schema)

    @property
    def accounts(self) -> KeyedTable:
        return self._table("accounts", "account_id", _ACCOUNT)

    @property
    def requests(self) -> KeyedTable:
        return self._table("requests", "key", _TEXT)

    @property
    def verdicts(self) -> KeyedTable:
        return self._table("verdicts", "key", _TEXT)

    @property
    def orders(self) -> KeyedTable:
        return self._table("orders", "order_id", _ORDER)

    @property
    def balances(self) -> KeyedTable:
        return self._table("balances", "account_id", _BALANCE)

    @property
    def reports(self) -> CommitTable:
        return CommitTable(f"{self.root}/tables/reports")

    @property
    def dead_letters(self) -> CommitTable:
        """Refused records; the producer of a commit is the stage that refused them."""
        return CommitTable(f"{self.root}/tables/dead_letters")

    # --- queries --------------------------------------------------------------
    def checkpoint(self, name: str) -> str:
        return f"{self.root}/checkpoints/{name}"

    def _start(
        self, name: str, df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str
    ) -> StreamingQuery:
        def write(batch: DataFrame, batch_id: int) -> None:
            # Several sinks read one batch: compute it once.
            batch.persist()
            try:
                sink(batch, batch_id)
            finally:
                batch.unpersist()

        writer = df.writeStream.queryName(name).outputMode(mode).foreachBatch(write)
        location = self.checkpoint(name)
        return writer.option("checkpointLocation", location).trigger(**self.trigger).start()

    def _refuse(self, letters: DataFrame, stage: str, batch: int) -> None:
        columns = letters.select("key", "value", "topic", "reason")
        self.dead_letters.write(columns, stage, batch)

    def start_accounts(self) -> StreamingQuery:
        raw = self.topics.read(self.spark, S.ACCOUNTS_INPUT)

        def sink(batch: DataFrame, n: int) -> None:
            self.accounts.write(accounts.accounts_state(batch), n)
            self.requests.write(accounts.request_status(batch), n)
            refused = dead_letters(batch)
            self._refuse(refused, "accounts", n)
            places = batch.filter(~F.col("is_valid")).select(
                "key", "value", "partition", "offset", "timestamp"
            )
            self.topics.append(S.ACCOUNTS_DLQ, places, "accounts", n)

        return self._start("accounts", decode_accounts(raw), sink, "append")

    def start_screen(self) -> StreamingQuery:
        raw = self.topics.read(self.spark, S.ORDERS_INPUT)

        def sink(batch: DataFrame, n: int) -> None:
            created = created_orders(batch)
            self.verdicts.write(
                fraud.fraud_verdicts(created, "key", F.struct(*_ARRIVAL)), n
            )
            key = F.col("key")
            self.topics.append(
                S.ORDERS_INPUT, _records(fraud.cleared_orders(created), key, SCREEN), "screen", n
            )
            self.topics.append(
                S.FRAUDS_OUTPUT, _records(fraud.fraudulent_orders(created), key, SCREEN),
                "screen", n,
            )
            self._refuse(fraud.undated_orders(created), "screen", n)

        return self._start("screen", decode_orders(raw), sink, "append")

    def start_report(self) -> StreamingQuery:
        feed = self.topics.read(self.spark, S.FRAUDS_OUTPUT)

        def sink(batch: DataFrame, n: int) -> None:
            self.reports.write(fraud.fraud_reports(batch), "report", n)

        return self._start("report", feed, sink, "append")

    def start_progress(self) -> StreamingQuery:
        raw = self.topics.read(self.spark, S.ORDERS_INPUT)

        def sink(batch: DataFrame, n: int) -> None:
            moving = orders.orders_in_progress(valid(batch))
            self.topics.append(
                S.ORDERS_OUTPUT, _records(moving, F.col("key"), SCREEN), "orders", n
            )
            self._refuse(dead_letters(batch), "orders", n)

        return self._start("progress", decode_orders(raw), sink, "append")

    def start_order_table(self) -> StreamingQuery:
        decoded = valid(decode_orders(self.topics.read(self.spark, S.ORDERS_INPUT)))
        events = decoded.withColumns(
            {"order_id": F.col("key"), "stage": F.col("partition"), "event_seq": F.col("offset")}
        )
        return self._start(
            "order_table",
            streaming_order_state(events, buckets=self.buckets),
            lambda batch, n: self.orders.write(batch, n),
            "update",
        )

    def _ledger_events(self) -> tuple[DataFrame, DataFrame]:
        def timed(df: DataFrame) -> DataFrame:
            return df.withColumns(
                {"event_ts": F.col("timestamp"), "event_seq": F.col("offset")}
            )

        moved = decode_orders(self.topics.read(self.spark, S.ORDERS_OUTPUT))
        topups = decode_topups(self.topics.read(self.spark, S.BALANCES_INPUT))
        events = ledger_input(timed(valid(moved)), timed(valid(topups)))
        return events, merge(dead_letters(moved), dead_letters(topups))

    def start_ledger(self) -> StreamingQuery:
        events, _ = self._ledger_events()

        def sink(batch: DataFrame, n: int) -> None:
            order = F.struct("event_ts", "source_rank", "event_seq")
            self.balances.write(batch, n, order)
            results = as_order_events(batch).withColumns(
                {"offset": F.col("event_seq"), "timestamp": F.col("event_ts")}
            )
            self.topics.append(
                S.ORDERS_INPUT, _records(results, F.col("order_id"), LEDGER), "ledger", n
            )

        return self._start("ledger", streaming_ledger(events, buckets=self.buckets), sink, "append")

    def start_ledger_refusals(self) -> StreamingQuery:
        events, undecoded = self._ledger_events()
        unfit = unfit_events(events).select("key", "value", "topic", "reason")
        return self._start(
            "ledger_refusals",
            merge(undecoded, unfit),
            lambda batch, n: self._refuse(batch, "ledger", n),
            "append",
        )

    def start(self) -> list[StreamingQuery]:
        """All queries; with ``availableNow`` each ends when its input is used up."""
        return [
            self.start_accounts(), self.start_screen(), self.start_report(),
            self.start_progress(), self.start_order_table(), self.start_ledger(),
            self.start_ledger_refusals(),
        ]

    def services(self) -> dict[str, tuple[Callable[[], StreamingQuery], tuple[str, ...]]]:
        """Every query by name with the topics it reads, causes before effects."""
        return {
            "accounts": (self.start_accounts, (S.ACCOUNTS_INPUT,)),
            "screen": (self.start_screen, (S.ORDERS_INPUT,)),
            "report": (self.start_report, (S.FRAUDS_OUTPUT,)),
            "progress": (self.start_progress, (S.ORDERS_INPUT,)),
            "ledger": (self.start_ledger, (S.ORDERS_OUTPUT, S.BALANCES_INPUT)),
            "ledger_refusals": (self.start_ledger_refusals, (S.ORDERS_OUTPUT, S.BALANCES_INPUT)),
            "order_table": (self.start_order_table, (S.ORDERS_INPUT,)),
        }

    def settle(self, seen: dict[str, dict[str, int]] | None = None) -> dict[str, dict[str, int]]:
        """Run the services in rounds until no topic has records that its readers have not seen.

        A service runs only if one of its topics has grown since its last run, with a trigger
        that ends when the input is used up.  What it writes to a shared topic is input of the
        same round for the services after it and of the next one for itself and those before.
        Rounds end because every service reacts only to statuses it does not produce.  Returns the
        ends of topics that each service has seen, to be handed to the next call.
        """
        seen = dict(seen or {})
        moved = True
        while moved:
            moved = False
            for name, (start, topics) in self.services().items():
                ends = {t: self.topics.end(self.spark, t) for t in topics}
                if ends == seen.get(name, dict.fromkeys(topics, 0)):
                    continue
                start().awaitTermination()
                seen[name], moved = ends, True
        return seen

    # --- requests -------------------------------------------------------------
    def submit(self, topic: str, records: DataFrame, batch: int) -> None:
        """Client requests: key, value and their place and time in the topic."""
        self.topics.append(topic, records.withColumn("partition", F.lit(CLIENT)), "client", batch)
