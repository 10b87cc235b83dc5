"""Every operator and flow as a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow import schemas as S
from cardflow.functions import ids
from cardflow.functions.json_text import encode_json
from cardflow.operators import decode, keyed, ledger
from cardflow.operators.order_state import order_state
from cardflow.operators.state_table import StateTable
from cardflow.plans import accounts, balances, fraud, lifecycle, orders
from cardflow.session import ROCKSDB, checkpoint_root, stored
from cardflow.sources import fixtures as fx
from cardflow.sources.topic_log import OFFSET, read_log
from cardflow.sources.topics import publish, read_topic, write_topic
from cardflow.streaming.flow import Flow
from cardflow.streaming.processors import LEDGER_OUTPUT, ORDER_OUTPUT, state_buckets
from cardflow.streaming.state import lookup_state, streaming_ledger, streaming_order_state
from cardflow.streaming.tables import FileTopics, KeyedTable, run_to_end

Query = Callable[[SparkSession, str], DataFrame]


def out(df: DataFrame, *columns: str) -> DataFrame:
    """Result columns in comparable types: money as exact text, times without zone."""

    def plain(name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, T.DecimalType):
            return F.col(name).cast(S.MONEY).cast("string").alias(name)
        if isinstance(kind, T.TimestampType):
            return F.col(name).cast("timestamp_ntz").alias(name)
        return F.col(name)

    return df.select(*[plain(c) for c in columns or df.columns])


ORDER_COLUMNS = ("order_id", "account_id", "credit_card_number", "order_amount",
                 "payment_status", "order_date", "credit_limit")
FLOW_ORDER = tuple(c for c in ORDER_COLUMNS if c != "order_date")


# --- scans, sinks, encoding -------------------------------------------------
def scan_raw_events(spark: SparkSession, d: str) -> DataFrame:
    return out(fx.raw_events(spark, d))


def topic_range_scan(spark: SparkSession, d: str) -> DataFrame:
    """The middle half of the events by offset in a log ordered by time."""
    events = fx.table(spark, d, "events")
    n = events.count()
    schema = T.StructType([*events.schema.fields, T.StructField(OFFSET, T.LongType())])
    log = read_log(spark, fx.event_log(spark, d), schema, startingOffset=n // 4, endingOffset=3 * n // 4)
    return log.select("event_id", "user_id", "ts", OFFSET)


def publish_order_json(spark: SparkSession, d: str) -> DataFrame:
    return publish(fx.orders(spark, d), F.col("order_id"), S.ORDER)


def accounts_dlq(spark: SparkSession, d: str) -> DataFrame:
    return decode.dead_letters(decode.decode_accounts(fx.account_requests(spark, d)))


def account_messages_dlq(spark: SparkSession, d: str) -> DataFrame:
    """Account messages carry a property that accounts lack: all are refused."""
    return decode.dead_letters(decode.decode_accounts(fx.account_messages(spark, d)))


def orders_output(spark: SparkSession, d: str) -> DataFrame:
    return orders.orders_output(fraud.cleared_orders(fx.orders(spark, d)), "order_id")


def frauds_output(spark: SparkSession, d: str) -> DataFrame:
    return fraud.frauds_output(fx.orders(spark, d), "order_id")


def cleared_orders_feed(spark: SparkSession, d: str) -> DataFrame:
    """Cleared orders as text, the way they go back to the order topic."""
    return fraud.cleared_feed(fx.orders(spark, d), "order_id")


def ledger_results_feed(spark: SparkSession, d: str) -> DataFrame:
    """Ledger outcomes as text, the way they go back to the order topic."""
    return balances.results_feed(_changes(spark, d))


def topic_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Balance requests written to a folder topic in two appends, and read from there."""
    path = f"{checkpoint_root(spark)}/topics/{uuid.uuid4()}"
    records = fx.balance_requests(spark, d)
    for half in (F.col("offset") % 2 == 0, F.col("offset") % 2 != 0):
        write_topic(records.filter(half), S.BALANCES_INPUT, path=path)
    return read_topic(spark, S.BALANCES_INPUT, path=path).select("key", "value", "offset")


def fraud_report(spark: SparkSession, d: str) -> DataFrame:
    return fraud.fraud_reports(frauds_output(spark, d))


# --- decoding ---------------------------------------------------------------
def decode_accounts(spark: SparkSession, d: str) -> DataFrame:
    good = decode.valid(decode.decode_accounts(fx.account_requests(spark, d)))
    return out(good, "key", "account_id", "account_name", "account_last_update",
               "credit_card_number", "brand_name")


def decode_orders(spark: SparkSession, d: str) -> DataFrame:
    good = decode.valid(decode.decode_orders(fx.order_requests(spark, d)))
    return out(good, "offset", "account_id", "credit_card_number", "order_amount",
               "order_date", "credit_limit")


def decode_account_details(spark: SparkSession, d: str) -> DataFrame:
    """Requests with every account property, refused ones with their reason."""
    return out(decode.decode_accounts(fx.account_details(spark, d)), "key", "user_document_id",
               "credit_card_number", "security_code", "expiration_date", "is_valid", "reason")


def decode_money_edges(spark: SparkSession, d: str) -> DataFrame:
    decoded = decode.decode_orders(fx.money_edges(spark, d))
    return out(decoded, "offset", "order_amount", "reason")


def decode_date_edges(spark: SparkSession, d: str) -> DataFrame:
    return out(decode.decode_orders(fx.date_edges(spark, d)), "offset", "order_date", "reason")


def created_orders(spark: SparkSession, d: str) -> DataFrame:
    decoded = decode.decode_orders(fx.orders_topic(spark, d))
    return out(decode.created_orders(decoded), *ORDER_COLUMNS)


def topup_orders(spark: SparkSession, d: str) -> DataFrame:
    return out(decode.valid(decode.decode_topups(fx.balance_requests(spark, d))), *ORDER_COLUMNS)


def decode_outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    decoded = keyed.merge(
        *[
            df.select("topic", "reason")
            for df in (
                decode.decode_accounts(fx.account_requests(spark, d)),
                decode.decode_orders(fx.order_requests(spark, d)),
                decode.decode_topups(fx.balance_requests(spark, d)),
            )
        ]
    )
    outcome = F.coalesce("reason", F.lit("ok")).alias("outcome")
    return decoded.groupBy("topic", outcome).agg(F.count("*").alias("n"))


def order_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Order requests refused by the decoder or, undated, by the fraud screen."""
    intake = decode.order_intake(fx.order_requests(spark, d))
    undated = fraud.undated_orders(decode.valid(intake))
    refused = keyed.merge(
        decode.dead_letters(intake), undated.select("key", "value", "topic", "reason")
    )
    return refused.select("key", "value", "reason")


# --- projections --------------------------------------------------------------
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    raw = keyed.merge(fx.account_requests(spark, d), fx.balance_requests(spark, d))
    return raw.select("topic", "offset", decode.request_key().alias("request_key"))


def order_intake(spark: SparkSession, d: str) -> DataFrame:
    good = decode.valid(decode.order_intake(fx.order_requests(spark, d)))
    return out(good, "offset", "order_id", "account_id", "order_amount", "payment_status")


def prefixed_account_key(spark: SparkSession, d: str) -> DataFrame:
    return fx.account_messages(spark, d).select("key", "value")


def request_status(spark: SparkSession, d: str) -> DataFrame:
    return accounts.request_status(decode.decode_accounts(fx.account_requests(spark, d)))


def fraud_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return fraud.fraud_verdicts(fx.orders(spark, d), "order_id", F.col("event_seq"))


def cleared_orders(spark: SparkSession, d: str) -> DataFrame:
    return out(fraud.cleared_orders(fx.orders(spark, d)), *ORDER_COLUMNS)


def orders_finished(spark: SparkSession, d: str) -> DataFrame:
    done = orders.orders_finished(ledger.as_order_events(_changes(spark, d)))
    return out(done, "order_id", "account_id", "order_amount", "payment_status")


# --- splits, keys, unions -----------------------------------------------------
def _brands(spark: SparkSession, d: str) -> DataFrame:
    return decode.decode_accounts(fx.account_requests(spark, d))


def accounts_netcard(spark: SparkSession, d: str) -> DataFrame:
    return accounts.accepted_accounts(_brands(spark, d)).select("key", "account_name", "brand_name")


def accounts_other_brand(spark: SparkSession, d: str) -> DataFrame:
    return accounts.rejected_accounts(_brands(spark, d)).select("key", "account_name", "brand_name")


def branch_accounts(spark: SparkSession, d: str) -> DataFrame:
    return accounts.branch_accounts(_brands(spark, d)).select("key", "branch")


def branch_orders(spark: SparkSession, d: str) -> DataFrame:
    return fraud.branch_orders(fx.orders(spark, d)).select("order_id", "branch")


def rekey_by_account(spark: SparkSession, d: str) -> DataFrame:
    by_order = fx.orders(spark, d).withColumn("key", F.col("order_id"))
    return keyed.rekey(by_order, F.col("account_id")).select("key", "order_id")


def events_per_key(spark: SparkSession, d: str) -> DataFrame:
    return keyed.events_per_key(fx.raw_events(spark, d))


def ledger_input_union(spark: SparkSession, d: str) -> DataFrame:
    return out(_feed(spark, d), "order_id", "account_id", "order_amount", "payment_status",
               "source_rank", "event_ts", "event_seq")


# --- state ------------------------------------------------------------------------
def _feed(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.ledger_feed(fx.orders(spark, d), fx.topups(spark, d))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return ledger.ledger_changes(_feed(spark, d))


def accounts_state(spark: SparkSession, d: str) -> DataFrame:
    state = accounts.accounts_state(_brands(spark, d))
    return out(state, "account_id", "account_name", "account_last_update",
               "credit_card_number", "brand_name")


def order_state_query(spark: SparkSession, d: str) -> DataFrame:
    """Order state where all events of a user count as events of one order."""
    return out(order_state(fx.order_events(spark, d), F.col("event_seq")), *ORDER_COLUMNS)


_BALANCE = ("account_id", "credit_card_number", "balance", "credit_limit", "order_id",
            "payment_status")
_CHANGE = ("account_id", "order_id", "event_amount", "is_topup", "balance", "payment_status")


def account_balances(spark: SparkSession, d: str) -> DataFrame:
    return out(ledger.account_balances(_feed(spark, d)), *_BALANCE)


def ledger_results(spark: SparkSession, d: str) -> DataFrame:
    results = ledger.as_order_events(_changes(spark, d))
    return out(results, "order_id", "account_id", "credit_card_number", "order_amount",
               "payment_status", "credit_limit", "event_amount", "is_topup")


def _pooled_feed(spark: SparkSession, d: str) -> DataFrame:
    return fx.pooled(_feed(spark, d))


# Fixed and small, so that the pooled account is folded in chunks on the test tables.
POOL_LIMITS = {"hot_rows": 1_000, "chunk_rows": 500}
GRID_LIMITS = {"hot_rows": 200, "chunk_rows": 100}


def ledger_results_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Ledger with a third of all accounts pooled into one busy account."""
    changes = ledger.ledger_changes(_pooled_feed(spark, d), **POOL_LIMITS)
    return out(changes, *_CHANGE)


def account_balances_pooled(spark: SparkSession, d: str) -> DataFrame:
    state = ledger.account_balances(_pooled_feed(spark, d), **POOL_LIMITS)
    return out(state, *_BALANCE)


def ledger_results_grid(spark: SparkSession, d: str) -> DataFrame:
    """A busy account whose chunks keep what they started from: settled by transfer functions."""
    changes = ledger.ledger_changes(fx.gridded(_pooled_feed(spark, d)), **GRID_LIMITS)
    return out(changes, *_CHANGE)


# --- lookups ----------------------------------------------------------------------
def lookup_accounts(spark: SparkSession, d: str) -> DataFrame:
    raw = fx.account_requests(spark, d)
    asked = raw.select(ids.record_uuid("account").alias("account_id"))
    state = accounts.accounts_state(decode.decode_accounts(raw))
    return keyed.lookup(asked, state.select("account_id", "account_name", "brand_name"), "account_id")


def lookup_requests(spark: SparkSession, d: str) -> DataFrame:
    raw = fx.account_requests(spark, d)
    state = accounts.request_status(decode.decode_accounts(raw))
    return keyed.lookup(raw.select("key"), state, "key")


def lookup_orders(spark: SparkSession, d: str) -> DataFrame:
    asked = fx.raw_events(spark, d).select(F.col("offset").cast("string").alias("order_id"))
    state = order_lifecycle(spark, d).select("order_id", "account_id", "payment_status")
    return keyed.lookup(asked, state, "order_id")


def lookup_balances(spark: SparkSession, d: str) -> DataFrame:
    customer = fx.table(spark, d, "customer")
    asked = customer.select(F.col("c_custkey").cast("string").alias("account_id"))
    state = account_balances(spark, d).select("account_id", "balance", "payment_status")
    return keyed.lookup(asked, state, "account_id")


def lookup_verdicts(spark: SparkSession, d: str) -> DataFrame:
    asked = fx.raw_events(spark, d).select(F.col("offset").cast("string").alias("key"))
    return keyed.lookup(asked, fraud_verdicts(spark, d), "key")


def lookup_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """One stored table of verdicts, asked by all events and by all customers."""
    verdicts = StateTable.write(fraud_verdicts(spark, d), "key")
    events = fx.raw_events(spark, d).select(F.col("offset").cast("string").alias("key"))
    customers = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return keyed.merge(*[_part(verdicts.lookup(asked), part, "key", "value")
                         for part, asked in (("event", events), ("customer", customers))])


def branch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows by outcome of onboarding and screening, counted while they are stored."""
    done = accounts.onboarding(fx.account_requests(spark, d))
    screen = fraud.fraud_screen(fx.orders(spark, d), "order_id", F.col("event_seq"))
    counted = [("accounts", name, n) for name, n in done.counts.items()]
    counted += [("orders", name, n) for name, n in screen.counts.items()]
    return spark.createDataFrame(counted, "flow string, branch string, n long")


# --- flows ------------------------------------------------------------------------
def _part(df: DataFrame, part: str, key: str, value: str) -> DataFrame:
    return df.select(
        F.lit(part).alias("part"), F.col(key).alias("key"), F.col(value).alias("value")
    )


def account_onboarding(spark: SparkSession, d: str) -> DataFrame:
    done = accounts.onboarding(fx.account_requests(spark, d))
    return keyed.merge(
        _part(done.accounts, "account", "account_id", "account_name"),
        _part(done.requests, "request", "key", "value"),
        _part(done.dead_letters, "dead letter", "key", "value"),
    )


def fraud_screen(spark: SparkSession, d: str) -> DataFrame:
    screen = fraud.fraud_screen(fx.orders(spark, d), "order_id", F.col("event_seq"))
    return keyed.merge(
        _part(screen.verdicts, "verdict", "key", "value"),
        _part(screen.cleared, "cleared", "order_id", "payment_status"),
        _part(fraud.fraud_reports(screen.frauds), "report", "key", "report"),
        _part(screen.dead_letters, "dead letter", "order_id", "reason"),
    )


def _topic_ledger(spark: SparkSession, d: str) -> balances.Ledger:
    return balances.ledger_from_topics(
        fx.orders_output_topic(spark, d), fx.balance_requests(spark, d)
    )


def balance_ledger(spark: SparkSession, d: str) -> DataFrame:
    return out(_topic_ledger(spark, d).balances(), "account_id", "credit_card_number",
               "balance", "credit_limit", "order_id", "payment_status")


def balance_ledger_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return _topic_ledger(spark, d).dead_letters.select("key", "value", "topic", "reason")


def order_flow(spark: SparkSession, d: str) -> DataFrame:
    """Order table from the order topic with the records of all three producers."""
    decoded = stored(decode.decode_orders(fx.full_orders_topic(spark, d, _changes(spark, d))))
    return out(orders.order_flow_state(decoded), *ORDER_COLUMNS)


def order_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    state = lifecycle.order_lifecycle(fx.orders(spark, d), fx.topups(spark, d))
    return out(state, *ORDER_COLUMNS)


def order_lifecycle_raw(spark: SparkSession, d: str) -> DataFrame:
    """The lifecycle from request texts, defects included."""
    state = lifecycle.lifecycle_from_requests(
        fx.order_requests(spark, d), fx.balance_requests(spark, d)
    )
    return out(state, *ORDER_COLUMNS)


# --- streams: the same results from Structured Streaming, run to the end of its input --
def _buckets(log: fx.EventLog) -> int:
    return state_buckets(log.batch_rows)


def _streamed(spark: SparkSession, log: fx.EventLog, df: DataFrame, key: str, schema: str, mode: str) -> DataFrame:
    root = f"{checkpoint_root(spark)}/streams/{uuid.uuid4()}"
    table = KeyedTable(f"{root}/table", key, schema)
    return run_to_end(df, table, mode, f"{root}/checkpoint", log.batch_rows)


def stream_fraud_verdicts(spark: SparkSession, d: str) -> DataFrame:
    log = fx.event_log(spark, d)
    created = fx.orders(spark, d, log)
    verdicts = fraud.fraud_verdicts(created, "order_id", F.col("event_seq"))
    return _streamed(spark, log, verdicts, "key", "key string, value string", "update")


def stream_ledger_results(spark: SparkSession, d: str) -> DataFrame:
    log = fx.event_log(spark, d)
    feed = lifecycle.ledger_feed(fx.orders(spark, d, log), fx.topups(spark, d, log))
    results = _streamed(spark, log, streaming_ledger(feed, buckets=_buckets(log)), "order_id", LEDGER_OUTPUT, "append")
    return out(results, *_CHANGE)


def stream_order_state(spark: SparkSession, d: str) -> DataFrame:
    log = fx.event_log(spark, d)
    events = fx.order_events(spark, d, log).withColumn("stage", F.lit(0))
    state = streaming_order_state(events, buckets=_buckets(log))
    return out(_streamed(spark, log, state, "order_id", ORDER_OUTPUT, "update"), *ORDER_COLUMNS)


def stream_ledger_restarted(spark: SparkSession, d: str) -> DataFrame:
    """The streaming ledger stopped halfway and started again from its checkpoint."""
    root = f"{checkpoint_root(spark)}/streams/{uuid.uuid4()}"
    table = KeyedTable(f"{root}/table", "order_id", LEDGER_OUTPUT)
    log = None
    for part in range(2):
        log = fx.event_log(spark, d, part, 2, log)
        feed = lifecycle.ledger_feed(fx.orders(spark, d, log), fx.topups(spark, d, log))
        results = run_to_end(streaming_ledger(feed, buckets=_buckets(log)), table, "append", f"{root}/checkpoint", log.batch_rows)
    return out(results, *_CHANGE)


def live_balances(spark: SparkSession, d: str) -> DataFrame:
    """Balances of all customers, asked from the state of the streaming ledger."""
    root = f"{checkpoint_root(spark)}/streams/{uuid.uuid4()}"
    log = fx.event_log(spark, d)
    feed = lifecycle.ledger_feed(fx.orders(spark, d, log), fx.topups(spark, d, log))
    run_to_end(streaming_ledger(feed, buckets=_buckets(log)), KeyedTable(f"{root}/table", "order_id", LEDGER_OUTPUT), "append",
               f"{root}/checkpoint", log.batch_rows)
    asked = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("account_id"))
    return out(lookup_state(asked, f"{root}/checkpoint", "balance", "account_id"), "account_id", "balance")


def live_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of all customers, asked from the state of the streaming order merge."""
    root = f"{checkpoint_root(spark)}/streams/{uuid.uuid4()}"
    log = fx.event_log(spark, d)
    events = fx.order_events(spark, d, log).withColumn("stage", F.lit(0))
    run_to_end(streaming_order_state(events, buckets=_buckets(log)), KeyedTable(f"{root}/table", "order_id", ORDER_OUTPUT), "update",
               f"{root}/checkpoint", log.batch_rows)
    asked = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("order_id"))
    return out(lookup_state(asked, f"{root}/checkpoint", "order", "order_id"), *ORDER_COLUMNS)


# --- the running flow: services that feed each other, until nothing moves -----------------
FLOW_SLICES = 2


def _flow(spark: SparkSession, d: str) -> Flow:
    """All services over shared topics; clients send requests in slices of time.

    Each slice goes round the loop (screen, ledger and back) before the next is sent.
    """
    root = f"{checkpoint_root(spark)}/flows/{uuid.uuid4()}"
    for key, value in ROCKSDB.items():
        spark.conf.set(key, value)
    rows = fx.table(spark, d, "events").count() // FLOW_SLICES
    flow = Flow(spark, FileTopics(f"{root}/topics"), root, {"availableNow": True}, state_buckets(rows))
    taken = stored(decode.valid(decode.order_intake(fx.order_requests(spark, d))).select(
        F.col("order_id").alias("key"), encode_json(S.ORDER).alias("value"), "offset", "timestamp"))
    topups = fx.balance_requests(spark, d).drop("topic", "partition")
    at = F.col("timestamp").cast("double")
    cuts = taken.select(at.alias("t")).approxQuantile("t", [i / FLOW_SLICES for i in range(1, FLOW_SLICES)], 0.01)
    place = sum((F.coalesce((at > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    seen = None
    for i in range(FLOW_SLICES):
        flow.submit(S.ORDERS_INPUT, taken.filter(place == i), i)
        flow.submit(S.BALANCES_INPUT, topups.filter(place == i), i)
        seen = flow.settle(seen)
    return flow


def flow_orders(spark: SparkSession, d: str) -> DataFrame:
    """Order table of the running flow; equals the unrolled lifecycle."""
    return out(_flow(spark, d).orders.read(spark), *FLOW_ORDER)


def flow_balances(spark: SparkSession, d: str) -> DataFrame:
    """Balance table of the running flow."""
    return out(_flow(spark, d).balances.read(spark), *_BALANCE)


def all_queries() -> dict[str, Query]:
    listed = [
        scan_raw_events, topic_range_scan, publish_order_json, accounts_dlq, account_messages_dlq, orders_output,
        frauds_output, fraud_report, cleared_orders_feed, ledger_results_feed, topic_round_trip, decode_accounts, decode_orders, decode_account_details, decode_money_edges, decode_date_edges, created_orders,
        topup_orders, decode_outcome_counts, order_dead_letters, request_keys, order_intake,
        prefixed_account_key, request_status, fraud_verdicts, cleared_orders, orders_finished,
        accounts_netcard, accounts_other_brand, branch_accounts, branch_orders,
        rekey_by_account, events_per_key, ledger_input_union, accounts_state,
        account_balances, ledger_results, ledger_results_pooled, account_balances_pooled, ledger_results_grid,
        lookup_accounts, lookup_requests, lookup_orders, lookup_balances, lookup_verdicts, lookup_bucketed, branch_counts,
        account_onboarding, fraud_screen, balance_ledger, balance_ledger_dead_letters,
        order_flow, order_lifecycle, order_lifecycle_raw, stream_fraud_verdicts,
        stream_ledger_results, stream_order_state, flow_orders, flow_balances,
        stream_ledger_restarted, live_balances, live_orders,
    ]
    return {q.__name__: q for q in listed} | {"order_state": order_state_query}
