"""Payment events derived from the test tables, as SQL that both engines can run.

Purchases are card orders, signups are balance top-ups, customers are account
requests.  The request texts carry defects on purpose (cut-off text, unknown
property, missing fields) so that strict decoding is exercised on all rows.
"""

from __future__ import annotations

import math
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow import schemas as S
from cardflow.functions.ids import prefixed_account_key
from cardflow.functions.json_text import encode_json
from cardflow.operators.ledger import as_order_events
from cardflow.plans.fraud import cleared_orders
from cardflow.plans.orders import orders_in_progress
from cardflow.session import checkpoint_root, use_utc
from cardflow.sources.topic_log import append_log, read_log

ORDERS_SQL = """
SELECT CAST(event_id AS STRING) AS order_id, CAST(user_id AS STRING) AS account_id,
       4000000000000000 + user_id AS credit_card_number,
       CAST(value AS DECIMAL(18,2)) AS order_amount, 'CREATED' AS payment_status,
       ts AS order_date, event_id AS event_seq
FROM events WHERE event_type = 'purchase'
"""

TOPUPS_SQL = """
SELECT CAST(event_id AS STRING) AS order_id, CAST(user_id AS STRING) AS account_id,
       4000000000000000 + user_id AS credit_card_number,
       CAST(value AS DECIMAL(18,2)) AS order_amount, 'ADD_BALANCE' AS payment_status,
       ts AS order_date, event_id AS event_seq
FROM events WHERE event_type = 'signup'
"""

ACCOUNT_REQUESTS_SQL = """
SELECT 'req-' || CAST(c_custkey AS STRING) AS key,
  CASE
    WHEN c_custkey % 17 = 0 THEN '{"accountName":"' || c_name
    WHEN c_custkey % 19 = 0 THEN '{"accountId":"x","accountName":"' || c_name
      || '","messageContent":"hi"}'
    WHEN c_custkey % 23 = 0 THEN '{"accountName":"' || c_name || '","creditCardNumber":"'
      || CAST(4000000000000000 + c_custkey AS STRING) || '","brandName":null}'
    ELSE '{"accountName":"' || c_name || '","creditCardNumber":'
      || CAST(4000000000000000 + c_custkey AS STRING) || ',"brandName":"' ||
         CASE c_mktsegment WHEN 'BUILDING' THEN 'NetCard' WHEN 'HOUSEHOLD' THEN 'NETCARD'
           ELSE c_mktsegment END || '"}'
  END AS value,
  c_custkey AS seq
FROM customer
"""

# {iso} and {ms} stand for the engine's own way to print a time.
ORDER_REQUESTS_SQL = """
SELECT 'client-' || CAST(user_id AS STRING) AS key,
  CASE
    WHEN event_id % 29 = 0 THEN '{"accountId":"' || CAST(user_id AS STRING)
    WHEN event_id % 31 = 0 THEN '{"accountId":"' || CAST(user_id AS STRING) || '","note":"x"}'
    WHEN event_id % 37 = 0 THEN '{"accountId":"' || CAST(user_id AS STRING)
      || '","orderAmount":' || amount || ',"creditLimit":5.5}'
    WHEN event_id % 41 = 0 THEN '{"accountId":null,"orderAmount":' || amount
      || ',"orderDate":' || {ms} || '}'
    WHEN event_id % 43 = 0 THEN '{"accountId":"' || CAST(user_id AS STRING)
      || '","orderAmount":"","orderDate":' || {ms} || '}'
    WHEN event_id % 2 = 0 THEN '{"accountId":"' || CAST(user_id AS STRING)
      || '","creditCardNumber":' || CAST(4000000000000000 + user_id AS STRING)
      || ',"orderAmount":' || amount || ',"orderDate":"' || {iso} || '"}'
    ELSE '{"accountId":"' || CAST(user_id AS STRING)
      || '","creditCardNumber":"' || CAST(4000000000000000 + user_id AS STRING)
      || '","orderAmount":"' || amount || '","orderDate":' || {ms} || '}'
  END AS value, ts, event_id AS seq
FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS amount
      FROM events WHERE event_type = 'purchase') purchases
"""

BALANCE_REQUESTS_SQL = """
SELECT 'client-' || CAST(user_id AS STRING) AS key,
  CASE
    WHEN event_id % 29 = 0 THEN '[' || CAST(user_id AS STRING) || ']'
    WHEN event_id % 31 = 0 THEN '{"accountId":"' || CAST(user_id AS STRING) || '"}'
    ELSE '{"accountId":"' || CAST(user_id AS STRING)
      || '","creditCardNumber":' || CAST(4000000000000000 + user_id AS STRING)
      || ',"balance":' || amount || ',"paymentStatus":"ignored"}'
  END AS value, ts, event_id AS seq
FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS amount
      FROM events WHERE event_type = 'signup') signups
"""

# Every account property, now and then with a value that does not read.
ACCOUNT_DETAILS_SQL = """
SELECT 'req-' || CAST(c_custkey AS STRING) AS key,
  '{"accountName":"' || c_name || '","userDocumentId":"doc-' || CAST(c_custkey AS STRING)
    || '","accountLastUpdate":' || CASE WHEN c_custkey % 17 = 0 THEN '"yesterday"'
      WHEN c_custkey % 5 = 0 THEN '"2024-01-02T03:04:05"' ELSE '[2024,1,2,3,4]' END
    || ',"creditCardNumber":' || CASE WHEN c_custkey % 7 = 0 THEN '"x"'
      ELSE CAST(4000000000000000 + c_custkey AS STRING) END
    || ',"securityCode":' || CASE WHEN c_custkey % 11 = 0 THEN '"abc"'
      WHEN c_custkey % 3 = 0 THEN 'null' ELSE CAST(c_custkey % 1000 AS STRING) END
    || ',"expirationDate":' || CASE WHEN c_custkey % 13 = 0 THEN '"soon"'
      WHEN c_custkey % 2 = 0 THEN '"2030-01-01"' ELSE '1893456000000' END
    || ',"brandName":"NetCard"}' AS value,
  c_custkey AS seq
FROM customer
"""

# Amounts at the edges: zeros at the end, many digits, exponents, too many decimals.
MONEY_EDGES_SQL = """
SELECT 'client-' || CAST(user_id AS STRING) AS key,
  '{"accountId":"a","orderAmount":' || CASE event_id % 6
    WHEN 0 THEN CAST(CAST(value AS DECIMAL(18,2)) AS STRING) || '0000000'
    WHEN 1 THEN '"' || CAST(event_id AS STRING) || '.1234567"'
    WHEN 2 THEN CAST(event_id AS STRING) || '0000000000000000000000'
    WHEN 3 THEN CAST(event_id AS STRING) || 'e-3'
    WHEN 4 THEN CAST(event_id AS STRING) || '.5e2'
    ELSE CAST(event_id AS STRING) || '.1000000000000004' END || '}' AS value,
  ts, event_id AS seq
FROM events
"""

# All events of a user as events of one order: some dated, some not, any status.
ORDER_EVENTS_SQL = """
SELECT CAST(user_id AS STRING) AS order_id,
       CASE WHEN event_type <> 'error' THEN 'acct-' || CAST(user_id AS STRING) END AS account_id,
       CASE WHEN event_type = 'view' THEN 4000000000000000 + event_id END AS credit_card_number,
       CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(value AS DECIMAL(18,2)) END
         AS order_amount,
       CASE event_type WHEN 'click' THEN 'CREATED' WHEN 'view' THEN 'NOT_FRAUD'
         WHEN 'purchase' THEN 'EXECUTED' WHEN 'signup' THEN 'NOT_EXECUTED' END AS payment_status,
       CASE WHEN event_type IN ('purchase', 'view') THEN ts END AS order_date,
       CAST(value AS DECIMAL(18,2)) AS credit_limit,
       event_id AS event_seq
FROM events
"""

_ISO = "date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss.SSSxxx\")"
_MS = "CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a file of a registered stream's log, and so of its smallest micro-batch.
STREAM_ROWS = 5_000
# Every micro-batch has a fixed cost: a longer log is read in about this many larger ones, of so many files each.
MICRO_BATCHES, BATCH_FILES = 10, 24


def stream_rows(rows: int) -> int:
    """Rows of a micro-batch over a log of so many rows."""
    return max(STREAM_ROWS, math.ceil(rows / MICRO_BATCHES))


def batch_rows(spark: SparkSession, sf_dir: str, name: str = "events") -> int:
    """Rows of a micro-batch of a registered stream over the table."""
    return stream_rows(table(spark, sf_dir, name).count())


class EventLog(str):
    """Path of a log that knows the rows of its table's micro-batches, so that these are counted once."""

    batch_rows: int


def event_log(spark: SparkSession, sf_dir: str, part: int = 0, parts: int = 1, path: str | None = None) -> EventLog:
    """Append the events, or one of so many slices of their time, to a log; equal times stay together.

    Streams of one query share it, so that their micro-batches cover the same times.
    """
    events = table(spark, sf_dir, "events")
    total = None
    if not isinstance(path, EventLog):
        total = events.count()
        path = EventLog(path or f"{checkpoint_root(spark)}/logs/{uuid.uuid4()}")
        path.batch_rows = stream_rows(total)
    file_rows = max(STREAM_ROWS, path.batch_rows // BATCH_FILES)
    if parts > 1:
        at = F.col("ts").cast("timestamp").cast("double")
        cuts = events.select(at.alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)
        place = sum((F.coalesce((at > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
        events, total = events.filter(place == part), None
    append_log(events, path, "ts", "event_id", file_rows=file_rows, rows=total)
    return path


def _run(
    spark: SparkSession, sf_dir: str, name: str, sql: str, log: str | None = None
) -> DataFrame:
    """Run a view's SQL on the table, or on a stream over its log."""
    source = f"parquet.`{sf_dir}/{name}.parquet`"
    if log is not None:
        source = f"cardflow_stream_{name}"
        # What one key brings into a task is sorted in pieces, whatever the rows of a micro-batch.
        stream = read_log(spark, log, table(spark, sf_dir, name).schema, streaming=True,
                          maxRowsPerTrigger=log.batch_rows if isinstance(log, EventLog) else batch_rows(spark, sf_dir, name),
                          position=f"{log}/position-{zlib.crc32(sql.encode())}.json")
        stream.createOrReplaceTempView(source)
    text = sql.replace(f"FROM {name}", f"FROM {source}")
    return use_utc(spark).sql(text.replace("{iso}", _ISO).replace("{ms}", _MS))


def _timed(df: DataFrame) -> DataFrame:
    instant = F.col("order_date").cast("timestamp")
    return df.withColumns(
        {
            "order_amount": F.col("order_amount").cast(S.MONEY),
            "credit_limit": F.lit(None).cast(S.MONEY),
            "order_date": F.timestamp_millis(F.unix_millis(instant)),
            "event_ts": instant,
        }
    )


def orders(spark: SparkSession, sf_dir: str, log: str | None = None) -> DataFrame:
    """Created card orders with order columns, ``event_ts`` and ``event_seq``."""
    return _timed(_run(spark, sf_dir, "events", ORDERS_SQL, log))


def topups(spark: SparkSession, sf_dir: str, log: str | None = None) -> DataFrame:
    """Top-ups in the shape of orders, status ADD_BALANCE."""
    limit = F.lit(S.TOPUP_CREDIT_LIMIT).cast(S.MONEY)
    df = _timed(_run(spark, sf_dir, "events", TOPUPS_SQL, log))
    return df.withColumn("credit_limit", limit)


def pooled(df: DataFrame) -> DataFrame:
    """The same events with a third of all accounts pooled into one."""
    shared = F.col("account_id").cast("bigint") % 3 == 0
    return df.withColumn("account_id", F.when(shared, "pooled").otherwise(F.col("account_id")))


def gridded(df: DataFrame) -> DataFrame:
    """The same events with prices on a grid above what top-ups bring: balances never forget."""
    topup = F.col("payment_status") == S.ADD_BALANCE
    small = F.when(F.col("event_seq") % 97 == 0, 70).otherwise(50)
    price = F.ceil(F.col("order_amount") / 100) * 100
    return df.withColumn("order_amount", F.when(topup, small).otherwise(price).cast(S.MONEY))


def _records(df: DataFrame, topic: str, timestamp: Column) -> DataFrame:
    return df.select(
        "key",
        "value",
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("seq").cast("bigint").alias("offset"),
        timestamp.alias("timestamp"),
    )


def account_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _run(spark, sf_dir, "customer", ACCOUNT_REQUESTS_SQL)
    return _records(df, S.ACCOUNTS_INPUT, F.timestamp_seconds(F.col("seq")))


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _run(spark, sf_dir, "events", ORDER_REQUESTS_SQL)
    return _records(df, S.ORDERS_INPUT, F.col("ts").cast("timestamp"))


def balance_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _run(spark, sf_dir, "events", BALANCE_REQUESTS_SQL)
    return _records(df, S.BALANCES_INPUT, F.col("ts").cast("timestamp"))


def account_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _run(spark, sf_dir, "customer", ACCOUNT_DETAILS_SQL)
    return _records(df, S.ACCOUNTS_INPUT, F.timestamp_seconds(F.col("seq")))


def money_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _run(spark, sf_dir, "events", MONEY_EDGES_SQL)
    return _records(df, S.ORDERS_INPUT, F.col("ts").cast("timestamp"))


DATE_EDGES_SQL = """
    SELECT CAST(event_id AS STRING) AS key, event_id AS seq, ts,
           concat('{"orderDate":"', CASE event_id % 6
             WHEN 0 THEN concat('2023-02-', 29 + (event_id DIV 6) % 3)
             WHEN 1 THEN concat(date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT')
             WHEN 2 THEN concat(date_format(ts, 'EEE, d MMM yyyy HH:mm:ss'), ' +0200')
             WHEN 3 THEN concat('2024-04-31T', date_format(ts, 'HH:mm:ss'), 'Z')
             WHEN 4 THEN concat('2024-', 13 + event_id % 80, '-01')
             ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") END, '"}') AS value
    FROM events"""


def date_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a date only: beyond a month's end, RFC 1123, impossible months, plain ones."""
    df = _run(spark, sf_dir, "events", DATE_EDGES_SQL)
    return _records(df, S.ORDERS_INPUT, F.col("ts").cast("timestamp"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the shape of a topic, keyed by user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        F.lit("events").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def account_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the second way in: one per customer, under a prefixed key."""
    message = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.col("c_mktsegment").alias("message_content"),
        F.col("c_custkey").alias("seq"),
    )
    keyed = message.select(
        prefixed_account_key(F.col("account_id")).alias("key"),
        encode_json(S.ACCOUNT_MESSAGE).alias("value"),
        "seq",
    )
    return _records(keyed, S.ACCOUNTS_INPUT, F.timestamp_seconds(F.col("seq")))


def order_events(spark: SparkSession, sf_dir: str, log: str | None = None) -> DataFrame:
    df = _run(spark, sf_dir, "events", ORDER_EVENTS_SQL, log)
    date = F.timestamp_millis(F.unix_millis(F.col("order_date").cast("timestamp")))
    return df.withColumn("order_date", date)


def _as_topic(df: DataFrame, stage: int) -> DataFrame:
    """Orders as text records of the order topic; the producers' order is the stage."""
    return df.select(
        F.col("order_id").alias("key"),
        encode_json(S.ORDER, epoch_millis=stage > 0).alias("value"),
        F.lit(S.ORDERS_INPUT).alias("topic"),
        F.lit(stage).alias("partition"),
        F.col("event_seq").alias("offset"),
        F.col("event_ts").alias("timestamp"),
    )


def orders_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order topic with created orders and their cleared copies."""
    created = orders(spark, sf_dir)
    return _as_topic(created, 0).unionByName(_as_topic(cleared_orders(created), 1))


def full_orders_topic(spark: SparkSession, sf_dir: str, changes: DataFrame) -> DataFrame:
    """Order topic with the ledger's outcomes as well."""
    return orders_topic(spark, sf_dir).unionByName(_as_topic(as_order_events(changes), 2))


def orders_output_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = orders_in_progress(cleared_orders(orders(spark, sf_dir)))
    return _as_topic(progress, 1).withColumn("topic", F.lit(S.ORDERS_OUTPUT))
