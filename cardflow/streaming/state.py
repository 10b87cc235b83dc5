"""Streaming operators: DataFrame -> DataFrame on unbounded input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from cardflow import schemas as S
from cardflow.functions.rules import stored_status
from cardflow.operators.ledger import fit_events
from cardflow.streaming import processors as P


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _packed(events: DataFrame, processor: P.Bucketed, bucket: Column) -> DataFrame:
    """Bucket and one text per event that holds the fields its processor reads."""
    kinds = dict(events.dtypes)
    fields = [F.unix_micros(F.col(f).cast("timestamp")) if kinds[f].startswith("timestamp") else F.col(f) for f in processor.FIELDS]
    return events.select(bucket, F.to_json(F.array(*[f.cast("string") for f in fields])).alias(P.PACKED))


def _applied(events: DataFrame, processor: P.Bucketed, schema: str, mode: str, bucket: Column) -> DataFrame:
    """Results of a processor over the packed events, a row each."""
    packs = _packed(events, processor, bucket).groupBy("bucket").transformWithState(
        statefulProcessor=processor, outputStructType=f"{P.PACKS} string", outputMode=mode, timeMode="None")
    row = F.explode(F.from_json(P.PACKS, "array<array<string>>")).alias("row")

    def field(i: int, name: str, kind: str) -> Column:
        text = F.col("row")[i]
        return (F.timestamp_micros(text.cast("bigint")) if kind == "timestamp" else text.cast(kind)).alias(name)

    return packs.select(row).select(*[field(i, *part.split(" ")) for i, part in enumerate(schema.split(", "))])


def streaming_ledger(events: DataFrame, piece: int = P.PIECE, buckets: int = P.BUCKETS) -> DataFrame:
    """Ledger changes, one row per event (append); see ``ledger_changes``.

    ``event_seq`` is a long here.  Accounts are dealt to ``buckets`` that share their state's
    value, so one bucket's events of a micro-batch meet in one task, which holds ``piece`` of them
    at a time.  A bucket with news is read and written whole; a checkpoint keeps its number of buckets.
    """
    processor = P.LedgerProcessor(S.ADD_BALANCE, S.EXECUTED, S.NOT_EXECUTED, piece)
    return _applied(fit_events(events), processor, P.LEDGER_OUTPUT, "Append", _bucket("account_id", buckets))


def streaming_order_state(events: DataFrame, piece: int = P.PIECE, buckets: int = P.BUCKETS) -> DataFrame:
    """Order state after every micro-batch that touches the order (update).

    ``stage`` and ``event_seq`` order the events of one micro-batch.  For ``piece`` and ``buckets``
    see the ledger.
    """
    known = events.filter(F.col("order_id").isNotNull()).withColumn("payment_status", stored_status(F.col("payment_status")))
    return _applied(known, P.OrderStateProcessor(piece), P.ORDER_OUTPUT, "Update", _bucket("order_id", buckets))


def read_state(spark: SparkSession, checkpoint: str, variable: str | None = None, batch: int | None = None) -> DataFrame:
    """Live keyed state of a streaming query, for bulk or single lookups.

    Name the ``variable`` (``balance`` or ``order``) for the stateful processors;
    the latest-per-key aggregates have none.
    """
    return _by_key(_state(spark, variable, batch).load(checkpoint))


def _by_key(state: DataFrame, *more: str) -> DataFrame:
    """State of buckets as a row per key: ``more`` columns, key, value and whether the last write set it."""
    value = state.schema["value"].dataType
    if P.BUCKET_ROWS not in value.names:
        return state
    key, *fields, changed = value[P.BUCKET_ROWS].dataType.elementType.names
    rows = state.select(*more, "partition_id", F.explode(F.col("value")[P.BUCKET_ROWS]).alias("row"))
    return rows.select(*more, F.struct(F.col("row")[key].alias(key)).alias("key"),
                       F.struct(*[F.col("row")[f].alias(f) for f in fields]).alias("value"), "partition_id", F.col("row")[changed].alias(changed))


def _state(spark: SparkSession, variable: str | None, batch: int | None) -> DataFrameReader:
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader if variable is None else reader.option("stateVarName", variable)


def lookup_state(asked: DataFrame, checkpoint: str, variable: str, key: str, batch: int | None = None) -> DataFrame:
    """Asked keys with the live state of a running query, null where it has none.

    One bulk join with the state store, as it was after micro-batch ``batch`` or is after the last
    one; the query need not stop.
    """
    state = read_state(asked.sparkSession, checkpoint, variable, batch)
    return asked.join(state.select(F.col("key")[key].alias(key), "value.*"), key, "left")


def state_changes(spark: SparkSession, checkpoint: str, variable: str, key: str, first: int, last: int | None = None) -> DataFrame:
    """Changes of the state from micro-batch ``first`` on: batch_id, change_type, key and value.

    Needs changelog checkpoints (``CHANGELOG`` in the session).
    """
    reader = _state(spark, variable, None).option("readChangeFeed", True).option("changeStartBatchId", first)
    if last is not None:
        reader = reader.option("changeEndBatchId", last)
    found = _by_key(reader.load(checkpoint), "batch_id", "change_type")
    if "changed" in found.columns:
        found = found.filter("changed")
    return found.select("batch_id", "change_type", F.col("key")[key].alias(key), "value.*")
