"""Offset-addressed topics: ranges, admission, restarts and broken attempts."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.sources import fixtures as fx
from cardflow.sources.topic_log import OFFSET, append_log, read_log
from tests.conftest import DATA

SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("at", T.TimestampType())])
NUMBERED = T.StructType([*SCHEMA.fields, T.StructField(OFFSET, T.LongType())])


def numbers(spark, first, last):
    n = spark.range(first, last).select(F.col("id").alias("n"), F.concat(F.lit("é"), "id").alias("text"))
    return n.withColumn("at", F.timestamp_seconds("n")).repartition(5)


def test_any_range_of_offsets(spark, tmp_path):
    log = f"{tmp_path}/log"
    append_log(numbers(spark, 0, 250), log, "n", file_rows=40)
    append_log(numbers(spark, 250, 300), log, "n", file_rows=40)
    whole = sorted(map(tuple, read_log(spark, log, NUMBERED).collect()))
    assert [(r[0], r[1], r[3]) for r in whole] == [(i, f"é{i}", i) for i in range(300)]
    assert [r[2].second for r in whole[:70]] == [i % 60 for i in range(70)]
    for start, end in ((0, 1), (37, 203), (249, 251), (299, 999), (300, 400), (5, 5)):
        got = read_log(spark, log, NUMBERED, startingOffset=start, endingOffset=end)
        assert sorted(r.n for r in got.collect()) == list(range(start, min(end, 300)))
    assert read_log(spark, f"{tmp_path}/none", SCHEMA).count() == 0


def batches(stream, checkpoint, kill_at=None):
    """Run until the input is used up; the numbers of each micro-batch."""
    seen = []

    def sink(batch, n):
        if n == kill_at:
            raise RuntimeError("killed")
        seen.append((n, sorted(r.n for r in batch.collect())))

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [rows for _, rows in seen if rows]


def test_micro_batches_of_a_fixed_size_in_order(spark, tmp_path):
    log, options = f"{tmp_path}/log", {"maxRowsPerTrigger": 100, "position": f"{tmp_path}/position"}
    append_log(numbers(spark, 0, 330), log, "n", file_rows=33)
    got = batches(read_log(spark, log, SCHEMA, streaming=True, **options), f"{tmp_path}/cp")
    assert [n for rows in got for n in rows] == list(range(330)) and len(got) >= 4
    assert all(0 < len(rows) <= 100 for rows in got)
    append_log(numbers(spark, 330, 350), log, "n")
    assert batches(read_log(spark, log, SCHEMA, streaming=True, **options), f"{tmp_path}/cp") == [list(range(330, 350))]
    assert batches(read_log(spark, log, SCHEMA, streaming=True, **options), f"{tmp_path}/cp") == []


def test_killed_stream_reads_its_batch_again(spark, tmp_path):
    log, options = f"{tmp_path}/log", {"maxRowsPerTrigger": 60, "position": f"{tmp_path}/position"}
    append_log(numbers(spark, 0, 200), log, "n", file_rows=50)
    with pytest.raises(Exception, match="killed"):
        batches(read_log(spark, log, SCHEMA, streaming=True, **options), f"{tmp_path}/cp", kill_at=2)
    got = batches(read_log(spark, log, SCHEMA, streaming=True, **options), f"{tmp_path}/cp")
    rest = [n for rows in got for n in rows]
    assert rest == list(range(rest[0], 200)) and 0 < rest[0] < 200


def test_attempt_without_its_mark_is_not_read(spark, tmp_path):
    log = f"{tmp_path}/log"
    append_log(numbers(spark, 0, 10), log, "n")
    append_log(numbers(spark, 10, 20), log, "n")
    os.remove(f"{log}/segment-00000001/_SUCCESS")
    assert read_log(spark, log, SCHEMA).count() == 10
    with pytest.raises(Exception, match="position"):
        batches(read_log(spark, log, SCHEMA, streaming=True, maxRowsPerTrigger=5), f"{tmp_path}/cp")


def test_equal_times_stay_together(spark, tmp_path):
    log = f"{tmp_path}/log"
    events = fx.table(spark, DATA, "events").withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    append_log(events, log, "ts", "event_id", file_rows=100)
    files = spark.read.parquet(f"{log}/segment-00000000").select("ts", F.input_file_name().alias("file"))
    assert files.groupBy("ts").agg(F.countDistinct("file").alias("n")).filter("n > 1").count() == 0
    assert files.select("file").distinct().count() > 1
    assert read_log(spark, log, events.schema).exceptAll(events).count() == 0


def test_micro_batches_grow_with_the_log(spark, tmp_path, monkeypatch):
    """A registered stream reads a log of any length in about as many micro-batches, each row once."""
    monkeypatch.setattr(fx, "STREAM_ROWS", 10)
    log = fx.event_log(spark, DATA)
    seen = []
    query = (fx.orders(spark, DATA, log).writeStream
             .foreachBatch(lambda batch, n: seen.append([r.order_id for r in batch.select("order_id").collect()]))
             .option("checkpointLocation", f"{tmp_path}/cp").start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert fx.MICRO_BATCHES / 2 < len(seen) <= 2 * fx.MICRO_BATCHES
    assert sorted(i for ids in seen for i in ids) == sorted(r.order_id for r in fx.orders(spark, DATA).select("order_id").collect())
