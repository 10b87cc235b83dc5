"""Streams give the batch result when their input arrives in event order."""

from pyspark.sql import functions as F

from cardflow import schemas as S
from cardflow.functions.json_text import encode_json
from cardflow.operators import ledger
from cardflow.operators.decode import decode_accounts, order_intake, valid
from cardflow.operators.keyed import latest_per_key
from cardflow.operators.order_state import order_state
from cardflow.plans import accounts, lifecycle
from cardflow.sources import fixtures as fx
from cardflow.streaming import processors
from cardflow.streaming.flow import LETTER, REPORT, Flow
from cardflow.session import CHANGELOG, PARTITIONS, STATE_ROWS, state_partitions
from cardflow.streaming.state import lookup_state, read_state, state_changes, streaming_ledger, streaming_order_state
from cardflow.streaming.tables import FileTopics, KeyedTable, run_to_end
from tests.conftest import DATA


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=repr)


def slices(df, order, n, path):
    """Write a frame as n folders of consecutive rows, for a stream to read one by one."""
    bounds = df.approxQuantile(order, [i / n for i in range(1, n)], 0.0)
    edges = [float("-inf"), *bounds, float("inf")]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = df.filter((F.col(order) > low) & (F.col(order) <= high))
        part.coalesce(1).write.mode("overwrite").parquet(f"{path}/part{i}")
        yield f"{path}/part{i}"


def run(query_writer, checkpoint, sink):
    q = (query_writer.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def feed_in_slices(spark, df, order, n, tmp_path, make, mode, table):
    """Restart the query from its checkpoint after every slice."""
    landing = f"{tmp_path}/landing"
    for i, part in enumerate(slices(df, order, n, f"{tmp_path}/parts")):
        spark.read.parquet(part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(df.schema).parquet(landing)
        run(make(stream).writeStream.outputMode(mode), f"{tmp_path}/cp",
            lambda batch, n: table.write(batch, n))


def test_latest_per_key_stream_equals_batch(spark, tmp_path):
    raw = fx.raw_events(spark, DATA).drop("topic", "partition")
    table = KeyedTable(f"{tmp_path}/t", "key", "key string, value string")
    feed_in_slices(
        spark, raw, "offset", 3, tmp_path,
        lambda s: latest_per_key(s, "key", ["value"], F.col("offset")), "update", table)
    expected = rows(latest_per_key(raw, "key", ["value"], F.col("offset")), "key", "value")
    assert rows(table.read(spark), "key", "value") == expected
    table.compact(spark)
    assert rows(table.read(spark), "key", "value") == expected
    assert not table.commits.batches("log") and len(list((tmp_path / "t" / "data").iterdir())) == 1
    table.compact(spark)
    table.write(spark.createDataFrame([("new", "1")], "key string, value string"), 99)
    assert rows(table.read(spark), "key", "value") == sorted([*expected, ("new", "1")])


def test_attempt_that_broke_off_is_never_read(spark, tmp_path):
    one = spark.createDataFrame([("k", "v")], "key string, value string")
    topics = FileTopics(str(tmp_path))
    stream = topics.read(spark, "t")
    # What an attempt that died while writing leaves behind.
    one.write.parquet(f"{tmp_path}/t/data/attempt=dead/batch=0")
    record = one.withColumns({"partition": F.lit(0), "offset": F.lit(0).cast("long"),
                              "timestamp": F.current_timestamp()})
    for _ in range(2):
        topics.append("t", record, "p", 0)
    seen = []
    query = (stream.writeStream.foreachBatch(lambda b, n: seen.extend(b.collect()))
             .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    assert [(r.key, r.value) for r in seen] == [("k", "v")]
    table = topics.table("t")
    assert table.rows() == table.read(spark, S.TOPIC_SCHEMA).count() == 1
    assert table.sweep() == 1 and table.read(spark, S.TOPIC_SCHEMA).count() == 1


def test_ledger_stream_equals_batch(spark, tmp_path):
    events = lifecycle.ledger_feed(fx.orders(spark, DATA), fx.topups(spark, DATA))
    ordered = events.withColumn("at", F.unix_micros("event_ts").cast("double")).cache()
    table = KeyedTable(
        f"{tmp_path}/t", "order_id",
        "order_id string, account_id string, balance decimal(38,6), payment_status string")
    feed_in_slices(spark, ordered, "at", 4, tmp_path, streaming_ledger, "append", table)
    columns = ("order_id", "account_id", "balance", "payment_status")
    assert rows(table.read(spark), *columns) == rows(ledger.ledger_changes(events), *columns)
    state = read_state(spark, f"{tmp_path}/cp", "balance")
    live = sorted((r.key.account_id, r.value.balance) for r in state.collect())
    assert live == rows(ledger.account_balances(events), "account_id", "balance")


def test_order_state_stream_equals_batch(spark, tmp_path):
    events = fx.order_events(spark, DATA).withColumn("stage", F.lit(0)).cache()
    money = {c: F.col(c).cast(S.MONEY) for c in ("order_amount", "credit_limit")}
    events = events.withColumns(money)
    schema = ("order_id string, account_id string, credit_card_number bigint, order_amount "
              "decimal(38,6), payment_status string, order_date timestamp, "
              "credit_limit decimal(38,6)")
    table = KeyedTable(f"{tmp_path}/t", "order_id", schema)
    feed_in_slices(spark, events, "event_seq", 3, tmp_path, streaming_order_state, "update", table)
    columns = [c.split()[0] for c in schema.split(", ")]
    expected = order_state(events, F.col("event_seq"))
    assert rows(table.read(spark), *columns) == rows(expected, *columns)


def test_running_flow_equals_lifecycle(spark, tmp_path):
    """All services over shared topics, run until nothing is left to do."""
    topics = FileTopics(f"{tmp_path}/topics")
    flow = Flow(spark, topics, f"{tmp_path}/flow", {"availableNow": True})
    raw_orders, raw_topups = fx.order_requests(spark, DATA), fx.balance_requests(spark, DATA)
    taken = valid(order_intake(raw_orders))
    created = taken.select(
        F.col("order_id").alias("key"), encode_json(S.ORDER).alias("value"), "offset", "timestamp")
    flow.submit(S.ORDERS_INPUT, created, 0)
    flow.submit(S.BALANCES_INPUT, raw_topups.drop("topic", "partition"), 0)
    flow.submit(S.ACCOUNTS_INPUT, fx.account_requests(spark, DATA).drop("topic", "partition"), 0)
    # The chain created -> cleared -> in progress -> paid needs the queries in this order.
    steps = (flow.start_accounts, flow.start_screen, flow.start_report, flow.start_progress,
             flow.start_ledger, flow.start_ledger_refusals, flow.start_order_table)
    for start in steps:
        start().awaitTermination()
    columns = ("order_id", "account_id", "credit_card_number", "order_amount", "payment_status",
               "credit_limit")
    expected = lifecycle.lifecycle_from_requests(raw_orders, raw_topups)
    assert rows(flow.orders.read(spark), *columns) == rows(expected, *columns)
    # Nothing is left: another round changes nothing.
    for start in steps:
        start().awaitTermination()
    assert rows(flow.orders.read(spark), *columns) == rows(expected, *columns)

    requests = accounts.request_status(decode_accounts(fx.account_requests(spark, DATA)))
    assert flow.requests.read(spark).count() == requests.count()
    reports = flow.reports.read(spark, REPORT)
    fraud = flow.verdicts.read(spark).filter("value = 'FRAUD'")
    assert sorted(r.key for r in reports.collect()) == sorted(r.key for r in fraud.collect())
    assert all(r.report.startswith("Authorities warned {") for r in reports.collect())
    letters = flow.dead_letters.read(spark, LETTER)
    assert {r.reason for r in letters.select("reason").distinct().collect()} >= {
        "unknown_property", "malformed_json", "null_order_date", "null_key", "null_amount"}


def test_one_key_with_a_whole_micro_batch(spark, tmp_path):
    """A key's rows are sorted in small pieces and give the batch result."""
    columns = ("order_id", "account_id", "balance", "payment_status")
    feed = lifecycle.ledger_feed(fx.orders(spark, DATA), fx.topups(spark, DATA))
    feed = feed.withColumn("account_id", F.lit("one")).orderBy(F.rand(3)).cache()
    feed.repartition(1).write.parquet(f"{tmp_path}/in")
    table = KeyedTable(f"{tmp_path}/t", "order_id",
                       "order_id string, account_id string, balance decimal(38,6), payment_status string")
    stream = spark.readStream.schema(feed.schema).parquet(f"{tmp_path}/in")
    run(streaming_ledger(stream, piece=7).writeStream.outputMode("append"), f"{tmp_path}/cp",
        lambda batch, n: table.write(batch, n))
    assert feed.count() > 70
    assert rows(table.read(spark), *columns) == rows(ledger.ledger_changes(feed), *columns)


def test_pieces_merge_in_order():
    from random import Random

    from pyspark.sql import Row

    rng = Random(1)
    made = [Row(a=rng.randrange(50), b=i, c=None) for i in range(500)]
    for piece in (1, 7, 499, 500, 501):
        held = [0]

        def counted(held=held):
            for r in made:
                held[0] += 1
                yield r

        got = list(processors.in_order(counted(), ("a", "b", "c"), lambda e: e[:2], piece))
        assert got == sorted(map(tuple, made), key=lambda e: e[:2]) and held == [500]
    assert list(processors.in_order(iter([]), ("a",), lambda e: e, 5)) == []


def test_killed_ledger_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    """Sinks that die leave state, table and input as they were; another layout replays the batch.

    State at an earlier micro-batch and the changes since can be read from the checkpoint.
    """
    for key, value in CHANGELOG.items():
        spark.conf.set(key, value)
    monkeypatch.setattr(fx, "STREAM_ROWS", 250)
    log, checkpoint = fx.event_log(spark, DATA), f"{tmp_path}/cp"
    table = KeyedTable(f"{tmp_path}/t", "order_id",
                       "order_id string, account_id string, balance decimal(38,6), payment_status string")
    died = []

    def attempt(layout):
        feed = lifecycle.ledger_feed(fx.orders(spark, DATA, log), fx.topups(spark, DATA, log))

        def sink(batch, n):
            if n in (1, 3) and n not in died:
                died.append(n)
                if n == 3:  # after half of the work
                    table.write(batch, n)
                raise RuntimeError("killed")
            table.write(batch, n)

        query = (streaming_ledger(feed.repartition(layout)).writeStream.outputMode("append").foreachBatch(sink)
                 .option("checkpointLocation", checkpoint).start())
        try:
            query.processAllAvailable()
        except Exception as e:
            assert "killed" in str(e)
        finally:
            query.stop()

    for layout in (2, 5, 3):
        attempt(layout)
    assert died == [1, 3]
    columns = ("order_id", "account_id", "balance", "payment_status")
    events = lifecycle.ledger_feed(fx.orders(spark, DATA), fx.topups(spark, DATA))
    assert rows(table.read(spark), *columns) == rows(ledger.ledger_changes(events), *columns)

    final = rows(ledger.account_balances(events), "account_id", "balance")
    asked = spark.createDataFrame([(a,) for a, _ in final] + [("nobody",)], "account_id string")
    assert rows(lookup_state(asked, checkpoint, "balance", "account_id")) == sorted([*final, ("nobody", None)], key=repr)
    first = rows(lookup_state(asked, checkpoint, "balance", "account_id", batch=0))
    assert first != rows(lookup_state(asked, checkpoint, "balance", "account_id")) and len(first) == len(final) + 1
    known = {a: b for a, b in first if b is not None}
    for change in sorted(state_changes(spark, checkpoint, "balance", "account_id", 1).collect()):
        assert change.change_type == "update"
        known[change.account_id] = change.balance
    assert sorted(known.items()) == final


def test_results_appear_between_ticks(spark, tmp_path):
    """With a processing-time trigger, a table follows its topic at the next tick, and idle ticks pass."""
    import time

    topics = FileTopics(f"{tmp_path}/topics")
    flow = Flow(spark, topics, f"{tmp_path}/flow", {"processingTime": "1 second"})
    requests = fx.account_requests(spark, DATA).drop("topic", "partition")
    expected = accounts.request_status(decode_accounts(fx.account_requests(spark, DATA)))
    n, halves = expected.count(), (F.col("offset") % 2 == 0, F.col("offset") % 2 == 1)
    flow.submit(S.ACCOUNTS_INPUT, requests.filter(halves[0]), 0)
    query = flow.start_accounts()
    try:
        counts = []
        for half in (None, halves[1]):
            if half is not None:
                flow.submit(S.ACCOUNTS_INPUT, requests.filter(half), 1)
            begin = time.time()
            while flow.requests.read(spark).count() <= (counts[-1] if counts else 0) and time.time() - begin < 60:
                time.sleep(0.5)
            assert query.isActive
            counts.append(flow.requests.read(spark).count())
        assert 0 < counts[0] < counts[1] == n
        ticks = [p.batchId for p in query.recentProgress if p.numInputRows]
        assert len(ticks) == 2
    finally:
        query.stop()


def test_state_partitions_follow_the_rows(spark, tmp_path):
    """Small micro-batches don't open and commit all partitions that the session has for large shuffles."""
    raw = fx.raw_events(spark, DATA).drop("topic", "partition")
    raw.write.parquet(f"{tmp_path}/in")
    given = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, "60")
    try:
        stream = latest_per_key(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in"), "key", ["value"], F.col("offset"))
        table = KeyedTable(f"{tmp_path}/t", "key", "key string, value string")
        read = run_to_end(stream, table, "update", f"{tmp_path}/cp", 1000)
        assert spark.conf.get(PARTITIONS) == "60"
        made = [p for p in (tmp_path / "cp" / "state" / "0").iterdir() if p.name.isdigit()]
        assert len(made) == min(60, spark.sparkContext.defaultParallelism)
        with state_partitions(spark, 30 * STATE_ROWS) as n:
            assert n == max(30, spark.sparkContext.defaultParallelism) and spark.conf.get(PARTITIONS) == str(n)
        with state_partitions(spark, 1000 * STATE_ROWS) as n:
            assert n == 60
    finally:
        spark.conf.set(PARTITIONS, given)
    assert rows(read, "key", "value") == rows(latest_per_key(raw, "key", ["value"], F.col("offset")), "key", "value")


def test_orders_share_the_state_of_a_bucket(spark, tmp_path):
    """A bucket costs one value, whatever its orders; lookups and changes are by order as before."""
    spark.conf.set(next(iter(CHANGELOG)), "true")
    money = {c: F.col(c).cast(S.MONEY) for c in ("order_amount", "credit_limit")}
    events = fx.order_events(spark, DATA).withColumns({"stage": F.lit(0), **money}).cache()
    late = events.filter("event_seq % 5 = 0 AND CAST(order_id AS INT) < 5").withColumn("event_seq", F.col("event_seq") + 10**6)
    checkpoint, seen = f"{tmp_path}/cp", []
    for part in (events, late):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        run(streaming_order_state(stream, piece=9, buckets=3).writeStream.outputMode("update"), checkpoint,
            lambda batch, n: seen.append(sorted(r.order_id for r in batch.select("order_id").collect())))
    orders = sorted(r.order_id for r in events.select("order_id").distinct().collect())
    touched = sorted(r.order_id for r in late.select("order_id").distinct().collect())
    assert seen == [orders, touched] and 0 < len(touched) < len(orders)
    raw = spark.read.format("statestore").option("stateVarName", "order").load(checkpoint)
    assert raw.count() <= 3 < len(orders)
    asked = spark.createDataFrame([(o,) for o in [*orders, "nobody"]], "order_id string")
    live = lookup_state(asked, checkpoint, "order", "order_id")
    columns = live.columns
    whole = events.unionByName(late)
    expected = rows(order_state(whole, F.col("event_seq")), *columns)
    assert rows(live.filter("order_id <> 'nobody'"), *columns) == expected
    assert live.filter("order_id = 'nobody' AND payment_status IS NULL").count() == 1
    assert sorted(r.order_id for r in state_changes(spark, checkpoint, "order", "order_id", 1).collect()) == touched


def test_packed_rows_keep_any_value(spark, tmp_path, monkeypatch):
    """Rows pass to the processors and back as texts: one column, and nothing of a value is lost."""
    odd = ['q"uote', "back\\slash", "line\nfeed", "tab\t,[]{}", "é \U0001f600", "", " ", "null"]
    made = [(o, i, a, d) for i, o in enumerate(odd) for a, d in
            [(None, None), ("-12.345678", "1901-02-03 04:05:06.789123"), ("0.000001", "2024-06-07 08:09:10")]]
    events = (spark.createDataFrame(made, "order_id string, n int, amount string, at string")
              .select("order_id", F.concat("order_id", F.lit("/a")).alias("account_id"), (F.lit(2) ** 62).cast("bigint").alias("credit_card_number"),
                      F.col("amount").cast(S.MONEY).alias("order_amount"), F.lit(S.CREATED).alias("payment_status"),
                      F.col("at").cast("timestamp").alias("order_date"), F.lit(None).cast(S.MONEY).alias("credit_limit"),
                      F.lit(0).alias("stage"), F.monotonically_increasing_id().alias("event_seq")).cache())
    events.write.parquet(f"{tmp_path}/in")
    stream = streaming_order_state(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), buckets=2)
    assert stream.columns[0] == "order_id" and processors.PACKED not in stream.columns
    table = KeyedTable(f"{tmp_path}/t", "order_id", processors.ORDER_OUTPUT)
    run(stream.writeStream.outputMode("update"), f"{tmp_path}/cp", lambda batch, n: table.write(batch, n))
    columns = [c.split(" ")[0] for c in processors.ORDER_OUTPUT.split(", ")]
    expected = rows(order_state(events, F.struct("stage", "event_seq")), *columns)
    assert rows(table.read(spark), *columns) == expected and len(expected) == len(odd)
    state = read_state(spark, f"{tmp_path}/cp", "order").select("key.order_id", "value.*")
    assert rows(state, *columns) == expected


def test_log_counts_its_table_once(spark):
    log = fx.event_log(spark, DATA, 0, 2)
    assert log.batch_rows == fx.batch_rows(spark, DATA)
    assert fx.event_log(spark, DATA, 1, 2, log) is log
