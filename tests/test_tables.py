"""Stored branches and bucketed state: what is scanned, moved and counted."""

from pyspark.sql import functions as F

from cardflow.operators.keyed import lookup, stored_branches
from cardflow.operators.state_table import StateTable
from cardflow.plans import accounts, fraud
from cardflow.sources import fixtures as fx
from tests.conftest import DATA


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_branches_in_one_pass(spark):
    numbers = spark.range(0, 100, 1, 4).withColumn("n", F.when(F.col("id") < 90, F.col("id")))
    parts = stored_branches(numbers, even=F.col("n") % 2 == 0, small=F.col("n") < 30, rest=F.col("n") < 80)
    assert parts.counts == {"even": 45, "small": 15, "rest": 25}
    assert sorted(r.n for r in parts.of("small").collect()) == list(range(1, 30, 2))
    assert parts.of("even", "rest").groupBy("branch").count().count() == 2
    none = stored_branches(numbers.filter("id < 0"), even=F.col("n") % 2 == 0, rest=F.lit(True))
    assert none.counts == {"even": 0, "rest": 0} and none.of("rest").count() == 0


def test_outputs_scan_their_branch_only(spark):
    done = accounts.onboarding(fx.account_requests(spark, DATA))
    screen = fraud.fraud_screen(fx.orders(spark, DATA), "order_id", F.col("event_seq"))
    assert sum(done.counts.values()) == fx.account_requests(spark, DATA).count()
    for output in (done.accounts, done.requests, done.dead_letters, screen.verdicts, screen.cleared,
                   screen.frauds, screen.dead_letters):
        plan = plan_of(output)
        assert plan.count("FileScan") == 1 and "PartitionFilters: [branch" in plan.replace("isnotnull(branch#", "branch#")
        assert "customer.parquet" not in plan and "events.parquet" not in plan
    assert screen.cleared.count() == screen.counts["clean"]
    assert screen.frauds.count() == screen.counts["night"]


def test_lookup_does_not_move_the_state(spark):
    state = spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    asked = spark.range(0, 3000, 3, 5).select(F.col("id").cast("string").alias("k"))
    asked = asked.unionByName(spark.createDataFrame([(None,), ("0",), ("0",)], "k string"))
    table = StateTable.write(state, "k", buckets=6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = table.lookup(asked)
        plan = plan_of(found)
        (scan,) = [line for line in plan.splitlines() if "FileScan" in line]
        assert "Bucketed: true" in scan and "SelectedBucketsCount: 6 out of 6" in scan
        # The only exchange by key is that of the asked side, which is a range, not a file.
        assert plan.count("Exchange hashpartitioning(k") == 1
        expected = sorted(map(tuple, lookup(asked, state, "k").collect()), key=repr)
        assert sorted(map(tuple, found.collect()), key=repr) == expected
        assert sorted(map(tuple, table.lookup(asked, hot_rows=2).collect()), key=repr) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        table.drop()
