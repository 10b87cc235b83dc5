"""Fraud screen, order state, lookups and the lifecycle on hand-written rows."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cardflow.functions.ids import prefixed_account_key
from cardflow.functions.rules import stored_status
from cardflow.operators import keyed
from cardflow.operators.order_state import order_state
from cardflow.plans import fraud, lifecycle

DAY = datetime(2024, 1, 1)
ORDER = ("order_id string, account_id string, credit_card_number bigint, "
         "order_amount decimal(38,6), payment_status string, order_date timestamp, "
         "credit_limit decimal(38,6), event_ts timestamp, event_seq bigint")


def order(oid, date, amount=1, status="CREATED", limit=None, seq=0, account="a", ts=DAY):
    limit = None if limit is None else Decimal(limit)
    return (oid, account, 4, Decimal(amount), status, date, limit, ts, seq)


@pytest.mark.parametrize(
    "after_midnight, expected",
    [(timedelta(0), "NOT_FRAUD"), (timedelta(milliseconds=1), "FRAUD"),
     (timedelta(microseconds=500), "NOT_FRAUD"),
     (timedelta(hours=4) - timedelta(milliseconds=1), "FRAUD"), (timedelta(hours=4), "NOT_FRAUD"),
     (timedelta(hours=-20), "NOT_FRAUD"), (timedelta(hours=-21), "FRAUD")],
)
def test_night_window(spark, after_midnight, expected):
    df = spark.createDataFrame([order("o", DAY + after_midnight)], ORDER)
    (row,) = fraud.fraud_verdicts(df, "order_id", F.col("event_seq")).collect()
    assert row.value == expected


def test_before_the_epoch(spark):
    df = spark.createDataFrame([order("o", datetime(1969, 12, 31, 3))], ORDER)
    (row,) = fraud.fraud_verdicts(df, "order_id", F.col("event_seq")).collect()
    assert row.value == "FRAUD"


def test_undated_order_is_a_dead_letter(spark):
    df = spark.createDataFrame([order("o", None)], ORDER)
    screen = fraud.fraud_screen(df, "order_id", F.col("event_seq"))
    assert screen.verdicts.count() == screen.cleared.count() == screen.frauds.count() == 0
    assert [r.reason for r in screen.dead_letters.collect()] == ["null_order_date"]


def test_stored_status(spark):
    cases = {"NOT_FRAUD": "PROGRESS", "EXECUTED": "COMPLETED-EXECUTED", "CREATED": "CREATED",
             "NOT_EXECUTED": "COMPLETED-NOT_EXECUTED", None: None, "odd": "odd"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in df.select(stored_status(F.col("s"))).collect()] == list(cases.values())


def merged(events):
    """The order merge as a plain loop."""
    fields = dict.fromkeys(("account", "amount", "date", "limit", "status"))
    for e in sorted(events, key=lambda e: e[8]):
        fields["account"] = e[1] if fields["account"] is None else fields["account"]
        fields["amount"] = e[3] if fields["amount"] is None else fields["amount"]
        fields["date"] = e[5] if fields["date"] is None else fields["date"]
        if fields["date"] is None:
            fields["limit"] = e[6]
        fields["status"] = e[4]
    return tuple(fields.values())


def test_credit_limit_rule(spark):
    events = [order("late", None, limit=5, seq=0), order("late", None, limit=7, seq=1),
              order("late", DAY, limit=9, seq=2), order("late", DAY, limit=0, seq=3),
              order("early", DAY, limit=5, seq=0), order("early", None, limit=6, seq=1),
              order("mixed", None, limit=5, seq=0), order("mixed", DAY, limit=6, seq=1),
              order("mixed", None, limit=8, seq=2), order("never", None, limit=3, seq=0),
              order("never", None, limit=None, seq=1)]
    got = order_state(spark.createDataFrame(events, ORDER), F.col("event_seq")).collect()
    limits = {r.order_id: r.credit_limit for r in got}
    assert limits == {"late": 7, "early": None, "mixed": 5, "never": None}


@pytest.mark.parametrize("seed, hot_rows", [(1, 10**9), (2, 50)])
def test_order_state_equals_loop(spark, seed, hot_rows):
    rng = random.Random(seed)
    events = []
    for i in range(600):
        oid = "hot" if rng.random() < 0.3 else f"o{rng.randrange(60)}"
        date = DAY + timedelta(hours=i) if rng.random() < 0.4 else None
        status = rng.choice(["CREATED", "PROGRESS", "x", None])
        account = rng.choice([None, "a", "b"])
        events.append(order(oid, date, rng.randrange(9), status, rng.choice([None, i]), i, account))
    expected = {}
    for oid in {e[0] for e in events}:
        expected[oid] = merged([e for e in events if e[0] == oid])
    df = spark.createDataFrame(rng.sample(events, len(events)), ORDER).repartition(3)
    got = {
        r.order_id: (r.account_id, r.order_amount, r.order_date, r.credit_limit, r.payment_status)
        for r in order_state(df, F.col("event_seq"), hot_rows).collect()
    }
    assert got == expected


def test_lifecycle_statuses(spark):
    noon, night = DAY.replace(hour=12), DAY.replace(hour=2)
    created = [order("paid", noon, 5, seq=1, ts=noon), order("refused", noon, 50, seq=2, ts=noon),
               order("night", night, 5, seq=3, ts=night), order("undated", None, 5, seq=4, limit=8)]
    topups = [order("top", DAY, 9, "ADD_BALANCE", seq=0)]
    state = lifecycle.order_lifecycle(
        spark.createDataFrame(created, ORDER), spark.createDataFrame(topups, ORDER))
    got = {r.order_id: (r.payment_status, r.order_amount, r.credit_limit) for r in state.collect()}
    assert got == {
        "paid": ("COMPLETED-EXECUTED", 5, None),
        "refused": ("COMPLETED-NOT_EXECUTED", 50, None),
        "night": ("CREATED", 5, None),
        "undated": ("CREATED", 5, 8),
        "top": ("COMPLETED-EXECUTED", 9, None),
    }


def test_lifecycle_runs_the_ledger_once(spark):
    """Undated events on both sides of a dated one must not repeat the ledger."""
    noon = DAY.replace(hour=12)
    created = [order("m", None, limit=1, seq=0), order("m", noon, seq=1, ts=noon),
               order("m", None, limit=2, seq=2, ts=noon)]
    topups = spark.createDataFrame([order("top", DAY, 9, "ADD_BALANCE")], ORDER)
    state = lifecycle.order_lifecycle(spark.createDataFrame(created, ORDER), topups)
    rows = {r.order_id: r.credit_limit for r in state.collect()}
    assert rows["m"] == 1
    plan = state._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("== Initial Plan ==")]
    assert final.count("MapInArrow") == 1
    assert "ReusedExchange" in final or "ReusedQueryStage" in final


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_lookup_of_unknown_and_hot_keys(spark, hot_rows):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    asks = ["a", "zz", "a", "b", "hot", "hot", None, None]
    asked = spark.createDataFrame([(a,) for a in asks], "key string")
    got = sorted(map(tuple, keyed.lookup(asked, state, "key", hot_rows).collect()), key=repr)
    expected = [(a, {"a": 1, "b": 2}.get(a)) for a in asks]
    assert got == sorted(expected, key=repr)


def test_branch_first_match_wins_and_rest_drops(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "n int")
    first, second = keyed.split(df, F.col("n") >= 2, F.col("n") >= 1)
    assert sorted(r.n for r in first.collect()) == [2, 3]
    assert [r.n for r in second.collect()] == [1]


def test_prefixed_key_prints_null(spark):
    df = spark.createDataFrame([("7",), (None,)], "a string")
    got = [r[0] for r in df.select(prefixed_account_key(F.col("a"))).collect()]
    assert got == ["account-7", "account-null"]
