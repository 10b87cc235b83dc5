"""The ledger against a plain loop, whole and in chunks, at any partitioning."""

import random
from datetime import datetime, timedelta
from decimal import Decimal, getcontext

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardflow.operators import ledger, ledger_fold

SCHEMA = ("account_id string, credit_card_number bigint, order_id string, "
          "order_amount decimal(38,6), credit_limit decimal(38,6), payment_status string, "
          "event_ts timestamp, source_rank int, event_seq bigint")
START = datetime(2024, 1, 1)


def event(account, amount, status="PROGRESS", at=0, seq=0, rank=None):
    rank = (0 if status == "ADD_BALANCE" else 1) if rank is None else rank
    amount = None if amount is None else Decimal(amount)
    return (account, 4, f"o{seq}", amount, None, status, START + timedelta(seconds=at), rank, seq)


def brute_force(events):
    """Expected (order, balance, status) per event and final balance per account."""
    balances, out = {}, {}
    getcontext().prec = 60
    for e in sorted(events, key=lambda e: (e[6], e[7], e[8])):
        account, amount, topup = e[0], e[3], e[5] == "ADD_BALANCE"
        balance = balances.get(account, Decimal(0))
        ok = topup or balance >= amount
        if ok:
            balance += amount if topup else -amount
        balances[account] = balance
        out[e[2]] = (balance, "EXECUTED" if ok else "NOT_EXECUTED")
    return out, balances


def check(spark, events, **options):
    df = spark.createDataFrame(events, SCHEMA)
    expected, final = brute_force(events)
    got = ledger.ledger_changes(df, **options).collect()
    assert len(got) == len(events)
    assert {r.order_id: (r.balance, r.payment_status) for r in got} == expected
    state = ledger.account_balances(df, **options).collect()
    assert {r.account_id: r.balance for r in state} == final
    last = {}
    for e in sorted(events, key=lambda e: (e[6], e[7], e[8])):
        last[e[0]] = e[2]
    assert {r.account_id: r.order_id for r in state} == last


EDGE = {
    "amount equals balance": [event("a", 5, "ADD_BALANCE", 0, 0), event("a", 5, at=1, seq=1)],
    "one cent above": [event("a", 5, "ADD_BALANCE", 0, 0), event("a", "5.01", at=1, seq=1)],
    "zero before any top-up": [event("a", 0, seq=0)],
    "negative order": [event("a", -5, seq=0)],
    "negative top-up": [event("a", -5, "ADD_BALANCE", seq=0), event("a", -3, at=1, seq=1)],
    "top-up first at one instant": [event("a", 5, seq=0), event("a", 5, "ADD_BALANCE", seq=1)],
    "beyond 64 bits": [event("a", 10**25, "ADD_BALANCE", 0, 0),
                       event("a", "1.000001", at=1, seq=1), event("b", 10**25, seq=2)],
}


@pytest.mark.parametrize("name", EDGE)
def test_edge(spark, name):
    check(spark, EDGE[name])


def test_unfit_events_change_nothing(spark):
    events = [event(None, 1, seq=0), event("a", None, seq=1), event("a", 1, None, seq=2, rank=1),
              event("a", 3, "ADD_BALANCE", seq=3)]
    df = spark.createDataFrame(events, SCHEMA)
    reasons = {r.order_id: r.reason for r in ledger.unfit_events(df).collect()}
    assert reasons == {"o0": "null_key", "o1": "null_amount", "o2": "null_status"}
    (row,) = ledger.account_balances(df).collect()
    assert row.balance == 3


def random_events(n, accounts, hot_share, topup_share, top, seed):
    rng = random.Random(seed)
    events = []
    for i in range(n):
        account = "hot" if rng.random() < hot_share else f"a{rng.randrange(accounts)}"
        status = "ADD_BALANCE" if rng.random() < topup_share else "PROGRESS"
        amount = Decimal(rng.randrange(-50, top)) / 100
        events.append(event(account, amount, status, rng.randrange(n), i))
    return events


# Few, balanced and many top-ups: mostly refused, mixed, never refused.
@pytest.mark.parametrize("topup_share", [0.1, 0.5, 0.9])
@pytest.mark.parametrize("parts", [1, 3])
def test_chunks_equal_brute_force(spark, topup_share, parts):
    events = random_events(1500, 8, 0.4, topup_share, 2000, seed=7)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        check(spark, events, hot_rows=200, chunk_rows=60)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chunk_cuts_do_not_follow_accounts(spark):
    """Several big accounts in few chunks, and one account alone in many."""
    check(spark, random_events(900, 3, 0.3, 0.4, 500, seed=1), hot_rows=50, chunk_rows=200)
    check(spark, random_events(600, 1, 1.0, 0.3, 900, seed=2), hot_rows=50, chunk_rows=20)


def test_adversarial_chain_settles(spark):
    """Amounts that double: every opening leads to a different set of refusals."""
    events, seq = [], 0
    for i in range(12):
        for status, amount in (("ADD_BALANCE", 2**i), ("PROGRESS", 2 ** (i + 1)), ("PROGRESS", 1)):
            events.append(event("hot", amount, status, seq, seq))
            seq += 1
    check(spark, events, hot_rows=5, chunk_rows=3)


def grid_prices(n):
    """Demand above supply on a price grid, after an odd first top-up: a chunk never forgets."""
    events = [event("hot", 20, "ADD_BALANCE", 0, 0)]
    for i in range(1, n):
        status, amount = ("ADD_BALANCE", 50) if i % 3 == 1 else ("PROGRESS", 100)
        events.append(event("hot", amount, status, i, i))
    return events


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_stuck_account_is_settled_by_transfer_functions(spark, monkeypatch, broadcast):
    """No walk through the account: two more passes over its chunks, side by side, settle all."""
    passes = []
    for name in ("simulate", "transfer"):
        made = getattr(ledger_fold, name)
        monkeypatch.setattr(ledger_fold, name, lambda *a, made=made, name=name: passes.append(name) or made(*a))
    monkeypatch.setattr(ledger, "MAX_BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame(grid_prices(400), SCHEMA)
    ledger.ledger_changes(df, hot_rows=50, chunk_rows=20).collect()
    assert passes == ["simulate"] * (1 + ledger.MAX_ROUNDS) + ["transfer"] * 2
    check(spark, grid_prices(400), hot_rows=50, chunk_rows=20)


@pytest.mark.parametrize("pieces, intervals", [(1, 1), (2, 3)])
def test_openings_outside_the_pieces_are_run_alone(spark, monkeypatch, pieces, intervals):
    monkeypatch.setattr(ledger, "MAX_ROUNDS", 0)
    monkeypatch.setattr(ledger, "MAX_PIECES", pieces)
    monkeypatch.setattr(ledger, "MAX_INTERVALS", intervals)
    rich = [event("hot", 10**6, "ADD_BALANCE", 200, 200)]
    events = [e for e in grid_prices(240) if e[8] != 200] + rich
    events += [event("other", e[3], e[5], e[8], 1000 + e[8]) for e in grid_prices(90)]
    check(spark, events, hot_rows=50, chunk_rows=30)


def test_stuck_accounts_of_random_amounts(spark, monkeypatch):
    monkeypatch.setattr(ledger, "MAX_ROUNDS", 0)
    check(spark, random_events(900, 2, 0.6, 0.4, 900, seed=11), hot_rows=50, chunk_rows=40)


def closing(events, balance):
    for delta, topup in events:
        if topup or balance + delta >= 0:
            balance += delta
    return balance


@given(st.lists(st.tuples(st.integers(-30, 30), st.booleans()), min_size=1, max_size=60), st.integers(0, 80), st.integers(1, 6),
       st.sampled_from([1, 2**61]))
@settings(max_examples=80, deadline=None)
def test_pieces_are_the_transfer_function(events, wide, limit, scale):
    """Every piece leads each of its openings to its closing; with merging no closing is missed."""
    events = [(d * scale, t) for d, t in events]
    function = ledger_fold.Pieces([(-5 * scale, wide * scale)], 10_000, False)
    closings = ledger_fold.Pieces([(-5 * scale, wide * scale)], limit, True)
    for event_ in events:
        function.step(*event_)
        closings.step(*event_)
    pieces, reached = function.rows(), closings.rows()
    assert len(reached) <= limit
    for opening in range(-5, wide + 1):
        opening *= scale
        (shift,) = [s for lo, hi, s in pieces if lo <= opening <= hi]
        assert opening + shift == closing(events, opening)
        assert any(lo <= opening + shift <= hi for lo, hi, _ in reached)


@given(st.lists(st.tuples(st.integers(-40, 40), st.booleans()), min_size=1, max_size=1500), st.integers(-50, 50))
@settings(max_examples=40, deadline=None)
def test_blocks_of_a_summary_equal_a_plain_loop(events, opening):
    balance, net, need = opening, 0, None
    for delta, topup in events:
        net += delta
        if not topup:
            need = -net if need is None else max(need, -net)
    deltas, topups = [d for d, _ in events], [t for _, t in events]
    assert ledger_fold._advance(deltas, topups, 0, len(events), opening, 0, None) == (closing(events, opening), net, need)


def test_blocks_without_refusals_and_beyond_64_bits(spark):
    events = [event("a", 10**6, "ADD_BALANCE", 0, 0)] + [event("a", i % 7, at=i, seq=i) for i in range(1, 1300)]
    events += [event("b", 10**24, "ADD_BALANCE", i, 2000 + i) for i in range(40)]
    events += [event("c", 2, "PROGRESS" if i % 2 else "ADD_BALANCE", i, 3000 + i) for i in range(700)]
    check(spark, events)


def test_input_order_does_not_matter(spark):
    events = random_events(400, 5, 0.2, 0.5, 800, seed=3)
    shuffled = random.Random(1).sample(events, len(events))
    columns = ("order_id", "balance", "payment_status")
    results = [
        sorted(ledger.ledger_changes(spark.createDataFrame(e, SCHEMA).repartition(n))
               .select(*columns).collect())
        for e, n in ((events, 1), (shuffled, 2), (shuffled, 7))
    ]
    assert results[0] == results[1] == results[2]


def test_properties(spark):
    events = random_events(800, 20, 0.1, 0.5, 900, seed=5)
    df = spark.createDataFrame(events, SCHEMA)
    changes = ledger.ledger_changes(df)
    signed = F.when(F.col("is_topup"), F.col("event_amount")).otherwise(-F.col("event_amount"))
    moved = (changes.filter("payment_status = 'EXECUTED'").groupBy("account_id")
             .agg(F.sum(signed).alias("moved")))
    both = ledger.account_balances(df).join(moved, "account_id", "left")
    assert both.filter("balance <> coalesce(moved, 0)").count() == 0


def test_wide_decimals_round_trip():
    values = [0, -1, 2**63 - 1, -(2**63), 2**63, -(2**64) - 5, 10**38 - 1, None]
    assert ledger_fold.unscaled(ledger_fold.money(values)) == values
    assert ledger_fold.unscaled(ledger_fold.money(values).slice(3)) == values[3:]
    whole = ledger_fold.money([1500000]).to_pylist()
    assert whole == [Decimal("1.5")]
    with pytest.raises(ArithmeticError):
        ledger_fold.money([10**38])


def test_account_across_arrow_batches():
    """A run that spans batches keeps its balance; the last row comes out once."""
    def batch(accounts, deltas):
        return pa.RecordBatch.from_arrays(
            [pa.array(accounts), pa.array([d > 0 for d in deltas]), ledger_fold.money(deltas)],
            names=["account_id", "is_topup", "delta"])

    batches = [batch(["a", "a"], [5, -3]), batch([], []), batch(["a", "b"], [-2, 4]),
               batch(["b"], [-9])]
    every = pa.Table.from_batches(ledger_fold.fold(["account_id"], False)(iter(batches)))
    assert ledger_fold.unscaled(every["balance"].combine_chunks()) == [5, 2, 0, 4, 4]
    last = pa.Table.from_batches(ledger_fold.fold(["account_id"], True)(iter(batches)))
    assert last["account_id"].to_pylist() == ["a", "b"]
    assert ledger_fold.unscaled(last["balance"].combine_chunks()) == [0, 4]


def test_small_chunks_grow_to_a_bounded_number(spark, monkeypatch):
    """However small the chunks that are asked for, an account is not cut into a task for each few rows."""
    monkeypatch.setattr(ledger, "MAX_CHUNKS", 4)
    laid, real = [], ledger.cut_lineage

    def spied(df):
        cut = real(df)
        if {"chunk", "order_id"} <= set(df.columns):
            laid.append(cut.select("chunk").distinct().count())
        return cut

    monkeypatch.setattr(ledger, "cut_lineage", spied)
    check(spark, grid_prices(400), hot_rows=50, chunk_rows=5)
    assert laid and all(1 < n <= 4 for n in laid)
