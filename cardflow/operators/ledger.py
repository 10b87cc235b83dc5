"""The balance ledger: every account starts at zero, top-ups add, orders debit.

An order that the balance does not cover is refused and changes nothing, so the
outcome of one event depends on all earlier ones of its account.  Accounts are
independent and are folded side by side.  An account too big for one task is cut
into contiguous chunks that are folded side by side as well (``_fold_chunks``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow import schemas as S
from cardflow.operators import ledger_fold
from cardflow.operators.keyed import merge
from cardflow.operators.skew import HOT_ROWS, hot_keys
from cardflow.session import cut_lineage, stored

# Accounts with more than HOT_ROWS events are cut into chunks of about this size.
CHUNK_ROWS = 2_000_000
# Smaller chunks, if asked for, grow up to CHUNK_ROWS so that there are no more than these; each is a task.
MAX_CHUNKS = 96
# Rounds over open chunks side by side; accounts that are open then get transfer functions.
MAX_ROUNDS = 3
# Pieces of a chunk's transfer function, and intervals of balances it is made for.
MAX_PIECES, MAX_INTERVALS = 4096, 256
# Chunk summaries and accounts up to which a list of them is broadcast.
MAX_BROADCAST_ROWS = 500_000

ORDER = ("event_ts", "source_rank", "event_seq")
_MONEY = "decimal(38,6)"


def ledger_input(orders: DataFrame, topups: DataFrame) -> DataFrame:
    """Union of both feeds with one total order; at equal times top-ups go first.

    Both need ``account_id, credit_card_number, order_id, order_amount,
    credit_limit, payment_status, event_ts, event_seq`` with ``event_seq`` unique
    within a feed.
    """

    def feed(df: DataFrame, rank: int) -> DataFrame:
        return df.withColumn("source_rank", F.lit(rank))

    return merge(feed(orders, 1), feed(topups, 0))


def _unfit() -> Column:
    return (
        F.when(F.col("account_id").isNull(), "null_key")
        .when(F.col("payment_status").isNull(), "null_status")
        .when(F.col("order_amount").isNull(), "null_amount")
        .when(F.col("event_ts").isNull(), "null_time")
    )


def unfit_events(events: DataFrame) -> DataFrame:
    """Events the ledger cannot apply, with the reason; they change no balance."""
    return events.withColumn("reason", _unfit()).filter(F.col("reason").isNotNull())


def fit_events(events: DataFrame) -> DataFrame:
    return events.filter(_unfit().isNull())


def _prepared(events: DataFrame) -> DataFrame:
    topup = F.col("payment_status") == S.ADD_BALANCE
    amount = F.col("order_amount").cast(S.MONEY)
    return fit_events(events).select(
        "account_id",
        "order_id",
        "credit_card_number",
        F.col("credit_limit").cast(S.MONEY).alias("credit_limit"),
        topup.alias("is_topup"),
        *ORDER,
        F.when(topup, amount).otherwise(-amount).cast(S.MONEY).alias("delta"),
    )


def _folded_schema(df: DataFrame) -> T.StructType:
    # Unfit events are gone: telling Catalyst lets it drop branches that look for nulls.
    kept = [
        T.StructField(f.name, f.dataType, f.nullable and f.name not in ("account_id", "event_ts"))
        for f in df.schema.fields
        if f.name != "opening"
    ]
    return T.StructType(
        [
            *kept,
            T.StructField("balance", S.MONEY, False),
            T.StructField("accepted", T.BooleanType(), False),
        ]
    )


def _fold(df: DataFrame, keys: list[str], last_only: bool) -> DataFrame:
    folded = df.mapInArrow(ledger_fold.fold(keys, last_only), _folded_schema(df))
    delta = F.col("delta")
    return folded.select(
        "account_id",
        "order_id",
        "credit_card_number",
        "credit_limit",
        F.when(F.col("is_topup"), delta).otherwise(-delta).cast(S.MONEY).alias("event_amount"),
        "is_topup",
        *ORDER,
        "balance",
        F.when(F.col("accepted"), S.EXECUTED).otherwise(S.NOT_EXECUTED).alias("payment_status"),
    )


def _fold_accounts(df: DataFrame, last_only: bool) -> DataFrame:
    """One shuffle by account; the sort spills, the fold streams."""
    placed = df.repartition("account_id").sortWithinPartitions("account_id", *ORDER)
    return _fold(placed, ["account_id"], last_only)


def _few(df: DataFrame) -> DataFrame:
    """A stored list, marked for broadcast if it is short enough."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def _fold_chunks(df: DataFrame, rows: int, last_only: bool, chunk_rows: int) -> DataFrame:
    """Fold big accounts in contiguous chunks of their event order.

    Range partitioning on (account, order) cuts every account wherever its size
    asks for it.  All chunks are simulated at once from a guessed opening balance.
    A chunk's summary then gives its closing exactly if the guess was right or if
    the opening covers everything; chunks that neither fits are run again from
    the opening that now leads to them.  A full chunk tends to forget where it started
    from, so a few rounds usually do.  ``_settled`` takes the accounts that are still open
    after MAX_ROUNDS.  No task reads more than its chunks, one after the other.
    """
    keys = ["account_id", "chunk"]
    chunk_rows = max(chunk_rows, min(CHUNK_ROWS, math.ceil(rows / MAX_CHUNKS)))
    chunks = max(1, math.ceil(rows / chunk_rows))
    laid = cut_lineage(
        df.repartitionByRange(chunks, "account_id", *ORDER)
        .sortWithinPartitions("account_id", *ORDER)
        .withColumn("chunk", F.spark_partition_id())
    )
    # Rounds read these four columns, in the same partitions and order.
    spine = cut_lineage(laid.select(*keys, "is_topup", "delta"))
    summary = "account_id string, chunk int, " + ", ".join(
        f"{c} {_MONEY}" for c in ("simulated_opening", "closing", "net", "need", "top")
    )

    def linked(summaries: DataFrame) -> DataFrame:
        # At most one row per chunk and account; they stream through the task of an account.
        placed = summaries.repartition("account_id").sortWithinPartitions(*keys)
        schema = f"{summary}, opening {_MONEY}, settled boolean"
        return cut_lineage(placed.mapInArrow(ledger_fold.link, schema))

    def opened(rows: DataFrame, openings: DataFrame, *order: str) -> DataFrame:
        joined = rows.join(_few(openings), keys)
        if openings.count() <= MAX_BROADCAST_ROWS:
            return joined
        # Beyond a broadcast the rows were shuffled and need their order back.
        return joined.repartition(*keys).sortWithinPartitions(*keys, *order)

    def simulated(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(ledger_fold.simulate(keys), summary)

    narrow = laid.select(*keys, *ORDER, "is_topup", "delta")
    plan = linked(simulated(spine.withColumn("opening", F.lit(0).cast(S.MONEY))))
    for _ in range(MAX_ROUNDS):
        open_chunks = plan.filter(~F.col("settled")).select(*keys, "opening")
        left = open_chunks.count()
        if not left:
            break
        rows_again = spine if left <= MAX_BROADCAST_ROWS else narrow
        again = simulated(opened(rows_again, open_chunks, *ORDER).select(*spine.columns, "opening"))
        known = plan.filter("settled").drop("opening", "settled")
        plan = linked(known.unionByName(again))
    stuck = cut_lineage(plan.filter(~F.col("settled")).select("account_id").distinct())
    openings = plan.select(*keys, "opening")
    if not stuck.isEmpty():
        own = stored(narrow.join(_few(stuck), "account_id", "left_semi"), "chunk")
        known = plan.join(_few(stuck), "account_id", "left_semi")
        rest = openings.join(_few(stuck), "account_id", "left_anti")
        openings = rest.unionByName(_settled(own, known, simulated))

    return _fold(opened(laid, openings, *ORDER), keys, last_only)


def _settled(rows: DataFrame, plan: DataFrame, simulated: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Openings of all chunks of accounts whose chunks never forget where they started from.

    ``rows`` is a table partitioned by chunk.  Each chunk gets its transfer function, from opening to
    closing, as pieces of slope one.  It is worked out for the openings that the chunk before can
    leave behind, if that one starts from no more than twice its greatest order: a first
    pass finds these balances, a second the pieces.  Chaining the functions then settles every chunk
    side by side.  An opening outside the pieces is exact by then, and its chunk is run
    from it, alone, before the rest is chained again.
    """
    keys = ["account_id", "chunk"]
    piece = "account_id string, chunk int, " + ", ".join(f"{c} {_MONEY}" for c in ("low", "high", "shift"))
    plan = cut_lineage(plan)
    zero, none = F.lit(0).cast(S.MONEY), F.lit(None).cast(S.MONEY)

    def run(intervals: DataFrame, limit: int, merge: bool) -> DataFrame:
        start = intervals.select(*keys, F.lit(0).alias("kind"), "low", "high", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ORDER],
                                 F.lit(True).alias("is_topup"), zero.alias("delta"))
        events = rows.select(*keys, F.lit(1).alias("kind"), zero.alias("low"), zero.alias("high"), *ORDER, "is_topup", "delta")
        placed = start.unionByName(events).repartition(*keys).sortWithinPartitions(*keys, "kind", *ORDER)
        return cut_lineage(placed.mapInArrow(ledger_fold.transfer(keys, limit, merge), piece))

    def known(summaries: DataFrame) -> DataFrame:
        run_from = F.col("simulated_opening")
        exact = summaries.select(*keys, run_from.alias("low"), run_from.alias("high"), (F.col("closing") - run_from).cast(S.MONEY).alias("shift"))
        return exact.unionByName(summaries.select(*keys, F.col("need").alias("low"), none.alias("high"), F.col("net").alias("shift")))

    def linked(pieces: DataFrame) -> DataFrame:
        placed = pieces.repartition("account_id").sortWithinPartitions(*keys)
        return cut_lineage(placed.mapInArrow(ledger_fold.link_pieces, f"account_id string, chunk int, opening {_MONEY}, settled boolean, exact boolean"))

    reach = (2 * F.coalesce(F.greatest("top", zero), zero)).cast(S.MONEY)
    left = run(plan.select(*keys, zero.alias("low"), reach.alias("high")), MAX_INTERVALS, True)
    after = F.lead("chunk").over(Window.partitionBy("account_id").orderBy("chunk"))
    follows = plan.select(*keys, after.alias("next")).filter("next IS NOT NULL")
    given = left.join(follows, keys).select("account_id", F.col("next").alias("chunk"), "low", "high")
    guessed = plan.select(*keys, F.col("opening").alias("low"), F.col("opening").alias("high"))
    pieces = run(given.unionByName(guessed), MAX_PIECES, False).unionByName(known(plan))
    chain = linked(pieces)
    # The first chunk of an account that is not settled has an exact opening.
    while first := chain.filter("exact AND NOT settled").select(*keys, "opening").collect():  # one an account at most
        chunks = sorted({r["chunk"] for r in first})
        exact = F.broadcast(rows.sparkSession.createDataFrame(first, f"account_id string, chunk int, opening {_MONEY}"))
        again = rows.filter(F.col("chunk").isin(chunks)).join(exact, keys)
        again = again.repartition(*keys).sortWithinPartitions(*keys, *ORDER)
        pieces = cut_lineage(pieces.unionByName(known(simulated(again.select(*keys, "is_topup", "delta", "opening")))))
        chain = linked(pieces)
    return chain.select(*keys, "opening")


def _run(events: DataFrame, last_only: bool, hot_rows: int, chunk_rows: int) -> DataFrame:
    prepared = _prepared(events)
    found = hot_keys(prepared, "account_id", hot_rows)
    if found is None:
        return _fold_accounts(prepared, last_only)
    hot = F.broadcast(found.keys)
    usual = prepared.join(hot, "account_id", "left_anti")
    big = prepared.join(hot, "account_id", "left_semi")
    return _fold_accounts(usual, last_only).unionByName(
        _fold_chunks(big, found.rows, last_only, chunk_rows)
    )


def ledger_changes(
    events: DataFrame, *, hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row per applied event: the account's balance after it and the outcome."""
    return _run(events, False, hot_rows, chunk_rows)


def account_balances(
    events: DataFrame, *, hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Final state per account: balance plus card, order, limit of its last event.

    Tasks hand on one row per account (or chunk), so the last step is small.
    """
    last = _run(events, True, hot_rows, chunk_rows)
    columns = ["credit_card_number", "balance", "credit_limit", "order_id", "payment_status"]
    newest = F.max_by(F.struct(*columns), F.struct(*ORDER))
    return last.groupBy("account_id").agg(newest.alias("s")).select("account_id", "s.*")


def as_order_events(changes: DataFrame) -> DataFrame:
    """Ledger outcomes as order events, the way they go back to the order flow.

    The amount is the balance after the event and the limit is zero;
    ``event_amount`` keeps the true amount.  The date is the event's own time.
    """
    return changes.select(
        "order_id",
        "account_id",
        "credit_card_number",
        F.col("balance").alias("order_amount"),
        "payment_status",
        F.col("event_ts").alias("order_date"),
        F.lit(0).cast(S.MONEY).alias("credit_limit"),
        "event_amount",
        "is_topup",
        *ORDER,
    )
