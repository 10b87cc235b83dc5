"""Stateful processors: the balance ledger and the order merge, event by event.

Keys share buckets.  Rows of one bucket arrive unordered within a micro-batch and are sorted
here, at most ``PIECE`` of them at a time: a bucket with more leaves sorted pieces on the task's
own disk, as Spark's sort does, and they are merged while they are applied.  Between micro-batches
the order of arrival counts.
"""

from __future__ import annotations

import heapq
import json
import pickle
import sys
import tempfile
from collections.abc import Callable, Generator, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from decimal import Context, Decimal
from itertools import groupby, islice

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EXACT = Context(prec=80)
_MOST = Decimal(10) ** 32  # what decimal(38,6) cannot hold
_FIRST_FIELDS = ("account_id", "credit_card_number", "order_amount", "order_date")

LEDGER_STATE = "balance decimal(38,6)"
LEDGER_OUTPUT = (
    "account_id string, order_id string, credit_card_number bigint, "
    "credit_limit decimal(38,6), event_amount decimal(38,6), is_topup boolean, "
    "event_ts timestamp, source_rank int, event_seq bigint, balance decimal(38,6), "
    "payment_status string"
)
ORDER_STATE = (
    "account_id string, credit_card_number bigint, order_amount decimal(38,6), "
    "order_date timestamp, credit_limit decimal(38,6), payment_status string"
)
ORDER_OUTPUT = f"order_id string, {ORDER_STATE}"


# Rows of one bucket that a task holds at once.
PIECE = 20_000
# Columns that carry rows as texts between Spark and the processors, and rows of one output text.
PACKED, PACKS, PACK_ROWS = "packed", "packs", 1_000
# Field of a bucket's state that holds its rows.
BUCKET_ROWS = "rows"
# Buckets if nothing is known about the input, and rows of a micro-batch for each otherwise.
BUCKETS, ROWS_PER_BUCKET = 1_024, 100


def state_buckets(rows: int) -> int:
    """Buckets of state for micro-batches of so many rows."""
    return max(64, -(-rows // ROWS_PER_BUCKET))


def in_order(rows: Iterable, fields: Iterable, place: Callable, piece: int) -> Iterator[tuple]:
    """The ``fields`` of rows by ``place`` (a function of them), holding ``piece`` rows at most."""
    taken = (tuple(r[f] for f in fields) for r in rows)
    first = sorted(islice(taken, piece), key=place)
    if len(first) < piece:
        yield from first
        return
    runs, now = [], first
    while now:
        run = tempfile.TemporaryFile()
        for row in now:
            pickle.dump(row, run, pickle.HIGHEST_PROTOCOL)
        run.seek(0)
        runs.append((run, len(now)))
        now = sorted(islice(taken, piece), key=place)

    def read(run, n: int) -> Iterator[tuple]:
        with run:
            for _ in range(n):
                yield pickle.load(run)

    yield from heapq.merge(*[read(*r) for r in runs], key=place)


class Bucketed(StatefulProcessor):
    """State of all keys of a bucket as one value, a row per key.

    A value costs a request to Spark to read and one to write, and a group costs a batch of output, far more
    than a row: a bucket shares these among its keys.  Rows that this micro-batch set are marked ``changed``.

    Spark hands rows over cell by cell, which costs far more than what is done with them.  So a row comes
    as one JSON array of texts (times as microseconds) and results leave as arrays of such rows.
    """

    VARIABLE: str
    STATE: str  # fields after the key
    FIELDS: tuple[str, ...]  # of the input: the key, then ``PLACES`` fields that order its events, then others
    PLACES: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{f.split(' ')[0]}: {f.split(' ')[1]}" for f in [f"{self.FIELDS[0]} string", *self.STATE.split(", ")])
        self.state = handle.getValueState(self.VARIABLE, f"{BUCKET_ROWS} array<struct<{fields}, changed: boolean>>")

    def unpack(self, row: Row) -> list:
        event = json.loads(row[PACKED])
        for i in range(1, 1 + self.PLACES):
            event[i] = None if event[i] is None else int(event[i])
        return event

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, = self.state.get() or ([],)
        known = {row[0]: tuple(row)[1:-1] for row in held}
        changed = set()
        events = in_order(map(self.unpack, rows), range(len(self.FIELDS)), lambda e: e[:1 + self.PLACES], self.piece)
        out = []
        for name, own in groupby(events, key=lambda e: e[0]):
            results = self.apply(name, known.get(name), own)
            while True:
                try:
                    out.append(next(results))
                except StopIteration as end:
                    known[name] = end.value
                    break
                if len(out) == PACK_ROWS:
                    yield Row(**{PACKS: json.dumps(out)})
                    out = []
            changed.add(name)
        if out:
            yield Row(**{PACKS: json.dumps(out)})
        self.state.update(([(name, *state, name in changed) for name, state in known.items()],))

    def apply(self, name: str, state: tuple | None, events: Iterator[tuple]) -> Generator[list, None, tuple]:
        """Output rows of a key's events in order, as texts; returns its state after them."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class LedgerProcessor(Bucketed):
    """One output row per event; the state is the account's balance."""

    VARIABLE, STATE, PLACES = "balance", LEDGER_STATE, 3
    FIELDS = ("account_id", "event_ts", "source_rank", "event_seq", "order_id", "credit_card_number", "credit_limit",
              "order_amount", "payment_status")

    def __init__(self, topup_status: str, executed: str, refused: str, piece: int = PIECE) -> None:
        self.topup_status, self.executed, self.refused, self.piece = topup_status, executed, refused, piece

    def apply(self, name: str, state: tuple | None, events: Iterator[tuple]) -> Generator[list, None, tuple]:
        balance, = state or (Decimal(0),)
        for account, ts, rank, seq, order_id, card, limit, amount, status in events:
            topup = status == self.topup_status
            after = (_EXACT.add if topup else _EXACT.subtract)(balance, Decimal(amount))
            accepted = topup or after >= 0
            balance = after if accepted else balance
            if abs(balance) >= _MOST:
                raise OverflowError(f"balance of account {account}: {balance}")
            # As in LEDGER_OUTPUT.
            yield [account, order_id, card, limit, amount, "true" if topup else "false", str(ts), str(rank), str(seq),
                   str(balance), self.executed if accepted else self.refused]
        return (balance,)


def _text(value: object) -> str | None:
    """A field of the state as it comes in an event."""
    if isinstance(value, datetime):
        return str(T.TimestampType().toInternal(value))
    return None if value is None else str(value)


# Fields of the state from what comes in an event.
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_READ = {"bigint": int, "decimal(38,6)": Decimal, "timestamp": lambda t: _EPOCH + timedelta(microseconds=int(t)), "string": str}


class OrderStateProcessor(Bucketed):
    """One output row per order and micro-batch: the order's state after it."""

    VARIABLE, STATE, PLACES = "order", ORDER_STATE, 2
    FIELDS = ("order_id", "stage", "event_seq", *_FIRST_FIELDS, "credit_limit", "payment_status")

    def __init__(self, piece: int = PIECE) -> None:
        self.piece = piece

    def apply(self, name: str, state: tuple | None, events: Iterator[tuple]) -> Generator[list, None, tuple]:
        kinds = dict(part.split(" ") for part in ORDER_STATE.split(", "))
        order = dict(zip(kinds, map(_text, state or [None] * len(kinds))))
        for _, _, _, *first, limit, status in events:
            for field, value in zip(_FIRST_FIELDS, first):
                if order[field] is None:
                    order[field] = value
            # The limit follows the events for as long as the order has no date.
            if order["order_date"] is None:
                order["credit_limit"] = limit
            order["payment_status"] = status
        yield [name, *order.values()]  # as in ORDER_OUTPUT
        return tuple(None if value is None else _READ[kinds[field]](value) for field, value in order.items())
