"""Task-side helpers of the ledger: the sequential fold over sorted Arrow batches.

Amounts stay exact: a decimal's unscaled value is handled as a Python integer.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MONEY = pa.decimal128(38, 6)
_LIMIT = 10**38
_LOW = (1 << 64) - 1


def unscaled(column: pa.Array) -> list[int | None]:
    """Unscaled integers of a decimal128 array."""
    n, start = len(column), column.offset
    words = np.frombuffer(column.buffers()[1], dtype="<i8", count=2 * (start + n))
    low, high = words[2 * start :: 2], words[2 * start + 1 :: 2]
    if (low >> 63 == high).all():
        values = low.tolist()
    else:
        values = [(h << 64) | (v & _LOW) for v, h in zip(low.tolist(), high.tolist())]
    if column.null_count:
        values = [v if ok else None for v, ok in zip(values, column.is_valid().to_pylist())]
    return values


def money(values: list[int | None]) -> pa.Array:
    """decimal(38,6) array from unscaled integers."""
    missing = [v is None for v in values] if None in values else None
    filled = [0 if v is None else v for v in values] if missing else values
    words = np.empty(2 * len(filled), dtype="<i8")
    try:
        low = np.array(filled, dtype=np.int64)
        words[0::2], words[1::2] = low, low >> 63
    except OverflowError:
        if any(abs(v) >= _LIMIT for v in filled):
            raise ArithmeticError("ledger balance exceeds decimal(38,6)") from None
        words[0::2] = np.array([v & _LOW for v in filled], dtype=np.uint64).view(np.int64)
        words[1::2] = np.array([v >> 64 for v in filled], dtype=np.int64)
    validity = None
    if missing:
        bits = np.packbits(~np.array(missing), bitorder="little")
        validity = pa.py_buffer(bits.tobytes())
    return pa.Array.from_buffers(MONEY, len(filled), [validity, pa.py_buffer(words.tobytes())])


def flags(column: pa.Array) -> list[bool]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Start positions of runs of equal keys, with the batch length at the end."""
    n = batch.num_rows
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for key in keys:
        column = batch.column(key)
        if not pa.types.is_integer(column.type):
            column = column.dictionary_encode().indices
        codes = column.to_numpy(zero_copy_only=False)
        change |= codes[1:] != codes[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist(), n]


_BLOCK = 512
_SAFE = 1 << 52
_WIDE = 1 << 60


def _apply(
    deltas: list[int], topups: list[bool], lo: int, hi: int, balance: int,
    balances: list[int], accepted: list[bool],
) -> int:
    """Apply one run of events; append every balance and outcome, return the last balance.

    Blocks without a refusal are one running sum; only the others are stepped through.
    """
    for at in range(lo, hi, _BLOCK):
        end = min(at + _BLOCK, hi)
        block, flags_ = deltas[at:end], topups[at:end]
        if end - at >= 32 and -_SAFE < balance < _SAFE and max(block) < _SAFE and min(block) > -_SAFE:
            sums = np.cumsum(np.array([balance, *block], dtype=np.int64))[1:]
            if not ((sums < 0) & ~np.array(flags_)).any():
                balances.extend(sums.tolist())
                accepted.extend([True] * len(block))
                balance = balances[-1]
                continue
        for delta, topup in zip(block, flags_):
            after = balance + delta
            ok = topup or after >= 0
            if ok:
                balance = after
            accepted.append(ok)
            balances.append(balance)
    return balance


def fold(keys: list[str], last_only: bool) -> Callable:
    """Apply every event to its account's balance, in order.

    Input: sorted rows with ``keys``, ``delta`` (signed amount), ``is_topup`` and
    optionally ``opening``.  Output: all columns but ``opening`` plus ``balance``
    and ``accepted``, one row per event, or only the last row of every run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, balance, held = None, 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            deltas = unscaled(batch.column("delta"))
            topups = flags(batch.column("is_topup"))
            has_opening = "opening" in batch.schema.names
            openings = unscaled(batch.column("opening")) if has_opening else None
            key_lists = [batch.column(k) for k in keys]
            balances: list[int] = []
            accepted: list[bool] = []
            starts = _runs(batch, keys)
            first = tuple(c[0].as_py() for c in key_lists)
            for lo, hi in zip(starts, starts[1:]):
                # Only the first run of a batch can continue the one before.
                if lo or first != current:
                    balance = openings[lo] if has_opening else 0
                balance = _apply(deltas, topups, lo, hi, balance, balances, accepted)
            before, current = current, tuple(c[-1].as_py() for c in key_lists)
            kept = [c for c in batch.schema.names if c != "opening"]
            out = pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], money(balances), pa.array(accepted)],
                names=[*kept, "balance", "accepted"],
            )
            if not last_only:
                yield out
                continue
            # The last run may go on in the next batch: hold its last row back.
            if held is not None and first != before:
                yield held
            ends = [s - 1 for s in starts[1:]]
            if len(ends) > 1:
                yield out.take(pa.array(ends[:-1]))
            held = out.take(pa.array(ends[-1:]))
        if last_only and held is not None:
            yield held

    return run


def _advance(deltas: list[int], topups: list[bool], lo: int, hi: int, balance: int, net: int, need: int | None):
    """Balance, net and need (see ``simulate``) after one run of events; blocks are summed up at once."""
    for at in range(lo, hi, _BLOCK):
        end = min(at + _BLOCK, hi)
        block, flags_ = deltas[at:end], topups[at:end]
        if max(abs(balance), abs(net), max(block), -min(block)) < _SAFE:
            sums, orders = np.cumsum(np.array(block, dtype=np.int64)), ~np.array(flags_)
            if orders.any():
                most = -net - int(sums[orders].min())
                need = most if need is None or most > need else need
            refused = (sums < -balance) & orders
            total = int(sums[-1])
            net += total
            if not refused.any():
                balance += total
                continue
            first = int(refused.argmax())
            if first:
                balance += int(sums[first - 1])
            block, flags_ = block[first:], flags_[first:]
        else:
            for delta, topup in zip(block, flags_):
                net += delta
                # balance >= amount is balance + delta >= 0, whatever the sign
                if not topup and (need is None or -net > need):
                    need = -net
        for delta, topup in zip(block, flags_):
            if topup or balance + delta >= 0:
                balance += delta
    return balance, net, need


def simulate(keys: list[str]) -> Callable:
    """Summary per run: where it closes from its rows' ``opening``, and when all is accepted.

    ``need`` is the smallest opening from which no event of the run is refused
    (null: any); from there on the closing is the opening plus ``net``.  ``top`` is the
    greatest amount of an order (null: no order).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        opening = balance = net = 0
        need: int | None = None
        top: int | None = None
        done: list[tuple] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            deltas = unscaled(batch.column("delta"))
            topups = flags(batch.column("is_topup"))
            openings = unscaled(batch.column("opening"))
            key_lists = [batch.column(k) for k in keys]
            starts = _runs(batch, keys)
            for lo, hi in zip(starts, starts[1:]):
                key = tuple(c[lo].as_py() for c in key_lists)
                if key != current:
                    if current is not None:
                        done.append((*current, opening, balance, net, need, top))
                    current, net, need, top = key, 0, None, None
                    opening = balance = openings[lo]
                most = max((-d for d, t in zip(deltas[lo:hi], topups[lo:hi]) if not t), default=top)
                top = most if top is None else max(top, most)
                balance, net, need = _advance(deltas, topups, lo, hi, balance, net, need)
        if current is not None:
            done.append((*current, opening, balance, net, need, top))
        if done:
            accounts, chunks, *sums = (list(c) for c in zip(*done))
            yield pa.RecordBatch.from_arrays(
                [pa.array(accounts, pa.string()), pa.array(chunks, pa.int32()),
                 *[money(s) for s in sums]],
                names=[*keys, "simulated_opening", "closing", "net", "need", "top"],
            )

    return run


class Pieces:
    """What a run of events makes of a set of openings, as intervals that keep their width.

    An order is accepted from its amount on, so it cuts the interval that holds the amount and
    moves what lies above.  ``low`` and ``high`` are balances less ``base``; ``shift`` leads from
    the opening to them.
    """

    def __init__(self, intervals: list[tuple[int, int]], limit: int, merge: bool) -> None:
        wide = any(max(abs(lo), abs(hi)) >= _WIDE for lo, hi in intervals)
        kind = object if wide else np.int64
        self.low = np.array([lo for lo, _ in intervals], dtype=kind)
        self.high = np.array([hi for _, hi in intervals], dtype=kind)
        self.shift = self.low - self.low
        self.base, self.limit, self.merge = 0, limit, merge
        self.compress()

    def _bounds(self) -> None:
        self.least = int(self.low.min()) if len(self.low) else 0
        self.most = int(self.high.max()) if len(self.low) else -1
        if self.low.dtype != object and max(-self.least, self.most) >= _WIDE:
            self.low, self.high, self.shift = (x.astype(object) for x in (self.low, self.high, self.shift))

    def compress(self) -> None:
        """Join intervals that are one, at most ``limit`` of them.

        With ``merge`` they are a set of balances: those that touch are one, and beyond the limit the
        closest are, which adds balances.  Else they are a function of the opening, which keeps
        its first pieces and is then unknown for other openings.
        """
        if not len(self.low):
            self.next_check = self.limit
            self._bounds()
            return
        start = self.low if self.merge else self.low - self.shift
        order = np.argsort(start, kind="stable")
        low, high, shift = self.low[order], self.high[order], self.shift[order]
        if self.merge:
            ends = np.maximum.accumulate(high)
            apart = low[1:] - ends[:-1]
            cut = apart > 1
            if cut.sum() >= self.limit:
                cut = np.zeros(len(apart), dtype=bool)
                cut[np.argsort(-apart, kind="stable")[: self.limit - 1]] = True
            first = np.concatenate([[True], cut])
            last = np.concatenate([cut, [True]])
            self.low, self.high, self.shift = low[first], ends[last], shift[first]
        else:
            cut = (shift[1:] != shift[:-1]) | (low[1:] != high[:-1] + 1)
            first = np.concatenate([[True], cut])
            last = np.concatenate([cut, [True]])
            self.low, self.high, self.shift = (x[: self.limit] for x in (low[first], high[last], shift[first]))
        self.next_check = max(2 * len(self.low), 64)
        self._bounds()

    def step(self, delta: int, topup: bool) -> None:
        need = -delta - self.base
        if topup or need <= self.least:
            self.base += delta
            return
        if need > self.most:
            return
        if abs(delta) >= _WIDE and self.low.dtype != object:
            self.low, self.high, self.shift = (x.astype(object) for x in (self.low, self.high, self.shift))
        cut = (self.low < need) & (self.high >= need)
        if cut.any():
            above = self.high[cut]
            self.high[cut] = need - 1
            self.low = np.concatenate([self.low, np.full(len(above), need, dtype=self.low.dtype)])
            self.shift = np.concatenate([self.shift, self.shift[cut]])
            self.high = np.concatenate([self.high, above])
        up = self.low >= need
        for x in (self.low, self.high, self.shift):
            x[up] += delta
        if len(self.low) > self.next_check:
            self.compress()
        else:
            self._bounds()

    def rows(self) -> list[tuple[int, int, int]]:
        """(first, last, shift): balances, if merged, else openings and what leads to the closing."""
        self.compress()
        low, high, shift = (x.tolist() for x in (self.low, self.high, self.shift))
        if self.merge:
            return [(a + self.base, b + self.base, 0) for a, b in zip(low, high)]
        return [(a - s, b - s, s + self.base) for a, b, s in zip(low, high, shift)]


def transfer(keys: list[str], limit: int, merge: bool) -> Callable:
    """Pieces of every run's transfer function, or with ``merge`` the balances it can close with.

    Rows of a run begin with intervals of openings (``kind`` 0, ``low``, ``high``); its events follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, given, pieces = None, [], None
        done: list[tuple] = []

        def emit() -> pa.RecordBatch:
            accounts, chunks, *sums = (list(c) for c in zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(accounts, pa.string()), pa.array(chunks, pa.int32()), *[money(s) for s in sums]],
                names=[*keys, "low", "high", "shift"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            deltas, topups, kinds = unscaled(batch.column("delta")), flags(batch.column("is_topup")), batch.column("kind").to_pylist()
            lows, highs = unscaled(batch.column("low")), unscaled(batch.column("high"))
            key_lists = [batch.column(k) for k in keys]
            starts = _runs(batch, keys)
            for lo, hi in zip(starts, starts[1:]):
                key = tuple(c[lo].as_py() for c in key_lists)
                if key != current:
                    if pieces is not None:
                        done.extend((*current, *row) for row in pieces.rows())
                    current, given, pieces = key, [], None
                for i in range(lo, hi):
                    if kinds[i] == 0:
                        given.append((lows[i], highs[i]))
                        continue
                    if pieces is None:
                        pieces = Pieces(_disjoint(given), limit, merge)
                    pieces.step(deltas[i], topups[i])
            if len(done) > limit:
                yield emit()
        if pieces is not None:
            done.extend((*current, *row) for row in pieces.rows())
        if done:
            yield emit()

    return run


def _disjoint(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def link_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the chunks of every account through what is known of their transfer functions.

    Rows (sorted by account and chunk) say that openings from ``low`` (null: all below as well) to
    ``high`` (null: all above) lead to the opening plus ``shift``.  A chunk is ``settled`` if its
    opening is exact and one of its rows holds it.  After one that is not, openings of its account
    are guesses, from the row whose ``low`` is nearest.
    """
    account, chunk, exact, balance = None, None, True, 0
    opening, closing, nearest = 0, None, None
    done: list[tuple] = []

    def close() -> None:
        nonlocal exact, balance
        settled = exact and closing is not None
        done.append((account, chunk, opening, settled, exact))
        exact, balance = settled, closing if closing is not None else opening + nearest[1]

    for batch in batches:
        if batch.num_rows == 0:
            continue
        names, chunks = batch.column("account_id").to_pylist(), batch.column("chunk").to_pylist()
        lows, highs, shifts = (unscaled(batch.column(c)) for c in ("low", "high", "shift"))
        for i, name in enumerate(names):
            if (name, chunks[i]) != (account, chunk):
                if account is not None:
                    close()
                if name != account:
                    exact, balance = True, 0
                account, chunk = name, chunks[i]
                opening, closing, nearest = balance, None, None
            low, high = lows[i], highs[i]
            if (low is None or low <= opening) and (high is None or opening <= high):
                closing = opening + shifts[i]
            far = 0 if low is None else abs(opening - low)
            if nearest is None or far < nearest[0]:
                nearest = (far, shifts[i])
        if len(done) > 10_000:
            yield _openings(done)
    if account is not None:
        close()
    if done:
        yield _openings(done)


def _openings(done: list[tuple]) -> pa.RecordBatch:
    accounts, chunks, opens, settled, exact = (list(c) for c in zip(*done))
    done.clear()
    return pa.RecordBatch.from_arrays(
        [pa.array(accounts, pa.string()), pa.array(chunks, pa.int32()), money(opens), pa.array(settled), pa.array(exact)],
        names=["account_id", "chunk", "opening", "settled", "exact"])


def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the chunks of every account, sorted by chunk, from a zero balance.

    A chunk is ``settled`` if its closing follows from its summary: it was run
    from this very opening, or the opening covers ``need``.  Otherwise its old
    closing is only a guess for the chunks after it.
    """
    account, balance = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        names = batch.column("account_id").to_pylist()
        simulated, closings, nets, needs = (
            unscaled(batch.column(c)) for c in ("simulated_opening", "closing", "net", "need")
        )
        opens: list[int] = []
        settled: list[bool] = []
        for i, name in enumerate(names):
            if name != account:
                account, balance = name, 0
            opens.append(balance)
            if balance == simulated[i]:
                settled.append(True)
                balance = closings[i]
            elif needs[i] is None or balance >= needs[i]:
                settled.append(True)
                balance += nets[i]
            else:
                settled.append(False)
                balance = closings[i]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, money(opens), pa.array(settled)],
            names=[*batch.schema.names, "opening", "settled"],
        )
