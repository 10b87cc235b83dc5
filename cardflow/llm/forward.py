"""Subtree sums of huge trees by time-forward processing.

Nodes are named by two numbers, (name, depth), and a parent's pair is always the smaller one.  The
tree is cut into shards, contiguous ranges of that order.  Within a shard nodes are sorted in
reverse level order; each takes the messages addressed to it from a priority queue, adds them
up, and sends its total on to its parent.  A queue that grows beyond its memory spills sorted runs,
private scratch of the task like Spark's own spill files.

Messages to nodes of other shards leave the shard, one per node.  The nodes that get such
messages, each tied to the one its shard passes its total on to, form a smaller tree of shard roots,
which is summed up in the same way; then the shards add what came from others.  No task holds or
reads more than a shard, and each level is written to reliable storage.
"""

from __future__ import annotations

import heapq
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.session import cut_lineage

SHARD_ROWS = 200_000
QUEUE_ROWS = 100_000  # messages a queue keeps in memory
MAX_BROADCAST_ROWS = 500_000
_READ = 4096  # messages read back from a run at once

_NODE = ("name", "depth")
_UP = ("up_name", "up_depth")
_SUMS = ("leaves", "saved")
_MESSAGES = "name long, depth long, leaves long, saved long"


class SpillingQueue:
    """Smallest tuple first; all tuples have ``width`` integers of 64 bits."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (next tuple, run number, rest of the run)

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()
        np.array(sorted(self.heap), np.int64).tofile(run)
        run.seek(0)
        self.heap = []
        self._advance(len(self.runs), self._read(run))

    def _read(self, run) -> Iterator[tuple]:
        with run:
            while len(block := np.fromfile(run, np.int64, self.width * _READ)):
                yield from map(tuple, block.reshape(-1, self.width).tolist())

    def _advance(self, number: int, rest: Iterator[tuple]) -> None:
        item = next(rest, None)
        if item is not None:
            heapq.heappush(self.runs, (item, number, id(rest), rest))

    def peek(self) -> tuple | None:
        heads = [q[0] if q is self.heap else q[0][0] for q in (self.heap, self.runs) if q]
        return min(heads) if heads else None

    def pop(self) -> tuple:
        if self.heap and (not self.runs or self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        item, number, _, rest = heapq.heappop(self.runs)
        self._advance(number, rest)
        return item


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple]:
    return zip(*[batch.column(c).to_pylist() for c in names], strict=True)


def _forward(least: dict[int, tuple], queue_rows: int, outgoing: bool):
    """Process shards sorted in reverse level order; ``least`` is the smallest node of each.

    Yields messages to nodes before the shard, one per node, or the totals of its own nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(4, queue_rows), None
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*_NODE, *_SUMS])

        def leave(until: tuple | None) -> None:
            """Messages addressed to nodes before the next one of this shard leave it."""
            while (top := queue.peek()) is not None and (until is None or top[:2] < until):
                depth, name, leaves, saved = queue.pop()
                if outgoing:
                    if out and out[-1][:2] == (-name, -depth):
                        _, _, more, much = out.pop()
                        leaves, saved = leaves + more, saved + much
                    out.append((-name, -depth, leaves, saved))

        for batch in batches:
            for name, depth, up_name, up_depth, leaves, saved, pid in _columns(batch, (*_NODE, *_UP, *_SUMS, "pid")):
                if pid != shard:
                    leave(None)
                    shard = pid
                at = (-depth, -name)
                leave(at)
                while (top := queue.peek()) is not None and top[:2] == at:
                    _, _, more, much = queue.pop()
                    leaves, saved = leaves + more, saved + much
                if not outgoing:
                    out.append((name, depth, leaves, saved))
                if up_name is not None and (outgoing or (up_name, up_depth) >= least[pid]):
                    queue.push((-up_depth, -up_name, leaves, saved))
            if len(out) > 1:
                last = out.pop()  # may get more
                yield emit()
                out.append(last)
        leave(None)
        if out:
            yield emit()

    return run


def _exits(least: dict[int, tuple]):
    """Per shard and name (sorted by node) its first and last depth and the node its totals leave to.

    Nodes of one name in a shard all leave to the same node: they are a chain, or were one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = current = None
        exits: dict[int, tuple] = {}
        first = last = 0
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["name", "first", "last", *_UP])

        for batch in batches:
            for name, depth, up_name, up_depth, pid in _columns(batch, (*_NODE, *_UP, "pid")):
                if (pid, name) == (shard, current):
                    last = depth
                    continue
                if current is not None:
                    out.append((current, first, last, *exits[current]))
                if pid != shard:
                    shard, exits = pid, {}
                up = (up_name, up_depth)
                exits[name] = exits[up_name] if up_name is not None and up >= least[pid] else up
                current, first, last = name, depth, depth
            if out:
                yield emit()
        if current is not None:
            out.append((current, first, last, *exits[current]))
            yield emit()

    return run


def shards_for(df: DataFrame, rows: int, shard_rows: int) -> int:
    """Partitions of at most about ``shard_rows``; some for every core if there are many rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(rows / shard_rows), min(cores, rows // 5000))


def laid_out(df: DataFrame, rows: int, shard_rows: int, *order: str) -> DataFrame:
    """Contiguous, sorted ranges of ``order``, written once, with their number as ``pid``."""
    n = shards_for(df, rows, shard_rows)
    cut = df.repartitionByRange(n, *order) if n > 1 else df.coalesce(1)
    return cut_lineage(cut.sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))


def totals(tree: DataFrame, shard_rows: int = SHARD_ROWS, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """``name, depth, leaves, saved`` with the sums over each node's subtree, itself included.

    ``tree`` is a stored table of ``name, depth, up_name, up_depth, leaves, saved``, the parent null at
    roots; depths grow along every path, and nodes of one name are a chain.
    """
    rows = tree.count()
    laid = laid_out(tree.select(*_NODE, *_UP, *_SUMS), rows, shard_rows, *_NODE)
    bounds = laid.groupBy("pid").agg(F.min(F.struct(*_NODE)).alias("least")).collect()  # one row a shard
    least = {r["pid"]: tuple(r["least"]) for r in bounds}
    level = [F.asc("pid"), F.desc("depth"), F.desc("name")]
    if len(least) > 1:
        sent = laid.sortWithinPartitions(*level).mapInArrow(_forward(least, queue_rows, True), _MESSAGES)
        outer = sent.groupBy(*_NODE).agg(*[F.sum(c).alias(c) for c in _SUMS])
        ways = laid.mapInArrow(_exits(least), "name long, first long, last long, up_name long, up_depth long")
        roots = outer.join(ways, "name").filter("depth BETWEEN first AND last").select(*_NODE, *_UP, *_SUMS)
        more = cut_lineage(totals(cut_lineage(roots), shard_rows, queue_rows))
        few = more.count() <= MAX_BROADCAST_ROWS
        names = [F.col(c).alias(f"more_{c}") for c in _SUMS]
        more = more.select(*_NODE, *names)
        own = laid.join(F.broadcast(more) if few else more, [*_NODE], "left")
        sums = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in _SUMS]
        laid = own.select(*_NODE, *_UP, *sums, "pid")
        if not few:  # beyond a broadcast the shards were shuffled
            laid = laid.repartition(len(least), "pid")
    return laid.sortWithinPartitions(*level).mapInArrow(_forward(least, queue_rows, False), _MESSAGES)
