"""Prefix trie of conversations: what logged conversations have in common, node by node.

Turns are digested, numbered and named by running sums over contiguous ranges of their order, so
that a conversation of any length spreads over tasks.  A node, a distinct sequence of first
turns, is known by its smallest member and its depth.  A conversation that is a node's smallest
member is that of all deeper nodes on its path: the nodes of one conversation are a chain, and a
parent's pair (conversation, depth) is the smaller one.  Sums over subtrees come from
time-forward processing over that order (``forward``).

Turns are ordered by turn (null first), then role, the first 64 characters of the text, and a
hash of it; null roles and texts are empty.  Rows without a conv_id are dropped, repeated rows are
turns of their own.  Without conversations there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm import forward
from cardflow.operators.skew import join_unique
from cardflow.session import stored

GROUP, MOST_SHARED = 100, 6  # conversations that share a head, and the turns of it below which they do
_EMPTY = hashlib.sha256(b"").hexdigest()
_PIECE = 4096  # ids of a node that are one row on their way to its hash
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

Words = Callable[[pa.RecordBatch], np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K1
    x = (x ^ (x >> np.uint64(29))) * _K2
    return x ^ (x >> np.uint64(32))


def one_each(batch: pa.RecordBatch) -> np.ndarray:
    return np.ones((batch.num_rows, 1), np.uint64)


def placed_digests(batch: pa.RecordBatch) -> np.ndarray:
    """Two words per turn that depend on what it says and on its depth."""
    depth = _mixed(batch.column("depth").to_numpy().view(np.uint64) * _K1)
    return np.stack([_mixed(batch.column(c).to_numpy().view(np.uint64) ^ depth) for c in ("d1", "d2")], axis=1)


def _sums(batch: pa.RecordBatch, words: Words, before: int | None, carried: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Running sums (modulo 2**64) within runs of equal conv_id, and where runs start.

    ``carried`` is added in the first run if that is the conversation ``before``.
    """
    conv = batch.column("conv_id").to_numpy()
    value = words(batch)
    starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    total = np.cumsum(value, axis=0, dtype=np.uint64)
    base = (total - value)[starts]
    out = total - np.repeat(base, np.diff(np.append(starts, len(conv))), axis=0)
    if before is not None and conv[0] == before:
        out[: starts[1] if len(starts) > 1 else len(conv)] += carried
    return out, starts.tolist()


def _carried(laid: DataFrame, words: Words, width: int) -> dict[int, tuple[int, np.ndarray]]:
    """Per range the conversation that goes on from the one before, and its sums so far.

    One row a range reaches the driver.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = pid = None
        runs, total, first_total = 0, np.zeros(width, np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            found, starts = _sums(batch, words, last, total)
            conv = batch.column("conv_id")
            if first is None:
                first, pid, runs = conv[0].as_py(), batch.column("pid")[0].as_py(), 1
            elif conv[0].as_py() != last:
                first_total = total if first_total is None else first_total
                runs += 1
            if len(starts) > 1:
                first_total = found[starts[1] - 1] if first_total is None else first_total
                runs += len(starts) - 1
            last, total = conv[-1].as_py(), found[-1]
        if first is not None:
            first_total = total if runs == 1 else first_total
            yield pa.RecordBatch.from_pydict({
                "pid": pa.array([pid], pa.int32()), "first": [first], "last": [last], "one": [runs == 1],
                "head": [first_total.view(np.int64).tolist()], "tail": [total.view(np.int64).tolist()]})

    schema = "pid int, first long, last long, one boolean, head array<long>, tail array<long>"
    out: dict[int, tuple[int, np.ndarray]] = {}
    last, so_far = None, np.zeros(width, np.uint64)
    for r in sorted(laid.mapInArrow(ends, schema).collect(), key=lambda r: r["pid"]):
        goes_on = r["first"] == last
        if goes_on:
            out[r["pid"]] = last, so_far
        tail = np.array(r["tail"], np.int64).view(np.uint64)
        so_far = tail + so_far if goes_on and r["one"] else tail
        last = r["last"]
    return out


def _running(laid: DataFrame, words: Words, width: int, add: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``add(batch, sums)`` with running sums per conversation, over all ranges."""
    known = _carried(laid, words, width)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(width, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                last, total = known.get(batch.column("pid")[0].as_py(), (None, total))
            found, _ = _sums(batch, words, last, total)
            last, total = batch.column("conv_id")[-1].as_py(), found[-1]
            yield add(batch, found)

    return laid.mapInArrow(rows, schema)


def digested(df: DataFrame) -> DataFrame:
    """Turns without their texts: a 128-bit digest of role and text, and the text's length."""
    own = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)

    def word(at: int) -> Column:
        halves = [F.conv(F.substring(digest, at + 8 * i, 8), 16, 10).cast("long") for i in (0, 1)]
        return F.shiftleft(halves[0], 32).bitwiseOR(halves[1])

    return own.select("conv_id", "turn", "role", F.left("text", F.lit(64)).alias("head"), F.xxhash64("text").alias("hash"),
                      word(1).alias("d1"), word(17).alias("d2"), F.char_length("text").cast("long").alias("chars"))


def numbered(turns: DataFrame, shard_rows: int) -> DataFrame:
    """``conv_id, pos (from 1), d1, d2, chars`` per turn."""
    turns = stored(turns)
    # Rows that are equal in everything may still be cut apart.
    order = ("conv_id", "turn", "role", "head", "hash", "salt")
    laid = forward.laid_out(turns.withColumn("salt", F.monotonically_increasing_id()), turns.count(), shard_rows, *order)
    kept = ("conv_id", "d1", "d2", "chars")

    def add(batch: pa.RecordBatch, found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found[:, 0].view(np.int64))], names=[*kept, "pos"])

    return stored(_running(laid.select(*kept, "pid"), one_each, 1, add, "conv_id long, d1 long, d2 long, chars long, pos long"))


def rebuilt(turns: DataFrame, own_length: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of all rebuilt conversations by depth, and the ids of those without turns.

    The first h turns of a conversation are those of the first of its hundred, all if that
    has fewer, none if it is absent; then its own follow from the (h+1)th.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED))
    convs = own_length.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    base_length = own_length.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = stored(convs.join(base_length, "base", "left").select(
        "conv_id", "n", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m")))
    heads = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    shared = convs.filter("m > 0").join(heads, "base").filter("pos <= m").select(
        "conv_id", F.col("pos").alias("depth"), "d1", "d2", "chars", ((F.col("pos") == F.col("m")) & (F.col("n") <= F.col("h"))).alias("last"))
    rest = join_unique(turns, convs.select("conv_id", "n", "h", "m"), "conv_id", "inner").filter("pos > h").select(
        "conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "d1", "d2", "chars", (F.col("pos") == F.col("n")).alias("last"))
    return shared.unionByName(rest), convs.filter("m = 0 AND n <= h").select("conv_id")


def prefixes(turns: DataFrame, shard_rows: int) -> DataFrame:
    """Each turn with the names of the node it ends (``key``) and of that node's parent (``up``).

    A name is the sum of two words per turn, modulo 2**64; zero is the root's.
    """
    turns = stored(turns)
    laid = forward.laid_out(turns, turns.count(), shard_rows, "conv_id", "depth")
    kept = ("conv_id", "depth", "d1", "d2", "chars", "last")

    def add(batch: pa.RecordBatch, found: np.ndarray) -> pa.RecordBatch:
        up = found - placed_digests(batch)
        names = [pa.array(np.ascontiguousarray(x[:, i]).view(np.int64)) for x in (found, up) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *names], names=[*kept, "k1", "k2", "u1", "u2"])

    schema = "conv_id long, depth long, d1 long, d2 long, chars long, last boolean, k1 long, k2 long, u1 long, u2 long"
    return stored(_running(laid, placed_digests, 2, add, schema))


def _key(a: str, b: str, name: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias(name)


def nodes(named: DataFrame, root_conv: int, n_convs: int) -> DataFrame:
    """``key, conv_id, depth, parent_conv_id, n_convs, n_children, chars`` of every node.

    All turns of a node must have one parent and one digest; two sequences of the same
    name would break this and stop the job.
    """
    exact = ("u1", "u2", "d1", "d2", "chars")
    own = named.groupBy("k1", "k2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in exact],
        *[F.max(c).alias(f"_{c}") for c in exact])
    same = F.array(*exact) == F.array(*[f"_{c}" for c in exact])
    own = stored(own.select(_key("k1", "k2", "key"), _key("u1", "u2", "up"), "depth", "conv_id", "chars",
                            F.when(same, F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes of one name")).cast("long")).alias("n_convs")))
    children = own.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    root = own.sparkSession.range(1).select(
        F.struct(zero.alias("a"), zero.alias("b")).alias("key"), zero.alias("depth"), F.lit(root_conv).cast("long").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"), zero.alias("chars"))
    top = own.filter("depth = 1").withColumn("parent_conv_id", F.lit(root_conv).cast("long"))
    parents = own.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    deep = join_unique(own.filter("depth > 1"), parents, "up", "inner")
    columns = ["key", "depth", "conv_id", "parent_conv_id", "n_convs", "chars"]
    every = root.unionByName(top.select(columns)).unionByName(deep.select(columns))
    return stored(every.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def end_hashes(ends: DataFrame, rows: int, shard_rows: int) -> DataFrame:
    """``key, ends_sha256``: SHA-256 of the ascending, comma-joined ids of each key (k1, k2).

    Keys inside a range of (key, id) are hashed where they are.  Those at its border leave as
    pieces of thousands of ids, which are put together in order, streaming.
    """
    laid = forward.laid_out(ends, rows, shard_rows, "k1", "k2", "conv_id")
    schema = "k1 long, k2 long, pid int, piece int, ids string, sha string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, pid, held, n = None, True, 0, [], 0
        out: list[tuple] = []

        def leave(border: bool) -> None:
            nonlocal held, n
            if border or n:
                out.append((*key, pid, n, ",".join(map(str, held)), None))
                n += 1
            else:
                out.append((*key, pid, 0, None, hashlib.sha256(",".join(map(str, held)).encode()).hexdigest()))
            held = []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              names=["k1", "k2", "pid", "piece", "ids", "sha"])

        for batch in batches:
            for k1, k2, conv, own_pid in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id", "pid")], strict=True):
                pid = own_pid
                if (k1, k2) != key:
                    if key is not None:
                        leave(first)
                        first, n = False, 0
                    key = (k1, k2)
                elif len(held) >= _PIECE:
                    leave(True)
                held.append(conv)
            if len(out) >= _PIECE:
                yield emit()
        if key is not None:
            leave(True)  # the last key may go on in the next range
        if out:
            yield emit()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "ids")], strict=True):
                if (k1, k2) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            out.append((*key, state.hexdigest()))
        if out:
            a, b, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha)], names=["k1", "k2", "sha"])

    found = stored(laid.mapInArrow(pieces, schema))
    parts = found.filter("sha IS NULL").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "pid", "piece")
    joined = parts.mapInArrow(whole, "k1 long, k2 long, sha string")
    done = found.filter("sha IS NOT NULL").select("k1", "k2", "sha").unionByName(joined)
    return done.select(_key("k1", "k2", "key"), F.col("sha").alias("ends_sha256"))


COLUMNS = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends_sha256 string")


def trie(df: DataFrame, shard_rows: int = forward.SHARD_ROWS, queue_rows: int = forward.QUEUE_ROWS) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    ``n_convs`` counts a node's members, ``n_leaves`` the childless nodes of its subtree;
    ``saved_tokens`` sums up, over the subtree, the characters that storing a node's text once saves;
    ``ends_sha256`` names the members that end there.
    """
    turns = numbered(digested(df), shard_rows)
    length = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("n")))
    root_conv, n_convs = length.agg(F.min("conv_id"), F.count("*")).first()
    if not n_convs:
        return df.sparkSession.createDataFrame([], COLUMNS)
    spelled, silent = rebuilt(turns, length)
    named = prefixes(spelled, shard_rows)
    known = nodes(named, root_conv, n_convs)
    zero = F.lit(0).cast("long")
    ends = named.filter("last").select("k1", "k2", "conv_id").unionByName(silent.select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    hashes = end_hashes(ends, n_convs, shard_rows)
    tree = known.select(
        F.col("conv_id").alias("name"), "depth", F.col("parent_conv_id").alias("up_name"),
        F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_depth"),
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sums = forward.totals(tree, shard_rows, queue_rows).select(
        F.col("name").alias("conv_id"), "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    full = known.join(sums, ["conv_id", "depth"]).join(hashes, "key", "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
