"""Near duplicates by SimHash: fingerprints within a few bits, found in a Gray-order index.

Equal fingerprints are one class.  The index is a hierarchy of masked bit patterns.  Its upper
nodes share the pattern of one of five bit ranges: codes that differ in at most four bits agree on
at least one of five disjoint ranges, so each code is filed under its five nodes, and no two nodes
need to meet.  A node with too many codes for a task is filed again, by the bits it does not share.
Below, codes are sorted by Gray rank, which keeps neighbours alike; eight neighbours form a node
that holds the bits all of them share, eight nodes the next.  The tree is traversed against
itself: a pair of nodes is dropped once the shared bits of both differ in too many places, or when
everything below it is linked already.  Nodes hand on a spanning forest of their links, not all
pairs, and the forests are joined into components.

A null text has no words; without words the fingerprint is zero and is linked like any other.
Null ids are never a component's id unless it has no other; repeated rows come out as often as
they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.components import components
from cardflow.operators.skew import join_unique
from cardflow.session import stored

WIDTH, SEED, BITS = 4, 42, 64
LIMIT = 4  # differing bits of a link
# Codes of a node that one task holds; bigger ones are filed again.
NODE_CODES = 1_000_000
FAN = 8
PAGE = 256  # codes of a node that are compared without a tree
_BLOCK = 1 << 16  # shingles whose bits are counted at once
_ROWS = 200_000  # index rows that are handled at once, if their nodes are smaller
_PAIRS = 4096  # node pairs expanded at once
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """Majority of the bits of all shingles' hashes; fewer words are one shingle, none give zero."""
    words = (text or b"").translate(_LOWER).split()  # splits at ASCII white space only
    if not words:
        return 0
    k = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)
        found = np.array([digest(joined[s:e], SEED) for s, e in spans], ">u8")
        counts += np.unpackbits(found.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) per row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return own.mapInArrow(rows, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(code: Column) -> Column:
    """Place of a code in the Gray sequence, shifted so that signed longs sort by it."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(2**63)))


def code_of(rank: np.ndarray) -> np.ndarray:
    u = rank.view(np.uint64) ^ np.uint64(1 << 63)
    return u ^ (u >> np.uint64(1))


def ranges(mask: int, parts: int) -> list[int]:
    """The bits of a mask, cut into ``parts`` masks of almost equal size."""
    bits = [i for i in range(BITS) if mask >> i & 1]
    cuts = [len(bits) * p // parts for p in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >> 63 else mask


def filed(codes: DataFrame, masks: list[int]) -> DataFrame:
    """``code, free, node`` per code and upper node; ``free`` are the bits it does not share.

    ``codes`` has ``code, free, node``, with the values of ``free`` in ``masks``.  Nodes are named by
    64-bit hashes: two of one name would be searched together, no more.
    """
    spans = [(_signed(m), _signed(r)) for m in masks for r in ranges(m, LIMIT + 1) if r]
    own = codes.sparkSession.createDataFrame(spans, "free long, own long")  # five rows a mask
    each = codes.join(F.broadcast(own), "free")
    return each.select("code", F.col("free").bitwiseAND(F.bitwise_not("own")).alias("free"),
                       F.xxhash64("node", "own", F.col("code").bitwiseAND(F.col("own"))).alias("node"))


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least index) after linking a[i] with b[i]; ``parent`` are labels before."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _pages(code: np.ndarray, end: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within small groups: each code against the later ones of its group."""
    first, second = [], []
    at = np.arange(len(code))
    k = 1
    while len(at := at[at + k < end[at]]):
        near = at[np.bitwise_count(code[at] ^ code[at + k]) <= limit]
        first.append(near)
        second.append(near + k)
        k += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


class Tree:
    """Codes in Gray order, with the shared bits of eight neighbours, eight nodes, and so on."""

    def __init__(self, code: np.ndarray, limit: int):
        self.limit = limit
        self.levels = [(code, np.full(len(code), ~np.uint64(0)))]
        while len(self.levels[-1][0]) > FAN:
            pattern, shared = (np.pad(x, (0, -len(x) % FAN), "edge").reshape(-1, FAN) for x in self.levels[-1])
            same = np.bitwise_and.reduce(shared & ~(pattern ^ pattern[:, :1]), axis=1)
            self.levels.append((pattern[:, 0] & same, same))

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """Per node the label of all codes below, or -1 where they differ."""
        out = [label]
        for pattern, _ in self.levels[1:]:
            below = np.pad(out[-1], (0, len(pattern) * FAN - len(out[-1])), "edge").reshape(-1, FAN)
            out.append(np.where((below == below[:, :1]).all(axis=1), below[:, 0], -1))
        return out

    def labels(self) -> np.ndarray:
        """The least index that each code is linked with, over any number of links."""
        code = self.levels[0][0]
        near = np.flatnonzero(np.bitwise_count(code[1:] ^ code[:-1]) <= self.limit)
        label = _joined(np.arange(len(code)), near, near + 1)
        known = self.uniform(label)
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, a, b)]
        pending = 0
        while stack:
            level, a, b = stack.pop()
            if len(a) > _PAIRS:
                stack.append((level, a[_PAIRS:], b[_PAIRS:]))
                a, b = a[:_PAIRS], b[:_PAIRS]
            pattern, shared = self.levels[level]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & shared[a] & shared[b])
            keep = (apart <= self.limit) & ((known[level][a] != known[level][b]) | (known[level][a] < 0))
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                new = np.count_nonzero(label[a] != label[b])
                if new:
                    label = _joined(label, a, b)
                    pending += new
                if pending > max(64, len(code) // 16):
                    known, pending = self.uniform(label), 0
                continue
            size, i = len(self.levels[level - 1][0]), np.arange(FAN)
            x, y = ((v[:, None, None] * FAN + w) for v, w in ((a, i[:, None]), (b, i[None, :])))
            x, y = (v.ravel() for v in np.broadcast_arrays(x, y))
            keep = (x < size) & (y < size) & (x < y if level == 1 else x <= y)
            stack.append((level - 1, x[keep], y[keep]))
        return label


def forest(node: np.ndarray, code: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within each run of equal nodes; at most one per code."""
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    sizes = np.diff(np.append(starts, len(node)))
    end = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= PAGE, sizes)
    at = np.flatnonzero(small)
    moved = np.cumsum(small) - 1  # places among the small groups' codes
    label = np.arange(len(code))
    if len(at):
        a, b = _pages(code[at], moved[end[at] - 1] + 1, limit)
        label[at] = at[_joined(np.arange(len(at)), a, b)]
    for s, n in zip(starts[sizes > PAGE].tolist(), sizes[sizes > PAGE].tolist(), strict=True):
        label[s : s + n] = s + Tree(code[s : s + n], limit).labels()
    linked = np.flatnonzero(label != np.arange(len(code)))
    return code[linked], code[label[linked]]


def links(codes: DataFrame, limit: int = LIMIT, node_codes: int = NODE_CODES) -> DataFrame:
    """``u, v``: links between distinct codes that join all within ``limit`` (4 at most) bits.

    ``codes`` has one column, ``code``, without repeats.
    """
    if not 0 <= limit <= LIMIT:
        raise ValueError(f"fingerprints are linked at up to {LIMIT} bits")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            u, v = forest(rows[0], code_of(np.ascontiguousarray(rows[1])), limit)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("node", "rank")]))
            size += batch.num_rows
            if size >= _ROWS and batch.num_rows:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last node may go on
                if cut:
                    yield emit(rows[:, :cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
        if size:
            yield emit(np.concatenate(held, axis=1))

    everything = (1 << BITS) - 1
    todo = codes.select("code", F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("node"))
    masks, out = [everything], None
    while True:
        rows = filed(todo, masks)
        masks = sorted({m & ~r for m in masks for r in ranges(m, LIMIT + 1) if r})
        big = stored(rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > node_codes).select("node"))
        done = not big.take(1)
        small = rows if done else rows.join(big, "node", "left_anti")
        placed = small.select("node", gray_rank(F.col("code")).alias("rank")).repartition("node").sortWithinPartitions("node", "rank")
        part = placed.mapInArrow(found, "u long, v long")
        out = part if out is None else out.unionByName(part)
        if done or not any(masks):
            return out
        todo = stored(rows.join(big, "node", "left_semi"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT,
                    node_codes: int = NODE_CODES) -> DataFrame:
    """``doc_id, fp, component_id`` per row; the component's id is its smallest doc_id."""
    prints = stored(fingerprints(docs, doc_id, text))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    tied = components(stored(links(classes.select(F.col("fp").alias("code")), limit, node_codes)))
    linked = classes.join(tied, classes["fp"] == tied["node"]).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("fp", "least")
    roots = classes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return join_unique(prints, roots, "fp", "inner").select("doc_id", "fp", "component_id")


def digits(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
