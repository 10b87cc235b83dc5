"""Similarity join on word shingles with signature trees.

Documents with equal shingle sets form a class; classes are the nodes of the join.
Two sets that reach the threshold share one of their first few shingles in any fixed order
(rare ones first here), so each such shingle roots a tree of the classes that have it.
A tree's leaves are classes in order of size; leaves form twigs, twigs pages, and 2^FAN_BITS
neighbours the node above them, up to a node or two at the top.  Nodes hold the OR of their
token bitmaps and their range of sizes.  The tree is traversed against itself from the top;
a pair of nodes is dropped when its largest possible overlap is too small, or when all
below it is already linked, and only pairs that are left are expanded.  Pairs of leaves are
judged by their parity bitmaps, which differ in at most as many bits as the sets differ in
shingles, however full they are.  What is left is verified on the full sets.

Two passes: the first verifies only neighbours in each tree and joins what they link into
components, which is enough for groups of near copies of any size; the second traverses
the trees for links between different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.components import components
from cardflow.llm.text import released, row_keys
from cardflow.session import stored

WIDTH, PERCENT = 3, 90
PAGE, TWIG = 64, 8
FAN_BITS = 4
# Bitmaps in the trees, in longs: TREE has the bits that are set, ODD those set an odd number of times.
# A class's own parity bitmap has about a bit per shingle.
TREE = tuple(f"t{i}" for i in range(8))
ODD = tuple(f"p{i}" for i in range(8))
TREE_BITS = 64 * len(TREE)
# The order of shingles puts frequent ones last: those that occur twice or more in a sample of one
# set in SAMPLE, at most FREQUENT of them.  It sets the work alone; any order gives the same result.
FREQUENT, SAMPLE = 500_000, 16
# Ids that are broadcast to fetch their texts; more are joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000
CACHED_WORDS = 200_000  # whose hashes a Python worker remembers
NO_ID = -(2**63)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_cache = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K1
    return (x ^ (x >> np.uint64(29))) * _K2


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words, A-Z lower-cased.

    Fewer words are one shingle; no words, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_cache) > CACHED_WORDS:
        _cache.clear()
    h = np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return tuple(np.frombuffer(digest, np.int64).tolist())


def bitmaps(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps of a set of hashes, in bytes: TREE_BITS bits that are set, and the parity of
    each bit's count, with as many bits as the next power of two of the size, TREE_BITS at least."""
    bits = max(TREE_BITS, 1 << int(len(s) - 1).bit_length())
    count = np.bincount((s >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits)
    either = (count > 0).reshape(-1, TREE_BITS).any(axis=0)
    return np.packbits(either, bitorder="little"), np.packbits((count & 1).astype(np.uint8), bitorder="little")


def folded(b: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap folded to ``size`` bytes: the one the set has at that width."""
    return np.bitwise_xor.reduce(b.reshape(-1, size), axis=0) if len(b) > size else b


def keyed(docs: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """One row per document (kind 0): h1, h2, doc_id, k1, k2, n; and rows of kind 1 with
    the shingles of a sample of sets: k1 (hash), n (count in a part of it)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def counts() -> pd.DataFrame:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"kind": 1, "h1": 0, "h2": 0, "doc_id": None, "k1": token.view(np.int64), "k2": 0, "n": count})

        for batch in batches:
            sets = [shingles(t, width) for t in batch["text"]]
            keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"kind": 0, "h1": batch["h1"], "h2": batch["h2"], "doc_id": batch["doc_id"],
                                "k1": keys[:, 0], "k2": keys[:, 1], "n": [len(s) for s in sets]})
            held += [s for s, k in zip(sets, keys, strict=True) if k[0] % SAMPLE == 0]
            size = sum(map(len, held))
            if size > 2_000_000:
                yield counts()
                held, size = [], 0
        if size:
            yield counts()

    own = docs.select(*row_keys(docs), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInPandas(released(rows), "kind int, h1 long, h2 long, doc_id long, k1 long, k2 long, n long")


def signed(docs: DataFrame, text: str, doc_id: str, width: int, percent: int, frequent: DataFrame) -> DataFrame:
    """Per document k1, k2, id, its first shingles in the global order, and its bitmaps."""
    last = np.sort(frequent.toArrow()["k1"].to_numpy().view(np.uint64))  # FREQUENT at most

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["id"], batch["text"], strict=True):
                s = shingles(t, width)
                if not len(s):
                    continue
                count = len(s) - (-(-percent * len(s) // 100)) + 1
                at = np.searchsorted(last, s)
                often = (last[np.minimum(at, len(last) - 1)] == s) if len(last) else np.zeros(len(s), bool)
                first = np.concatenate([s[~often], s[often]])[:count]
                tree, bits = bitmaps(s)
                odd = folded(bits, TREE_BITS // 8)
                longs = np.concatenate([tree, odd]).view(np.int64)
                out.append((i, *set_key(s), first.view(np.int64), bits.tobytes(), *longs.tolist()))
            yield pd.DataFrame(out, columns=["id", "k1", "k2", "first", "bits", *TREE, *ODD])

    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    return own.mapInPandas(released(rows), f"id long, k1 long, k2 long, first array<long>, bits binary, {', '.join(f'{c} long' for c in TREE + ODD)}")


def paged(classes: DataFrame) -> DataFrame:
    """Trees cut into pages: token, page, node, n, row by row in order of size.

    Equal sizes are in an order of each tree's own, so that near copies get other neighbours
    in every tree they share.  Rows are range-partitioned by this order, so the tree of a
    frequent token spreads over tasks.  Tokens of a single class are left out; at a partition's ends a single
    row stays, as its tree may go on next door.
    """
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = classes.select(F.explode("first").alias("token"), "n", "node")
    each = each.withColumn("turn", F.xxhash64("token", "node"))
    dealt = each.repartitionByRange(parts, "token", "n", "turn").sortWithinPartitions("token", "n", "turn", "node").drop("turn")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, pages, rest, before = TaskContext.get().partitionId() << 40, 0, None, None

        def cut(df: pd.DataFrame, ends: bool) -> pd.DataFrame:
            nonlocal pages, before
            token = df["token"].to_numpy()
            new = np.concatenate([[True], token[1:] != token[:-1]])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(token)))
            place = np.arange(len(token)) - np.repeat(start, size)
            page = np.cumsum(new | (place % PAGE == 0)) - 1 + pages
            pages += int(page[-1] - pages) + 1
            keep = np.repeat(size > 1, size)
            if before is None or before == token[0]:  # the tree may have begun next door, or just before
                keep[: size[0]] = True
            if ends:
                keep[start[-1] :] = True
            before = token[-1]
            return df.assign(page=base + page)[keep]

        for batch in batches:
            df = batch if rest is None else pd.concat([rest, batch])
            token = df["token"].to_numpy()
            whole = int(np.searchsorted(token, token[-1])) if len(token) else 0
            # A token's rows wait for the next batch in full pages only, so little is held.
            held = len(token) - whole
            whole += held // PAGE * PAGE if held > 4 * PAGE else 0
            if whole:
                yield cut(df.iloc[:whole], False)
            rest = df.iloc[whole:]
        if rest is not None and len(rest):
            yield cut(rest, True)

    return dealt.mapInPandas(released(rows), "token long, n long, node long, page long")


def _compatible(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return 100 * small >= percent * large


def neighbours(pages: DataFrame, percent: int) -> DataFrame:
    """Pairs u < v for the first pass: every leaf with the three before it and the first of its page."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            token, page, n, node = (df[c].to_numpy() for c in ("token", "page", "n", "node"))
            if len(page) < 2:
                continue
            first = np.repeat(*_starts(page))
            here = np.arange(len(page))
            for other in (here - 1, here - 2, here - 3, first):
                ok = (other >= 0) & (other < here)
                ok[ok] = (token[other[ok]] == token[ok]) & _compatible(n[other[ok]], n[ok], percent)
                a, b = node[other[ok]], node[ok]
                yield pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b)})

    return pages.mapInPandas(released(rows), "u long, v long").filter("u <> v").distinct()


def _starts(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of every run of equal values, and the runs' lengths."""
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return at, np.diff(np.append(at, len(group)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _possible(n_a, n_b, bits_a, bits_b, low_a, low_b, percent: int) -> np.ndarray:
    """May any set below a reach the threshold with any below b?  n: largest size; bits: OR
    of bitmaps; low: fewest bits of any one bitmap.  Bits without a partner are
    shingles that the other side lacks."""
    common = _popcount(bits_a & bits_b)
    missing = np.maximum(low_a - common, 0) + np.maximum(low_b - common, 0)
    return missing * (100 + percent) <= (n_a + n_b) * (100 - percent)


def _alike(n_a, n_b, odd_a, odd_b, percent: int) -> np.ndarray:
    """May two sets reach the threshold?  Every bit in which their parity bitmaps differ is a
    shingle that only one of them has."""
    return _popcount(odd_a ^ odd_b) * (100 + percent) <= (n_a + n_b) * (100 - percent)


def traversed(leaves: DataFrame, percent: int) -> DataFrame:
    """Pairs u < v of different components within each page, from a traversal of its twigs.

    ``leaves`` are page, n, node, root and bitmaps, in any order; pages are put together here, in order of size.
    """

    def walk(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        page, n, node, root = (df[c].to_numpy() for c in ("page", "n", "node", "root"))
        bits = df[list(TREE)].to_numpy().view(np.uint64)
        odd = df[list(ODD)].to_numpy().view(np.uint64)
        low = _popcount(bits)
        start, size = _starts(page)
        place = np.arange(len(page)) - np.repeat(start, size)
        at, held = _starts(np.cumsum(place % TWIG == 0))
        either = np.bitwise_or.reduceat(bits, at, axis=0)
        least, most = n[at], n[at + held - 1]
        fewest = np.minimum.reduceat(low, at)
        one = np.minimum.reduceat(root, at) == np.maximum.reduceat(root, at)
        for step in range(PAGE // TWIG):
            a = np.arange(len(at) - step)
            b = a + step
            ok = (page[at[a]] == page[at[b]]) & _compatible(most[a], least[b], percent)
            ok &= ~(one[a] & one[b] & (root[at[a]] == root[at[b]]))
            a, b = a[ok], b[ok]
            ok = _possible(most[a], most[b], either[a], either[b], fewest[a], fewest[b], percent)
            a, b = a[ok], b[ok]
            for i in range(TWIG):
                for j in range(i + 1 if step == 0 else 0, TWIG):
                    both = (i < held[a]) & (j < held[b])
                    x, y = at[a[both]] + i, at[b[both]] + j
                    keep = (root[x] != root[y]) & _compatible(n[x], n[y], percent)
                    x, y = x[keep], y[keep]
                    keep = _alike(n[x], n[y], odd[x], odd[y], percent)
                    x, y = x[keep], y[keep]
                    if len(x):
                        yield pd.DataFrame({"u": np.minimum(node[x], node[y]), "v": np.maximum(node[x], node[y])})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            df = batch if rest is None else pd.concat([rest, batch])
            page = df["page"].to_numpy()
            whole = int(np.flatnonzero(page != page[-1])[-1]) + 1 if len(page) and page[0] != page[-1] else 0
            if whole:
                yield from walk(df.iloc[:whole])
            rest = df.iloc[whole:]
        if rest is not None and len(rest):
            yield from walk(rest)

    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole_pages = leaves.repartition(parts, "page").sortWithinPartitions("page", "n", "node")
    return whole_pages.mapInPandas(released(rows), "u long, v long")


def _levels(pages: DataFrame) -> list[int]:
    """By how many bits a page's number is shifted to name the nodes above it, level by level.

    Numbers of a tree's pages are consecutive within a partition, whose own number begins at
    bit 40; at the last level a tree has two nodes at most.
    """
    within = pages.groupBy("token", F.shiftright("page", 40).alias("part")).agg(
        (F.max("page") - F.min("page")).alias("span"))
    each = within.groupBy("token").agg(F.max("span").alias("span"), (F.max("part") - F.min("part")).alias("parts"))
    span, parts = each.agg(F.coalesce(F.max("span"), F.lit(0)), F.coalesce(F.max("parts"), F.lit(0))).first()
    out = [FAN_BITS]
    while span >> out[-1]:
        out.append(out[-1] + FAN_BITS)
    if parts:
        out.append(40 + FAN_BITS)
        while parts >> (out[-1] - 40):
            out.append(out[-1] + FAN_BITS)
    return out


def across_pages(leaves: DataFrame, percent: int) -> DataFrame:
    """Pairs u < v of different components on different pages of one tree.

    ``leaves`` are token, page, n, node, root and bitmaps of the trees of several pages.  Their
    nodes are traversed in pairs from the top; a level's pairs that may hold a link are
    expanded to the pairs of the nodes below, down to pages and then leaves.
    """

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*[F.col(c).alias(c + mark) for c in df.columns])

    def bits_of(columns, how) -> Column:
        return sum((F.bit_count(how(c)) for c in columns[1:]), F.bit_count(how(columns[0]))).cast("long")

    low = bits_of(TREE, F.col)
    summary = [F.min("least").alias("least"), F.max("most").alias("most"), F.min("root").alias("root"),
               F.max("other").alias("other"), F.min("low").alias("low"), *[F.bit_or(c).alias(c) for c in TREE]]
    own = leaves.select("token", "page", F.col("n").alias("least"), F.col("n").alias("most"), "root",
                        F.col("root").alias("other"), low.alias("low"), *TREE)
    pages = stored(own.groupBy("token", "page").agg(*summary))
    levels = _levels(pages)

    def nodes(shift: int, above: int) -> DataFrame:
        """The nodes of a level, by place, and the place of the one above."""
        at = pages.groupBy("token", F.shiftright("page", shift).alias("place")).agg(*summary) if shift else (
            pages.withColumnRenamed("page", "place"))
        return at.withColumn("above", F.shiftright("place", above - shift))

    common = bits_of(TREE, lambda c: F.col(f"{c}_a").bitwiseAND(F.col(f"{c}_b")))
    missing = F.greatest(F.col("low_a") - common, F.lit(0)) + F.greatest(F.col("low_b") - common, F.lit(0))
    one = (F.col("root_a") == F.col("other_a")) & (F.col("root_b") == F.col("other_b")) & (F.col("root_a") == F.col("root_b"))
    may_link = (
        (100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a"))
        & ~one & (missing * (100 + percent) <= (F.col("most_a") + F.col("most_b")) * (100 - percent)))

    top = nodes(levels[-1], levels[-1])
    met = side(top, "_a").join(side(top, "_b"), (F.col("token_a") == F.col("token_b"))
                               & (F.col("place_a") <= F.col("place_b")) & may_link)
    for shift, above in zip([0, *levels][-2::-1], levels[::-1], strict=True):
        # Level by level, as one plan of all takes the driver's memory each time that it is planned anew.
        pairs = stored(met.select(F.col("token_a").alias("token"), F.col("place_a").alias("up_a"), F.col("place_b").alias("up_b")))
        below = nodes(shift, above)
        # A page meets itself within `traversed`.
        order = F.col("place_a") <= F.col("place_b") if shift else F.col("place_a") < F.col("place_b")
        met = pairs.join(side(below, "_a"), (F.col("token") == F.col("token_a")) & (F.col("up_a") == F.col("above_a"))).join(
            side(below, "_b"), (F.col("token") == F.col("token_b")) & (F.col("up_b") == F.col("above_b")) & order & may_link)

    leaf = leaves.select("page", "n", "node", "root", *ODD)
    apart = bits_of(ODD, lambda c: F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    found = stored(met.select("place_a", "place_b")).join(side(leaf, "_a"), F.col("place_a") == F.col("page_a")).join(
        side(leaf, "_b"),
        (F.col("place_b") == F.col("page_b")) & (F.col("root_a") != F.col("root_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)))
    return found.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v"))


def _bound(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column, percent: int) -> Column:
    """May two classes reach the threshold, by their own parity bitmaps?"""

    @F.pandas_udf("boolean")
    def possible(n_a: pd.Series, n_b: pd.Series, bits_a: pd.Series, bits_b: pd.Series) -> pd.Series:
        out = []
        for n, m, x, y in zip(n_a, n_b, bits_a, bits_b, strict=True):
            p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            width = min(len(p), len(q))
            missing = int(np.bitwise_count(folded(p, width) ^ folded(q, width)).sum())
            out.append(missing * (100 + percent) <= (n + m) * (100 - percent))
        return pd.Series(out, dtype=bool)

    return possible(n_a, n_b, bits_a, bits_b)


def _sets_of(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """node, members (hashes) of the given classes (node, id, k1, k2)."""
    ids = nodes.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch["text"]]
            keys = np.array([set_key(s) for s in sets], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"id": batch["id"], "k1": keys[:, 0], "k2": keys[:, 1], "members": [s.view(np.int64) for s in sets]})

    found = own.join(ids, "id", "left_semi").mapInPandas(released(rows), "id long, k1 long, k2 long, members array<long>")
    # Rows that repeat an id with an equal text give their class once.
    return found.join(nodes, ["id", "k1", "k2"]).select("node", "members").dropDuplicates(["node"])


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, text: str, doc_id: str, width: int, percent: int) -> DataFrame:
    """Pairs of classes that reach the threshold, stored; first by their bitmaps, then by their sets."""
    side = classes.select("node", "n", "bits")
    a, b = side.toDF("u", "n_u", "bits_u"), side.toDF("v", "n_v", "bits_v")
    near = pairs.join(a, "u").join(b, "v").filter(
        _bound(F.col("n_u"), F.col("n_v"), F.col("bits_u"), F.col("bits_v"), percent)).select("u", "v")
    near = stored(near)
    if near.isEmpty():
        return near
    nodes = near.select(F.col("u").alias("node")).union(near.select(F.col("v").alias("node"))).distinct()
    sets = stored(_sets_of(docs, classes.select("node", "id", "k1", "k2").join(nodes, "node", "left_semi"), text, doc_id, width))

    full = near.join(sets.toDF("u", "set_u"), "u").join(sets.toDF("v", "set_v"), "v")
    # 100 * common >= percent * union, the union being both sizes less what is common.
    common = F.size(F.array_intersect("set_u", "set_v"))
    linked = (100 + percent) * common >= percent * (F.size("set_u") + F.size("set_v"))
    return stored(full.filter(linked).select("u", "v"))


def groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """h1, h2 (key of the row), doc_id, n (set size), root and root_id: the component (null
    without shingles) and the smallest doc_id in it.

    Rows with null or empty texts have n = 0 and their own id.  Rows that repeat an id are
    documents of their own; a null id counts as greater than any other.
    """
    rows = stored(keyed(docs, text, doc_id, width))
    own = rows.filter("kind = 0").drop("kind")
    frequent = rows.filter("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(
        F.desc("n"), "k1").limit(FREQUENT).select("k1")
    ids = own.filter("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).withColumn("node", F.monotonically_increasing_id())
    ids = stored(ids.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))))
    signs = signed(docs, text, doc_id, width, percent, frequent)
    wanted = ids.drop("doc_id")
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_IDS else wanted
    classes = stored(signs.join(wanted, ["id", "k1", "k2"]).dropDuplicates(["node"]))

    pages = stored(paged(classes))
    links = verified(docs, classes, neighbours(pages, percent), text, doc_id, width, percent)
    tied = stored(components(links))

    # Trees that are one component by now hold no link that is needed.
    in_tree = stored(pages.join(tied, "node", "left").withColumn("root", F.coalesce("root", "node")))
    trees = in_tree.groupBy("token").agg(
        (F.min("root") < F.max("root")).alias("open"), (F.min("page") < F.max("page")).alias("wide"))
    open_trees = stored(in_tree.join(trees.filter("open").drop("open"), "token"))
    bits = classes.select("node", *TREE, *ODD)
    leaves = open_trees.join(bits, "node").select("page", "n", "node", "root", *TREE, *ODD)
    wide = stored(open_trees.filter("wide").drop("wide").join(bits, "node"))
    pairs = traversed(leaves, percent).unionByName(across_pages(wide, percent)).distinct()
    more = verified(docs, classes, stored(pairs), text, doc_id, width, percent)
    if not more.isEmpty():
        tied = stored(components(links.union(more)))

    named = ids.select("k1", "k2", "node", "doc_id").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("root_id"))
    label = named.join(least, "root").select("k1", "k2", "root", "root_id")
    full = own.join(label, ["k1", "k2"], "left")
    return full.select("h1", "h2", "doc_id", "n", "root", F.when(F.col("n") > 0, F.col("root_id")).otherwise(F.col("doc_id")).alias("root_id"))
