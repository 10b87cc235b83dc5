"""Mixing sources to target weights.

Each source's texts form one stream of words, cut into fixed-length blocks.  Every output
shard draws how many of its slots each source gets from a multinomial
distribution; slots that the draws give a source beyond its quota go to those below theirs.  The
n-th slot of a source takes the block at place n of a pseudorandom permutation of its
blocks (a keyed Feistel network), once more from the start when all are used.  Slots
and blocks are then joined by block index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardflow.llm.prefix import running_totals
from cardflow.llm.text import row_keys, unused, word_count, words
from cardflow.session import stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 16_384
# Rows of a source that are summed up in one task.
CHUNK_ROWS = 4_096
# Sources are a dimension table: their totals and targets are handled on the driver.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    rows: int
    target: float
    n_blocks: int
    quota: int  # slots


def targets(sizes: Sequence[int], weights: Sequence[float], repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight; none above ``repeats`` times its size.

    What a capped source leaves is shared by the others by weight, again and again.
    """
    out = [0.0] * len(sizes)
    free, rest = set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / total for i in sorted(free)}
        over = [i for i in share if share[i] > repeats * sizes[i]]
        for i in over or share:
            out[i] = float(repeats * sizes[i]) if over else share[i]
        if not over:
            break
        rest -= sum(out[i] for i in over)
        free -= set(over)
    return out


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 sends ``place``, by row.

    A four-round Feistel network on the next even number of bits, repeated while the
    result is not below n.
    """
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n = place.astype(np.uint64), n.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            mix = _mixed(right, key[todo] + np.uint64(r * 0x632BE59B)) & mask[todo]
            left, right = right, left ^ mix
        x[todo] = (left << half[todo]) | right
        todo = x >= n
    return x.astype(np.int64)


def _key(seed: int, src: np.ndarray) -> np.ndarray:
    return _mixed(src.astype(np.uint64), np.full(len(src), seed, dtype=np.uint64))


def place_of(at: int, n: int, key: np.ndarray) -> int:
    """The place that ``permuted`` sends to ``at``: the same rounds, backwards."""
    half = np.uint64(max(1, math.ceil(math.log2(max(n, 2)) / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = np.array([at], dtype=np.uint64)
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(4)):
            left, right = right ^ (_mixed(left, key + np.uint64(r * 0x632BE59B)) & mask), left
        x = (left << half) | right
        if x[0] < n:
            return int(x[0])


def taken_by_quota(quota: int, size: int, n_blocks: int, block: int, seed: int, src: int) -> int:
    """Words of the first ``quota`` slots of a source; its last block may be short."""
    if not n_blocks:
        return 0
    rounds, rest = divmod(quota, n_blocks)
    short = n_blocks * block - size
    has_last = place_of(n_blocks - 1, n_blocks, _key(seed, np.array([src]))) < rest
    return rounds * size + rest * block - short * has_last


def plan_sources(
    rows: Sequence[tuple[str | None, int, int]], weights: Sequence[float], block: int, repeats: int, seed: int
) -> list[Source]:
    """Targets and slot quotas; sources by code point, null last."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in ordered]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], repeats)
    out = []
    for i, ((name, size, n), t) in enumerate(zip(ordered, goal, strict=True)):
        blocks = math.ceil(size / block)
        guess = round(t * blocks / size) if size else 0
        near = [q for q in range(guess - 1, guess + 2) if 0 <= q <= repeats * blocks]
        quota = min(near, key=lambda q: (abs(taken_by_quota(q, size, blocks, block, seed, i) - t), q))
        out.append(Source(name, size, n, t, blocks, quota))
    return out


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *row_keys(docs))


def _number(sources: Sequence[Source], values: Sequence[int], source: Column) -> Column:
    """A value per source, by literal map; null is looked up as a flagged key."""
    pairs = [x for s, v in zip(sources, values, strict=True) for x in (F.lit(("n:" if s.name is None else "s:" + s.name)), F.lit(v))]
    key = F.when(source.isNull(), F.lit("n:")).otherwise(F.concat(F.lit("s:"), source))
    return F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("long")


def packed(sizes: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """Sizes with the source's number ``src`` and the document's ``start`` in its stream.

    Documents are ordered by a chunk (a hash of the id), id and size within a source.
    """
    chunks = [max(1, math.ceil(s.rows / CHUNK_ROWS)) for s in sources]
    placed = sizes.withColumn("src", _number(sources, list(range(len(sources))), F.col("source")).cast("int"))
    placed = placed.withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id"), _number(sources, chunks, F.col("source")).cast("long"))
    )
    return running_totals(placed, ["src"], "chunk", ["doc_id", "size", "h1", "h2"], {"size": "start"})


def pieces(placed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Parts of documents in blocks: src, block, start (of the document), first (word), n_words."""
    last = F.expr(f"(start + size - 1) div {block}")
    each = placed.filter("size > 0").select(
        "src", "doc_id", "h1", "h2", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return each.select("src", "block", "doc_id", "h1", "h2", "start", (begin - F.col("start")).alias("first"), (end - begin).alias("n_words"))


def slots(spark, sources: Sequence[Source], shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """One row per slot of the mix: shard, src, n (of the source's slots), block."""
    quota = np.array([s.quota for s in sources], dtype=np.int64)
    blocks = np.array([max(1, s.n_blocks) for s in sources], dtype=np.int64)
    total = int(quota.sum())
    shards = math.ceil(total / shard_slots)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                size = min(shard_slots, total - int(shard) * shard_slots)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(size, quota / total)
                yield pd.DataFrame({"shard": shard, "src": np.arange(len(quota), dtype=np.int32), "drawn": counts})

    draws = spark.range(shards).mapInPandas(drawn, "shard long, src int, drawn long")
    draws = draws.withColumn("chunk", F.expr("shard div 4096"))
    counted = running_totals(draws, ["src"], "chunk", ["shard"], {"drawn": "n"})
    limits = F.element_at(F.array(*[F.lit(int(q)) for q in quota]) if len(quota) else F.array(F.lit(0)), F.col("src") + 1)
    keep = F.least(F.col("drawn"), F.greatest(F.lit(0), limits - F.col("n")))
    counted = counted.withColumns({"keep": keep, "free": F.col("drawn") - keep, "all": F.lit(0)})
    # Freed slots, numbered over all shards, meet the missing slots, numbered over all sources.
    freed = running_totals(
        counted.groupBy("all", "chunk", "shard").agg(F.sum("free").alias("free")), ["all"], "chunk", ["shard"], {"free": "free_from"})
    have = {r["src"]: r["n"] for r in counted.groupBy("src").agg(F.sum("keep").alias("n")).collect()}
    got = np.array([have.get(i, 0) for i in range(len(quota))], dtype=np.int64)
    ends = np.cumsum(quota - got)

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, count, first in zip(batch["shard"], batch["free"], batch["free_from"], strict=True):
                at = np.arange(first, first + count)
                src = np.searchsorted(ends, at, side="right")
                before = ends[src] - (quota - got)[src]
                yield pd.DataFrame({"shard": shard, "src": src.astype(np.int32), "n": got[src] + at - before})

    own = counted.filter("keep > 0").select("shard", "src", F.explode(F.expr("sequence(n, n + keep - 1)")).alias("n"))
    given = freed.filter("free > 0").select("shard", "free", "free_from").mapInPandas(filled, "shard long, src int, n long")

    @F.pandas_udf("long")
    def block_of(src: pd.Series, n: pd.Series) -> pd.Series:
        s = src.to_numpy()
        return pd.Series(permuted(n.to_numpy() % blocks[s], blocks[s], _key(seed, s)))

    return own.unionByName(given).withColumn("block", block_of("src", "n"))


@dataclass(frozen=True)
class Mix:
    sources: list[Source]
    placed: DataFrame  # doc_id, source, size, src, start
    slots: DataFrame
    pieces: DataFrame


def mix(
    docs: DataFrame, text: str = "text", weights: Sequence[float] = WEIGHTS, block: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS, repeats: int = MAX_REPEATS, seed: int = 0,
    source: str = "source", doc_id: str = "doc_id",
) -> Mix:
    """Plan a mix of all documents.

    Null and empty texts have size 0 and are never taken; a null source is a source of
    its own, the last.  Rows that repeat an id are documents of their own.  An empty
    table gives empty frames.  Only ids, sources and word counts are stored and shuffled.
    """
    sizes = stored(sized(docs, text, source, doc_id))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = plan_sources([(r["source"], r["size"], r["n"]) for r in rows], weights, block, repeats, seed)
    placed = packed(sizes, sources)
    return Mix(sources, placed, slots(docs.sparkSession, sources, shard_slots, seed), pieces(placed, block))


def taken(plan: Mix) -> DataFrame:
    """Per document doc_id, source, size, source_size, target and taken words, repeats counted."""
    used = plan.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
    of_docs = plan.pieces.join(used, ["src", "block"]).groupBy("src", "start").agg(
        F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    # Documents of size 0 share a start with the next one.
    full = plan.placed.withColumn("start", F.when(F.col("size") > 0, F.col("start")))
    source_size = _number(plan.sources, [s.size for s in plan.sources], F.col("source"))
    target = _number(plan.sources, [s.target for s in plan.sources], F.col("source"))
    return full.join(of_docs, ["src", "start"], "left").select(
        "doc_id", "source", "size", source_size.cast("long").alias("source_size"), target.cast("double").alias("target"),
        F.coalesce("taken", F.lit(0)).alias("taken"))


def runs_of(parts: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(first word, words) of what is taken of a document, from parts (first, n_words, times).

    Neighbouring parts that are taken equally often make one run, so a document that is
    taken whole stays whole.
    """
    parts = sorted(parts)
    for layer in range(1, max(t for _, _, t in parts) + 1):
        begin = end = -1
        for first, n, times in parts:
            if times < layer:
                continue
            if first != end:
                if end > begin:
                    yield begin, end - begin
                begin = first
            end = first + n
        yield begin, end - begin


def one_of_equal(rows: DataFrame, h1: str = "h1", h2: str = "h2") -> DataFrame:
    """One row for each key h1, h2; tasks drop their own copies before the shuffle."""
    first = Window.partitionBy(h1, h2).orderBy(h1)
    place, = unused(rows, "_rn")
    return rows.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(place)


def mixed_texts(docs: DataFrame, plan: Mix, text: str = "text", block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself in the columns of ``docs``: a row per run of words that is taken.

    A document that is taken whole keeps its text; of other runs the words are joined
    by spaces.  Texts are shuffled once; equal rows once for all of them.
    """
    used = plan.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
    spans = plan.pieces.join(used, ["src", "block"]).groupBy(
        "h1", "h2", F.expr(f"start % {block}").alias("cut"), "first", "n_words").agg(F.sum("times").alias("times"))
    h1, h2, parts, spans_of, split, size_of, span = unused(docs, "h1", "h2", "_parts", "_runs", "_words", "_size", "_run")
    listed = spans.groupBy(F.col("h1").alias(h1), F.col("h2").alias(h2), "cut").agg(
        F.collect_list(F.struct("first", "n_words", "times")).alias(parts)).select(h1, h2, parts)
    joined = one_of_equal(docs.select("*", *row_keys(docs, h1, h2)), h1, h2).join(listed, [h1, h2]).drop(h1, h2)
    runs = F.udf(lambda parts: [(int(a), int(n)) for a, n in runs_of([tuple(p) for p in parts])],
                 "array<struct<first:int,n:int>>")
    cut = joined.withColumn(spans_of, runs(parts)).drop(parts).withColumn(split, words(F.col(text)))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    each = cut.select(*kept, split, F.size(split).alias(size_of), F.explode(spans_of).alias(span))
    taken_text = F.when((F.col(f"{span}.first") == 0) & (F.col(f"{span}.n") == F.col(size_of)), F.col(text)).otherwise(
        F.array_join(F.slice(split, F.col(f"{span}.first") + 1, F.col(f"{span}.n")), " "))
    return each.withColumn(text, taken_text).select(kept)
