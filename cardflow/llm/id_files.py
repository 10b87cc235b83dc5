"""Token ids of documents in files of range-coded blocks, written and read by Spark.

A file row is a segment: a run of whole documents in ascending order of id, with their
ids (``doc_ids``), token counts (``counts``) and blocks (``data``, see ``coder``).  The
blocks of a segment hold its documents' ids back to back.  Segments are ordered by (part, seq).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.llm.coder import BLOCK_IDS, LANES, decode_blocks, encode_blocks, split_blocks
from cardflow.llm.prefix import running_totals
from cardflow.llm.text import released
from cardflow.llm.tokens import encoder

END_ID = 1
# A segment is closed once it has so many ids; a longer document is a segment of its own.
SEGMENT_IDS = 64 * BLOCK_IDS
FILE = "part int, seq int, doc_ids array<long>, counts array<long>, data binary"


def _segments(rows: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[tuple[list, list[int], np.ndarray]]:
    ids, counts, held, size = [], [], [], 0
    for doc_id, tokens in rows:
        ids.append(doc_id)
        counts.append(len(tokens))
        held.append(tokens)
        size += len(tokens)
        if size >= SEGMENT_IDS:
            yield ids, counts, np.concatenate(held)
            ids, counts, held, size = [], [], [], 0
    if ids:
        yield ids, counts, np.concatenate(held)


def _batched(items: Iterator, weight, limit: int) -> Iterator[list]:
    """Lists of items whose weights reach ``limit``."""
    held, total = [], 0
    for x in items:
        held.append(x)
        total += weight(x)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Segments of all documents, a row each.

    Null and empty texts have the end id only.  Null ids come first; documents that repeat
    an id are ordered by text.  An empty table has no segments.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder(tokenizer), np.array([end_id], np.uint32)

        def tokens() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                    yield None if pd.isna(i) else int(i), np.concatenate([enc.encode(t), end])

        seq = 0
        for group in _batched(_segments(tokens()), lambda s: -(-len(s[2]) // BLOCK_IDS), LANES):
            cuts = [[s[2][i : i + BLOCK_IDS] for i in range(0, len(s[2]), BLOCK_IDS)] for s in group]
            coded = iter(encode_blocks([b for c in cuts for b in c]))
            data = [b"".join(next(coded) for _ in c) for c in cuts]
            yield pd.DataFrame({"part": part, "seq": range(seq, seq + len(group)), "doc_ids": [s[0] for s in group],
                                "counts": [s[1] for s in group], "data": data})
            seq += len(group)

    return dealt.mapInPandas(released(rows), FILE)


def write(docs: DataFrame, path: str, tokenizer: str, **names: str) -> None:
    encoded(docs, tokenizer, **names).write.parquet(path)


def _documents(spark: SparkSession, path: str, name: str, kind: str, value: Callable[[bytes], object]) -> DataFrame:
    """doc_id, start, n_tokens and a column made of each document's ids in the task that decodes them."""
    files = spark.read.schema(FILE).parquet(path)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    sizes = files.select("part", "seq", total.alias("total"), F.lit(0).alias("all"))
    starts = running_totals(sizes, ["all"], "part", ["seq"], {"total": "begin"}).select("part", "seq", "begin")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments = (s for batch in batches for s in batch.itertuples(index=False))
        split = ((s, split_blocks(s.data)) for s in segments)
        for group in _batched(split, lambda x: len(x[1]), LANES):
            decoded = iter(decode_blocks([b for _, blocks in group for b in blocks]))
            for s, blocks in group:
                ids = np.concatenate([next(decoded) for _ in blocks]).astype("<u4")
                ends = np.cumsum(s.counts)
                begin = ends - s.counts
                yield pd.DataFrame({
                    "part": s.part, "seq": s.seq, "doc_id": pd.array(list(s.doc_ids), dtype="Int64"), "inner": begin,
                    "n_tokens": s.counts, name: [value(ids[a:b].tobytes()) for a, b in zip(begin, ends, strict=True)]})

    schema = f"part int, seq int, doc_id long, inner long, n_tokens long, {name} {kind}"
    return files.mapInPandas(released(rows), schema).join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", name)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit integers.  A damaged block fails the read.
    """
    return _documents(spark, path, "ids", "binary", bytes)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    return _documents(spark, path, "ids_crc32", "long", zlib.crc32)
