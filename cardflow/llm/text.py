"""Column helpers on whole texts, all of them built-in Spark expressions."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order; none if it is null."""
    found = F.array_remove(F.split(text, SPACES), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(text, UPPER, UPPER.lower())


def windows(hashes: Column, width: int) -> Column:
    """A 64-bit hash of every run of ``width`` neighbours in an array of hashes."""
    last = F.size(hashes) - width
    starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, width)))


# Bytes of an Arrow batch on its way to a Python worker; rows alone do not bound whole texts.
BATCH_BYTES = 4 << 20


def release_memory() -> None:
    """Give a Python worker's unused memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def released(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's step that gives its memory back to the system at the end.

    Python workers are kept for later tasks; without this they also keep what the largest one took.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            release_memory()

    return run


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where the frame has such a column already."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_keys(docs: DataFrame, h1: str = "h1", h2: str = "h2") -> list[Column]:
    """128 bits that tell rows apart; rows with equal keys are equal in all columns but maps."""
    cols = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(nulls, *cols).alias(h1), F.xxhash64(F.lit(1), nulls, *cols).alias(h2)]
