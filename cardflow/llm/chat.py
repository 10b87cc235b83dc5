"""Chat formatting with cumulative-snapshot collapse.

A chat logged after every turn leaves conversations that are prefixes of longer ones.
A rolling hash of the turns names every prefix of every conversation; a conversation
whose whole hash is a proper prefix of another is dropped by an anti-join, and of equal
conversations the smallest id stays.  What is left is rendered.

The rolling hash is a sum of turn hashes that include the turn's place, so it is
a running total: a conversation with very many turns is cut into chunks like any hot group, by
ranges of the turns' order and then by place, so that equal and null turns are cut as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.prefix import running_totals
from cardflow.session import stored

CHUNK_TURNS = 4096
# Bits of a turn's hash; sums of 2^31 of them fit a long.  Two such sums name a prefix.
HASH_BITS = 32


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation, from 0; stored.

    Order is by turn, role and text; null turns come first.  Repeated rows are turns of their own.
    Rows without a conv_id belong to no conversation and are left out.
    """
    own = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", "role", "text", F.lit(1).cast("long").alias("one"))
    order = ["turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored before it is used: the numbers of ranges must not change if a task is repeated.
    laid = stored(own.repartitionByRange(parts, "conv_id", *order).withColumn("chunk", F.spark_partition_id()))
    return stored(running_totals(laid, ["conv_id"], "chunk", order, {"one": "place"}))


def turn_hash(seed: int) -> Column:
    full = F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    return full.bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def prefixes(placed: DataFrame) -> DataFrame:
    """Per turn the hashes ``p1, p2`` of the prefix that ends with it, and its length."""
    hashed = placed.select("conv_id", "place", turn_hash(1).alias("t1"), turn_hash(2).alias("t2"),
                           F.expr(f"place div {CHUNK_TURNS}").alias("part"))
    summed = running_totals(hashed, ["conv_id"], "part", ["place"], {"t1": "b1", "t2": "b2"})
    return summed.select("conv_id", (F.col("place") + 1).alias("length"),
                         (F.col("b1") + F.col("t1")).alias("p1"), (F.col("b2") + F.col("t2")).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, n_turns) that are no prefix of a longer one, nor a later copy."""
    return _maximal(numbered(turns))


def _maximal(placed: DataFrame) -> DataFrame:
    each = prefixes(placed)
    size = placed.groupBy("conv_id").agg((F.max("place") + 1).alias("n_turns"))
    marked = each.join(size, "conv_id")
    whole = marked.filter("length = n_turns").groupBy("p1", "p2", "n_turns").agg(F.min("conv_id").alias("conv_id"))
    longer = marked.filter("length < n_turns").select("p1", "p2", F.col("length").alias("n_turns")).distinct()
    return whole.join(longer, ["p1", "p2", "n_turns"], "left_anti").select("conv_id", "n_turns")


def rendered(turns: DataFrame) -> DataFrame:
    """Maximal conversations as text, a row each: conv_id, n_turns, text.

    A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``; null roles and texts are
    empty.  An empty table gives no rows.
    """
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"),
                    F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    placed = numbered(turns)
    kept = placed.join(_maximal(placed), "conv_id").select("conv_id", "n_turns", "place", line.alias("line"))
    whole = kept.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
