"""Commits: an attempt counts wholly or not at all, and once."""

import threading

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.sources import commits
from cardflow.sources.commits import CommitTable, put_once

SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("at", T.TimestampType())])


def numbers(spark, first, last, parts=4):
    n = spark.range(first, last, 1, parts).withColumnRenamed("id", "n")
    return n.withColumn("at", F.timestamp_seconds("n"))


def read(spark, table):
    return sorted(r.n for r in table.read(spark, SCHEMA).collect())


def streamed(spark, table, checkpoint, kill_at=None):
    """Run until the input is used up; the numbers of each micro-batch."""
    seen = []

    def sink(batch, n):
        if n == kill_at:
            raise RuntimeError("killed")
        seen.append(sorted(r.n for r in batch.collect()))

    query = table.stream(spark, SCHEMA).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return seen


def test_killed_commit_is_never_seen_and_then_once(spark, tmp_path, monkeypatch):
    table = CommitTable(f"{tmp_path}/t")
    assert table.write(numbers(spark, 0, 10), "p", 0)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # all files are written, the commit is not
        m.setattr(commits, "put_once", killed)
        with pytest.raises(RuntimeError, match="killed"):
            table.write(numbers(spark, 10, 20), "p", 1)
    assert read(spark, table) == list(range(10)) and table.rows() == 10
    assert streamed(spark, table, f"{tmp_path}/cp") == [list(range(10))]
    assert table.write(numbers(spark, 10, 20), "p", 1)
    assert not table.write(numbers(spark, 10, 20), "p", 1)
    assert streamed(spark, table, f"{tmp_path}/cp") == [list(range(10, 20))]
    assert read(spark, table) == list(range(20))
    assert table.sweep() == 1 and read(spark, table) == list(range(20))


def test_task_that_dies_leaves_nothing(spark, tmp_path):
    table = CommitTable(f"{tmp_path}/t")
    bad = numbers(spark, 0, 100).withColumn("n", F.when(F.col("n") < 90, F.col("n")).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        table.write(bad, "p", 0)
    assert table.rows() == 0 and read(spark, table) == []
    assert table.write(numbers(spark, 0, 100), "p", 0) and read(spark, table) == list(range(100))


def test_of_two_attempts_at_a_batch_one_counts(spark, tmp_path, monkeypatch):
    """Both look before either has committed; the second finds the first one's commit."""
    table, both = CommitTable(f"{tmp_path}/t"), threading.Barrier(2)
    put = commits.put_once

    def together(*args):
        both.wait(60)
        return put(*args)

    monkeypatch.setattr(commits, "put_once", together)
    won = []
    attempts = [threading.Thread(target=lambda: won.append(table.write(numbers(spark, 0, 50), "p", 0))) for _ in range(2)]
    for t in attempts:
        t.start()
    for t in attempts:
        t.join()
    assert sorted(won) == [False, True]
    assert read(spark, table) == list(range(50)) and table.sweep() == 1


def test_producers_side_by_side_and_a_killed_reader(spark, tmp_path):
    table = CommitTable(f"{tmp_path}/t")
    table.write(numbers(spark, 0, 5), "a", 0)
    assert streamed(spark, table, f"{tmp_path}/cp") == [list(range(5))]
    table.write(numbers(spark, 5, 9), "b", 7)
    table.write(numbers(spark, 9, 12), "a", 1)
    with pytest.raises(Exception, match="killed"):
        streamed(spark, table, f"{tmp_path}/cp", kill_at=1)
    assert streamed(spark, table, f"{tmp_path}/cp") == [list(range(5, 12))]
    # A commit without rows wakes no one, so a service that reads its own topic comes to rest.
    table.write(numbers(spark, 0, 0), "a", 2)
    assert streamed(spark, table, f"{tmp_path}/cp") == []
    table.write(numbers(spark, 12, 14), "a", 3)
    assert streamed(spark, table, f"{tmp_path}/cp") == [[12, 13]]
    batches = {r.batch for r in table.read(spark, SCHEMA).select("batch").collect()}
    assert batches == {0, 1, 3, 7}


def test_object_is_created_once(tmp_path):
    fs = pafs.LocalFileSystem()
    assert put_once(fs, f"{tmp_path}/x/1", b"one") and not put_once(fs, f"{tmp_path}/x/1", b"two")
    assert (tmp_path / "x" / "1").read_bytes() == b"one"
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["1"]
