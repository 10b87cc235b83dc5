"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from cardflow.llm import queries, whitening
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, n long, i int"


def brute(vectors, k=32):
    """x, exact deviations, eigenvalues, axes and trace of a list of vectors."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return centred, deviation, values[::-1][:k], axes[:, ::-1][:, :k], values.sum()


def check(rows, vectors, ids, k=32):
    centred, deviation, values, axes, trace = brute(vectors, k)
    k = len(values)
    assert len(rows) == len(vectors) * k
    white = np.zeros((len(vectors), k))
    at = {v: i for i, v in enumerate(ids)}
    for r in rows:
        i, j = at[r["vec_id"]], r["component"] - 1
        white[i, j] = r["whitened"]
        assert r["n"] == len(vectors) and r["deviation"] == deviation[i]
        assert r["explained"] == pytest.approx(values[j] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9
    expected = centred @ axes / np.sqrt(values)
    signs = np.sign((white * expected).sum(axis=0))
    np.testing.assert_allclose(white, expected * signs, atol=1e-6)


def test_query_equals_numpy(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    kept = [r for r in table if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    df = queries.op11_embedding_whitening(spark, DATA)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(df.collect(), [r["embedding"] for r in kept], [r["vec_id"] for r in kept])


def test_odd_rows(spark):
    """Null, short, non-finite and null-holding vectors go; clashing names do no harm."""
    rng = np.random.default_rng(3)
    good = [(i, rng.standard_normal(4).astype("float32").tolist(), 7, 1) for i in range(40)]
    bad = [(100, None, 1, 1), (101, [], 1, 1), (102, [1.0, None, 2.0, 3.0], 1, 1), (103, [1.0, float("nan"), 0.0, 0.0], 1, 1),
           (104, [float("inf"), 0.0, 0.0, 0.0], 1, 1), (105, [1.0, 2.0], 1, 1)]
    rows = whitening.whiten(spark.createDataFrame(good + bad, SCHEMA).repartition(5)).collect()
    check(rows, [g[1] for g in good], [g[0] for g in good])


def test_repeated_and_empty(spark):
    same = [(None, [0.5, -1.0], 0, 0)] * 6
    rows = whitening.whiten(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(rows) == 12
    assert {(r["vec_id"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {
        (None, 6, 0, 0.0, 0.0, 0.0)}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wide_numbers(spark):
    """Deviations are exact, and null beyond 64 bits."""
    vectors = [[1e6, 0.0], [-1e6, 1.0], [3e30, 2.0]]
    rows = whitening.whiten(spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert len(rows) == 6 and all(r["deviation"] is None for r in rows)
    few = whitening.whiten(spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors[:2])], SCHEMA)).collect()
    assert {r["deviation"] for r in few} == set(brute(vectors[:2])[1])


def test_fit_accumulates_over_batches(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((300, 6)).tolist()
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(vectors)], SCHEMA).repartition(7)
    stored = [r["embedding"] for r in df.orderBy("vec_id").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        check(whitening.whiten(df, components=3).collect(), stored, range(300), 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("values", [np.ones(9), np.repeat([3.0, 2.0, 1.0], 5), 10.0 ** -np.arange(20), np.r_[1.0, np.zeros(7)]])
def test_eigen_of_hard_matrices(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))[0]
    a = (q * values) @ q.T
    found, axes = whitening.eigen(a)
    np.testing.assert_allclose(found, np.sort(values)[::-1], atol=1e-13)
    np.testing.assert_allclose(axes.T @ a @ axes, np.diag(found), atol=1e-13)
    np.testing.assert_allclose(axes.T @ axes, np.eye(len(values)), atol=1e-13)


def test_polar_has_signs_of_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((8, 8)))[0]
    signs = np.array([1, 1, -1, 1, -1, -1, 1, -1.0])
    found = whitening.polar((q * (signs * [5, 1e-6, 3, 2, 1e-9, 4, 1, 0.1])) @ q.T)
    np.testing.assert_allclose(found, (q * signs) @ q.T, atol=1e-6)
