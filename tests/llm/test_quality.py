import numpy as np
import pytest
from pyspark.sql import functions as F

from cardflow.llm import quality as q
from cardflow.llm.queries import op4_quality_classifier


def test_isotonic_fit_pools_violators():
    out = q.pooled(np.array([0.2, 0.1, 0.5, 0.4, 0.9]), np.array([1.0, 1, 1, 3, 1]))
    assert out.tolist() == pytest.approx([0.15, 0.15, 0.425, 0.425, 0.9])
    assert (np.diff(q.pooled(np.random.default_rng(0).random(200), np.ones(200))) >= 0).all()


def test_features_approximate_the_gaussian_kernel():
    x = np.random.default_rng(1).normal(size=(60, q.STATS))
    z = q.expanded(x, np.zeros(q.STATS), np.ones(q.STATS))[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-far / (2 * q.STATS))).mean() < 0.06


def test_partition_sums_equal_one_solution(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, q.STATS)), rng.integers(0, 2, 300)
    stats = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, stats array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = q.fit(stats, labels, F.lit(True), F.lit(True))
    z = q.expanded(x, x.mean(axis=0), x.std(axis=0))
    want = np.linalg.solve(z.T @ z + q.RIDGE * 300 / q.N_FEATURES * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ model.theta, z @ want, atol=1e-6)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op4_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x " * 200_000, 0.5), (2, "", 0.5), (5, "ok", 1.0)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    assert [r.score for r in q.classify(docs, none, fold).collect()] == [0.5] * 5
    some = spark.createDataFrame([(1, 1), (2, 0), (5, None), (5, 1), (7, 1)], "doc_id long, quality int")
    scores = [r.score for r in q.classify(docs, some, fold).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert q.classify(docs.limit(0), some, fold).count() == 0
