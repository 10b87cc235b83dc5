"""Quality classifier: kernel ridge regression by random Fourier features.

Statistics of whole texts are standardised and sent through random Fourier features,
which approximate a Gaussian kernel.  Every partition sums its part of the normal equations;
the sums give ridge scores.  Isotonic regression on rows kept apart turns scores
into probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.session import stored

N_FEATURES, RIDGE, SEED = 256, 1e-3, 7
BANDWIDTH = 1.0  # in units of the root of the number of statistics
BINS = 512  # of the score, for the calibration
STATS = 22
# Bytes of classes that are counted (fixed values).
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n",
            b".,;:", b"!?", b"#*$%&|<>", b"'\"()[]{}-_", b"@/\\=+~^`")
_CLASS_OF = np.full(256, len(_CLASSES))
for _i, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c)] = _i


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; those of the empty text for null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    shares = np.bincount(_CLASS_OF, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(_CLASSES) + 1) / n
    words = raw.split()
    k = max(1, len(words))
    pairs = len(set(zip(words, words[1:]))) / max(1, k - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    packed = len(zlib.compress(raw, 1)) / n
    return np.array([
        *shares, np.log1p(len(words)), sizes.mean(), sizes.std(), len(set(words)) / k, pairs,
        len(set(lines)) / m, ends, np.log1p(k / m), packed, shares[7] * n / k, shares[1] / (shares[0] + shares[1] + 1e-9),
    ])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    at: np.ndarray  # calibration: scores and their probabilities
    p: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return expanded(stats, self.mean, self.scale) @ self.theta

    def predict(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.scores(stats), self.at, self.p), 0.0, 1.0)


def expanded(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(len(mean), N_FEATURES)) / (BANDWIDTH * np.sqrt(len(mean)))
    shift = rng.uniform(0, 2 * np.pi, N_FEATURES)
    x = np.clip((stats - mean) / scale, -8, 8)
    z = np.sqrt(2 / N_FEATURES) * np.cos(x @ w + shift)
    return np.hstack([z, np.ones((len(z), 1))])


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and stats of every document, in input order."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.select(F.col(doc_id).alias("doc_id"), stats(F.col(text)).alias("stats"))


def pooled(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) fit of values with weights, by pooling neighbours."""
    blocks: list[list[float]] = []
    for v, c in zip(value, count, strict=True):
        blocks.append([v * c, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.repeat([s / c for s, c, _ in blocks], [int(n) for _, _, n in blocks])


def fit(stats: DataFrame, labels: DataFrame, fit_row: Column, calibration_row: Column, label: str = "quality") -> Model | None:
    """Fit on labelled rows; None if ``fit_row`` leaves no labelled row.

    ``labels`` has doc_id and the label; null labels are skipped, of several labels of
    a document the greatest counts.  Means and deviations are those of all documents.
    """
    moments = stats.agg(
        F.array(*[F.coalesce(F.avg(F.get("stats", F.lit(i))), F.lit(0.0)) for i in range(STATS)]),
        F.array(*[F.coalesce(F.stddev_pop(F.get("stats", F.lit(i))), F.lit(0.0)) for i in range(STATS)]),
    ).first()
    mean, scale = np.array(moments[0]), np.maximum(np.array(moments[1]), 1e-6)
    one = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    rows = stats.join(one, "doc_id")

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((N_FEATURES + 1, N_FEATURES + 2))
        for batch in batches:
            z = expanded(np.stack(batch["stats"].to_numpy()), mean, scale)
            total += z.T @ np.column_stack([z, batch["y"]])
        if total[-1, -2]:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": parts["i"].iloc[:1], "v": [np.sum(np.stack(parts["v"].to_numpy()), axis=0)]})

    sums = rows.filter(fit_row).mapInPandas(equations, "i int, v array<double>").groupBy("i").applyInPandas(
        added, "i int, v array<double>").collect()
    if not sums:
        return None
    full = np.array([r["v"] for r in sorted(sums, key=lambda r: r["i"])])
    n = full[-1, -2]
    theta = np.linalg.solve(full[:, :-1] + RIDGE * n / N_FEATURES * np.eye(len(full)), full[:, -1])
    raw = Model(mean, scale, theta, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = np.clip(raw.scores(np.stack(batch["stats"].to_numpy())), -0.5, 1.5)
            yield pd.DataFrame({"bin": np.floor((score + 0.5) / 2 * (BINS - 1)).astype(int), "s": score, "y": batch["y"]})

    bins = rows.filter(calibration_row).mapInPandas(binned, "bin int, s double, y double").groupBy("bin").agg(
        F.avg("s").alias("s"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if not bins:
        return Model(mean, scale, theta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    p = pooled(np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], dtype=float))
    return Model(mean, scale, theta, np.array([r["s"] for r in bins]), p)


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row; 0.5 without a model."""

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack(rows.to_numpy())) if model and len(rows) else np.full(len(rows), 0.5))

    return stats.select("doc_id", score("stats").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, remainder: Column, held_out: int = 0, folds: int = 5) -> DataFrame:
    """Score all documents; learn from labelled rows outside the held-out fold.

    ``remainder`` gives each doc_id its fold; the one after the held-out fold calibrates.
    Documents without an id are never learned from.
    """
    stats = stored(measured(docs))
    apart = (held_out + 1) % folds
    model = fit(stats, labels, ~remainder.isin(held_out, apart), remainder == apart)
    return scored(stats, model)
