"""Whitening of embeddings: principal components by spectral divide and conquer.

Entries become integers first, so counts, sums and distances are exact.  Tasks sum up centred
products per partition; what reaches the driver is one square matrix of the dimension, whatever
the number of rows.  Its components come from polar decompositions (QDWH, dynamically weighted
Halley steps): the polar factor of the matrix minus a shift is +1 on the eigenvectors above the
shift and -1 below, which gives projectors on two invariant subspaces; each is split again until
it has one dimension.  Components, values and means travel to the tasks and whiten all rows.

Rows whose vector is null, empty, or holds a null or non-finite entry are dropped, as are
vectors whose length is not the most frequent one (the longer one of a tie).  Repeated rows count
and come out as often as they occur, null ids stay.  Entries from 2**46 on count as 2**46.
Components without variance (repeated or too few vectors) have the whitened value zero and stay
out of the identity error.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
_MOST = 2.0**52  # of a scaled entry; integers up to it are exact doubles
_LOW_BITS = 26  # sums are kept in two halves that do not overflow
_WIDE = 2**62
_SMALL = 1e-15  # lower bound of singular values that polar() assumes
_ROWS = 1024  # vectors that become result rows at once


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by QDWH."""
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    eye = np.eye(len(x))
    low = _SMALL
    for _ in range(12):
        low2 = low * low
        d = np.cbrt(4 * (1 - low2) / (low2 * low2))
        wa = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low2) / (low2 * np.sqrt(1 + d))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:  # far from orthogonal: the stable form
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            step = (wa - wb / wc) / np.sqrt(wc) * (q[: len(x)] @ q[len(x) :].T)
        else:
            step = (wa - wb / wc) * np.linalg.solve(eye + wc * (x @ x.T), x)
        after = wb / wc * x + step
        after = (after + after.T) / 2
        low = min(1.0, low * (wa + wb * low2) / (1 + wc * low2))
        moved = np.linalg.norm(after - x)
        x = after
        if 1 - low < 1e-15 and moved < 1e-8:
            break
    return x


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """An orthogonal basis of two invariant subspaces, and the dimension of the first.

    The first belongs to the eigenvalues above a shift.  The mean of the diagonal lies between
    the least and the greatest; shifts too near an eigenvalue leave a residue, and others are tried.
    """
    n = len(a)
    diagonal = np.diag(a)
    mean, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(n)) / np.sqrt(n)
    shifts = [float(np.median(diagonal)), mean, *(mean + spread * f for f in (0.05, -0.05, 0.15, -0.15, 0.3, -0.3))]
    best: tuple[float, np.ndarray, int] | None = None
    for shift in shifts:
        above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(above)))
        if not 0 < k < n:
            continue
        basis = rng.standard_normal((n, n))
        for _ in range(2):
            basis = np.linalg.qr(np.hstack([above @ basis[:, :k], basis[:, k:] - above @ basis[:, k:]]))[0]
        residue = np.linalg.norm(basis[:, :k].T @ a @ basis[:, k:])
        if best is None or residue < best[0]:
            best = residue, basis, k
        if residue <= 8 * n * np.finfo(float).eps * np.linalg.norm(a):
            break
    if best is None:  # equal up to rounding: any two parts do
        return np.eye(n), n // 2
    return best[1], best[2]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    rng = np.random.default_rng(11)
    a = (a + a.T) / 2
    tiny = np.finfo(float).eps * np.linalg.norm(a)
    found: list[np.ndarray] = []
    todo = [(a, np.eye(len(a)))]
    while todo:
        part, basis = todo.pop()
        if len(part) == 1 or np.linalg.norm(part - np.diag(np.diag(part))) <= tiny / len(a):
            found.append(basis)
            continue
        turned, k = split(part, rng)
        for own in (turned[:, :k], turned[:, k:]):
            smaller = own.T @ part @ own
            todo.append(((smaller + smaller.T) / 2, basis @ own))
    vectors = np.hstack(found)
    for _ in range(2):
        vectors = vectors @ (1.5 * np.eye(len(a)) - 0.5 * (vectors.T @ vectors))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """n vectors with these sums; components (rows of ``axes``) by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64-bit integers where they do, Python's beyond."""
        if self.n * max(int(np.abs(x).max(initial=0)), 1) < _WIDE:
            return self.n * x - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares per row; null beyond 64 bits."""
        apart = self.apart(x)
        if apart.dtype != object and (np.square(apart.astype(float)).sum(axis=1) < _WIDE).all():
            return np.square(apart).sum(axis=1).tolist()
        exact = [sum(v * v for v in row) for row in apart.astype(object).tolist()]
        return [v if v < 2**63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.varied, np.sqrt(np.where(self.varied, self.values, 1.0)), np.inf)
        return self.centred(x) @ (self.axes.T / scale)

    @property
    def varied(self) -> np.ndarray:
        least = len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)
        return self.values > least


def usable(df: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int, int]:
    """``vec_id, v`` of the rows to whiten, their number and their dimension."""
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    # A null entry makes the test null, which drops the row as well; NaN is above all numbers.
    finite = rows.filter(F.forall("v", lambda e: F.abs(e) < F.lit(float("inf"))) & (F.size("v") > 0))
    sizes = finite.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return finite, 0, 0
    return finite.filter(F.size("v") == top["d"]), top["n"], top["d"]


def scaled(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    entries = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(SCALE * entries), -_MOST, _MOST).astype(np.int64).reshape(-1, dim) + SHIFT


def _summed(rows: DataFrame, dim: int, shape: tuple[int, int], step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``step``, a matrix of ``shape``; one matrix a partition is shuffled.

    ``_halves`` are integers and are summed up exactly.
    """
    whole = step is _halves
    kind, item = ("long", "decimal(38,0)") if whole else ("double", "double")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = step(scaled(batch, dim))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": total.tolist()})

    entries = rows.mapInArrow(parts, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "v"))
    cells = entries.groupBy("i", "j").agg(F.sum(F.col("v").cast(item)).alias("v")).toArrow()
    out = np.zeros(shape, object if whole else float)
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = [int(v) if whole else v for v in cells["v"].to_pylist()]
    return out


def _halves(x: np.ndarray) -> np.ndarray:
    return np.stack([(x >> _LOW_BITS).sum(axis=0), (x & ((1 << _LOW_BITS) - 1)).sum(axis=0)])


def fit(rows: DataFrame, n: int, dim: int, components: int = COMPONENTS) -> Whitening:
    """Components of the covariance (divisor n) of all rows; two passes, centred before multiplying."""
    high, low = _summed(rows, dim, (2, dim), _halves).tolist()
    sums = [(h << _LOW_BITS) + v for h, v in zip(high, low, strict=True)]
    flat = Whitening(n, sums, np.zeros(0), np.zeros((0, dim)), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        c = flat.centred(x)
        return c.T @ c

    covariance = _summed(rows, dim, (dim, dim), products) / n
    values, vectors = eigen(covariance)
    k = min(components, dim)
    return Whitening(n, sums, values[:k], np.ascontiguousarray(vectors[:, :k].T), float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity; one more pass."""
    k, dim = len(model.values), len(model.sums)

    def products(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([model.whitened(x), np.ones(len(x))])
        return w.T @ w

    total = _summed(rows, dim, (k + 1, k + 1), products) / model.n
    covariance = total[:k, :k] - np.outer(total[:k, k], total[:k, k])
    off = np.abs(covariance - np.eye(k))[np.ix_(model.varied, model.varied)]
    return float(off.max(initial=0.0))


_RESULT = ("vec_id {}, component int, n long, deviation long, whitened double, "
           "explained double, identity_error double")


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component (numbered from 1 by falling variance).

    ``deviation`` is the exact sum of (n*x - S)**2 over the dimensions, null where it takes more
    than 64 bits; ``explained`` the component's share of all variance.
    """
    rows, n, dim = usable(df, vec_id, embedding)
    schema = _RESULT.format(rows.schema["vec_id"].dataType.simpleString())
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    model = fit(rows, n, dim, components)
    error = identity_error(rows, model)
    k = len(model.values)
    share = (np.maximum(model.values, 0.0) / model.trace if model.trace > 0 else np.zeros(k))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = scaled(part, dim)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n, np.int64)), pa.array(model.deviations(x), pa.int64()).take(each),
                     pa.array(model.whitened(x).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(results, schema)
