"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Each entry becomes ``floor(256 * c)``; the fit list is every distinct vector of these integers once.  The covariance is never
formed: a pass over the stored fit list gives ``Xᵀ X Q`` of the centred rows for a block ``Q`` of bounded width, summed per
task and then by about the square root of the tasks, so the driver holds a few blocks only.  A round applies a Chebyshev
polynomial to the block (one pass per degree), which damps the spectrum below the smallest Ritz value, then takes QR and
Rayleigh-Ritz; the product needed for the residuals is the next round's first degree.  Rounds end when the residuals of the
wanted components are as small as double precision allows.  A block as wide as the vectors needs one pass.

Edge cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; shorter vectors count as having
zeros at the end; repeated rows and rows without ``vec_id`` are kept, each with its own result; other columns are ignored.
Components whose eigenvalue is zero (to ``ZERO`` of the trace) cannot be whitened and are left out, so one distinct vector,
empty vectors or an empty table give no rows.  A deviation beyond 63 bits is null.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize

COMPONENTS = 4
#: Columns of the block beyond the wanted components, and the degree of the filter.
GUARD = 28
DEGREE = 12
MAX_ROUNDS = 200
#: Residuals, as a share of the largest eigenvalue: aimed at, and the most that is accepted once they stop falling.
AIM, ACCEPT = 2e-15, 1e-12
ZERO = 1e-13
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """Of the fit list: rows, sums of each entry and the sum of squares, all exact."""

    n: int
    sums: list[int]
    squares: int

    @property
    def trace(self) -> float:
        return (self.n * self.squares - sum(s * s for s in self.sums)) / self.n ** 2 if self.n else 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: machine integers where they suffice, else Python's."""
        most = max(int(np.abs(x).max(initial=0)), max(map(abs, self.sums), default=0))
        if most == -(1 << 63) or self.n * most >= 1 << 61:
            return self.n * x.astype(object) - np.array(self.sums, object)
        return self.n * x - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squared_lengths(self, x: np.ndarray) -> list[int | None]:
        dev = self.deviations(x)
        if dev.dtype == object or int(np.abs(dev).max(initial=0)) ** 2 * max(1, x.shape[1]) >= 1 << 63:
            dev = dev.astype(object)
        return [v if v < 1 << 63 else None for v in map(int, (dev * dev).sum(axis=1))] if len(dev) else []


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` of the rows that stay, all of one length."""
    whole = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    whole = whole.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    longest = whole.agg(F.max(F.size("v"))).first()[0] or 0
    x = F.transform("v", lambda c: F.floor(256 * c))
    return whole.select("vec_id", F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("v"))).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column.values) // len(column) if len(column) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def _total(rows: DataFrame, part: Callable[[np.ndarray], tuple]) -> tuple | None:
    """Sums the tuples that ``part`` makes of each batch's matrix, first within tasks, then over groups of tasks."""
    def add(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        total = None
        for p in parts:
            total = p if total is None else tuple(a + b for a, b in zip(total, p, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    def first(batches):
        return add(part(_matrix(b.column("x"))) for b in batches if b.num_rows)

    def second(batches):
        return add(pickle.loads(p) for b in batches for p in b.column("part").to_pylist())

    tasks = rows.rdd.getNumPartitions()
    parts = rows.select("x").mapInArrow(first, "part binary").repartition(max(1, math.isqrt(tasks))).mapInArrow(second, "part binary").collect()
    total = None
    for row in parts:
        p = pickle.loads(row["part"])
        total = p if total is None else tuple(a + b for a, b in zip(total, p, strict=True))
    return total


def moments(fit: DataFrame) -> Moments:
    def part(x: np.ndarray) -> tuple:
        x = x.astype(object) if int(np.abs(x.astype(np.float64)).max(initial=0)) ** 2 * x.size >= 1 << 62 else x
        sums = np.array([int(s) for s in x.sum(axis=0)], object)
        return len(x), sums, int((x * x).sum())

    total = _total(fit, part)
    return Moments(total[0], list(total[1]), total[2]) if total else Moments(0, [], 0)


def _product(fit: DataFrame, known: Moments, q: np.ndarray) -> np.ndarray:
    """The covariance times ``q``: one pass."""
    def part(x: np.ndarray) -> tuple:
        c = known.centred(x)
        return (c.T @ (c @ q),)

    return _total(fit, part)[0] / known.n


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values by falling size, Ritz vectors, and their images."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def leading(fit: DataFrame, known: Moments, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, their unit eigenvectors as columns, and the certified residual as a share of the first."""
    d = len(known.sums)
    width, wanted = min(d, wanted + GUARD), min(d, wanted)
    q = np.eye(d) if width == d else np.linalg.qr(np.random.default_rng(11).standard_normal((d, width)))[0]
    values, q, vq = _ritz(q, _product(fit, known, q))
    before = math.inf
    for _ in range(MAX_ROUNDS):
        gap = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / max(values[0], 1e-300)
        if width == d or gap <= AIM or (gap <= ACCEPT and gap > before / 2):
            return values[:wanted], q[:, :wanted], float(gap)
        before = gap
        # the polynomial stays small on [0, smallest Ritz value] and is scaled to one at the largest
        half = max(values[-1], 1e-12 * values[0]) / 2
        scale = half / (values[0] - half)
        sigma, last, now = scale, q, (vq - half * q) * (scale / half)
        for _ in range(DEGREE - 1):
            following = 1 / (2 / scale - sigma)
            last, now = now, 2 * following / half * (_product(fit, known, now) - half * now) - sigma * following * last
            sigma = following
        q = np.linalg.qr(now)[0]
        values, q, vq = _ritz(q, _product(fit, known, q))
    raise ArithmeticError(f"the leading components did not settle in {MAX_ROUNDS} rounds; residual {before:.1e}")


def _identity_error(fit: DataFrame, known: Moments, whitener: np.ndarray) -> float:
    def part(x: np.ndarray) -> tuple:
        w = known.centred(x) @ whitener
        return (w.T @ w,)

    return float(np.abs(_total(fit, part)[0] / known.n - np.eye(whitener.shape[1])).max())


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """A row for each vector that stays and each component, numbered from 1 by falling eigenvalue."""
    rows = integer_vectors(vectors, key, column)
    fit = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "whitening-fit")
    known = moments(fit)
    trace, kept, whitener, explained, error = known.trace, 0, None, [], 0.0
    if trace > 0:
        values, vectors_, _ = leading(fit, known, wanted)
        kept = int((values > ZERO * trace).sum())
        whitener = vectors_[:, :kept] / np.sqrt(values[:kept])
        explained, error = (values[:kept] / trace).tolist(), _identity_error(fit, known, whitener)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not kept:
                continue
            x = _matrix(batch.column("x"))
            size = len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(size), kept)))
            long = pa.array([v for v in known.squared_lengths(x) for _ in range(kept)], pa.int64())
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), size)), pa.array(np.full(size * kept, known.n)), long,
                pa.array((known.centred(x) @ whitener).ravel()), pa.array(np.tile(np.array(explained), size)), pa.array(np.full(size * kept, error))],
                [f.split()[0] for f in RESULT.split(", ")])

    return rows.mapInArrow(project, RESULT)
