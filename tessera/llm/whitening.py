"""Embedding whitening: randomised range finder, power passes over all rows, Rayleigh-Ritz.

Entries become whole numbers x = floor(1024 * c) + 100000, so their sums S are exact. A random basis, wider than the
components asked by `OVERSAMPLE`, is multiplied by the covariance in a pass over all centred rows, made orthonormal, and
multiplied again; after each pass the eigenvectors of the covariance on the basis (Rayleigh-Ritz) are tried: they
are taken once every residual is below `TOLERANCE` of the gap to the next eigenvalue. If `PASSES` passes don't get
there, or the rate of the last two shows that they won't, the basis grows to the full dimension, where one pass gives all
eigenvectors to double precision. A task adds up a matrix of dimension x basis and emits it as cells, which Spark
adds by number; the driver sees only sums over all rows, whose size follows from the dimension.

Defined cases: rows whose vector is null, holds null or non-finite entries, or has another length than most (the
shorter one on a tie) are left out, of the fit as well; repeated rows count as often as they occur, null ids stay; an entry beyond
2^53 counts as 2^53. A component without variance (one row, equal rows, fewer rows than components) has explained 0 and
whitened null, and identity_error is over the others, or null without any. `deviation` is null where a long can't hold it;
`deviation_exact` holds up to 38 digits. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
OVERSAMPLE = 8
PASSES = 6
TOLERANCE = 1e-10
SCALE, SHIFT = 1024, 100_000
#: Doubles hold every whole number up to here.
LIMIT = 1 << 53
SEED = 17


def whole_numbers(column, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sound vectors in a batch's column, and their x, a row each."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    c = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    sound = np.isfinite(c).all(axis=1)
    x = np.clip(np.floor(SCALE * c[sound]) + SHIFT, -LIMIT, LIMIT)
    return at[sound], x.astype(np.int64)


def usual_length(vectors: DataFrame, column: str) -> int:
    """The length of most vectors; 0 if there is none."""
    lengths = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("length")).count()
    top = lengths.orderBy(F.desc("count"), "length").limit(1).collect()
    return top[0]["length"] if top else 0


class Rows:
    """The sound vectors of a column, and sums over all of them."""

    def __init__(self, vectors: DataFrame, column: str):
        self.frame, self.dimension = vectors.select(column), usual_length(vectors, column)
        self.n, self.sums = self._whole_sums() if self.dimension else (0, [])
        #: What is near the mean as whole numbers, and what S leaves beside n times that: both exact.
        self.base = [(2 * s + self.n) // (2 * self.n) for s in self.sums] if self.n else []
        self.rest = [s - b * self.n for s, b in zip(self.sums, self.base)]

    def _whole_sums(self) -> tuple[int, list[int]]:
        dimension = self.dimension

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dimension + 1, 2), object)  # the last row counts; high and low parts can't overflow
            for batch in batches:
                _, x = whole_numbers(batch.column(0), dimension)
                total[:-1, 0] += (x >> 26).sum(axis=0)
                total[:-1, 1] += (x & ((1 << 26) - 1)).sum(axis=0)
                total[-1, 1] += len(x)
            if total[-1, 1]:
                yield pa.RecordBatch.from_arrays([pa.array(range(dimension + 1), pa.int32()), pa.array(total[:, 0], pa.int64()), pa.array(total[:, 1], pa.int64())], ["cell", "high", "low"])

        add = lambda c: F.sum(F.col(c).cast("decimal(19,0)")).alias(c)
        got = {r["cell"]: (int(r["high"]) << 26) + int(r["low"]) for r in self.frame.mapInArrow(partial, "cell int, high long, low long").groupBy("cell").agg(add("high"), add("low")).collect()}
        return got.get(dimension, 0), [got[k] for k in range(dimension)] if got else []

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n."""
        return (x - np.array(self.base, np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)^2, exactly."""
        away = x - np.array(self.base, np.int64)
        most = (float(np.abs(away).max(initial=0)) + 1) * self.n
        if most * most * self.dimension < 2.0**62:
            return ((away * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        return ((away.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(axis=1).tolist()

    def summed(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of the cells that `of` adds up over some centred rows."""
        rows, dimension = self.bare(), self.dimension

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                _, x = whole_numbers(batch.column(0), dimension)
                if len(x):
                    part = of(rows.centred(x))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["cell", "value"])

        got = self.frame.mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(len(got))
        for r in got:
            out[r["cell"]] = r["value"]
        return out

    def bare(self) -> "Rows":
        """A copy that tasks can be sent."""
        out = object.__new__(Rows)
        out.dimension, out.n, out.sums, out.base, out.rest = self.dimension, self.n, self.sums, self.base, self.rest
        return out


def covariance_times(rows: Rows, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """V times the basis, and the trace of V: one pass over all rows."""
    got = rows.summed(lambda c: np.append((c.T @ (c @ basis)).ravel(), (c * c).sum()))
    return got[:-1].reshape(basis.shape) / rows.n, got[-1] / rows.n


def ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Falling eigenvalues on the basis, their vectors, and the norms of the residuals. image: V times the basis."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def principal(rows: Rows, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The first eigenvalues of V, their unit vectors (the largest entry of each is positive), and the trace."""
    d = rows.dimension
    k = min(components, d)
    width = min(d, k + OVERSAMPLE)
    basis, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))
    before = None
    for done in range(1, PASSES + 1):
        image, trace = covariance_times(rows, basis)
        values, vectors, residuals = ritz(basis, image)
        gaps = np.array([np.delete(np.abs(values - values[j]), j).min(initial=np.inf if d == 1 else values[0]) for j in range(k)])
        off = float((residuals[:k] / np.maximum(gaps, np.finfo(float).tiny)).max())
        if width == d or off <= TOLERANCE:
            break
        hopeless = before is not None and off * min(off / before, 1.0) ** (PASSES - done) > TOLERANCE
        if done == PASSES or hopeless:  # the whole space, where the residuals are rounding alone
            basis, _ = np.linalg.qr(np.concatenate([vectors, np.eye(d)], axis=1))
            image, trace = covariance_times(rows, basis)
            values, vectors, _ = ritz(basis, image)
            break
        before = off
        basis, _ = np.linalg.qr(image)
    vectors = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
    return values[:k], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)]), trace


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each sound vector and component: key, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    kind = dict(vectors.select(key).dtypes)[key]
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    rows = Rows(vectors, column)
    if not rows.n:
        return vectors.sparkSession.createDataFrame([], schema)
    values, axes, trace = principal(rows, components)
    varies = values > 16 * rows.dimension * np.finfo(float).eps * max(trace, 0.0)
    scaled = axes[:, varies] / np.sqrt(values[varies])
    k, kept = len(values), int(varies.sum())
    error = None
    if kept:
        got = rows.summed(lambda c: np.concatenate([(c @ scaled).sum(axis=0), ((c @ scaled).T @ (c @ scaled)).ravel()])) / rows.n
        mean, square = got[:kept], got[kept:].reshape(kept, kept)
        error = float(np.abs(square - np.outer(mean, mean) - np.eye(kept)).max())
    explained = np.where(varies, values / trace if trace > 0 else 0.0, 0.0)
    bare, dimension = rows.bare(), rows.dimension

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole_numbers(batch.column(1), dimension)
            deviations = bare.deviation(x)
            white = np.zeros((len(x), k))
            white[:, varies] = bare.centred(x) @ scaled
            m = len(x)
            per_row = np.repeat(np.arange(m), k)
            exact = pa.array([Decimal(v) if v < 10**38 else None for v in deviations], pa.decimal128(38, 0))
            longs = pa.array([v if v < 1 << 63 else None for v in deviations], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, bare.n, np.int64)),
                    longs.take(pa.array(per_row)),
                    pa.array(white.ravel(), mask=np.tile(~varies, m)),
                    pa.array(np.tile(explained, m)),
                    pa.array([error] * (m * k), pa.float64()),
                    exact.take(pa.array(per_row)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return vectors.select(key, column).mapInArrow(projected, schema)
