"""Embedding whitening: Chebyshev-filtered subspace iteration.

The covariance of the fit list is never formed: a pass multiplies it with a block
of vectors, centred X'(XQ), summed over the partitions.  A Chebyshev polynomial
of the covariance, applied by its three-term recurrence, damps the unwanted part
of the spectrum; QR and Rayleigh-Ritz turn the filtered block into eigenpairs.
Rounds go on until the residuals certify the wanted ones.  The lower end of the
spectrum comes from a few Lanczos steps, its damped upper end from the last
Ritz values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import staged
from tiller.llm.vectors import binary_matrix, dimension, integer_rows, row_slices, summed

COMPONENTS, SCALE = 4, 256
#: Vectors of a block, passes of a filter, Lanczos steps, rounds at most.
BLOCK, DEGREE, LANCZOS, MOST_ROUNDS = 32, 8, 10, 200
#: Certified: no residual beyond this part of the largest eigenvalue ...
CERTIFIED = 1e-13
#: ... or, where rounding allows no less, beyond this one and no longer falling.
ROUNDING = 1e-11
#: A filter lifts the largest eigenvalue over the last wanted one by this factor at most,
#: beyond which rounding of the one would bury the other.
MOST_LIFT = 1e8
#: Eigenvalues below this part of the largest are 0.
NOTHING = 1e-12
#: Components are smaller than this.
LIMIT = 1 << 31


def _matrices(batches, dim: int):
    for batch in batches:
        for a, b in row_slices(batch.num_rows, dim):
            part = batch.slice(a, b - a)
            yield part, binary_matrix(part.column("x"), "<i4", dim)


def _added(dim: int, of: Callable):
    """Partial sums of ``of(x)`` over a partition's rows."""
    def partial(batches):
        total = None
        for _, x in _matrices(batches, dim):
            own = of(x)
            total = own if total is None else total + own
        return total

    return partial


def ritz(apply: Callable, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors, and the norms of their residuals; one pass."""
    image = apply(block)
    small = block.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = block @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def lowest(apply: Callable, dim: int, steps: int = LANCZOS) -> float:
    """An estimate from below of the smallest eigenvalue, by Lanczos steps."""
    basis = [np.random.default_rng(7).standard_normal(dim)]
    basis[0] /= np.linalg.norm(basis[0])
    diagonal, beside = [], []
    for _ in range(min(dim, steps)):
        w = apply(basis[-1][:, None])[:, 0]
        diagonal.append(basis[-1] @ w)
        for _ in range(2):  # reorthogonalised in full
            w = w - np.stack(basis, 1) @ (np.stack(basis) @ w)
        beside.append(np.linalg.norm(w))
        if beside[-1] <= 1e-14 * max(map(abs, diagonal)):
            break
        basis.append(w / beside[-1])
    t = np.diag(diagonal) + np.diag(beside[: len(diagonal) - 1], 1) + np.diag(
        beside[: len(diagonal) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    return max(0.0, values[0] - beside[-1] * abs(vectors[-1, 0]))


def filtered(apply: Callable, block: np.ndarray, low: float, high: float, top: float,
             degree: int = DEGREE) -> np.ndarray:
    """A Chebyshev polynomial of the operator on ``block``, small between ``low`` and ``high``.

    Scaled so that it is about 1 at ``top``; one pass for each degree.
    """
    half, centre = (high - low) / 2, (high + low) / 2
    first = sigma = half / (top - centre)
    before, now = block, (apply(block) - centre * block) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (2 * after / half) * (apply(now) - centre * now) - sigma * after * before
        sigma = after
    return now


def eigenpairs(apply: Callable, dim: int, wanted: int, size: int = BLOCK,
               degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their vectors, certified by residuals."""
    size = min(dim, max(size, 2 * wanted))
    block = np.eye(dim) if size == dim else np.linalg.qr(
        np.random.default_rng(11).standard_normal((dim, size)))[0]
    values, vectors, residual = ritz(apply, block)
    low, last = None, np.inf
    for _ in range(MOST_ROUNDS):
        worst, top = residual[:wanted].max(), values[0]
        if size == dim or worst <= CERTIFIED * top or ROUNDING * top >= worst > last / 2:
            break
        last = worst
        low = lowest(apply, dim) if low is None else low
        if values[-1] < low:  # the estimate was too high: the filter lifted what lies below
            low = max(0.0, 2 * values[-1] - low)
        spread = top - low
        # the damped part ends below the wanted values, also where many are equal
        least = values[min(wanted, size) - 1]
        high = max(min(values[-1], low + 0.98 * (least - low)), low + 1e-12 * spread)
        lift = math.acosh(max(1.0, (2 * top - high - low) / (high - low))) - math.acosh(
            max(1.0, (2 * least - high - low) / (high - low)))
        steps = max(1, int(min(degree, math.log(MOST_LIFT) / max(lift, 1e-9))))
        block = np.linalg.qr(filtered(apply, vectors, low, high, top, steps))[0]
        values, vectors, residual = ritz(apply, block)
    else:
        raise ArithmeticError("the eigenvectors did not converge")
    wanted = min(wanted, size)
    vectors = vectors[:, :wanted]
    most = np.abs(vectors).argmax(axis=0)
    return values[:wanted], vectors * np.where(vectors[most, np.arange(wanted)] < 0, -1.0, 1.0)


def _rows(dim: int, n: int, total: np.ndarray, turn: np.ndarray):
    """Of every row: deviation, and a row for each component."""
    k, mean = turn.shape[1], total / n
    top = int(np.abs(total).max()) if dim else 0

    def emit(batches):
        for part, x in _matrices(batches, dim):
            biggest = n * int(np.abs(x.astype(np.int64)).max()) + top if len(x) else 0
            exact = np.int64 if dim * biggest ** 2 < 1 << 63 else object
            gap = n * x.astype(exact) - total.astype(exact)
            deviation = (gap * gap).sum(axis=1)
            whitened = (x - mean) @ turn
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.repeat(deviation, k).tolist(), pa.int64()),
                 pa.array(whitened.ravel())], ["id", "component", "deviation", "whitened"])

    return emit


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``.

    A row for every usable row of ``vectors`` and every component.  Left out are
    vectors that are NULL, hold a NULL or non-finite component or have another
    length than most (ties: the shorter).  Repeated vectors count once in the
    fit and all get rows; so do rows that share an id or have none.  Components
    with eigenvalue 0 do not exist: a table with one distinct vector, or none,
    gives no rows.  A component of 2^31 / ``scale`` or more, or a deviation
    beyond a long, is an error.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    dim = dimension(vectors, vec_col)
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"))
    rows = staged(integer_rows(named, "vector", dim, scale, LIMIT, ["id"]), "integers")
    fit = staged(rows.select("x").distinct(), "fit-list")

    def over(of, dtype=np.float64):
        return summed(fit, _added(dim, of), dtype)

    sums = over(lambda x: np.concatenate(([len(x)], x.sum(axis=0, dtype=np.int64))), np.int64)
    schema = (f"`{id_col}` long, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    if sums is None or sums[0] < 2:
        return spark.createDataFrame([], schema)
    n, total = int(sums[0]), sums[1:]
    mean = total / n

    def apply(q):
        def product(x):
            centred = x - mean
            return (centred.T @ (centred @ q)).ravel()

        return over(product).reshape(q.shape) / n

    trace = float(over(lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    values, axes = eigenpairs(apply, dim, components)
    real = values > NOTHING * max(values[0], 0.0)
    values, turn = values[real], axes[:, real] / np.sqrt(values[real])

    def spread(x):
        white = (x - mean) @ turn
        return (white.T @ white).ravel()

    error = np.abs(over(spread).reshape(len(values), -1) / n - np.eye(len(values))).max()
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    out = rows.mapInArrow(_rows(dim, n, total, turn),
                          "id long, component int, deviation long, whitened double")
    return out.select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"),
                      "deviation", "whitened", F.element_at(explained, F.col("component"))
                      .alias("explained"), F.lit(float(error)).alias("identity_error"))
