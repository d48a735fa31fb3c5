"""Whitening of embeddings by leading eigenvectors of their covariance, without the covariance matrix.

The covariance V of the whole-number vectors is only used through products V Q with
a thin block Q.  A product is one Spark job: every task centres its vectors, forms
its share of Y' (Y Q) / n, and Spark sums the shares entry by entry; a block of
dimensions x columns is all that reaches the driver.

Block Jacobi-Davidson finds the eigenvectors: Rayleigh-Ritz on the search space
gives Ritz pairs; those whose residual has reached double precision are locked and
projected out; for all others at once, the correction equations

    (I - QQ')(V - theta I)(I - QQ') t = -residual,   Q: locked and current Ritz vectors

are solved roughly by some steps of MINRES (one product each, for all columns), and
the solutions enlarge the search space, which restarts from its best Ritz vectors
when it is full.

Precision: entries are long numbers about 1,000,000, so squares of raw entries would
lose the covariance.  Sums are whole numbers; with S = q n + r an entry is centred as
(x - q) - r / n, rounded once.  ``deviation`` is a sum of squares of whole numbers;
where it leaves the range of a long it is null, never wrong.

Results for odd rows: a vector that is null or holds a null or non-finite entry takes
no part, and no more do vectors of another length than the most common one (the longer
of equally common ones); a null vec_id is kept; repeated vectors count as often as they
occur; equal eigenvalues have any orthonormal basis of their space; components without
variance (below rounding of the trace) are left out, so that a table of equal vectors,
a single vector or vectors without entries give no rows; an empty table gives no rows;
other columns are not read.  Texts have no part here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.session import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Residuals at which a pair is locked, of the largest eigenvalue.
PRECISION = 1e-14
#: Steps of MINRES for a correction, and Ritz vectors beyond the wanted ones.
INNER, GUARD = 6, 8
ROUNDS = 60
_EPS = float(np.finfo(float).eps)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the whole-number vector of every row that takes part."""
    c = F.col("embedding")
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT)
    return embeddings.where(c.isNotNull() & ~odd).select("vec_id", x.alias("x"))


@dataclass(frozen=True)
class Fitted:
    """Size, sums and leading eigenpairs of a table of vectors."""

    rows: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            yield batch, flat.reshape(batch.num_rows, width)


def _summed(table: DataFrame, width: int, share: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Entry-wise sum of ``share(vectors)`` over all batches of all tasks."""

    def partial(batches):
        total = None
        for _, x in _matrices(batches, width):
            one = share(x).ravel()
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"entry": np.arange(total.size), "value": total})

    rows = table.select("x").mapInArrow(partial, f"entry long, value {kind}").groupBy("entry").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), np.int64 if kind == "long" else float)
    for r in rows:
        out[r["entry"]] = r["value"]
    return out


def _centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    whole = sums // n
    return (x - whole) - (sums - whole * n) / n


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what ``block`` adds to the (orthonormal) columns of ``against``."""
    for _ in range(2):
        for base in against:
            block = block - base @ (base.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
    left, weight, _ = np.linalg.svd(block, full_matrices=False)
    fresh = left[:, weight > 1e-10]
    for base in against:
        fresh = fresh - base @ (base.T @ fresh)
    return np.linalg.qr(fresh)[0] if fresh.size else fresh


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float = 0.02) -> np.ndarray:
    """Roughly solves A_i t_i = right_i for every column i at once; ``product`` applies each A_i to its column."""
    tiny = np.finfo(float).tiny
    norm = lambda m: np.maximum(np.linalg.norm(m, axis=0), tiny)
    start = norm(right)
    x, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    older, old, beta, beta_old = np.zeros_like(right), right, start, np.ones_like(start)
    c, s, d_bar, epsilon, left = -np.ones_like(start), np.zeros_like(start), np.zeros_like(start), np.zeros_like(start), start
    for step in range(steps):
        v = old / beta
        y = product(v)
        if step:
            y = y - older * (beta / beta_old)
        alpha = np.sum(v * y, axis=0)
        y = y - old * (alpha / beta)
        older, old, beta_old, beta = old, y, beta, norm(y)
        epsilon_old, delta = epsilon, c * d_bar + s * alpha
        g_bar, epsilon, d_bar = s * d_bar - c * alpha, s * beta, -c * beta
        gamma = np.maximum(np.hypot(g_bar, beta), tiny)
        c, s = g_bar / gamma, beta / gamma
        w_old, w = w, (v - w_old * epsilon_old - w * delta) / gamma
        x = x + w * (c * left)
        left = np.abs(s * left)
        if np.all((left <= enough * start) | (beta <= _EPS * start)):
            break
    return x


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, inner: int = INNER, space: int | None = None, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` leading eigenpairs of a symmetric operator, by block Jacobi-Davidson with locking."""
    wanted = min(wanted, width)
    keep = min(width, wanted + GUARD)
    space = max(space or 3 * wanted + GUARD, keep + wanted)
    locked, locked_values = np.zeros((width, 0)), np.zeros(0)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((width, keep)))
    image = product(basis)
    scale, best, stalled = 0.0, np.inf, 0
    for _ in range(ROUNDS):
        ritz = basis.T @ image
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        turn = turn[:, ::-1]
        values, basis, image = values[::-1], basis @ turn, image @ turn
        scale = max(scale, float(np.abs(values).max(initial=0)), float(np.abs(locked_values).max(initial=0)))
        missing = min(wanted - locked_values.size, values.size)
        residual = image[:, :missing] - basis[:, :missing] * values[:missing]
        # what has been locked is no part of the remaining problem
        residual = residual - locked @ (locked.T @ residual)
        error = np.linalg.norm(residual, axis=0)
        worst = float(error.max(initial=0))
        stalled = 0 if worst < best * 0.5 else stalled + 1
        best = min(best, worst)
        whole = basis.shape[1] + locked.shape[1] >= width  # nothing is left to search
        limit = PRECISION * scale if not (whole or stalled >= 4) else max(PRECISION * scale, 1e-11 * scale)
        done = np.flatnonzero(error <= limit)
        if done.size:
            locked = np.hstack([locked, basis[:, done]])
            locked_values = np.concatenate([locked_values, values[done]])
            rest = np.setdiff1d(np.arange(basis.shape[1]), done)
            basis, image, values = basis[:, rest], image[:, rest], values[rest]
            open_ = np.setdiff1d(np.arange(missing), done)
            residual = residual[:, open_]
        if locked_values.size >= wanted or not residual.shape[1]:
            order = np.argsort(-locked_values, kind="stable")
            return locked_values[order], locked[:, order]
        if basis.shape[1] + residual.shape[1] > space:
            basis, image, values = basis[:, :keep], image[:, :keep], values[:keep]
        shift = values[: residual.shape[1]]
        near = np.hstack([locked, basis[:, : residual.shape[1]]])
        inside = lambda t: t - near @ (near.T @ t)
        step = minres(lambda t: inside(product(inside(t)) - inside(t) * shift), -inside(residual), inner)  # noqa: B023
        # residuals themselves are added where a correction has come to nothing
        fresh = _orthonormal(np.hstack([step, residual])[:, : space], locked, basis)[:, : width - basis.shape[1] - locked.shape[1]]
        if fresh.shape[1]:
            basis, image = np.hstack([basis, fresh]), np.hstack([image, product(fresh)])
    raise ArithmeticError(f"eigenpairs did not reach double precision: residual {best / max(scale, _EPS):.1e} of the largest eigenvalue")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Fitted | None]:
    """The vectors that take part, written once, and their eigenpairs (None without any vector)."""
    table = stored(vectors.withColumn("_d", F.size("x")), "vectors")
    common = table.groupBy("_d").count().orderBy(F.desc("count"), F.desc("_d")).first()  # one row for each length
    if common is None:
        return table, None
    width, n = common["_d"], common["count"]
    table = table.where(F.col("_d") == width).drop("_d")
    if not width:
        return table, None
    sums = _summed(table, width, lambda x: x.sum(axis=0), "long")

    def product(block: np.ndarray) -> np.ndarray:
        def share(x: np.ndarray) -> np.ndarray:
            y = _centred(x, sums, n)
            return y.T @ (y @ block)

        return _summed(table, width, share, "double").reshape(width, -1) / n

    trace = float(_summed(table, width, lambda x: np.array([np.sum(_centred(x, sums, n) ** 2)]), "double")[0]) / n
    if trace == 0:
        return table, Fitted(n, sums, trace, np.zeros(0), np.zeros((width, 0)))
    values, found = eigenpairs(product, width, components)
    seen = values > 64 * width * _EPS * trace
    return table, Fitted(n, sums, trace, values[seen], found[:, seen])


def identity_error(table: DataFrame, fitted: Fitted) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    n, width, sums = fitted.rows, fitted.sums.size, fitted.sums
    k, project = fitted.values.size, fitted.vectors / np.sqrt(fitted.values)
    mean = _summed(table, width, lambda x: (_centred(x, sums, n) @ project).sum(axis=0), "double") / n

    def share(x: np.ndarray) -> np.ndarray:
        w = _centred(x, sums, n) @ project - mean
        return w.T @ w

    covariance = _summed(table, width, share, "double").reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def _deviations(x: np.ndarray, sums: np.ndarray, n: int) -> list[int | None]:
    whole = sums // n
    d, rest = x - whole, sums - whole * n
    if x.shape[1] * (n * (int(np.abs(d).max()) + 1)) ** 2 < 1 << 63:
        return np.sum((n * d - rest) ** 2, axis=1).tolist()
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in d]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(table: DataFrame, fitted: Fitted) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened and explained of every vector."""
    n, width, sums, k = fitted.rows, fitted.sums.size, fitted.sums, fitted.values.size
    project, explained = fitted.vectors / np.sqrt(fitted.values), fitted.values / fitted.trace

    def rows(batches):
        for batch, x in _matrices(batches, width):
            count = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(count), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * k, n)),
                    pa.array(_deviations(x, sums, n), pa.int64()).take(pa.array(np.repeat(np.arange(count), k))),
                    pa.array((_centred(x, sums, n) @ project).ravel()),
                    pa.array(np.tile(explained, count)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.select("vec_id", "x").mapInArrow(rows, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every vector projected on the leading components, with ``identity_error`` of the whole."""
    table, fitted = fit(whole_vectors(embeddings), components)
    if fitted is None or not fitted.values.size:
        kind = table.schema["vec_id"].dataType.simpleString()
        return table.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    return whitened(table, fitted).withColumn("identity_error", F.lit(identity_error(table, fitted)))
