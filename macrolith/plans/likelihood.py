"""Maximum likelihood over rows: Newton steps whose sums come from one pass of Arrow batches each.

A pass returns the log-likelihood, its gradient and its Hessian at one point as
sums over rows (central differences of the batch's sum, or a model's own derivatives), or the log-likelihood
at several points for the line search. Only k + k^2 numbers leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import guarded_inverse

Log = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Maximum:
    theta: np.ndarray
    cov: np.ndarray
    loglik: float
    steps: int
    n: int


def _pass(df: DataFrame, columns: list[str], f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a vector function of a batch's matrix."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                v = f(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
                held = v if held is None else held + v
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(held, pa.float64())], ["at", "v"])

    got = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(go, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    return np.array([r.v for r in got])


def _derivatives(log: Log, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    k = len(theta)
    h = 1e-4 * (1 + np.abs(theta))
    at = lambda d: float(log(theta + d, x).sum())
    e = np.diag(h)
    mid = at(0 * h)
    up, down = [at(v) for v in e], [at(-v) for v in e]
    g = np.array([(u - d) / (2 * s) for u, d, s in zip(up, down, h, strict=True)])
    hess = np.zeros((k, k))
    for i in range(k):
        hess[i, i] = (up[i] - 2 * mid + down[i]) / h[i] ** 2
        for j in range(i):
            hess[i, j] = hess[j, i] = (at(e[i] + e[j]) - at(e[i] - e[j]) - at(e[j] - e[i]) + at(-e[i] - e[j])) / (4 * h[i] * h[j])
    return np.concatenate(([mid, len(x)], g, hess.ravel()))


def by_indices(loglik: float, designs: list[np.ndarray], first: list[np.ndarray], second: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """What a pass sums, from a row's derivatives by its indices, each of them a product of a design with its own parameters.

    first[i] are derivatives by index i, second[i, j] (i <= j, zero if absent) by two.
    """
    ends = np.cumsum([0, *[d.shape[1] for d in designs]])
    hess = np.zeros((ends[-1], ends[-1]))
    for (i, j), w in second.items():
        block = designs[i].T @ (w[:, None] * designs[j])
        hess[ends[i] : ends[i + 1], ends[j] : ends[j + 1]] = block
        hess[ends[j] : ends[j + 1], ends[i] : ends[i + 1]] = block.T
    g = [d.T @ f for d, f in zip(designs, first, strict=True)]
    return np.concatenate(([loglik, len(designs[0])], *g, hess.ravel()))


def maximise(df: DataFrame, columns: list[str], log: Log, theta: np.ndarray, steps: int = 40, tol: float = 1e-7, derivatives: Log | None = None) -> Maximum:
    """log(theta, rows) -> log-likelihood of each row.

    derivatives(theta, rows) -> what by_indices gives: without differences a row costs about what its
    likelihood costs, and a full step that gains is taken at once, a pass a step.
    """
    df = df.dropna(subset=columns)
    k = len(theta)
    look = derivatives or (lambda t, x: _derivatives(log, t, x))
    v = None
    for step in range(1, steps + 1):
        if v is None:
            v = _pass(df, columns, lambda x, t=theta: look(t, x))
        ll, n, g, hess = v[0], int(v[1]), v[2 : 2 + k], v[2 + k :].reshape(k, k)
        w, q = np.linalg.eigh(-hess)
        move = q @ ((q.T @ g) / np.maximum(np.abs(w), 1e-8 * max(1.0, np.abs(w).max())))
        if np.abs(g @ move) < tol * max(1.0, abs(ll)) * 1e-3:
            break
        if derivatives:
            with np.errstate(all="ignore"):
                ahead = _pass(df, columns, lambda x, t=theta + move: look(t, x))
            if ahead[0] > ll and np.isfinite(ahead).all():
                theta, v = theta + move, ahead
                continue
        v = None
        sizes = 0.5 ** np.arange(8)
        with np.errstate(all="ignore"):
            tried = _pass(df, columns, lambda x, t=theta, m=move: np.array([np.nan_to_num(log(t + s * m, x).sum(), nan=-1e300) for s in sizes]))
        best = int(np.argmax(tried))
        if tried[best] <= ll:
            break
        theta = theta + sizes[best] * move
    return Maximum(theta, guarded_inverse(-hess), float(ll), step, n)
