"""Kalman filter and smoother of one long series by a parallel scan (Sarkka and Garcia-Fernandez, 2021).

A stretch of the order is turned into one element: how the state at its end
depends on the state before it (a matrix, an offset, a covariance), and what
its observations say about that state (information). Elements of neighbours
combine associatively, so each stretch's rows combine pairwise in numpy, the
stretches' elements on the driver (a few small matrices a stretch), and then
every stretch filters its own rows from the exact state before it. The smoother
does the same backwards with conditional means of a state given its successor.

Three passes give states and bands, two the likelihood; several parameter
vectors are evaluated in the same two passes, so a step of the maximisation is
two jobs whatever the number of parameters. Observations may be several
columns, each may be null; a row without any only moves the state on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import guarded_inverse
from ..plans.ordered import blocked
from ..plans.store import Kept
from .describe import rows


@dataclass
class Model:
    """x(t) = move x(t - 1) + noise of covariance shock; y(t) = see x(t) + noise of covariance error; x at the first row has this mean and covariance."""

    move: np.ndarray
    see: np.ndarray
    shock: np.ndarray
    error: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def __post_init__(self):
        for k in ("move", "see", "shock", "error", "cov"):
            setattr(self, k, np.atleast_2d(np.asarray(getattr(self, k), float)))
        self.mean = np.atleast_1d(np.asarray(self.mean, float))

    @property
    def states(self) -> int:
        return len(self.mean)


def elements(m: Model, y: np.ndarray, first: bool) -> tuple[np.ndarray, ...]:
    """One element a row: A, b, C, eta, J as arrays by row. first: the series begins with the first row."""
    n, d = len(y), m.states
    a, b, c = np.tile(m.move, (n, 1, 1)), np.zeros((n, d)), np.tile(m.shock, (n, 1, 1))
    eta, j = np.zeros((n, d)), np.zeros((n, d, d))
    seen = ~np.isnan(y)
    for pattern in np.unique(seen, axis=0):
        at = np.flatnonzero((seen == pattern).all(1))
        if not pattern.any():
            continue
        h, r = m.see[pattern], m.error[np.ix_(pattern, pattern)]
        inv = guarded_inverse(h @ m.shock @ h.T + r)
        gain = m.shock @ h.T @ inv
        keep = np.eye(d) - gain @ h
        v = y[np.ix_(at, pattern)]
        a[at], b[at], c[at] = keep @ m.move, v @ gain.T, keep @ m.shock
        up = m.move.T @ h.T @ inv
        eta[at], j[at] = v @ up.T, up @ h @ m.move
    if first and n:
        mean, cov = _update(m, m.mean, m.cov, y[0])[:2]
        a[0], b[0], c[0], eta[0], j[0] = 0, mean, cov, 0, 0
    return a, b, c, eta, j


def combine(x: tuple[np.ndarray, ...], z: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Elements x followed by elements z, row by row."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = x, z
    eye = np.eye(a1.shape[-1])
    left = np.linalg.solve((eye + c1 @ j2).swapaxes(-1, -2), a2.swapaxes(-1, -2)).swapaxes(-1, -2)
    right = np.linalg.solve((eye + j2 @ c1).swapaxes(-1, -2), a1).swapaxes(-1, -2)
    mul = lambda m, v: (m @ v[..., None])[..., 0]
    c = left @ c1 @ a2.swapaxes(-1, -2) + c2
    j = right @ j2 @ a1 + j1
    return left @ a1, mul(left, b1 + mul(c1, e2)) + b2, (c + c.swapaxes(-1, -2)) / 2, mul(right, e2 - mul(j2, b1)) + e1, (j + j.swapaxes(-1, -2)) / 2


def total(e: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """All rows' elements as one, combined pairwise."""
    while len(e[0]) > 1:
        n = len(e[0])
        even = n - n % 2
        both = combine(tuple(x[0:even:2] for x in e), tuple(x[1:even:2] for x in e))
        e = tuple(np.concatenate((b, x[even:])) for b, x in zip(both, e, strict=True))
    return tuple(x[0] for x in e)


def _update(m: Model, mean: np.ndarray, cov: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """State after an observation, and its log density: -inf where the observation's covariance is not positive, as at variances of zero."""
    ok = ~np.isnan(y)
    if not ok.any():
        return mean, cov, 0.0
    h, r = m.see[ok], m.error[np.ix_(ok, ok)]
    f = h @ cov @ h.T + r
    v = y[ok] - h @ mean
    sign, size = (1.0, math.log(f[0, 0])) if len(v) == 1 and f[0, 0] > 0 else np.linalg.slogdet(f)
    if not (sign > 0 and math.isfinite(size)):
        return mean, cov, -math.inf
    if len(v) == 1:
        g = cov @ h[0] / f[0, 0]
        return mean + g * v[0], cov - np.outer(g, h[0] @ cov), -0.5 * (math.log(2 * math.pi) + size + v[0] ** 2 / f[0, 0])
    inv = guarded_inverse(f)
    g = cov @ h.T @ inv
    return mean + g @ v, cov - g @ h @ cov, -0.5 * (len(v) * math.log(2 * math.pi) + float(size) + float(v @ inv @ v))


def forward(m: Model, y: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Filtered means and covariances and the log-likelihood of rows; start: the state before them, None where the series begins."""
    n, d = len(y), m.states
    means, covs, ll = np.zeros((n, d)), np.zeros((n, d, d)), 0.0
    for i in range(n):
        if i or start:
            mean, cov = (means[i - 1], covs[i - 1]) if i else start
            mean, cov = m.move @ mean, m.move @ cov @ m.move.T + m.shock
        else:
            mean, cov = m.mean, m.cov
        means[i], c, one = _update(m, mean, cov, y[i])
        covs[i] = (c + c.T) / 2
        ll += one
    return means, covs, ll


def _back(m: Model, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state given its successor: matrix, offset and covariance."""
    ahead = m.move @ cov @ m.move.T + m.shock
    e = cov @ m.move.T @ guarded_inverse(ahead)
    return e, mean - e @ (m.move @ mean), cov - e @ m.move @ cov


def backward(m: Model, means: np.ndarray, covs: np.ndarray, after: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed means and covariances; after: the smoothed state of the row that follows, None where the series ends."""
    s, p = means.copy(), covs.copy()
    for i in range(len(means) - 1, -1, -1):
        if i == len(means) - 1 and after is None:
            continue
        mean, cov = (s[i + 1], p[i + 1]) if i < len(means) - 1 else after
        e, g, low = _back(m, means[i], covs[i])
        s[i], c = e @ mean + g, e @ cov @ e.T + low
        p[i] = (c + c.T) / 2
    return s, p


class Line:
    """Observations in their order, cut in stretches; null observations stay."""

    def __init__(self, df: DataFrame, columns: list[str], order: str, parts: int | None = None):
        self.columns, self.order, self.spark = columns, order, df.sparkSession
        self.kind = df.schema[order].dataType.simpleString()
        plain = df.select(order, *[F.col(c).cast("double").alias(c) for c in columns]).where(F.col(order).isNotNull())
        d, self.sizes = blocked(plain, order, parts=parts)
        self.rows = d.select("_block", "_place", order, *columns)

    def _told(self, f: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
        """f(stretch, y) -> a vector, by stretch."""
        columns = self.columns

        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_place")
            k = int(pdf["_block"].iloc[0])
            v = np.asarray(f(k, pdf[columns].to_numpy(float)), float)
            return pd.DataFrame({"block": k, "at": np.arange(len(v), dtype=np.int32), "v": v})

        got = self.rows.groupBy("_block").applyInPandas(go, "block int, at int, v double").toPandas()
        return {int(k): g.sort_values("at")["v"].to_numpy() for k, g in got.groupby("block")}

    def starts(self, models: list[Model]) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
        """For each model the exact filtered state before each stretch but the first."""
        if len(self.sizes) == 1:
            return [{} for _ in models]
        got = self._told(lambda k, y: np.concatenate([np.concatenate([x.ravel() for x in total(elements(m, y, k == 0))]) for m in models]))
        out: list[dict] = [{} for _ in models]
        at = 0
        for found, m in zip(out, models, strict=True):
            d = m.states
            shapes = ((d, d), (d,), (d, d), (d,), (d, d))
            held = None
            for k in sorted(got):
                v, own = at, []
                for s in shapes:
                    size = math.prod(s)
                    own.append(got[k][v : v + size].reshape(s))
                    v += size
                held = tuple(own) if held is None else combine(held, tuple(own))
                # The first element takes the prior in, so offset and covariance are the filtered state.
                found[k + 1] = (held[1], held[2])
            at += sum(math.prod(s) for s in shapes)
        return out

    def log_likelihoods(self, models: list[Model]) -> np.ndarray:
        starts = self.starts(models)
        got = self._told(lambda k, y: [forward(m, y, s.get(k))[2] for m, s in zip(models, starts, strict=True)])
        return np.sum(list(got.values()), axis=0)

    def states(self, m: Model, smooth: bool = False) -> DataFrame:
        """order, state (0..), mean, variance: filtered, or smoothed, for each row."""
        (start,) = self.starts([m])
        columns, order, after = self.columns, self.order, {}
        if smooth and len(self.sizes) > 1:
            d = m.states

            def back(k, y):
                means, covs, _ = forward(m, y, start.get(k))
                e, g, low = np.eye(d), np.zeros(d), np.zeros((d, d))
                for i in range(len(y) - 1, -1, -1):
                    ei, gi, li = _back(m, means[i], covs[i])
                    e, g, low = ei @ e, ei @ g + gi, ei @ low @ ei.T + li
                return np.concatenate([e.ravel(), g, low.ravel(), means[-1], covs[-1].ravel(), backward(m, means, covs, None)[0][0], backward(m, means, covs, None)[1][0].ravel()])

            got = self._told(back)
            held = None
            for k in sorted(got, reverse=True):
                v = got[k]
                cut = np.split(v, np.cumsum([d * d, d, d * d, d, d * d, d]))
                if held is not None:
                    after[k] = held
                    e, g, low = cut[0].reshape(d, d), cut[1], cut[2].reshape(d, d)
                    held = (e @ held[0] + g, e @ held[1] @ e.T + low)
                else:
                    held = (cut[5], cut[6].reshape(d, d))

        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_place")
            k, d = int(pdf["_block"].iloc[0]), m.states
            means, covs, _ = forward(m, pdf[columns].to_numpy(float), start.get(k))
            if smooth:
                means, covs = backward(m, means, covs, after.get(k))
            return pd.DataFrame({order: np.repeat(pdf[order].to_numpy(), d), "state": np.tile(np.arange(d, dtype=np.int32), len(pdf)), "mean": means.ravel(), "variance": np.diagonal(covs, axis1=1, axis2=2).ravel()})

        return self.rows.groupBy("_block").applyInPandas(go, f"{order} {self.kind}, state int, mean double, variance double")

    def end(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """The filtered state of the last row."""
        (start,) = self.starts([m])
        last = len(self.sizes) - 1
        if last and last + 1 in start:
            return start[last + 1]
        d = m.states
        v = self._told(lambda k, y: (lambda f: np.concatenate([f[0][-1], f[1][-1].ravel()]))(forward(m, y, start.get(k))))[last]
        return v[:d], v[d:].reshape(d, d)


def filtered(df: DataFrame, columns: list[str], order: str, model: Model, parts: int | None = None) -> DataFrame:
    return Line(df, columns, order, parts).states(model)


def smoothed(df: DataFrame, columns: list[str], order: str, model: Model, parts: int | None = None) -> DataFrame:
    return Line(df, columns, order, parts).states(model, True)


def forecast(df: DataFrame, columns: list[str], order: str, model: Model, steps: int = 8, level: float = 0.95, parts: int | None = None) -> DataFrame:
    """horizon, variable, forecast, std_error, lower, upper of the observations."""
    from ..functions import dist

    mean, cov = Line(df, columns, order, parts).end(model)
    z, out = dist.norm_ppf(0.5 + level / 2), []
    for h in range(1, steps + 1):
        mean, cov = model.move @ mean, model.move @ cov @ model.move.T + model.shock
        y, s = model.see @ mean, np.sqrt(np.diag(model.see @ cov @ model.see.T + model.error))
        out += [{"horizon": h, "variable": c, "forecast": float(a), "std_error": float(b), "lower": float(a - z * b), "upper": float(a + z * b)} for c, a, b in zip(columns, y, s, strict=True)]
    return rows(df.sparkSession, out, "horizon int, variable string, forecast double, std_error double, lower double, upper double")


def estimate(df: DataFrame, columns: list[str], order: str, build: Callable[[np.ndarray], Model], start: list[float], names: list[str], parts: int | None = None, steps: int = 50, tol: float = 1e-6) -> tuple[DataFrame, Model]:
    """Maximum likelihood of build(theta): term, estimate, std_error (of theta, by the Hessian), and the model found.

    Newton steps; all points of the differences and of the line search are
    evaluated together. It raises if the steps don't settle. Where the
    likelihood only flattens out (a log variance toward minus infinity), they
    end once the slope is below tol, and the error of that parameter is large.
    """
    from .regression import coefficient_table

    # Every step reads the series twice, so it is computed once and kept.
    kept = Kept(df.select(order, *[F.col(c).cast("double").alias(c) for c in columns]))
    line, theta = Line(kept.rows, columns, order, parts), np.array(start, float)
    k = len(theta)

    def at(points: list[np.ndarray]) -> np.ndarray:
        """Log-likelihoods; -1e300 where there is none, as at variances that are zero or infinite in doubles."""
        with np.errstate(all="ignore"):
            models = [build(p) for p in points]
            good = [i for i, m in enumerate(models) if all(np.isfinite(v).all() for v in (m.move, m.see, m.shock, m.error, m.mean, m.cov))]
            out = np.full(len(points), -1e300)
            if good:
                out[good] = np.nan_to_num(line.log_likelihoods([models[i] for i in good]), nan=-1e300, posinf=-1e300, neginf=-1e300)
            return out

    for _ in range(steps):
        h = 1e-3 * (1 + np.abs(theta))
        e = np.diag(h)
        pairs = [(i, j) for i in range(k) for j in range(i)]
        ll = at([theta, *[theta + v for v in e], *[theta - v for v in e], *[theta + a * e[i] + b * e[j] for i, j in pairs for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]])
        up, down = ll[1 : 1 + k], ll[1 + k : 1 + 2 * k]
        g = (up - down) / (2 * h)
        hess = np.diag((up - 2 * ll[0] + down) / h**2)
        for n, (i, j) in enumerate(pairs):
            a, b, c, d = ll[1 + 2 * k + 4 * n : 5 + 2 * k + 4 * n]
            hess[i, j] = hess[j, i] = (a - b - c + d) / (4 * h[i] * h[j])
        w, q = np.linalg.eigh(-hess)
        move = q @ ((q.T @ g) / np.maximum(np.abs(w), 1e-6 * max(1.0, np.abs(w).max())))
        if abs(g @ move) < tol:
            break
        # Far from the maximum a step may be thousands too long; then shorter ones follow.
        for first in (0, 8, 16, 24, 32):
            sizes = [*([] if first else [2.0]), *0.5 ** np.arange(first, first + 8)]
            tried = at([theta + s * move for s in sizes])
            if tried.max() > ll[0]:
                break
        else:
            break
        theta = theta + sizes[int(np.argmax(tried))] * move
    else:
        raise RuntimeError(f"the likelihood hasn't settled after {steps} steps")
    kept.drop()
    return coefficient_table(df.sparkSession, names, theta, guarded_inverse(-hess)), build(theta)


def local_level(var_error: float, var_level: float, first: float = 0.0, spread: float = 1e7) -> Model:
    return Model([[1.0]], [[1.0]], [[var_level]], [[var_error]], [first], [[spread]])


def local_trend(var_error: float, var_level: float, var_slope: float, first: float = 0.0, spread: float = 1e7) -> Model:
    return Model([[1.0, 1.0], [0.0, 1.0]], [[1.0, 0.0]], np.diag([var_level, var_slope]), [[var_error]], [first, 0.0], np.eye(2) * spread)
