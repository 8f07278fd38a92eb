"""Nonlinear autoregressions: tests of linearity, simulated forecasts, and the Sheather-Jones bandwidth."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions import dist
from ..functions.linalg import lags as lag_matrix
from ..functions.linalg import ols
from .kernels import tidy
from .series import run, threshold


def _sup(z: np.ndarray, x: np.ndarray, s: np.ndarray, trim: float) -> tuple[float, float]:
    """Largest F-type statistic of a split at a threshold, and where."""
    rss0 = float((ols(z, x)[1] ** 2).sum())
    n, best = len(z), (-1.0, 0.0)
    for c in np.unique(s)[int(trim * n) : int((1 - trim) * n)]:
        low = s <= c
        if min(low.sum(), (~low).sum()) <= x.shape[1]:
            continue
        rss = float((ols(z[low], x[low])[1] ** 2).sum() + (ols(z[~low], x[~low])[1] ** 2).sum())
        w = n * (rss0 - rss) / rss
        if w > best[0]:
            best = (w, float(c))
    return best


def threshold_linearity(df: DataFrame, column: str, order: str, p: int = 1, d: int = 1, trim: float = 0.15, replicates: int = 99, seed: int = 1, by: str | None = None) -> DataFrame:
    """Hansen's sup-Wald: statistic, threshold, p_value by a fixed-regressor bootstrap with normal weights on the linear residuals."""

    def f(t, y):
        z, x = lag_matrix(y, p)
        z, s = z[:, 0], y[p - d : len(y) - d]
        w, at = _sup(z, x, s, trim)
        e, rng = ols(z, x)[1], np.random.default_rng(seed)
        above = sum(_sup(e * rng.normal(size=len(e)), x, s, trim)[0] >= w for _ in range(replicates))
        return {"statistic": [w], "threshold": [at], "p_value": [(1 + above) / (1 + replicates)]}

    return run(df, column, order, f, "statistic double, threshold double, p_value double", by)


def threshold_forecast(df: DataFrame, column: str, order: str, p: int = 1, d: int = 1, steps: int = 6, paths: int = 500, level: float = 0.9, seed: int = 1, by: str | None = None) -> DataFrame:
    """horizon, forecast, lower, upper: residuals of each regime are drawn along simulated paths."""

    def f(t, y):
        m = threshold(y, p, d)
        z, x = lag_matrix(y, p)
        low = y[p - d : len(y) - d] <= m["threshold"]
        pools = (z[~low, 0] - x[~low] @ m["high"], z[low, 0] - x[low] @ m["low"])
        rng, out = np.random.default_rng(seed), np.empty((paths, steps))
        for i in range(paths):
            path = list(y[-max(p, d) :])
            for h in range(steps):
                k = path[-d] <= m["threshold"]
                b = m["low"] if k else m["high"]
                path.append(b[0] + sum(b[1 + j] * path[-1 - j] for j in range(p)) + rng.choice(pools[int(k)]))
                out[i, h] = path[-1]
        a = (1 - level) / 2
        return {"horizon": np.arange(1, steps + 1), "forecast": out.mean(0), "lower": np.quantile(out, a, axis=0), "upper": np.quantile(out, 1 - a, axis=0)}

    return run(df, column, order, f, "horizon int, forecast double, lower double, upper double", by)


def smooth_linearity(df: DataFrame, column: str, order: str, p: int = 1, d: int = 1, by: str | None = None) -> DataFrame:
    """Terasvirta's sequence on a third-order expansion: test (lm3, h4, h3, h2), statistic (F), p_value; lstr1 unless h3 is rejected the most strongly."""

    def f(t, y):
        z, x = lag_matrix(y, p)
        z, s = z[:, 0], y[p - d : len(y) - d]
        # Scaled, which leaves the spans as they are; by orthogonal factors, as powers are near one another.
        s, x = (s - s.mean()) / s.std(), np.column_stack([x[:, 0], x[:, 1:]])
        add = [x[:, 1:] * s[:, None] ** j for j in (1, 2, 3)]

        def left(k):
            q = np.linalg.qr(np.hstack([x, *add[:k]]))[0]
            e = z - q @ (q.T @ z)
            return float(e @ e)

        rss = [left(k) for k in range(4)]
        n, k = len(z), x.shape[1]
        out = []
        for name, a, b in (("lm3", 0, 3), ("h4", 2, 3), ("h3", 1, 2), ("h2", 0, 1)):
            q, dof = (b - a) * p, n - k - b * p
            v = (rss[a] - rss[b]) / q / (rss[b] / dof)
            out.append((name, v, dist.f_sf(v, q, dof)))
        return tidy(("test", "statistic", "p_value"), out)

    return run(df, column, order, f, "test string, statistic double, p_value double", by)


def smooth_forecast(df: DataFrame, column: str, order: str, p: int = 1, steps: int = 6, paths: int = 500, level: float = 0.9, seed: int = 1, by: str | None = None) -> DataFrame:
    """horizon, forecast, lower, upper of a logistic transition model (speed and place by a grid), residuals drawn along paths."""

    def f(t, y):
        z, x = lag_matrix(y, p)
        z, s = z[:, 0], x[:, 1]
        weight = lambda v, g, c: 1 / (1 + np.exp(-np.clip(g * (v - c) / s.std(), -500, 500)))
        fit = lambda g, c: ols(z, np.hstack([x, weight(s, g, c)[:, None] * x]))
        g, c = min(((g, c) for g in (1, 3, 10, 30) for c in np.quantile(s, np.linspace(0.2, 0.8, 13))), key=lambda q: float((fit(*q)[1] ** 2).sum()))
        b, e, _ = fit(g, c)
        k, rng, out = x.shape[1], np.random.default_rng(seed), np.empty((paths, steps))
        for i in range(paths):
            path = list(y[-p:])
            for h in range(steps):
                r = np.concatenate(([1.0], path[-1 : -p - 1 : -1]))
                path.append(float(r @ (b[:k] + weight(path[-1], g, c) * b[k:]) + rng.choice(e)))
                out[i, h] = path[-1]
        a = (1 - level) / 2
        return {"horizon": np.arange(1, steps + 1), "forecast": out.mean(0), "lower": np.quantile(out, a, axis=0), "upper": np.quantile(out, 1 - a, axis=0)}

    return run(df, column, order, f, "horizon int, forecast double, lower double, upper double", by)


def sheather_jones(x: np.ndarray, bins: int = 400) -> float:
    """Solve-the-equation bandwidth on binned data (Sheather and Jones, 1991)."""
    n = len(x)
    q = np.quantile(x, (0.25, 0.75))
    scale = min(x.std(ddof=1), (q[1] - q[0]) / 1.349) or x.std(ddof=1)
    lo, hi = x.min(), x.max()
    width = (hi - lo) / bins * 1.01
    c = np.bincount(np.minimum(((x - lo) / width).astype(int), bins - 1), minlength=bins).astype(float)
    pairs = np.correlate(c, c, "full")[bins - 1 :]
    pairs[0] = (pairs[0] - n) / 2  # pairs within a bin
    gap = np.arange(bins) * width

    def phi(h, order):
        u = (gap / h) ** 2
        e = np.exp(-np.minimum(u / 2, 700))
        poly, own = (u * u - 6 * u + 3, 3.0) if order == 4 else (u**3 - 15 * u * u + 45 * u - 15, -15.0)
        return (2 * (pairs * e * poly).sum() + n * own) / (n * (n - 1) * h ** (order + 1) * math.sqrt(2 * math.pi))

    a, b = 1.24 * scale * n ** (-1 / 7), 1.23 * scale * n ** (-1 / 9)
    td, sd = -phi(b, 6), phi(a, 4)
    alpha = 1.357 * (sd / td) ** (1 / 7)
    f = lambda h: (1 / (2 * math.sqrt(math.pi) * n * phi(alpha * h ** (5 / 7), 4))) ** 0.2 - h
    top = 1.144 * scale * n**-0.2
    lo, hi = 0.1 * top, top
    while f(lo) * f(hi) > 0 and hi < 10 * top:
        lo, hi = lo * 0.9, hi * 1.1
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(lo) * f(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def bandwidth_sj(df: DataFrame, column: str, order: str, by: str | None = None) -> DataFrame:
    """silverman, sheather_jones."""

    def f(t, y):
        q = np.quantile(y, (0.25, 0.75))
        return {"silverman": [0.9 * min(y.std(ddof=1), (q[1] - q[0]) / 1.349) * len(y) ** -0.2], "sheather_jones": [sheather_jones(y)]}

    return run(df, column, order, f, "silverman double, sheather_jones double", by)
