"""Sums over one long ordered series or system, many tasks at a time: regressions on lags without a task that has all rows.

The order is cut into stretches (``ordered.blocked``); each brings as many rows
of its neighbours as lags and leads reach. A task turns its stretch into sums
(cross products of a lag design, scores times their own lags), which add up;
only these leave it. Values are centred and scaled by the whole series' moments
first, so products neither cancel nor overflow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import guarded_inverse
from .ordered import blocked


class Stretches:
    """Rows of the columns in an order, complete ones only; ``n`` of them, with their means and spreads."""

    def __init__(self, df: DataFrame, columns: list[str], order: str, before: int, after: int = 0, centre: bool = True, parts: int | None = None):
        self.columns, self.order, self.spark = columns, order, df.sparkSession
        #: Rows in the order as they are, for what needs single ones.
        self.plain = df.select(order, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
        r = self.plain.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
        k = len(columns)
        self.n = r[0]
        self.mean = np.array([v or 0.0 for v in r[1 : 1 + k]]) * centre
        self.sd = np.array([v or 1.0 for v in r[1 + k :]])
        self.rows, self.sizes = blocked(self.plain, order, before, after, parts, self.n)

    def each(self, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """f(z, place, own) of every stretch as a row of the result, in order: z are scaled values with the neighbours' rows, place the 1-based places of all rows, own the indices of the stretch's own."""
        columns, mean, sd = self.columns, self.mean, self.sd

        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_place")
            z = (pdf[columns].to_numpy(float) - mean) / sd
            v = np.asarray(f(z, pdf["_place"].to_numpy(), np.flatnonzero(~pdf["_halo"].to_numpy())), float)
            return pd.DataFrame({"block": pdf["_block"].iloc[0], "at": np.arange(len(v), dtype=np.int32), "v": v})

        got = self.rows.select("_block", "_place", "_halo", *columns).groupBy("_block").applyInPandas(go, "block int, at int, v double").toPandas()
        if not len(got):
            return np.zeros((0, 0))
        return got.sort_values(["block", "at"])["v"].to_numpy().reshape(got["block"].nunique(), -1)

    def sums(self, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        return self.each(f).sum(0)

    def last(self, rows: int) -> np.ndarray:
        """The last rows in the order, oldest first, as they are."""
        got = self.plain.orderBy(F.col(self.order).desc()).limit(rows).toPandas()
        return got.sort_values(self.order)[self.columns].to_numpy(float)


def products(w: np.ndarray) -> np.ndarray:
    """Cross products of a design's columns, flat."""
    return (w.T @ w).ravel()


def square(v: np.ndarray) -> np.ndarray:
    k = round(len(v) ** 0.5)
    return v.reshape(k, k)


def regress(g: np.ndarray, y: list[int], x: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, (X'X)^-1 and residual products of columns y on columns x of cross products."""
    inv = guarded_inverse(g[np.ix_(x, x)])
    xy = g[np.ix_(x, y)]
    b = inv @ xy
    return b, inv, g[np.ix_(y, y)] - b.T @ xy


def unscaled(b: np.ndarray, inv: np.ndarray, mean_y: np.ndarray, sd_y: np.ndarray, mean_x: np.ndarray, sd_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and (X'X)^-1 of the values as they were, the constant first; means and spreads of the other regressors."""
    t = np.diag(np.concatenate(([1.0], 1 / sd_x)))
    t[0, 1:] = -mean_x / sd_x
    out = (t @ b) * sd_y
    out[0] += mean_y
    return out, t @ inv @ t.T


def lag_columns(z: np.ndarray, at: np.ndarray, lags: range) -> np.ndarray:
    """Values so many rows before each row, lag by lag."""
    return np.hstack([z[at - j] for j in lags]) if len(lags) else np.zeros((len(at), 0))


# -- a single variable --------------------------------------------------------------


def _trend(place: np.ndarray, n: int, kind: str) -> np.ndarray:
    one = np.ones((len(place), 1))
    return {"none": one[:, :0], "constant": one, "trend": np.hstack([one, (place[:, None] - n / 2) / n])}[kind]


def dickey_fuller(s: Stretches, column: int, lags: int | None, kind: str, most: int | None = None, combine: np.ndarray | None = None, detrend: np.ndarray | None = None) -> tuple[float, int, int, float]:
    """t statistic, lags, rows used, rho, as ``series.adf`` of the column (or of a combination of all columns, less detrend times [1, place] if given)."""
    n = s.n
    if lags is None:
        top = most if most is not None else int(12 * (n / 100) ** 0.25)
        top = max(0, min(top, n // 2 - 3))
        g = square(s.sums(_differences(column, top, kind, n, combine, detrend)))
        d = g.shape[0] - 2 - top

        def criterion(p: int) -> float:
            _, _, r = regress(g, [0], [1, *range(2, 2 + p), *range(2 + top, 2 + top + d)])
            return (n - 1 - top) * np.log(r[0, 0] / (n - 1 - top)) + 2 * (1 + p + d)

        lags = min(range(top + 1), key=criterion)
    g = square(s.sums(_differences(column, lags, kind, n, combine, detrend)))
    rows = n - 1 - lags
    b, inv, r = regress(g, [0], list(range(1, g.shape[0])))
    v = r[0, 0] / (rows - (g.shape[0] - 1))
    return float(b[0, 0] / np.sqrt(v * inv[0, 0])), lags, rows, float(b[0, 0])


def _differences(column: int, lags: int, kind: str, n: int, combine: np.ndarray | None, detrend: np.ndarray | None):
    """Products of the difference, the level before, lagged differences, deterministic terms."""

    def f(z, place, own):
        y = z[:, column] if combine is None else z @ combine
        if detrend is not None:
            y = y - detrend[0] - detrend[1] * place
        at = own[place[own] >= lags + 2]
        d = np.concatenate(([0.0], np.diff(y)))
        return products(np.column_stack([d[at], y[at - 1], *[d[at - j] for j in range(1, lags + 1)], _trend(place[at], n, kind)]))

    return f


def detrended(s: Stretches, column: int, kind: str) -> np.ndarray:
    """Coefficients of the scaled column on [1, (place - n / 2) / n]; the second is zero without a trend."""
    n = s.n
    g = square(s.sums(lambda z, place, own: products(np.column_stack([z[own, column], _trend(place[own], n, kind)]))))
    b = np.zeros(2)
    if kind != "none":
        b[: g.shape[0] - 1] = regress(g, [0], list(range(1, g.shape[0])))[0][:, 0]
    return b


def autocovariances(s: Stretches, residual: Callable[[np.ndarray, np.ndarray], np.ndarray], first: int, lags: int) -> np.ndarray:
    """Sums of e(t) e(t - j), j = 0..lags, over places from ``first`` on; residual(z, place) gives e of every row, right from its second."""

    def f(z, place, own):
        e = residual(z, place)
        e = np.where(place >= first, e, 0.0)
        return [float(e[own] @ np.where(own >= j, e[np.maximum(own - j, 0)], 0.0)) for j in range(lags + 1)]

    return s.sums(f)


def unit_root_battery(df: DataFrame, column: str, order: str, kind: str, lags: int | None, parts: int | None = None) -> tuple[tuple, tuple, tuple, tuple, int]:
    """adf (t, lags, rows), phillips_perron (z_t, bandwidth), kpss (statistic, bandwidth), df_gls (t), and the rows."""
    n = df.dropna(subset=[column]).count()
    top = max(0, min(int(12 * (n / 100) ** 0.25), n // 2 - 3))
    bw = int(4 * (n / 100) ** 0.25)
    reach = max(top if lags is None else lags, bw) + 2
    s = Stretches(df, [column], order, reach, centre=kind != "none", parts=parts)
    a, p, rows, _ = dickey_fuller(s, 0, lags, kind)

    # Phillips and Perron: the regression on the level before, then the long-run variance of its residuals.
    m = n - 1
    pbw = int(4 * (m / 100) ** 0.25)
    g = square(s.sums(lambda z, place, own: (lambda at: products(np.column_stack([z[at, 0], z[at - 1, 0], _trend(place[at], n, kind)])))(own[place[own] >= 2])))
    b, inv, r = regress(g, [0], list(range(1, g.shape[0])))
    coef = b[:, 0]
    residual = lambda z, place: z[:, 0] - np.concatenate(([0.0], z[:-1, 0])) * coef[0] - _trend(place, n, kind) @ coef[1:]
    gamma = autocovariances(s, residual, 2, pbw) / m
    lr = gamma[0] + 2 * sum((1 - j / (pbw + 1)) * gamma[j] for j in range(1, pbw + 1))
    s2 = r[0, 0] / (m - len(coef))
    se = np.sqrt(s2 * inv[0, 0])
    z_t = np.sqrt(gamma[0] / lr) * (coef[0] - 1) / se - (lr - gamma[0]) / 2 * m * se / np.sqrt(lr * s2)

    # KPSS: partial sums of the detrended series; each stretch tells its own, the totals before it shift them.
    t = detrended(s, 0, kind)
    left = lambda z, place: z[:, 0] - t[0] - t[1] * (place - n / 2) / n

    def partial(z, place, own):
        c = np.cumsum(left(z, place)[own])
        return [c[-1], c.sum(), c @ c, len(c)] if len(c) else [0.0] * 4

    parts = s.each(partial)
    begin = np.concatenate(([0.0], np.cumsum(parts[:, 0])[:-1]))
    total = float((parts[:, 3] * begin**2 + 2 * begin * parts[:, 1] + parts[:, 2]).sum())
    gamma = autocovariances(s, left, 1, bw) / n
    k_lr = gamma[0] + 2 * sum((1 - j / (bw + 1)) * gamma[j] for j in range(1, bw + 1))

    # DF-GLS: quasi-differences on quasi-differenced terms, then a test without terms.
    q = 1 - (7 if kind == "constant" else 13.5) / n

    def quasi(z, place, own):
        x = np.column_stack([z[:, 0], _trend(place, n, kind)])
        w = x[own] - q * np.where((place[own] > 1)[:, None], x[np.maximum(own - 1, 0)], 0.0)
        return products(w)

    g = square(s.sums(quasi))
    d = np.zeros(2)
    if kind != "none":
        found = regress(g, [0], list(range(1, g.shape[0])))[0][:, 0]
        slope = found[1] / n if len(found) > 1 else 0.0
        d = np.array([found[0] - (found[1] / 2 if len(found) > 1 else 0.0), slope])
    gls = dickey_fuller(s, 0, p, "none", detrend=d)
    return (a, p, rows), (float(z_t), pbw), (total / (n * n * k_lr), bw), (gls[0],), n


# -- systems --------------------------------------------------------------------------


def autoregression(s: Stretches, p: int, skip: int | None = None) -> np.ndarray:
    """Cross products of [1, y, lags 1..p] (scaled) over the places after ``skip`` (p by default)."""
    skip = p if skip is None else skip

    def f(z, place, own):
        at = own[place[own] > skip]
        return products(np.hstack([np.ones((len(at), 1)), lag_columns(z, at, range(p + 1))]))

    return square(s.sums(f))


def cointegration(s: Stretches, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """s00, s11, s01 and rows: moments of differences and levels before, freed of a constant and p - 1 lagged differences."""
    n = len(s.columns)

    def f(z, place, own):
        at = own[place[own] >= p + 1]
        d = np.vstack([np.zeros((1, n)), np.diff(z, axis=0)])
        return products(np.hstack([d[at], z[at - 1], np.ones((len(at), 1)), lag_columns(d, at, range(1, p))]))

    g = square(s.sums(f))
    m = s.n - p
    r = regress(g, list(range(2 * n)), list(range(2 * n, g.shape[0])))[2] / m
    return r[:n, :n], r[n:, n:], r[:n, n:], m


def projections(s: Stretches, shock: int, horizon: int, lags: int, bandwidth: Callable[[int, int], int]) -> np.ndarray:
    """(horizon, variable) estimates and errors: each variable so many rows ahead on the shock, a constant and lags; Newey-West errors. Two passes: products, then scores of the shock's coefficient times their lags.

    Stretches need lags before and the horizon after, and the largest bandwidth before besides.
    """
    n, total = len(s.columns), s.n
    k = 2 + n * lags

    def design(z, at):
        return np.hstack([z[at, shock][:, None], np.ones((len(at), 1)), lag_columns(z, at, range(1, lags + 1))])

    def gram(z, place, own):
        out = []
        for h in range(horizon + 1):
            at = own[(place[own] > lags) & (place[own] + h <= total)]
            x, y = design(z, at), z[at + h]
            out += [(x.T @ x).ravel(), (x.T @ y).ravel()]
        return np.concatenate(out)

    g = s.sums(gram).reshape(horizon + 1, k * (k + n))
    inv = [guarded_inverse(r[: k * k].reshape(k, k)) for r in g]
    b = [i @ r[k * k :].reshape(k, n) for i, r in zip(inv, g, strict=True)]
    bw = [bandwidth(h, s.n - lags - h) for h in range(horizon + 1)]

    def scores(z, place, own):
        out = []
        for h in range(horizon + 1):
            # Scores of the rows before the stretch too, as far as the bandwidth reaches.
            at = np.flatnonzero((place > lags) & (place + h <= total) & (np.arange(len(place)) >= lags) & (np.arange(len(place)) + h < len(place)))
            x = design(z, at)
            a = np.zeros((len(place), n))
            a[at] = (x @ inv[h][0])[:, None] * (z[at + h] - x @ b[h])
            for j in range(bw[h] + 1):
                here = own[own >= j]
                out.append((a[here] * a[here - j]).sum(0))
        return np.concatenate(out)

    got, at, out = s.sums(scores), 0, np.zeros((horizon + 1, n, 2))
    for h in range(horizon + 1):
        c = got[at : at + n * (bw[h] + 1)].reshape(bw[h] + 1, n)
        at += n * (bw[h] + 1)
        w = np.array([1.0, *[2 * (1 - j / (bw[h] + 1)) for j in range(1, bw[h] + 1)]])
        out[h, :, 0] = b[h][0] * s.sd / s.sd[shock]
        out[h, :, 1] = np.sqrt(np.maximum(w @ c, 0)) * s.sd / s.sd[shock]
    return out
