"""Factor models: dynamic factors by principal components or the Kalman filter, generalised dynamic factors, factor-augmented and structural forms, nowcasts.

A panel of series is one kernel, wide in columns; many panels run in parallel
by a group column. Missing values are NaN.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.linalg import guarded_inverse, ols
from ..functions.linalg import lags as lag_matrix
from .kernels import tidy
from .multivariate import Var
from .vectors import Given

CUBE = "horizon int, variable string, shock string, value double"


def panel_kernel(df: DataFrame, columns: list[str], order: str, f, schema: str, by: str | None = None) -> DataFrame:
    """As per_series, rows with missing values being kept as NaN."""
    key = by or "_panel"
    d = df.select(*([by] if by else [F.lit("all").alias("_panel")]), order, *[F.col(c).cast("double").alias(c) for c in columns])

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = pd.DataFrame(f(pdf[order].to_numpy(), pdf[columns].to_numpy(float)))
        if by:
            out.insert(0, by, pdf[key].iloc[0])
        return out.replace([np.inf, -np.inf], np.nan)

    kind = f"{by} {df.schema[by].dataType.simpleString()}, " if by else ""
    return d.groupBy(key).applyInPandas(go, kind + schema)


def standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Standardised on observed cells; means and population spreads."""
    m, s = np.nanmean(x, 0), np.nanstd(x, 0)
    s = np.where(s > 0, s, 1.0)
    return (x - m) / s, m, s


def components(z: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of unit variance, loadings, eigenvalues; each loading vector's largest entry is positive."""
    w, v = np.linalg.eigh(z.T @ z / len(z))
    w, v = w[::-1], v[:, ::-1]
    v = v * np.where(v[np.abs(v).argmax(0), range(len(w))] < 0, -1, 1)
    return z @ v[:, :r] / np.sqrt(w[:r]), v[:, :r] * np.sqrt(w[:r]), w


# -- two steps ------------------------------------------------------------------


class Dynamic:
    """Principal components, then an autoregression of the factors."""

    def __init__(self, x: np.ndarray, r: int, p: int):
        self.z, self.mean, self.sd = standard(x)
        self.factors, self.loadings, self.w = components(self.z, r)
        self.var = Var(self.factors, p)
        self.idio = (self.z - self.factors @ self.loadings.T).var(0)

    def forecast(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the series and their standard errors."""
        f, _ = self.var.forecast(steps)
        phi = self.var.moving_average(steps)
        mse = np.cumsum([a @ self.var.sigma @ a.T for a in phi], axis=0)
        v = np.array([np.diag(self.loadings @ m @ self.loadings.T) for m in mse]) + self.idio
        return f @ self.loadings.T * self.sd + self.mean, np.sqrt(v) * self.sd


def dynamic_factors(df: DataFrame, columns: list[str], order: str, r: int = 1, p: int = 1, by: str | None = None) -> DataFrame:
    """order, factor, value."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, x):
        m = Dynamic(x, r, p)
        return {order: np.repeat(t, r), "factor": np.tile(np.arange(1, r + 1), len(t)), "value": m.factors.ravel()}

    return panel_kernel(df.dropna(subset=columns), columns, order, f, f"{order} {kind}, factor int, value double", by)


def dynamic_summary(df: DataFrame, columns: list[str], order: str, r: int = 1, p: int = 1, by: str | None = None) -> DataFrame:
    """part (loading, coefficient, companion, modulus), row, column, value."""

    def f(t, x):
        m = Dynamic(x, r, p)
        names = [f"f{j + 1}" for j in range(r)]
        terms = ["const", *[f"{c}_l{j}" for j in range(1, p + 1) for c in names]]
        from ..functions.linalg import companion

        c = companion(m.var.b, r, p)
        out = [("loading", columns[i], names[j], m.loadings[i, j]) for i in range(len(columns)) for j in range(r)]
        out += [("coefficient", terms[i], names[j], m.var.b[i, j]) for i in range(len(terms)) for j in range(r)]
        out += [("companion", str(i), str(j), c[i, j]) for i in range(len(c)) for j in range(len(c))]
        out += [("modulus", str(i), "", float(v)) for i, v in enumerate(m.var.roots)]
        return tidy(("part", "row", "column", "value"), out)

    return panel_kernel(df.dropna(subset=columns), columns, order, f, "part string, row string, column string, value double", by)


def dynamic_criteria(df: DataFrame, columns: list[str], order: str, most_r: int = 3, most_p: int = 3, by: str | None = None) -> DataFrame:
    """r, p, aic, bic of the factor autoregression plus the fit of the panel."""

    def f(t, x):
        out = []
        for r in range(1, most_r + 1):
            for p in range(1, most_p + 1):
                m = Dynamic(x, r, p)
                n, k = len(t), r * (1 + r * p) + r * x.shape[1]
                v = math.log(float(m.idio.mean())) * x.shape[1] + float(np.linalg.slogdet(m.var.sigma)[1])
                out.append((r, p, v + 2 * k / n, v + math.log(n) * k / n))
        return tidy(("r", "p", "aic", "bic"), out)

    return panel_kernel(df.dropna(subset=columns), columns, order, f, "r int, p int, aic double, bic double", by)


def factor_forecast(df: DataFrame, columns: list[str], order: str, r: int = 1, p: int = 1, steps: int = 4, level: float = 0.95, by: str | None = None) -> DataFrame:
    """horizon, variable, forecast, lower, upper of the series through the factors."""
    z = dist.norm_ppf(0.5 + level / 2)

    def f(t, x):
        m, s = Dynamic(x, r, p).forecast(steps)
        return {"horizon": np.repeat(np.arange(1, steps + 1), len(columns)), "variable": np.tile(columns, steps), "forecast": m.ravel(), "lower": (m - z * s).ravel(), "upper": (m + z * s).ravel()}

    return panel_kernel(df.dropna(subset=columns), columns, order, f, "horizon int, variable string, forecast double, lower double, upper double", by)


# -- Kalman filter and expectation-maximisation ---------------------------------


class Filtered:
    """x = L f + e, f a vector autoregression, e noise of its own for each series (AR(1) if ``ar``); missing cells are skipped. By expectation-maximisation."""

    def __init__(self, x: np.ndarray, r: int = 1, p: int = 1, steps: int = 100, tol: float = 1e-4, quarterly: int = 0):
        self.z, self.mean, self.sd = standard(x)
        self.r, self.p, self.quarterly = r, p, quarterly
        n, k = self.z.shape
        filled = np.where(np.isnan(self.z), 0.0, self.z)
        f, self.loadings, _ = components(filled, r)
        b = Var(f, p)
        self.a, self.q = b.b[1:].T, b.sigma
        self.h = np.maximum((filled - f @ self.loadings.T).var(0), 1e-4)
        last = -math.inf
        self.steps = 0
        for self.steps in range(1, steps + 1):
            ll = self._step()
            if abs(ll - last) < tol * (abs(ll) + abs(last)) / 2:
                break
            last = ll
        self.loglik = ll

    def system(self):
        r, p = self.r, self.p
        m = r * p
        t = np.zeros((m, m))
        t[:r] = self.a
        t[r:, : m - r] = np.eye(m - r)
        q = np.zeros((m, m))
        q[:r, :r] = self.q
        l = np.zeros((len(self.h), m))  # noqa: E741
        l[:, :r] = self.loadings
        return t, q, l

    def smooth(self, z: np.ndarray | None = None, ahead: int = 0):
        """Log-likelihood, smoothed states, their variances and lag covariances."""
        z = self.z if z is None else z
        if ahead:
            z = np.vstack([z, np.full((ahead, z.shape[1]), np.nan)])
        t, q, l = self.system()  # noqa: E741
        m, n = len(t), len(z)
        a, p = np.zeros(m), np.eye(m) * 10
        pa, pp, fa, fp = np.zeros((n, m)), np.zeros((n, m, m)), np.zeros((n, m)), np.zeros((n, m, m))
        ll = 0.0
        for i in range(n):
            if i:
                a, p = t @ a, t @ p @ t.T + q
            pa[i], pp[i] = a, p
            ok = ~np.isnan(z[i])
            if ok.any():
                c, d = l[ok], 1 / self.h[ok]
                # Information form: as many rows as factors, however many series.
                info = np.linalg.inv(guarded_inverse(p + 1e-12 * np.eye(m)) + (c * d[:, None]).T @ c)
                v = z[i, ok] - c @ a
                g = info @ (c * d[:, None]).T
                s = c @ p @ c.T + np.diag(self.h[ok])
                ll -= 0.5 * (ok.sum() * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + v @ np.linalg.solve(s, v))
                a, p = a + g @ v, info
            fa[i], fp[i] = a, p
        sa, sp, lag = fa.copy(), fp.copy(), np.zeros((n, m, m))
        for i in range(n - 2, -1, -1):
            j = fp[i] @ t.T @ np.linalg.pinv(pp[i + 1])
            sa[i] = fa[i] + j @ (sa[i + 1] - pa[i + 1])
            sp[i] = fp[i] + j @ (sp[i + 1] - pp[i + 1]) @ j.T
            lag[i + 1] = sp[i + 1] @ j.T
        return ll, sa, sp, lag

    def _step(self) -> float:
        r = self.r
        ll, s, v, lag = self.smooth()
        n = len(s)
        e11 = s[1:, :r].T @ s[1:, :r] + v[1:, :r, :r].sum(0)
        e10 = s[1:, :r].T @ s[:-1] + lag[1:, :r].sum(0)
        e00 = s[:-1].T @ s[:-1] + v[:-1].sum(0)
        self.a = e10 @ np.linalg.pinv(e00)
        self.q = (e11 - self.a @ e10.T) / (n - 1)
        self.q = (self.q + self.q.T) / 2 + 1e-9 * np.eye(r)
        ok = ~np.isnan(self.z)
        for i in range(self.z.shape[1]):
            k = ok[:, i]
            f = s[k, :r]
            ff = f.T @ f + v[k][:, :r, :r].sum(0)
            fz = f.T @ self.z[k, i]
            self.loadings[i] = np.linalg.solve(ff, fz)
            c = self.loadings[i]
            self.h[i] = max(1e-4, float((self.z[k, i] @ self.z[k, i] - 2 * c @ fz + c @ ff @ c) / k.sum()))
        return ll

    def fitted(self, ahead: int = 0, z: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Expected values of all cells, and the variances of the common part, in the series' own units."""
        _, s, v, _ = self.smooth(z, ahead)
        l = self.loadings  # noqa: E741
        var = np.einsum("ij,tjk,ik->ti", l, v[:, : self.r, : self.r], l) + self.h
        return s[:, : self.r] @ l.T * self.sd + self.mean, np.sqrt(var) * self.sd


def fill_panel(df: DataFrame, columns: list[str], order: str, r: int = 1, p: int = 1, by: str | None = None) -> DataFrame:
    """order, variable, value, filled: missing cells by the smoothed common part."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, x):
        m, _ = Filtered(x, r, p).fitted()
        gap = np.isnan(x)
        return {order: np.repeat(t, x.shape[1]), "variable": np.tile(columns, len(t)), "value": np.where(gap, m, x).ravel(), "filled": gap.ravel()}

    return panel_kernel(df, columns, order, f, f"{order} {kind}, variable string, value double, filled boolean", by)


def nowcast(df: DataFrame, columns: list[str], order: str, target: str, r: int = 1, p: int = 1, ahead: int = 3, level: float = 0.95, by: str | None = None) -> DataFrame:
    """step (0: the last row), value, lower, upper of the target; ragged edges are filtered."""
    z = dist.norm_ppf(0.5 + level / 2)
    i = columns.index(target)

    def f(t, x):
        v, s = Filtered(x, r, p).fitted(ahead)
        k = np.arange(len(t) - 1, len(t) + ahead)
        return {"step": k - len(t) + 1, "value": v[k, i], "lower": v[k, i] - z * s[k, i], "upper": v[k, i] + z * s[k, i]}

    return panel_kernel(df, columns, order, f, "step int, value double, lower double, upper double", by)


def news(df: DataFrame, old: DataFrame, columns: list[str], order: str, target: str, r: int = 1, p: int = 1) -> DataFrame:
    """order, variable, forecast, released, weight, impact: releases are cells that the old vintage misses; rows ``revisions`` and ``total`` close the sum.

    Both vintages are filtered with the parameters of the new one; weights are
    the target's regression on the surprises jointly.
    """
    kind = df.schema[order].dataType.simpleString()
    i = columns.index(target)
    both = df.select(order, *[F.col(c).cast("double").alias(c) for c in columns]).join(old.select(order, *[F.col(c).cast("double").alias(f"_old_{c}") for c in columns]), order, "left")
    wide = [*columns, *[f"_old_{c}" for c in columns]]

    def f(t, v):
        k = len(columns)
        new, was = v[:, :k], v[:, k:]
        m = Filtered(new, r, p)
        z_new = (new - m.mean) / m.sd
        z_old = (was - m.mean) / m.sd
        mixed = np.where(np.isnan(z_old), np.nan, z_new)  # revised values of what was known before
        path = lambda z: m.smooth(z)[1][:, : m.r] @ m.loadings.T
        a, b, c = path(z_old), path(mixed), path(z_new)
        at = len(t) - 1
        cells = [(s, j) for s in range(len(t)) for j in range(k) if np.isnan(z_old[s, j]) and not np.isnan(z_new[s, j])]
        surprise = np.array([z_new[s, j] - b[s, j] for s, j in cells])
        # Each release's own weight: response of the target to a unit surprise in it, the others as they are expected.
        weights = []
        for s, j in cells:
            z = mixed.copy()
            for s2, j2 in cells:
                z[s2, j2] = b[s2, j2]
            z[s, j] = b[s, j] + 1.0
            base = mixed.copy()
            for s2, j2 in cells:
                base[s2, j2] = b[s2, j2]
            weights.append(float(path(z)[at, i] - path(base)[at, i]))
        out = [(t[s], columns[j], float(b[s, j] * m.sd[j] + m.mean[j]), float(new[s, j]), w * m.sd[i] / m.sd[j], w * x * m.sd[i]) for (s, j), w, x in zip(cells, weights, surprise, strict=True)]
        out.append((t[at], "revisions", None, None, None, float((b[at, i] - a[at, i]) * m.sd[i])))
        out.append((t[at], "total", float(a[at, i] * m.sd[i] + m.mean[i]), float(c[at, i] * m.sd[i] + m.mean[i]), None, float((c[at, i] - a[at, i]) * m.sd[i])))
        return tidy((order, "variable", "forecast", "released", "weight", "impact"), out)

    return panel_kernel(both, wide, order, f, f"{order} {kind}, variable string, forecast double, released double, weight double, impact double")


def bridge(df: DataFrame, monthly: list[str], quarterly: str, order: str, lags: int = 1, by: str | None = None) -> DataFrame:
    """model, value: quarterly target on quarter averages of pairs of monthly series and its own lag, gaps of months filled by autoregressions, and the mean of the models. The order counts months from 0; the target stands in the third month of its quarter."""

    def f(t, v):
        x, y = v[:, :-1].copy(), v[:, -1]
        for j in range(x.shape[1]):
            for k in range(1, len(x)):
                if np.isnan(x[k, j]):
                    past = x[:k, j]
                    b = ols(past[1:], np.column_stack([np.ones(k - 1), past[:-1]]))[0] if k > 4 else np.array([past[-1], 0.0])
                    x[k, j] = b[0] + b[1] * past[-1]
        q = t // 3
        names = np.unique(q)
        low = np.array([x[q == k].mean(0) for k in names])
        target = np.array([y[q == k][~np.isnan(y[q == k])][-1] if (~np.isnan(y[q == k])).any() else np.nan for k in names])
        out = []
        pairs = [(i, j) for i in range(len(monthly)) for j in range(i)] or [(0, 0)]
        for i, j in pairs:
            z = np.column_stack([np.ones(len(low) - lags), low[lags:, sorted({i, j})], *[target[lags - k : len(target) - k] for k in range(1, lags + 1)]])
            ok = ~np.isnan(target[lags:]) & ~np.isnan(z).any(1)
            b = ols(target[lags:][ok], z[ok])[0]
            out.append(("+".join(monthly[k] for k in sorted({i, j})), float(z[-1] @ b)))
        out.append(("mean", float(np.nanmean([r[1] for r in out]))))
        return tidy(("model", "value"), out)

    return panel_kernel(df, [*monthly, quarterly], order, f, "model string, value double", by)


def nowcast_bvar(df: DataFrame, columns: list[str], order: str, target: str, p: int = 2, tau: tuple = (0.05, 0.1, 0.2, 0.5, 1.0), rounds: int = 10, ahead: int = 2, by: str | None = None) -> DataFrame:
    """step, value, tightness: gaps are filled and the shrunk autoregression fitted again until both stand; tightness by marginal likelihood."""
    from .vectors import dummy_rows, marginal_likelihood

    i = columns.index(target)

    def f(t, x):
        gap = np.isnan(x)
        y = np.where(gap, np.nanmean(x, 0), x)
        for j in range(x.shape[1]):
            k = np.flatnonzero(~gap[:, j])
            y[:, j] = np.interp(np.arange(len(x)), k, x[k, j])
        full = ~gap.any(1)
        last = int(np.flatnonzero(full)[-1]) + 1
        best = max(tau, key=lambda a: marginal_likelihood(y[:last], p, a))
        for _ in range(rounds):
            z, w = lag_matrix(y, p)
            yd, xd = dummy_rows(y, p, best)
            b = ols(np.vstack([z, yd]), np.vstack([w, xd]))[0]
            before = y.copy()
            m = Given(y, p, b)
            for s in range(p, len(y)):
                if gap[s].any():
                    e = b[0] + sum(y[s - 1 - j] @ b[1 + j * y.shape[1] : 1 + (j + 1) * y.shape[1]] for j in range(p))
                    k, o = gap[s], ~gap[s]
                    fix = m.sigma[np.ix_(k, o)] @ guarded_inverse(m.sigma[np.ix_(o, o)]) @ (y[s, o] - e[o]) if o.any() else 0.0
                    y[s, k] = e[k] + fix
            if np.abs(y - before).max() < 1e-6:
                break
        out = [(0, float(y[-1, i]), best)] + [(h + 1, float(v[i]), best) for h, v in enumerate(Given(y, p, b).forecast(ahead)[0])]
        return tidy(("step", "value", "tightness"), out)

    return panel_kernel(df, columns, order, f, "step int, value double, tightness double", by)


# -- frequency domain -------------------------------------------------------------


def spectral_matrices(z: np.ndarray, m: int, kernel: str = "bartlett") -> tuple[np.ndarray, np.ndarray]:
    """Frequencies 0..pi and lag-window spectral matrices."""
    n = len(z)
    gam = [z[k:].T @ z[: n - k] / n for k in range(m + 1)]
    x = np.arange(m + 1) / (m + 1)
    w = {"bartlett": 1 - x, "parzen": np.where(x <= 0.5, 1 - 6 * x**2 + 6 * x**3, 2 * (1 - x) ** 3), "tukey": 0.5 * (1 + np.cos(math.pi * x))}[kernel]
    freq = math.pi * np.arange(m + 1) / m
    out = []
    for f in freq:
        s = gam[0].astype(complex)
        for k in range(1, m + 1):
            s = s + w[k] * (gam[k] * np.exp(-1j * f * k) + gam[k].T * np.exp(1j * f * k))
        out.append(s / (2 * math.pi))
    return freq, np.array(out)


class Generalised:
    """Dynamic principal components: q per frequency, the common part back in time by the two-sided filter."""

    def __init__(self, x: np.ndarray, q: int, m: int = 0, kernel: str = "bartlett"):
        self.z, self.mean, self.sd = standard(x)
        n, k = self.z.shape
        m = m or max(2, int(round(math.sqrt(n))))
        self.freq, self.s = spectral_matrices(self.z, m, kernel)
        w, v = np.linalg.eigh(self.s)
        self.w, v = w[:, ::-1], v[:, :, ::-1]
        proj = np.einsum("fia,fja->fij", v[:, :, :q], v[:, :, :q].conj())
        # Filter weights from the projections, symmetric in frequency.
        weight = np.ones(len(self.freq))
        weight[0] = weight[-1] = 0.5
        c = {}
        for lag in range(-m, m + 1):
            e = np.exp(1j * self.freq * lag)
            c[lag] = (np.einsum("f,f,fij->ij", weight, e, proj) / m).real
        self.common = np.zeros_like(self.z)
        for lag, a in c.items():
            src = np.clip(np.arange(n) - lag, 0, n - 1)
            ok = (np.arange(n) - lag >= 0) & (np.arange(n) - lag < n)
            self.common += (self.z[src] * ok[:, None]) @ a.T
        self.share = np.array([np.trapezoid(self.w[:, j], self.freq) for j in range(k)])
        self.share /= self.share.sum()

    @property
    def variance_share(self) -> np.ndarray:
        return self.common.var(0) / self.z.var(0)


def generalised_factors(df: DataFrame, columns: list[str], order: str, q: int = 1, kernel: str = "bartlett", by: str | None = None) -> DataFrame:
    """order, variable, common, idiosyncratic in the series' units."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, x):
        m = Generalised(x, q, 0, kernel)
        c = m.common * m.sd + m.mean
        return {order: np.repeat(t, x.shape[1]), "variable": np.tile(columns, len(t)), "common": c.ravel(), "idiosyncratic": (x - c).ravel()}

    return panel_kernel(df.dropna(subset=columns), columns, order, f, f"{order} {kind}, variable string, common double, idiosyncratic double", by)


def generalised_summary(df: DataFrame, columns: list[str], order: str, most: int = 3, by: str | None = None) -> DataFrame:
    """part (share of a variable's variance, eigenvalue at a frequency, cumulative share and criterion by number), name, at, value."""

    def f(t, x):
        m = Generalised(x, 1)
        out = [("variance_share", c, 0.0, float(v)) for c, v in zip(columns, m.variance_share, strict=True)]
        out += [("eigenvalue", str(j + 1), float(w), float(m.w[k, j])) for k, w in enumerate(m.freq) for j in range(x.shape[1])]
        n, k = x.shape
        band = len(m.freq) - 1
        pen = (1 / band**2 + math.sqrt(band / n) + 1 / k) * math.log(min(k, band**2, math.sqrt(n / band)) + 1)
        for q in range(1, min(most, k) + 1):
            rest = float(np.mean(m.w[:, q:].sum(1))) / k
            out.append(("criterion", str(q), 0.0, math.log(max(rest, 1e-12)) + q * pen))
            out.append(("cumulative_share", str(q), 0.0, float(m.share[:q].sum())))
        return tidy(("part", "name", "at", "value"), out)

    return panel_kernel(df.dropna(subset=columns), columns, order, f, "part string, name string, at double, value double", by)


def generalised_forecast(df: DataFrame, columns: list[str], order: str, q: int = 1, steps: int = 4, by: str | None = None) -> DataFrame:
    """horizon, variable, forecast: autoregressions of the common parts."""

    def f(t, x):
        m = Generalised(x, q)
        out = []
        for j, c in enumerate(columns):
            v = Var(m.common[:, [j]], 1).forecast(steps)[0][:, 0] * m.sd[j] + m.mean[j]
            out += [(h + 1, c, float(a)) for h, a in enumerate(v)]
        return tidy(("horizon", "variable", "forecast"), out)

    return panel_kernel(df.dropna(subset=columns), columns, order, f, "horizon int, variable string, forecast double", by)


# -- augmented and structural -------------------------------------------------------


class Augmented:
    """Factors of a panel beside key variables in one autoregression; the keys come last. What the keys explain is taken out of the factors."""

    def __init__(self, x: np.ndarray, key: np.ndarray, r: int, p: int):
        self.z, self.mean, self.sd = standard(x)
        f, _, _ = components(self.z, r)
        slow = ols(f, np.column_stack([np.ones(len(key)), key]))[0]
        self.factors = f - (key - key.mean(0)) @ slow[1:]
        self.joint = np.column_stack([self.factors, key])
        self.var = Var(self.joint, p)
        self.loadings = ols(self.z, np.column_stack([np.ones(len(key)), self.joint]))[0][1:].T


def augmented(df: DataFrame, panel: list[str], key: list[str], order: str, what: str = "irf", r: int = 1, p: int = 1, horizon: int = 8, by: str | None = None) -> DataFrame:
    """horizon, variable, shock, value: what is irf, fevd (of factors and keys), panel_irf (of the series through the loadings), forecast or panel_forecast (shock empty), historical (horizon counts rows)."""
    names = [*[f"f{j + 1}" for j in range(r)], *key]

    def f(t, v):
        m = Augmented(v[:, : len(panel)], v[:, len(panel) :], r, p)
        if what in ("forecast", "panel_forecast"):
            y = m.var.forecast(horizon)[0]
            if what == "panel_forecast":
                y = (y - m.joint.mean(0)) @ m.loadings.T * m.sd + m.mean
            cols = panel if what == "panel_forecast" else names
            return {"horizon": np.repeat(np.arange(1, horizon + 1), len(cols)), "variable": np.tile(cols, horizon), "shock": "", "value": y.ravel()}
        if what == "historical":
            a, first = m.var.historical()[0], p
            cols = names
        else:
            a, first = (m.var.fevd(horizon) if what == "fevd" else m.var.irf(horizon)), 0
            cols = names
            if what == "panel_irf":
                a, cols = np.einsum("ij,hjk->hik", m.loadings, a) * m.sd[:, None], panel
        h, i, s = a.shape
        return {"horizon": np.repeat(np.arange(first, first + h), i * s), "variable": np.tile(np.repeat(cols, s), h), "shock": np.tile(names, h * i), "value": a.ravel()}

    return panel_kernel(df.dropna(subset=[*panel, *key]), [*panel, *key], order, f, CUBE, by)


def augmented_to_var(df: DataFrame, panel: list[str], key: list[str], order: str, r: int = 1, p: int = 1, by: str | None = None) -> DataFrame:
    """equation, term, estimate of the joint autoregression."""
    names = [*[f"f{j + 1}" for j in range(r)], *key]
    terms = ["const", *[f"{c}_l{j}" for j in range(1, p + 1) for c in names]]

    def f(t, v):
        b = Augmented(v[:, : len(panel)], v[:, len(panel) :], r, p).var.b
        return {"equation": np.tile(names, len(terms)), "term": np.repeat(terms, len(names)), "estimate": b.ravel()}

    return panel_kernel(df.dropna(subset=[*panel, *key]), [*panel, *key], order, f, "equation string, term string, estimate double", by)


def augmented_bayesian(df: DataFrame, panel: list[str], key: list[str], order: str, r: int = 1, p: int = 1, horizon: int = 8, draws: int = 100, seed: int = 1) -> DataFrame:
    """horizon, variable, shock, mean, lower, upper: factors given the panel, the autoregression's posterior drawn; draws are rows."""
    from .multivariate import system
    from .vectors import Posterior

    spark = df.sparkSession
    v = system(df, [*panel, *key], order)
    m = Augmented(v[:, : len(panel)], v[:, len(panel) :], r, p)
    shared = spark.sparkContext.broadcast(Posterior(m.joint, p, None))
    names = [*[f"f{j + 1}" for j in range(r)], *key]

    def go(batches):
        post = shared.value
        for pdf in batches:
            out = []
            for k in pdf.id:
                a = post.model(np.random.default_rng([seed, int(k)])).irf(horizon)
                h, i, s = a.shape
                out.append(pd.DataFrame({"horizon": np.repeat(np.arange(h), i * s), "variable": np.tile(np.repeat(names, s), h), "shock": np.tile(names, h * i), "value": a.ravel()}))
            if out:
                yield pd.concat(out)

    got = spark.range(draws).mapInPandas(go, CUBE)
    return got.groupBy("horizon", "variable", "shock").agg(F.avg("value").alias("mean"), F.percentile("value", 0.16).alias("lower"), F.percentile("value", 0.84).alias("upper"))


def structural_factors(df: DataFrame, columns: list[str], order: str, q: int = 1, p: int = 1, horizon: int = 8, by: str | None = None) -> DataFrame:
    """horizon, variable, shock, value: static factors of the generalised common part, their autoregression's recursive shocks, responses of the series."""

    def f(t, x):
        g = Generalised(x, q)
        fac, load, _ = components(g.common - g.common.mean(0), q)
        a = np.einsum("ij,hjk->hik", load, Var(fac, p).irf(horizon)) * g.sd[:, None]
        h, i, s = a.shape
        return {"horizon": np.repeat(np.arange(h), i * s), "variable": np.tile(np.repeat(columns, s), h), "shock": np.tile([f"shock{j + 1}" for j in range(s)], h * i), "value": a.ravel()}

    return panel_kernel(df.dropna(subset=columns), columns, order, f, CUBE, by)


def loading_breaks(df: DataFrame, columns: list[str], order: str, r: int = 1, trim: float = 0.15, by: str | None = None) -> DataFrame:
    """test (wald, lm, lr), statistic, at: largest statistic over dates that second moments of the factors shift, loadings having changed."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, x):
        z, _, _ = standard(x)
        fac, _, _ = components(z, r)
        cells = [(i, j) for i in range(r) for j in range(i + 1)]
        m = np.column_stack([fac[:, i] * fac[:, j] - (i == j) for i, j in cells])
        n = len(m)
        v = m.T @ m / n
        out = {"wald": (-1.0, None), "lm": (-1.0, None), "lr": (-1.0, None)}
        for b in range(int(trim * n), int((1 - trim) * n)):
            one, two = m[:b].mean(0), m[b:].mean(0)
            d = one - two
            lm = float(d @ guarded_inverse(v) @ d) * b * (n - b) / n
            e = np.vstack([m[:b] - one, m[b:] - two])
            u = e.T @ e / n
            wald = float(d @ guarded_inverse(u) @ d) * b * (n - b) / n
            lr = n * float(np.linalg.slogdet(v)[1] - np.linalg.slogdet(u)[1])
            for name, s in (("wald", wald), ("lm", lm), ("lr", lr)):
                if s > out[name][0]:
                    out[name] = (s, t[b])
        return tidy(("test", "statistic", "at"), [(a, *v) for a, v in out.items()])

    return panel_kernel(df.dropna(subset=columns), columns, order, f, f"test string, statistic double, at {kind}", by)
