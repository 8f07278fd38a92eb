"""More of vector autoregressions: covariances of coefficients, error correction with restrictions, Bayesian posteriors.

Arrays in, arrays out; the DataFrame forms run one system a group, or draws as
rows seeded by their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.linalg import guarded_inverse, ols
from ..functions.linalg import lags as lag_matrix
from .kernels import per_series, tidy
from .multivariate import _cube, CUBE, per_system, system, TRACE_5, Var

TESTS = "test string, statistic double, df int, p_value double"


def _chi2(name: str, s: float, df: int) -> tuple[str, float, int, float]:
    return name, float(s), int(df), dist.chi2_sf(s, df) if df > 0 else float("nan")


def terms_of(columns: list[str], p: int) -> list[str]:
    return ["const", *[f"{c}_l{j}" for j in range(1, p + 1) for c in columns]]


class Given(Var):
    """An autoregression whose coefficients come from elsewhere."""

    def __init__(self, y: np.ndarray, p: int, coefficients: np.ndarray, covariance: np.ndarray | None = None):
        super().__init__(y, p)
        self.coefficients, self.covariance = coefficients, covariance

    @cached_property
    def fit(self):
        z, x = lag_matrix(self.y, self.p)
        return z, x, guarded_inverse(x.T @ x), self.coefficients, z - x @ self.coefficients

    @property
    def sigma(self) -> np.ndarray:
        return self.u.T @ self.u / self.rows if self.covariance is None else self.covariance


# -- least squares ------------------------------------------------------------


def coefficient_covariance(df: DataFrame, columns: list[str], order: str, p: int = 1, by: str | None = None) -> DataFrame:
    """equation, term, equation2, term2, value: residual covariance (degrees of freedom adjusted) times the inverse Gram matrix."""

    def f(m):
        v = np.kron(m.sigma_dof, m.inv)
        names = [(c, k) for c in columns for k in terms_of(columns, p)]
        n = len(names)
        a = [names[i // n] for i in range(n * n)]
        b = [names[i % n] for i in range(n * n)]
        return {"equation": [x[0] for x in a], "term": [x[1] for x in a], "equation2": [x[0] for x in b], "term2": [x[1] for x in b], "value": v.ravel()}

    return per_system(df, columns, order, p, f, "equation string, term string, equation2 string, term2 string, value double", by)


def lag_coefficients(df: DataFrame, columns: list[str], order: str, p: int = 1, by: str | None = None) -> DataFrame:
    """lag, equation, variable, value: the matrices A_1 .. A_p."""

    def f(m):
        n = len(columns)
        return tidy(("lag", "equation", "variable", "value"), [(j, columns[i], columns[k], m.b[1 + (j - 1) * n + k, i]) for j in range(1, p + 1) for i in range(n) for k in range(n)])

    return per_system(df, columns, order, p, f, "lag int, equation string, variable string, value double", by)


def dimensions(df: DataFrame, columns: list[str], order: str, p: int = 1, by: str | None = None) -> DataFrame:
    """variables, lags, coefficients (of one equation), rows_used, loglik, stationary."""

    def f(m):
        ll = -m.rows * m.n / 2 * (math.log(2 * math.pi) + 1) - m.rows / 2 * np.linalg.slogdet(m.sigma)[1]
        return {"variables": [m.n], "lags": [p], "coefficients": [1 + m.n * p], "rows_used": [m.rows], "loglik": [ll], "stationary": [bool(m.roots[0] < 1)]}

    return per_system(df, columns, order, p, f, "variables int, lags int, coefficients int, rows_used int, loglik double, stationary boolean", by)


def fitted(df: DataFrame, columns: list[str], order: str, p: int = 1, by: str | None = None) -> DataFrame:
    """order, variable, fitted, residual."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        m = Var(y, p)
        return {order: np.repeat(t[p:], m.n), "variable": np.tile(columns, m.rows), "fitted": (m.fit[1] @ m.b).ravel(), "residual": m.u.ravel()}

    return per_series(df, columns, order, f, f"{order} {kind}, variable string, fitted double, residual double", by)


def point_forecast(df: DataFrame, columns: list[str], order: str, p: int = 1, steps: int = 8, by: str | None = None) -> DataFrame:
    """horizon, variable, forecast by recursion."""
    return per_system(df, columns, order, p, lambda m: {"horizon": np.repeat(np.arange(1, steps + 1), len(columns)), "variable": np.tile(columns, steps), "forecast": m.forecast(steps)[0].ravel()}, "horizon int, variable string, forecast double", by, last=True)


def structural_shocks(df: DataFrame, columns: list[str], order: str, p: int = 1, method: str = "cholesky", by: str | None = None) -> DataFrame:
    """order, shock, value."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        e = Var(y, p).shocks(method)
        return {order: np.repeat(t[p:], e.shape[1]), "shock": np.tile(columns, len(e)), "value": e.ravel()}

    return per_series(df, columns, order, f, f"{order} {kind}, shock string, value double", by)


def decomposition_gap(df: DataFrame, columns: list[str], order: str, p: int = 1, tol: float = 1e-8, by: str | None = None) -> DataFrame:
    """variable, gap (largest difference between data and the sum of contributions and initial part), holds."""

    def f(t, y):
        c, base = Var(y, p).historical()
        gap = np.abs(c.sum(2) + base - y[p:]).max(0)
        return {"variable": columns, "gap": gap, "holds": gap < tol * max(1.0, np.abs(y).max())}

    return per_series(df, columns, order, f, "variable string, gap double, holds boolean", by)


def shock_totals(df: DataFrame, columns: list[str], order: str, p: int = 1, by: str | None = None) -> DataFrame:
    """order, variable, total: the sum of all shocks' contributions."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        c, _ = Var(y, p).historical()
        return {order: np.repeat(t[p:], len(columns)), "variable": np.tile(columns, len(c)), "total": c.sum(2).ravel()}

    return per_series(df, columns, order, f, f"{order} {kind}, variable string, total double", by)


def granger_blocks(df: DataFrame, columns: list[str], order: str, blocks: dict[str, list[str]], effect: str, p: int = 1, by: str | None = None) -> DataFrame:
    """test (name of the block), statistic, df, p_value: Wald chi-square that all lags of a block of causes vanish in the equation of the effect."""

    def f(t, y):
        m = Var(y, p)
        e = columns.index(effect)
        out = []
        for name, causes in blocks.items():
            k = [1 + j * m.n + columns.index(c) for j in range(p) for c in causes]
            b = m.b[k, e]
            out.append(_chi2(name, b @ np.linalg.solve(m.sigma_dof[e, e] * m.fit[2][np.ix_(k, k)], b), len(k)))
        return tidy(("test", "statistic", "df", "p_value"), out)

    return per_series(df, columns, order, f, TESTS, by)


def likelihood_ratio(loglik_small: float, loglik_big: float, extra: int) -> tuple[float, float]:
    """Statistic and p value of nested models."""
    s = 2 * (loglik_big - loglik_small)
    return s, dist.chi2_sf(s, extra)


def lag_tests(df: DataFrame, columns: list[str], order: str, small: int = 1, big: int = 2, by: str | None = None) -> DataFrame:
    """lr and lm tests of an autoregression of ``small`` lags within one of ``big`` lags, on the same rows: test, statistic, df, p_value."""

    def f(t, y):
        z, x = lag_matrix(y, big)
        n = y.shape[1]
        x0 = x[:, : 1 + n * small]
        e0, e1 = ols(z, x0)[1], ols(z, x)[1]
        m, k = len(z), n * n * (big - small)
        ld = lambda e: np.linalg.slogdet(e.T @ e / m)[1]
        s0 = e0.T @ e0 / m
        # Score test: trace of the restricted residuals' projection on all regressors.
        fit = x @ ols(e0, x)[0]
        return tidy(("test", "statistic", "df", "p_value"), [_chi2("lr", m * (ld(e0) - ld(e1)), k), _chi2("lm", np.trace(np.linalg.solve(s0, fit.T @ fit)), k)])

    return per_series(df, columns, order, f, TESTS, by)


# -- error correction -----------------------------------------------------------

#: Osterwald-Lenum (1992) with an unrestricted constant, largest eigenvalue at 5 % for 1..5 common trends.
MAX_5 = (3.76, 14.07, 20.97, 27.07, 33.46)


class Vecm:
    """Johansen's estimates: p lags in levels, unrestricted constant; beta is normalised on the first variables."""

    def __init__(self, y: np.ndarray, p: int = 2, rank: int = 1):
        self.y, self.p, self.rank = y, p, rank
        d, n = np.diff(y, axis=0), y.shape[1]
        self.z0, self.z1 = d[p - 1 :], y[p - 1 : -1]
        self.x = np.hstack([np.ones((len(self.z0), 1)), *[d[p - 1 - j : len(d) - j] for j in range(1, p)]])
        q = lambda a: a - self.x @ np.linalg.lstsq(self.x, a, rcond=None)[0]
        self.r0, self.r1 = q(self.z0), q(self.z1)
        self.t, self.n = len(self.z0), n
        self.s00, self.s11, self.s01 = self.r0.T @ self.r0 / self.t, self.r1.T @ self.r1 / self.t, self.r0.T @ self.r1 / self.t
        self.w, v = self.eigen(self.s00, self.s01, self.s11)
        self.beta = v[:, :rank] @ np.linalg.inv(v[:rank, :rank]) if rank else np.zeros((n, 0))

    @staticmethod
    def eigen(s00: np.ndarray, s01: np.ndarray, s11: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = np.linalg.inv(np.linalg.cholesky(s11))
        w, v = np.linalg.eigh(root @ s01.T @ np.linalg.solve(s00, s01) @ root.T)
        return np.clip(w[::-1], 0, 1 - 1e-15), (root.T @ v)[:, ::-1]

    @cached_property
    def b(self) -> np.ndarray:
        """Rows: the rank's loadings, then constant and lagged differences."""
        return ols(self.z0, np.hstack([self.z1 @ self.beta, self.x]))[0]

    alpha = property(lambda self: self.b[: self.rank].T)

    @cached_property
    def u(self) -> np.ndarray:
        return self.z0 - np.hstack([self.z1 @ self.beta, self.x]) @ self.b

    def to_var(self) -> Given:
        n, p, g = self.n, self.p, self.b[self.rank :]
        gamma = [g[1 + j * n : 1 + (j + 1) * n].T for j in range(p - 1)]
        pi = self.alpha @ self.beta.T
        a = []
        for j in range(1, p + 1):
            m = -gamma[j - 2] if j > 1 else np.eye(n) + pi
            a.append(m + gamma[j - 1] if j < p else m)
        return Given(self.y, p, np.vstack([g[:1], *[x.T for x in a]]))

    def rank_table(self) -> list[tuple]:
        lr = -self.t * np.log(1 - self.w)
        return [(r, self.w[r], lr[r:].sum(), TRACE_5[self.n - r - 1], lr[r], MAX_5[self.n - r - 1]) for r in range(self.n)]

    def select_rank(self, criterion: str = "trace") -> int:
        k = (2, 3) if criterion == "trace" else (4, 5)
        return next((r[0] for r in self.rank_table() if r[k[0]] <= r[k[1]]), self.n)

    def _lr(self, w: np.ndarray) -> float:
        r = self.rank
        return float(self.t * (np.log(1 - w[:r]).sum() - np.log(1 - self.w[:r]).sum()))

    def beta_restriction(self, h: np.ndarray) -> tuple:
        """beta = H phi."""
        w, _ = self.eigen(self.s00, self.s01 @ h, h.T @ self.s11 @ h)
        return _chi2("beta", self._lr(w), self.rank * (self.n - h.shape[1]))

    def alpha_restriction(self, a: np.ndarray, name: str = "alpha") -> tuple:
        """alpha = A psi: the equations orthogonal to A are partialled out of the others."""
        q, _ = np.linalg.qr(a, mode="complete")
        rest = q[:, a.shape[1] :]
        bar = a @ np.linalg.inv(a.T @ a)
        if rest.shape[1]:
            k = np.linalg.inv(rest.T @ self.s00 @ rest)
            s00 = bar.T @ (self.s00 - self.s00 @ rest @ k @ rest.T @ self.s00) @ bar
            s01 = bar.T @ (self.s01 - self.s00 @ rest @ k @ rest.T @ self.s01)
            s11 = self.s11 - self.s01.T @ rest @ k @ rest.T @ self.s01
        else:
            s00, s01, s11 = bar.T @ self.s00 @ bar, bar.T @ self.s01, self.s11
        w, _ = self.eigen(s00, s01, s11)
        return _chi2(name, self._lr(w), self.rank * (self.n - a.shape[1]))

    def weak_exogeneity(self, variables: list[int]) -> tuple:
        """The rows of alpha of these variables are zero."""
        return self.alpha_restriction(np.delete(np.eye(self.n), variables, axis=1), "weak_exogeneity")

    def known_beta(self, b: np.ndarray) -> tuple:
        """All cointegrating vectors are given."""
        b = b.reshape(self.n, -1)
        m = np.linalg.solve(b.T @ self.s11 @ b, b.T @ self.s01.T @ np.linalg.solve(self.s00, self.s01 @ b))
        w = np.sort(np.clip(np.linalg.eigvals(m).real, 0, 1 - 1e-15))[::-1]
        return _chi2("known_beta", self._lr(w), self.rank * (self.n - self.rank))

    def joint_restriction(self, h: np.ndarray, a: np.ndarray, maxiter: int = 1000, tol: float = 1e-8) -> tuple:
        """beta = H phi and alpha = A psi, by switching between the two until the likelihood stands."""
        beta, last = h @ np.linalg.lstsq(h, self.beta, rcond=None)[0], -math.inf
        for _ in range(maxiter):
            # psi and the residual covariance given beta, by generalised least squares.
            omega = self.s00
            for _ in range(3):
                w = np.linalg.inv(omega)
                psi = np.linalg.solve(a.T @ w @ a, a.T @ w @ self.s01 @ beta) @ np.linalg.inv(beta.T @ self.s11 @ beta)
                al = a @ psi
                omega = self.s00 - self.s01 @ beta @ al.T - al @ beta.T @ self.s01.T + al @ beta.T @ self.s11 @ beta @ al.T
            w = np.linalg.inv(omega)
            # vec(phi) given alpha.
            k = np.kron(al.T @ w @ al, h.T @ self.s11 @ h)
            phi = np.linalg.solve(k, (h.T @ self.s01.T @ w @ al).T.ravel()).reshape(self.rank, -1).T
            beta = h @ phi
            ll = -self.t / 2 * np.linalg.slogdet(omega)[1]
            if abs(ll - last) < tol:
                break
            last = ll
        free = -self.t / 2 * (np.linalg.slogdet(self.s00)[1] + np.log(1 - self.w[: self.rank]).sum())
        r = self.rank
        return _chi2("joint", 2 * (free - ll), r * (self.n - h.shape[1]) + r * (self.n - a.shape[1]))

    def granger(self, cause: int, effect: int) -> list[tuple]:
        """Short-run (lagged differences), long-run (loadings) and both, as Wald tests."""
        x = np.hstack([self.z1 @ self.beta, self.x])
        inv = guarded_inverse(x.T @ x)
        s = self.u[:, effect] @ self.u[:, effect] / (self.t - x.shape[1])
        r, out = self.rank, []
        short = [r + 1 + j * self.n + cause for j in range(self.p - 1)]
        for name, k in (("short_run", short), ("long_run", list(range(r))), ("strong", [*range(r), *short])):
            if k:
                b = self.b[k, effect]
                out.append(_chi2(name, b @ np.linalg.solve(s * inv[np.ix_(k, k)], b), len(k)))
        return out


def vecm_rank(df: DataFrame, columns: list[str], order: str, p: int = 2, by: str | None = None) -> DataFrame:
    """criterion, rank: the first rank that the 5 % test does not reject."""
    return per_series(df, columns, order, lambda t, y: {"criterion": ["trace", "max_eigen"], "rank": [Vecm(y, p, 1).select_rank("trace"), Vecm(y, p, 1).select_rank("max")]}, "criterion string, rank int", by)


def vecm_to_var(df: DataFrame, columns: list[str], order: str, p: int = 2, rank: int = 1, by: str | None = None) -> DataFrame:
    """equation, term, estimate of the autoregression in levels."""

    def f(t, y):
        b = Vecm(y, p, rank).to_var().b
        return {"equation": np.tile(columns, len(b)), "term": np.repeat(terms_of(columns, p), len(columns)), "estimate": b.ravel()}

    return per_series(df, columns, order, f, "equation string, term string, estimate double", by)


def vecm_fitted(df: DataFrame, columns: list[str], order: str, p: int = 2, rank: int = 1, by: str | None = None) -> DataFrame:
    """order, variable, fitted (of the difference), residual."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        m = Vecm(y, p, rank)
        return {order: np.repeat(t[p:], m.n), "variable": np.tile(columns, m.t), "fitted": (m.z0 - m.u).ravel(), "residual": m.u.ravel()}

    return per_series(df, columns, order, f, f"{order} {kind}, variable string, fitted double, residual double", by)


def vecm_forecast(df: DataFrame, columns: list[str], order: str, p: int = 2, rank: int = 1, steps: int = 8, level: float = 0.95, by: str | None = None) -> DataFrame:
    """horizon, variable, forecast, lower, upper of the levels; bands are normal."""
    z = dist.norm_ppf(0.5 + level / 2)

    def f(t, y):
        m, s = Vecm(y, p, rank).to_var().forecast(steps)
        return {"horizon": np.repeat(np.arange(1, steps + 1), len(columns)), "variable": np.tile(columns, steps), "forecast": m.ravel(), "lower": (m - z * s).ravel(), "upper": (m + z * s).ravel()}

    return per_series(df, columns, order, f, "horizon int, variable string, forecast double, lower double, upper double", by)


def vecm_irf(df: DataFrame, columns: list[str], order: str, p: int = 2, rank: int = 1, horizon: int = 12, shares: bool = False, by: str | None = None) -> DataFrame:
    """horizon, variable, shock, value: responses, or variance shares, by the level form."""

    def f(t, y):
        m = Vecm(y, p, rank).to_var()
        return _cube(m.fevd(horizon) if shares else m.irf(horizon), columns)

    return per_series(df, columns, order, f, CUBE, by)


def vecm_historical(df: DataFrame, columns: list[str], order: str, p: int = 2, rank: int = 1, by: str | None = None) -> DataFrame:
    """order, variable, shock (or initial), value."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        c, base = Vecm(y, p, rank).to_var().historical()
        a = np.concatenate((c, base[:, :, None]), axis=2)
        k, v, s = a.shape
        return {order: np.repeat(t[p:], v * s), "variable": np.tile(np.repeat(columns, s), k), "shock": np.tile([*columns, "initial"], k * v), "value": a.ravel()}

    return per_series(df, columns, order, f, f"{order} {kind}, variable string, shock string, value double", by)


def vecm_granger(df: DataFrame, columns: list[str], order: str, cause: str, effect: str, p: int = 2, rank: int = 1, by: str | None = None) -> DataFrame:
    return per_series(df, columns, order, lambda t, y: tidy(("test", "statistic", "df", "p_value"), Vecm(y, p, rank).granger(columns.index(cause), columns.index(effect))), TESTS, by)


def vecm_restrictions(df: DataFrame, columns: list[str], order: str, p: int = 2, rank: int = 1, *, beta: list[list[float]] | None = None, alpha: list[list[float]] | None = None, exogenous: list[str] = (), known: list[float] | None = None, by: str | None = None) -> DataFrame:
    """Likelihood ratios of those asked for: beta = H phi, alpha = A psi, both at once, weak exogeneity, a known beta: test, statistic, df, p_value."""

    def f(t, y):
        m, out = Vecm(y, p, rank), []
        h, a = (np.array(beta, float) if beta else None), (np.array(alpha, float) if alpha else None)
        if h is not None:
            out.append(m.beta_restriction(h))
        if a is not None:
            out.append(m.alpha_restriction(a))
        if h is not None and a is not None:
            out.append(m.joint_restriction(h, a))
        if exogenous:
            out.append(m.weak_exogeneity([columns.index(c) for c in exogenous]))
        if known:
            out.append(m.known_beta(np.array(known, float)))
        return tidy(("test", "statistic", "df", "p_value"), out)

    return per_series(df, columns, order, f, TESTS, by)


# -- Bayesian -------------------------------------------------------------------


def dummy_rows(y: np.ndarray, p: int, tau: float = 0.2, decay: float = 1.0, mu: float = 0.0, lam: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Minnesota prior as rows: own random walks with tightness tau and lag decay, residual scales, sums of coefficients (mu) and a common start (lam), the last two if positive."""
    n = y.shape[1]
    s = []
    for c in y.T:
        z, x = lag_matrix(c, p)
        e = ols(z[:, 0], x)[1]
        s.append(math.sqrt(e @ e / len(e)))
    s, mean = np.array(s), y[:p].mean(0)
    yd, xd = [], []
    for j in range(1, p + 1):
        for i in range(n):
            row = np.zeros(1 + n * p)
            row[1 + (j - 1) * n + i] = s[i] * j**decay / tau
            xd.append(row)
            yd.append(s[i] / tau * np.eye(n)[i] if j == 1 else np.zeros(n))
    for i in range(n):
        xd.append(np.zeros(1 + n * p))
        yd.append(s[i] * np.eye(n)[i])
    if mu > 0:
        for i in range(n):
            yd.append(mu * mean[i] * np.eye(n)[i])
            xd.append(np.concatenate(([0.0], np.tile(yd[-1], p))))
    if lam > 0:
        yd.append(lam * mean)
        xd.append(np.concatenate(([lam], np.tile(lam * mean, p))))
    return np.array(yd), np.array(xd)


class Posterior:
    """Normal-inverse-Wishart, from dummy rows or diffuse (tau = None)."""

    def __init__(self, y: np.ndarray, p: int, tau: float | None = 0.2, **options):
        self.y, self.p, self.n = y, p, y.shape[1]
        z, x = lag_matrix(y, p)
        if tau is not None:
            yd, xd = dummy_rows(y, p, tau, **options)
            z, x = np.vstack([z, yd]), np.vstack([x, xd])
        self.inv = guarded_inverse(x.T @ x)
        self.b = self.inv @ x.T @ z
        e = z - x @ self.b
        self.scale, self.dof = e.T @ e, len(z) - x.shape[1]
        self.root, self.half = np.linalg.cholesky(self.inv), np.linalg.cholesky(np.linalg.inv(self.scale))

    def draw(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        w = self.half @ rng.normal(size=(self.n, self.dof))
        sigma = np.linalg.inv(w @ w.T)
        return self.b + self.root @ rng.normal(size=self.b.shape) @ np.linalg.cholesky(sigma).T, sigma

    def model(self, rng: np.random.Generator) -> Given:
        return Given(self.y, self.p, *self.draw(rng))


def _log_constant(z: np.ndarray, x: np.ndarray) -> float:
    """Log of the integral of the likelihood under a flat prior."""
    n, d = z.shape[1], len(z) - x.shape[1]
    e = z - x @ np.linalg.lstsq(x, z, rcond=None)[0]
    g = n * (n - 1) / 4 * math.log(math.pi) + sum(math.lgamma((d - i) / 2) for i in range(n))
    return -n * d / 2 * math.log(math.pi) - n / 2 * np.linalg.slogdet(x.T @ x)[1] - d / 2 * np.linalg.slogdet(e.T @ e)[1] + g


def marginal_likelihood(y: np.ndarray, p: int, tau: float = 0.2, **options) -> float:
    """Log density of the data under the dummy-row prior."""
    z, x = lag_matrix(y, p)
    # A weak row for the constant makes the prior proper.
    yd, xd = dummy_rows(y, p, tau, **options)
    row = np.zeros(x.shape[1])
    row[0] = 1e-3
    yd, xd = np.vstack([yd, 1e-3 * y[:p].mean(0)]), np.vstack([xd, row])
    return _log_constant(np.vstack([z, yd]), np.vstack([x, xd])) - _log_constant_prior(yd, xd, y.shape[1])


def _log_constant_prior(yd: np.ndarray, xd: np.ndarray, n: int) -> float:
    """As _log_constant, the residual scale rows keeping the degrees of freedom above n - 1."""
    d = max(len(yd) - xd.shape[1], n)
    e = yd - xd @ np.linalg.lstsq(xd, yd, rcond=None)[0]
    g = n * (n - 1) / 4 * math.log(math.pi) + sum(math.lgamma((d - i) / 2) for i in range(n))
    return -n * d / 2 * math.log(math.pi) - n / 2 * np.linalg.slogdet(xd.T @ xd)[1] - d / 2 * np.linalg.slogdet(e.T @ e + 1e-12 * np.eye(n))[1] + g


def hyperparameters(df: DataFrame, columns: list[str], order: str, p: int = 1, tau: tuple = tuple(np.geomspace(0.01, 10, 20)), decay: tuple = (1.0,), mu: tuple = (0.0,), by: str | None = None) -> DataFrame:
    """tau, decay, mu, log_ml, best over the grid of prior settings."""
    grid = [(a, b, c) for a in tau for b in decay for c in mu]

    def f(t, y):
        v = [marginal_likelihood(y, p, a, decay=b, mu=c) for a, b, c in grid]
        return {"tau": [g[0] for g in grid], "decay": [g[1] for g in grid], "mu": [g[2] for g in grid], "log_ml": v, "best": [x == max(v) for x in v]}

    return per_series(df, columns, order, f, "tau double, decay double, mu double, log_ml double, best boolean", by)


def posterior_rows(df: DataFrame, columns: list[str], order: str, p: int, draws: int, seed: int, f: Callable[[Given, np.random.Generator], pd.DataFrame], schema: str, tau: float | None = 0.2, stationary: bool = False) -> DataFrame:
    """One piece of rows a draw; draws are rows, seeded by their number. Draws with an explosive root are left out if asked."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Posterior(system(df, columns, order), p, tau))

    def go(batches):
        post = shared.value
        for pdf in batches:
            out = []
            for r in pdf.id:
                rng = np.random.default_rng([seed, int(r)])
                m = post.model(rng)
                if not stationary or m.roots[0] < 1:
                    out.append(f(m, rng).assign(draw=int(r)))
            if out:
                yield pd.concat(out)[["draw", *[c.split()[0] for c in schema.split(", ")]]]

    return spark.range(draws).mapInPandas(go, "draw long, " + schema)


def bands(rows: DataFrame, keys: list[str], value: str = "value", quantiles: tuple = (0.16, 0.5, 0.84)) -> DataFrame:
    """keys, mean and a column q16, q50.. a quantile, over draws."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), *[F.percentile(value, q).alias(f"q{round(100 * q)}") for q in quantiles])


def posterior_irf(df: DataFrame, columns: list[str], order: str, p: int = 1, horizon: int = 12, draws: int = 200, seed: int = 1, shares: bool = False, quantiles: tuple = (0.16, 0.5, 0.84)) -> DataFrame:
    """horizon, variable, shock, mean and quantiles of responses or variance shares."""
    got = posterior_rows(df, columns, order, p, draws, seed, lambda m, rng: pd.DataFrame(_cube(m.fevd(horizon) if shares else m.irf(horizon), columns)), CUBE)
    return bands(got, ["horizon", "variable", "shock"], quantiles=quantiles)


def posterior_historical(df: DataFrame, columns: list[str], order: str, p: int = 1, draws: int = 50, seed: int = 1) -> DataFrame:
    """at (row number of the time), variable, shock, mean and quantiles of contributions."""

    def f(m, rng):
        return pd.DataFrame(_cube(m.historical()[0], columns, p)).rename(columns={"horizon": "at"})

    got = posterior_rows(df, columns, order, p, draws, seed, f, CUBE.replace("horizon", "at"))
    return bands(got, ["at", "variable", "shock"])


def posterior_forecast(df: DataFrame, columns: list[str], order: str, p: int = 1, steps: int = 8, draws: int = 300, seed: int = 1, quantiles: tuple = (0.025, 0.5, 0.975)) -> DataFrame:
    """horizon, variable, mean and quantiles of the predictive density: parameters and shocks are drawn."""
    n = len(columns)

    def f(m, rng):
        c, path = np.linalg.cholesky(m.sigma), list(m.y[-p:])
        for _ in range(steps):
            path.append(m.b[0] + sum(path[-1 - j] @ m.b[1 + j * n : 1 + (j + 1) * n] for j in range(p)) + c @ rng.normal(size=n))
        return pd.DataFrame({"horizon": np.repeat(np.arange(1, steps + 1), n), "variable": np.tile(columns, steps), "value": np.array(path[p:]).ravel()})

    return bands(posterior_rows(df, columns, order, p, draws, seed, f, "horizon int, variable string, value double"), ["horizon", "variable"], quantiles=quantiles)


def posterior_model(df: DataFrame, columns: list[str], order: str, p: int = 1, draws: int = 300, seed: int = 1) -> DataFrame:
    """matrix (b or sigma), row, column, mean, median: the models of mean and of median parameters."""
    t = terms_of(columns, p)

    def f(m, rng):
        b = [("b", r, c, m.b[i, j]) for i, r in enumerate(t) for j, c in enumerate(columns)]
        s = [("sigma", r, c, m.sigma[i, j]) for i, r in enumerate(columns) for j, c in enumerate(columns)]
        return pd.DataFrame(b + s, columns=["matrix", "row", "column", "value"])

    got = posterior_rows(df, columns, order, p, draws, seed, f, "matrix string, row string, column string, value double")
    return got.groupBy("matrix", "row", "column").agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"))


def gibbs(df: DataFrame, columns: list[str], order: str, p: int = 1, chains: int = 4, burnin: int = 200, kept: int = 200, thin: int = 1, tau: float = 0.2, seed: int = 1) -> DataFrame:
    """matrix, row, column, mean, sd: independent normal and inverse-Wishart priors, chains as rows."""
    spark = df.sparkSession
    y = system(df, columns, order)
    z, x = lag_matrix(y, p)
    n, k = y.shape[1], x.shape[1]
    yd, xd = dummy_rows(y, p, tau)
    # Prior means and variances that the dummy rows stand for; the constant is free.
    scale = np.array([abs(yd[p * n + i, i]) for i in range(n)])
    b0 = np.zeros((k, n))
    b0[1 : 1 + n] = np.eye(n)
    v0 = np.full((k, n), 1e6)
    for j in range(1, p + 1):
        for i in range(n):
            v0[1 + (j - 1) * n + i] = (tau / j) ** 2 * scale**2 / scale[i] ** 2
    shared = spark.sparkContext.broadcast((z, x, b0, v0, np.diag(scale**2)))
    t = terms_of(columns, p)

    def go(batches):
        z, x, b0, v0, s0 = shared.value
        for pdf in batches:
            out = []
            for r in pdf.id:
                rng = np.random.default_rng([seed, int(r)])
                b = ols(z, x)[0]
                for step in range(burnin + kept * thin):
                    e = z - x @ b
                    w = np.linalg.cholesky(np.linalg.inv(s0 + e.T @ e)) @ rng.normal(size=(n, len(z) + n + 1))
                    w = w @ w.T
                    a = np.kron(w, x.T @ x) + np.diag(1 / v0.T.ravel())
                    c = (x.T @ z @ w).T.ravel() + (b0 / v0).T.ravel()
                    chol = np.linalg.cholesky(a)
                    mean = np.linalg.solve(a, c)
                    b = (mean + np.linalg.solve(chol.T, rng.normal(size=k * n))).reshape(n, k).T
                    if step >= burnin and (step - burnin) % thin == 0:
                        sigma = np.linalg.inv(w)
                        out += [("b", q, v, b[i, j]) for i, q in enumerate(t) for j, v in enumerate(columns)] + [("sigma", q, v, sigma[i, j]) for i, q in enumerate(columns) for j, v in enumerate(columns)]
            yield pd.DataFrame(out, columns=["matrix", "row", "column", "value"])

    got = spark.range(chains).repartition(chains).mapInPandas(go, "matrix string, row string, column string, value double")
    return got.groupBy("matrix", "row", "column").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"))
