"""Vector autoregressions, impulse responses, decompositions, local projections, cointegration.

A system is small in columns. One system of any length is fitted from sums over
stretches of its order (``plans/lagged.py``); with a group column each system is
a kernel and many run in parallel. Bootstrap replicates and posterior draws are rows
of spark.range, seeded by their number, so results don't depend on partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.linalg import companion, guarded_inverse, ols
from ..functions.linalg import lags as lag_matrix
from ..plans.lagged import Stretches, autoregression, cointegration, dickey_fuller, lag_columns, products, projections, regress, square, unscaled
from .describe import rows
from .kernels import per_series
from .series import newey_west


@dataclass
class Var:
    """Fitted on an array with one column a variable; b has the constant first, then lag by lag."""

    y: np.ndarray
    p: int

    @cached_property
    def fit(self):
        z, x = lag_matrix(self.y, self.p)
        inv = guarded_inverse(x.T @ x)
        b = inv @ x.T @ z
        return z, x, inv, b, z - x @ b

    n = property(lambda self: self.y.shape[1])
    b = property(lambda self: self.fit[3])
    inv = property(lambda self: self.fit[2])
    u = property(lambda self: self.fit[4])
    rows = property(lambda self: len(self.fit[0]))

    @property
    def sigma(self) -> np.ndarray:
        """Residual covariance over the rows used."""
        return self.u.T @ self.u / self.rows

    @property
    def sigma_dof(self) -> np.ndarray:
        return self.u.T @ self.u / (self.rows - self.b.shape[0])

    def criteria(self) -> dict[str, float]:
        """Penalties count regressors of one equation."""
        k, t = self.b.shape[0], self.rows
        ld = float(np.linalg.slogdet(self.sigma)[1])
        return {"aic": ld + 2 * k / t, "bic": ld + math.log(t) * k / t, "hqic": ld + 2 * math.log(math.log(t)) * k / t}

    @property
    def roots(self) -> np.ndarray:
        return np.sort(np.abs(np.linalg.eigvals(companion(self.b, self.n, self.p))))[::-1]

    def moving_average(self, horizon: int) -> np.ndarray:
        """Coefficients Phi_0..Phi_{horizon - 1}."""
        a = [self.b[1 + j * self.n : 1 + (j + 1) * self.n].T for j in range(self.p)]
        out = [np.eye(self.n)]
        for h in range(1, horizon):
            out.append(sum(out[h - 1 - j] @ a[j] for j in range(min(self.p, h))))
        return np.array(out)

    def impact(self, method: str = "cholesky") -> np.ndarray:
        if method == "cholesky":
            return np.linalg.cholesky(self.sigma)
        if method == "long_run":
            m = np.eye(self.n) - sum(self.b[1 + j * self.n : 1 + (j + 1) * self.n].T for j in range(self.p))
            inv = np.linalg.inv(m)
            return m @ np.linalg.cholesky(inv @ self.sigma @ inv.T)
        raise ValueError(f"identification {method} is not known")

    def irf(self, horizon: int, method: str = "cholesky") -> np.ndarray:
        return self.moving_average(horizon) @ self.impact(method)

    def fevd(self, horizon: int, method: str = "cholesky") -> np.ndarray:
        s = np.cumsum(self.irf(horizon, method) ** 2, axis=0)
        return s / s.sum(2, keepdims=True)

    def shocks(self, method: str = "cholesky") -> np.ndarray:
        return np.linalg.solve(self.impact(method), self.u.T).T

    def historical(self, method: str = "cholesky") -> tuple[np.ndarray, np.ndarray]:
        """Contributions (time, variable, shock) and the part of initial values."""
        t = self.rows
        theta, e = self.irf(t, method), self.shocks(method)
        c = np.zeros((t, self.n, self.n))
        for k in range(t):
            c[k] = (theta[: k + 1] * e[k::-1][: k + 1][:, None, :]).sum(0)
        return c, self.fit[0] - c.sum(2)

    def forecast(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Point forecasts and their standard errors."""
        y = list(self.y[-self.p :])
        for _ in range(steps):
            y.append(self.b[0] + sum(y[-1 - j] @ self.b[1 + j * self.n : 1 + (j + 1) * self.n] for j in range(self.p)))
        phi = self.moving_average(steps)
        mse = np.cumsum([f @ self.sigma @ f.T for f in phi], axis=0)
        return np.array(y[self.p :]), np.sqrt(np.array([np.diag(m) for m in mse]))

    def granger(self, cause: int, effect: int) -> tuple[float, int, int, float]:
        """F of the lags of cause in the equation of effect."""
        k = [1 + j * self.n + cause for j in range(self.p)]
        b = self.b[k, effect]
        v = self.sigma_dof[effect, effect] * self.inv[np.ix_(k, k)]
        f = float(b @ np.linalg.solve(v, b)) / self.p
        dof = self.rows - self.b.shape[0]
        return f, self.p, dof, dist.f_sf(f, self.p, dof)


class Summed(Var):
    """The same from cross products of [1, y, lags] of one long system; y holds its last p rows only."""

    def __init__(self, s: Stretches, p: int, g: np.ndarray | None = None, last: bool = True):
        self.p, self.s = p, s
        n = len(s.columns)
        g = autoregression(s, p) if g is None else g
        x = [0, *range(1 + n, 1 + n * (p + 1))]
        b, inv, rss = regress(g, list(range(1, 1 + n)), x)
        self._b, self._inv = unscaled(b, inv, s.mean, s.sd, np.tile(s.mean, p), np.tile(s.sd, p))
        self._rss = rss * np.outer(s.sd, s.sd)
        self._rows = round(g[0, 0])
        self.y = s.last(p) if last else np.zeros((p, n))

    b = property(lambda self: self._b)
    inv = property(lambda self: self._inv)
    rows = property(lambda self: self._rows)
    sigma = property(lambda self: self._rss / self._rows)
    sigma_dof = property(lambda self: self._rss / (self._rows - self._b.shape[0]))


def fitted_system(df: DataFrame, columns: list[str], order: str, p: int, last: bool = False, parts: int | None = None) -> Summed:
    """The autoregression of one system, of any length."""
    return Summed(Stretches(df, columns, order, p, parts=parts), p, last=last)


def per_system(df: DataFrame, columns: list[str], order: str, p: int, f, schema: str, by: str | None, last: bool = False) -> DataFrame:
    """f(model) -> columns of the result: of the one system, by sums, or of each group's by a kernel."""
    if by:
        return per_series(df, columns, order, lambda t, y: f(Var(y, p)), schema, by)
    return _frame(df.sparkSession, f(fitted_system(df, columns, order, p, last)), schema)


def _frame(spark, columns: dict, schema: str) -> DataFrame:
    pdf = pd.DataFrame({k: list(v) for k, v in columns.items()}).replace([np.inf, -np.inf], np.nan)
    return rows(spark, [{k: _plain(v) for k, v in r.items()} for r in pdf.to_dict("records")], schema)


def _plain(v):
    v = v.item() if isinstance(v, np.generic) else v
    return None if isinstance(v, float) and math.isnan(v) else v


def _cube(a: np.ndarray, names: list[str], first: int = 1) -> dict:
    h, v, s = a.shape
    return {"horizon": np.repeat(np.arange(first, first + h), v * s), "variable": np.tile(np.repeat(names, s), h), "shock": np.tile(names, h * v), "value": a.ravel()}


CUBE = "horizon int, variable string, shock string, value double"


def var_coefficients(df: DataFrame, columns: list[str], order: str, p: int = 1, by: str | None = None) -> DataFrame:
    """equation, term, estimate, std_error (degrees of freedom adjusted)."""

    def f(m):
        terms = ["const", *[f"{c}_l{j}" for j in range(1, p + 1) for c in columns]]
        se = np.sqrt(np.outer(np.diag(m.inv), np.diag(m.sigma_dof)))
        return {"equation": np.tile(columns, len(terms)), "term": np.repeat(terms, len(columns)), "estimate": m.b.ravel(), "std_error": se.ravel()}

    return per_system(df, columns, order, p, f, "equation string, term string, estimate double, std_error double", by)


def lag_order(df: DataFrame, columns: list[str], order: str, most: int = 4, by: str | None = None) -> DataFrame:
    """p, aic, bic, hqic; each p on its own sample."""

    told = lambda c: {"p": range(1, most + 1), **{k: [x[k] for x in c] for k in ("aic", "bic", "hqic")}}
    schema = "p int, aic double, bic double, hqic double"
    if by:
        return per_series(df, columns, order, lambda t, y: told([Var(y, p).criteria() for p in range(1, most + 1)]), schema, by)
    s, n = Stretches(df, columns, order, most), len(columns)
    # Each order's own rows: those that all orders use, and the few that only shorter ones reach.
    g = s.sums(lambda z, place, own: np.concatenate([(lambda at: products(np.hstack([np.ones((len(at), 1)), lag_columns(z, at, range(p + 1))])))(own[place[own] > p]) for p in range(1, most + 1)]))
    cuts = np.cumsum([0, *[(1 + n * (p + 1)) ** 2 for p in range(1, most + 1)]])
    return _frame(df.sparkSession, told([Summed(s, p, square(g[cuts[p - 1] : cuts[p]]), last=False).criteria() for p in range(1, most + 1)]), schema)


def irf(df: DataFrame, columns: list[str], order: str, p: int = 1, horizon: int = 12, method: str = "cholesky", cumulative: bool = False, by: str | None = None) -> DataFrame:
    def f(m):
        a = m.irf(horizon, method)
        return _cube(np.cumsum(a, axis=0) if cumulative else a, columns)

    return per_system(df, columns, order, p, f, CUBE, by)


def fevd(df: DataFrame, columns: list[str], order: str, p: int = 1, horizon: int = 12, method: str = "cholesky", by: str | None = None) -> DataFrame:
    return per_system(df, columns, order, p, lambda m: _cube(m.fevd(horizon, method), columns), CUBE, by)


def historical_decomposition(df: DataFrame, columns: list[str], order: str, p: int = 1, method: str = "cholesky", by: str | None = None) -> DataFrame:
    """order, variable, shock (or initial), value; the values of a variable add up to its data."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        c, base = Var(y, p).historical(method)
        a = np.concatenate((c, base[:, :, None]), axis=2)
        names = [*columns, "initial"]
        k, v, s = a.shape
        return {order: np.repeat(t[p:], v * s), "variable": np.tile(np.repeat(columns, s), k), "shock": np.tile(names, k * v), "value": a.ravel()}

    return per_series(df, columns, order, f, f"{order} {kind}, variable string, shock string, value double", by)


def var_forecast(df: DataFrame, columns: list[str], order: str, p: int = 1, steps: int = 8, level: float = 0.95, by: str | None = None) -> DataFrame:
    z = dist.norm_ppf(0.5 + level / 2)

    def f(v):
        m, s = v.forecast(steps)
        return {"horizon": np.repeat(np.arange(1, steps + 1), len(columns)), "variable": np.tile(columns, steps), "forecast": m.ravel(), "lower": (m - z * s).ravel(), "upper": (m + z * s).ravel()}

    return per_system(df, columns, order, p, f, "horizon int, variable string, forecast double, lower double, upper double", by, last=True)


def granger(df: DataFrame, columns: list[str], order: str, p: int = 1, by: str | None = None) -> DataFrame:
    def f(m):
        out = [(columns[i], columns[j], *m.granger(i, j)) for i in range(m.n) for j in range(m.n) if i != j]
        return dict(zip(("cause", "effect", "statistic", "df1", "df2", "p_value"), zip(*out, strict=True), strict=True))

    return per_system(df, columns, order, p, f, "cause string, effect string, statistic double, df1 int, df2 int, p_value double", by)


def stability(df: DataFrame, columns: list[str], order: str, p: int = 1, by: str | None = None) -> DataFrame:
    return per_system(df, columns, order, p, lambda m: {"root": range(1, len(columns) * p + 1), "modulus": m.roots}, "root int, modulus double", by)


#: Rows of one system that the driver takes; more are an error.
SYSTEM_ROWS = 1_000_000


def system(df: DataFrame, columns: list[str], order: str, most: int = SYSTEM_ROWS) -> np.ndarray:
    """One system's rows, which the model needs together in any case."""
    got = df.dropna(subset=columns).select(order, *columns).limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"a system has {most} rows at most")
    return got.sort_values(order)[columns].to_numpy(float)


def bootstrap_irf(df: DataFrame, columns: list[str], order: str, p: int = 1, horizon: int = 12, replicates: int = 200, level: float = 0.95, seed: int = 1) -> DataFrame:
    """horizon, variable, shock, value, lower, upper by residual bootstrap; replicates are rows."""
    spark = df.sparkSession
    y = system(df, columns, order)
    m = Var(y, p)
    shared = spark.sparkContext.broadcast((y[:p], m.b, m.u - m.u.mean(0)))
    n = len(columns)

    def go(batches):
        first, b, u = shared.value
        for pdf in batches:
            out = []
            for r in pdf.id:
                rng = np.random.default_rng([seed, int(r)])
                e = u[rng.integers(0, len(u), len(u))]
                path = list(first)
                for k in range(len(e)):
                    path.append(b[0] + sum(path[-1 - j] @ b[1 + j * n : 1 + (j + 1) * n] for j in range(p)) + e[k])
                c = _cube(Var(np.array(path), p).irf(horizon), columns)
                out.append(pd.DataFrame(c).assign(id=int(r)))
            if out:
                yield pd.concat(out)[["id", "horizon", "variable", "shock", "value"]]

    draws = spark.range(replicates).mapInPandas(go, "id long, " + CUBE)
    a = (1 - level) / 2
    bands = draws.groupBy("horizon", "variable", "shock").agg(F.percentile("value", a).alias("lower"), F.percentile("value", 1 - a).alias("upper"))
    point = spark.createDataFrame(pd.DataFrame(_cube(m.irf(horizon), columns)), CUBE)
    return point.join(bands, ["horizon", "variable", "shock"])


def sign_restricted_irf(df: DataFrame, columns: list[str], order: str, signs: dict[tuple[str, str], int], p: int = 1, horizon: int = 12, draws: int = 1000, seed: int = 1) -> DataFrame:
    """horizon, variable, shock, median, lower, upper over Haar rotations whose impact has the signs {(variable, shock): +-1}; rotations are rows."""
    spark = df.sparkSession
    m = Var(system(df, columns, order), p)
    shared = spark.sparkContext.broadcast((m.moving_average(horizon), m.impact()))
    at = {c: i for i, c in enumerate(columns)}
    want = [(at[v], at[s], g) for (v, s), g in signs.items()]
    n = len(columns)

    def go(batches):
        phi, chol = shared.value
        for pdf in batches:
            out = []
            for r in pdf.id:
                q, t = np.linalg.qr(np.random.default_rng([seed, int(r)]).normal(size=(n, n)))
                a = chol @ (q * np.sign(np.diag(t)))
                if all(a[v, s] * g > 0 for v, s, g in want):
                    out.append(pd.DataFrame(_cube(phi @ a, columns)))
            if out:
                yield pd.concat(out)

    kept = spark.range(draws).mapInPandas(go, CUBE)
    return kept.groupBy("horizon", "variable", "shock").agg(F.count("*").alias("draws"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.16).alias("lower"), F.percentile("value", 0.84).alias("upper"))


def bvar(df: DataFrame, columns: list[str], order: str, p: int = 1, draws: int = 500, tightness: float = 0.2, seed: int = 1) -> DataFrame:
    """equation, term, mean, sd, lower, upper: normal-inverse-Wishart posterior with Minnesota dummy rows, direct draws as rows."""
    spark = df.sparkSession
    y = system(df, columns, order)
    n = y.shape[1]
    z, x = lag_matrix(y, p)
    s = np.array([math.sqrt((lambda e: e @ e / len(e))(ols(*(lambda q: (q[0][:, 0], q[1]))(lag_matrix(c, p)))[1])) for c in y.T])
    yd, xd = [], []
    for j in range(1, p + 1):
        for i in range(n):
            row = np.zeros(1 + n * p)
            row[1 + (j - 1) * n + i] = s[i] * j / tightness
            xd.append(row)
            yd.append((s[i] / tightness) * np.eye(n)[i] if j == 1 else np.zeros(n))
    for i in range(n):
        xd.append(np.zeros(1 + n * p))
        yd.append(s[i] * np.eye(n)[i])
    z, x = np.vstack([z, yd]), np.vstack([x, xd])
    inv = guarded_inverse(x.T @ x)
    b = inv @ x.T @ z
    e = z - x @ b
    shared = spark.sparkContext.broadcast((b, np.linalg.cholesky(inv), e.T @ e, len(z) - x.shape[1]))
    terms = ["const", *[f"{c}_l{j}" for j in range(1, p + 1) for c in columns]]

    def go(batches):
        b, root, scale, dof = shared.value
        half = np.linalg.cholesky(np.linalg.inv(scale))
        for pdf in batches:
            out = []
            for r in pdf.id:
                rng = np.random.default_rng([seed, int(r)])
                w = half @ rng.normal(size=(len(half), dof))
                sigma = np.linalg.inv(w @ w.T)
                d = b + root @ rng.normal(size=b.shape) @ np.linalg.cholesky(sigma).T
                out.append(pd.DataFrame({"equation": np.tile(columns, len(terms)), "term": np.repeat(terms, len(columns)), "value": d.ravel()}))
            if out:
                yield pd.concat(out)

    got = spark.range(draws).mapInPandas(go, "equation string, term string, value double")
    return got.groupBy("equation", "term").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.percentile("value", 0.05).alias("lower"), F.percentile("value", 0.95).alias("upper"))


def local_projection(df: DataFrame, columns: list[str], shock: str, order: str, horizon: int = 12, lags: int = 4, bandwidth: int | None = None, level: float = 0.95, by: str | None = None) -> DataFrame:
    """horizon 0.., variable, value, std_error, lower, upper: y(t + h) on the shock and lags of all columns; Newey-West, bandwidth h + 1 at least."""
    z = dist.norm_ppf(0.5 + level / 2)
    k = columns.index(shock)
    schema = "horizon int, variable string, value double, std_error double, lower double, upper double"
    if not by:
        n = df.dropna(subset=columns).count()
        width = lambda h, m: min(m - 1, bandwidth if bandwidth is not None else max(h + 1, int(4 * (m / 100) ** (2 / 9))))
        s = Stretches(df, columns, order, lags + max(width(h, n - lags - h) for h in range(horizon + 1)), horizon)
        got = projections(s, k, horizon, lags, width)
        return rows(df.sparkSession, [{"horizon": h, "variable": c, "value": float(b), "std_error": float(e), "lower": float(b - z * e), "upper": float(b + z * e)} for h in range(horizon + 1) for c, (b, e) in zip(columns, got[h], strict=True)], schema)

    def f(t, y):
        out = []
        for h in range(horizon + 1):
            _, x = lag_matrix(y[: len(y) - h], lags)
            x = np.column_stack([y[lags : len(y) - h, k], x])
            bw = bandwidth if bandwidth is not None else max(h + 1, int(4 * (len(x) / 100) ** (2 / 9)))
            for i, c in enumerate(columns):
                b, e, inv = ols(y[lags + h :, i], x)
                se = math.sqrt(newey_west(x, e, inv, bw)[0, 0])
                out.append((h, c, b[0], se, b[0] - z * se, b[0] + z * se))
        return dict(zip(("horizon", "variable", "value", "std_error", "lower", "upper"), zip(*out, strict=True), strict=True))

    return per_series(df, columns, order, f, schema, by)


def local_projection_iv(df: DataFrame, columns: list[str], shock: str, instrument: str, order: str, horizon: int = 12, lags: int = 4, by: str | None = None) -> DataFrame:
    """horizon, variable, value, first_stage_f: the shock instrumented, controls partialled out."""
    k = columns.index(shock)

    def f(t, v):
        y, z = v[:, :-1], v[:, -1]
        out = []
        for h in range(horizon + 1):
            _, w = lag_matrix(y[: len(y) - h], lags)
            part = lambda q: ols(q, w)[1]
            d, m = part(y[lags : len(y) - h, k]), part(z[lags : len(y) - h])
            pi, e, _ = ols(d, m[:, None])
            first = pi[0] ** 2 * (m @ m) / (e @ e / (len(e) - w.shape[1] - 1))
            for i, c in enumerate(columns):
                out.append((h, c, (m @ part(y[lags + h :, i])) / (m @ d), first))
        return dict(zip(("horizon", "variable", "value", "first_stage_f"), zip(*out, strict=True), strict=True))

    return per_series(df, [*columns, instrument], order, f, "horizon int, variable string, value double, first_stage_f double", by)


#: Osterwald-Lenum (1992) with an unrestricted constant, trace at 5 % for 1..5 common trends.
TRACE_5 = (3.76, 15.41, 29.68, 47.21, 68.52)


def johansen(df: DataFrame, columns: list[str], order: str, p: int = 2, by: str | None = None) -> DataFrame:
    """rank, eigenvalue, trace, max_eigen, trace_cv_5; p lags in levels, unrestricted constant."""
    n, schema = len(columns), "rank int, eigenvalue double, trace double, max_eigen double, trace_cv_5 double"

    def told(s00, s11, s01, m):
        w = np.sort(np.linalg.eigvals(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01))).real)[::-1]
        w = np.clip(w, 0, 1 - 1e-15)
        lr = -m * np.log(1 - w)
        return {"rank": range(n), "eigenvalue": w, "trace": [lr[r:].sum() for r in range(n)], "max_eigen": lr, "trace_cv_5": [TRACE_5[n - r - 1] if n - r <= 5 else None for r in range(n)]}

    def f(t, y):
        d = np.diff(y, axis=0)
        z0, z1 = d[p - 1 :], y[p - 1 : -1]
        x = np.hstack([np.ones((len(z0), 1)), *[d[p - 1 - j : len(d) - j] for j in range(1, p)]])
        r0, r1 = z0 - x @ np.linalg.lstsq(x, z0, rcond=None)[0], z1 - x @ np.linalg.lstsq(x, z1, rcond=None)[0]
        m = len(z0)
        return told(r0.T @ r0 / m, r1.T @ r1 / m, r0.T @ r1 / m, m)

    if by:
        return per_series(df, columns, order, f, schema, by)
    return _frame(df.sparkSession, told(*cointegration(Stretches(df, columns, order, p), p)), schema)


def engle_granger(df: DataFrame, y: str, x: list[str], order: str, lags: int = 1, by: str | None = None) -> DataFrame:
    """term, estimate of the long-run regression, and the residual ADF t as term adf_t."""
    from .series import adf

    def f(t, v):
        b, e, _ = ols(v[:, 0], np.column_stack([np.ones(len(v)), v[:, 1:]]))
        return {"term": ["const", *x, "adf_t"], "estimate": [*b, adf(e, lags, "none")[0]]}

    if by:
        return per_series(df, [y, *x], order, f, "term string, estimate double", by)
    s = Stretches(df, [y, *x], order, lags + 2)
    b = regress(square(s.sums(lambda z, place, own: products(z[own]))), [0], list(range(1, 1 + len(x))))[0][:, 0]
    t = dickey_fuller(s, 0, lags, "none", combine=np.concatenate(([1.0], -b)))[0]
    slope = b * s.sd[0] / s.sd[1:]
    return _frame(df.sparkSession, {"term": ["const", *x, "adf_t"], "estimate": [s.mean[0] - slope @ s.mean[1:], *slope, t]}, "term string, estimate double")


def cointegrating_regression(df: DataFrame, y: str, x: list[str], order: str, method: str = "fmols", leads: int = 1, by: str | None = None) -> DataFrame:
    """term, estimate, std_error by fmols or dols with a constant."""
    from .series import long_run_covariance

    def f(t, v):
        yy, xx = v[:, 0], v[:, 1:]
        if method == "dols":
            d = np.diff(xx, axis=0)
            n = len(d)
            keep = slice(leads, n - leads)
            z = np.hstack([np.ones((n - 2 * leads, 1)), xx[1:][keep], *[d[leads + j : n - leads + j] for j in range(-leads, leads + 1)]])
            b, e, inv = ols(yy[1:][keep], z)
            om = long_run_covariance(e)[0, 0]
            k = 1 + xx.shape[1]
            return {"term": ["const", *x], "estimate": b[:k], "std_error": np.sqrt(om * np.diag(inv)[:k])}
        z = np.column_stack([np.ones(len(yy)), xx])
        e = ols(yy, z)[1][1:]
        u = np.column_stack([e, np.diff(xx, axis=0)])
        u = u - np.concatenate(([0.0], u[:, 1:].mean(0)))
        n = len(u)
        from .series import andrews_bandwidth, kernel_weight

        bw = andrews_bandwidth(u)
        om = long_run_covariance(u, bw, demean=False)
        last = min(n - 1, int(bw))
        one = u.T @ u / n + sum((w * u[j:].T @ u[:-j] / n).T for j, w in zip(range(1, last + 1), kernel_weight(np.arange(1, last + 1), bw, "bartlett"), strict=True))
        o22 = np.linalg.inv(om[1:, 1:])
        plus = yy[1:] - u[:, 1:] @ o22 @ om[1:, 0]
        bias = one[1:, 0] - one[1:, 1:] @ o22 @ om[1:, 0]
        zt = z[1:]
        inv = guarded_inverse(zt.T @ zt)
        b = inv @ (zt.T @ plus - n * np.concatenate(([0.0], bias)))
        om_u = om[0, 0] - om[0, 1:] @ o22 @ om[1:, 0]
        return {"term": ["const", *x], "estimate": b, "std_error": np.sqrt(om_u * np.diag(inv))}

    return per_series(df, [y, *x], order, f, "term string, estimate double, std_error double", by)


def ardl(df: DataFrame, y: str, x: list[str], order: str, p: int = 1, q: int = 1, by: str | None = None) -> DataFrame:
    """term, estimate, std_error of an ARDL(p, q..), long-run multipliers (lr_*), and the bounds F (bounds_f)."""
    names = ["const", *[f"{y}_l{j}" for j in range(1, p + 1)], *[f"{c}_l{j}" for c in x for j in range(q + 1)]]
    k, most = 1 + len(x), max(p, q)

    def designs(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """y and the regressors with levels; its difference and those of differences only."""
        one = np.ones((len(at), 1))
        own = np.hstack([v[at, :1], one, lag_columns(v[:, :1], at, range(1, p + 1)), *[lag_columns(v[:, i : i + 1], at, range(q + 1)) for i in range(1, k)]])
        d = np.vstack([np.zeros((1, k)), np.diff(v, axis=0)])
        return own, np.hstack([d[at, :1], one, lag_columns(d[:, :1], at, range(1, p)), *[lag_columns(d[:, i : i + 1], at, range(q)) for i in range(1, k)]])

    def told(b, inv, rss, rss0, n):
        s2 = rss / (n - len(b))
        gap = 1 - b[1 : 1 + p].sum()
        lr = [b[1 + p + i * (q + 1) : 1 + p + (i + 1) * (q + 1)].sum() / gap for i in range(len(x))]
        ser = []
        for i, r in enumerate(lr):
            g = np.zeros(len(b))
            g[1 : 1 + p] = r / gap
            g[1 + p + i * (q + 1) : 1 + p + (i + 1) * (q + 1)] = 1 / gap
            ser.append(math.sqrt(s2 * g @ inv @ g))
        return {"term": [*names, *[f"lr_{c}" for c in x], "bounds_f"], "estimate": [*b, *lr, (rss0 - rss) / k / s2], "std_error": [*np.sqrt(s2 * np.diag(inv)), *ser, None]}

    def f(t, v):
        own, short = designs(v, np.arange(most, len(v)))
        b, e, inv = ols(own[:, 0], own[:, 1:])
        r0 = ols(short[:, 0], short[:, 1:])[1]
        return told(b, inv, e @ e, r0 @ r0, len(own))

    if by:
        return per_series(df, [y, *x], order, f, "term string, estimate double, std_error double", by)
    s = Stretches(df, [y, *x], order, most + 1)

    def both(z, place, own):
        a, c = designs(z, own[place[own] > most])
        return np.concatenate([products(a), products(c)])

    g, width = s.sums(both), 1 + len(names)
    g, short = square(g[: width * width]), square(g[width * width :])
    b, inv, rss = regress(g, [0], list(range(1, width)))
    of = [*[0] * p, *[i for i in range(1, k) for _ in range(q + 1)]]
    b, inv = unscaled(b, inv, s.mean[:1], s.sd[:1], s.mean[of], s.sd[of])
    rss0 = regress(short, [0], list(range(1, len(short))))[2][0, 0]
    return _frame(df.sparkSession, told(b[:, 0], inv, rss[0, 0] * s.sd[0] ** 2, rss0 * s.sd[0] ** 2, s.n - most), "term string, estimate double, std_error double")


def principal_factors(df: DataFrame, columns: list[str], r: int = 1) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Loadings, eigenvalue shares and the factors as columns f1.. beside the rows; moments come from one Gram aggregate."""
    from ..plans.gram import Moments

    df = df.dropna(subset=columns)
    m = Moments.of(df, columns)
    mean = m.sub(columns, ["const"])[:, 0] / m.n
    s = m.sub(columns) / m.n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(s))
    w, v = np.linalg.eigh(s / np.outer(sd, sd))
    w, v = w[::-1], v[:, ::-1]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(len(w))] < 0, -1, 1)
    load = v[:, :r] * np.sqrt(w[:r])
    out = df
    for j in range(r):
        f = F.lit(0.0)
        for i, c in enumerate(columns):
            f = f + (F.col(c) - float(mean[i])) * float(v[i, j] / sd[i] / math.sqrt(w[j]))
        out = out.withColumn(f"f{j + 1}", f)
    return load, w / w.sum(), out


def factor_summary(df: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """factors, share, cumulative, ic1, ic2, ic3 (Bai and Ng, 2002)."""
    _, share, _ = principal_factors(df, columns, 1)
    t, n = df.dropna(subset=columns).count(), len(columns)
    out = []
    c2 = min(n, t)
    for r in range(1, most + 1):
        v = math.log(max(1e-300, 1 - share[:r].sum()))
        g = (n + t) / (n * t)
        out.append({"factors": r, "share": float(share[r - 1]), "cumulative": float(share[:r].sum()), "ic1": v + r * g * math.log(1 / g), "ic2": v + r * g * math.log(c2), "ic3": v + r * math.log(c2) / c2})
    return rows(df.sparkSession, out, "factors int, share double, cumulative double, ic1 double, ic2 double, ic3 double")


def seemingly_unrelated(df: DataFrame, equations: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """equation, term, estimate, std_error: feasible GLS from one Gram aggregate over all columns."""
    from ..plans.gram import Moments

    names = sorted({c for y, x in equations.values() for c in [y, *x]})
    df = df.dropna(subset=names)
    m = Moments.of(df, names)
    eqs = list(equations.items())
    xs = [["const", *x] for _, (_, x) in eqs]
    bs = [m.solve(y, x)[0] for (_, (y, _)), x in zip(eqs, xs, strict=True)]
    k = len(eqs)
    s = np.zeros((k, k))
    for i in range(k):
        for j in range(k):
            yi, yj = eqs[i][1][0], eqs[j][1][0]
            s[i, j] = (m.sub([yi], [yj])[0, 0] - bs[i] @ m.sub(xs[i], [yj])[:, 0] - bs[j] @ m.sub(xs[j], [yi])[:, 0] + bs[i] @ m.sub(xs[i], xs[j]) @ bs[j]) / m.n
    w = np.linalg.inv(s)
    a = np.block([[w[i, j] * m.sub(xs[i], xs[j]) for j in range(k)] for i in range(k)])
    c = np.concatenate([sum(w[i, j] * m.sub(xs[i], [eqs[j][1][0]])[:, 0] for j in range(k)) for i in range(k)])
    inv = guarded_inverse(a)
    b = inv @ c
    se = np.sqrt(np.diag(inv))
    out, at = [], 0
    for (name, _), x in zip(eqs, xs, strict=True):
        for t in x:
            out.append({"equation": name, "term": t, "estimate": float(b[at]), "std_error": float(se[at])})
            at += 1
    return rows(df.sparkSession, out, "equation string, term string, estimate double, std_error double")
