"""Generalised and simulated method of moments, bound transforms, and what follows a panel autoregression.

Moment functions take an array of rows and give a row of moments each; a
sample is one kernel. Panel autoregressions are solved from sums over units.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.linalg import companion, guarded_inverse
from .describe import rows
from .further import _unit_sums
from .kernels import per_series, tidy
from .series import long_run_covariance, nelder_mead
from .transforms import demean, panel_shift

Moments = Callable[[np.ndarray, np.ndarray], np.ndarray]


# -- bounds -------------------------------------------------------------------


class Bounds:
    """Parameters with lower and upper limits (None for none) as free numbers and back."""

    def __init__(self, lower: list, upper: list):
        self.lower = np.array([-math.inf if v is None else v for v in lower], float)
        self.upper = np.array([math.inf if v is None else v for v in upper], float)

    def _kinds(self):
        low, high = np.isfinite(self.lower), np.isfinite(self.upper)
        return low & high, low & ~high, ~low & high

    def free(self, theta: np.ndarray) -> np.ndarray:
        out = np.array(theta, float)
        both, low, high = self._kinds()
        s = (out[both] - self.lower[both]) / (self.upper[both] - self.lower[both])
        out[both] = np.log(s / (1 - s))
        out[low] = np.log(out[low] - self.lower[low])
        out[high] = np.log(self.upper[high] - out[high])
        return out

    def bound(self, phi: np.ndarray) -> np.ndarray:
        out = np.array(phi, float)
        both, low, high = self._kinds()
        out[both] = self.lower[both] + (self.upper[both] - self.lower[both]) / (1 + np.exp(-out[both]))
        out[low] = self.lower[low] + np.exp(out[low])
        out[high] = self.upper[high] - np.exp(out[high])
        return out

    def slopes(self, phi: np.ndarray) -> np.ndarray:
        """Diagonal of the derivative of bound()."""
        out = np.ones(len(phi))
        both, low, high = self._kinds()
        s = 1 / (1 + np.exp(-phi[both]))
        out[both] = (self.upper[both] - self.lower[both]) * s * (1 - s)
        out[low] = np.exp(phi[low])
        out[high] = -np.exp(phi[high])
        return out

    def log_slopes(self, phi: np.ndarray) -> float:
        return float(np.log(np.abs(self.slopes(phi))).sum())


def numerical_gradient(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float = 1e-6) -> np.ndarray:
    """Central differences; a column a parameter."""
    cols = []
    for k in range(len(x)):
        d = np.zeros(len(x))
        d[k] = step * max(1.0, abs(x[k]))
        cols.append((np.asarray(f(x + d)) - np.asarray(f(x - d))) / (2 * d[k]))
    return np.column_stack([np.atleast_1d(c) for c in cols])


# -- generalised --------------------------------------------------------------


def weighting(g: np.ndarray, hac: bool = True) -> np.ndarray:
    """Inverse long-run covariance of the moments."""
    s = long_run_covariance(g) if hac else (g - g.mean(0)).T @ (g - g.mean(0)) / len(g)
    return guarded_inverse(s)


def objective(theta: np.ndarray, f: Moments, data: np.ndarray, w: np.ndarray) -> float:
    m = f(theta, data).mean(0)
    return float(m @ w @ m)


def gmm(f: Moments, start: np.ndarray, data: np.ndarray, steps: str = "two_step", hac: bool = True, bounds: Bounds | None = None, maxiter: int = 100, tol: float = 1e-8) -> dict:
    """identity, two_step or iterated weighting; Gauss-Newton with a simplex at the start. theta, cov, j, j_p, objective."""
    n = len(data)
    q = f(np.asarray(start, float), data).shape[1]
    if q < len(start):
        raise ValueError("fewer moments than parameters")
    b = bounds or Bounds([None] * len(start), [None] * len(start))
    phi, w = b.free(np.asarray(start, float)), np.eye(q)
    mean = lambda x: f(b.bound(x), data).mean(0)
    for turn in range({"identity": 1, "two_step": 2, "iterated": maxiter}[steps]):
        before = phi
        phi = nelder_mead(lambda x, w=w: float(mean(x) @ w @ mean(x)), phi, 0.2, 300 * len(phi)) if not turn else phi
        for _ in range(maxiter):
            g, d = mean(phi), numerical_gradient(mean, phi)
            move = guarded_inverse(d.T @ w @ d) @ d.T @ w @ g
            size = 1.0
            while size > 1e-6 and (lambda m: m @ w @ m)(mean(phi - size * move)) > g @ w @ g:
                size /= 2
            phi = phi - size * move
            if np.abs(size * move).max() < tol:
                break
        if turn and np.abs(phi - before).max() < tol:
            break
        if steps != "identity":
            w = weighting(f(b.bound(phi), data), hac)
    theta = b.bound(phi)
    g = f(theta, data)
    d = numerical_gradient(lambda x: f(x, data).mean(0), theta)
    s = guarded_inverse(weighting(g, hac))
    a = guarded_inverse(d.T @ w @ d)
    cov = a @ d.T @ w @ s @ w @ d @ a / n
    m = g.mean(0)
    j = float(n * m @ guarded_inverse(s) @ m)
    return {"theta": theta, "cov": cov, "j": j, "df": q - len(theta), "j_p": dist.chi2_sf(j, q - len(theta)) if q > len(theta) else float("nan"), "objective": float(m @ w @ m), "moments": m, "n": n}


def selection_criteria(j: float, moments: int, parameters: int, n: int, q: float = 2.1) -> dict[str, float]:
    """Andrews and Lu: j less a penalty for moments beyond parameters."""
    c = moments - parameters
    return {"bic": j - c * math.log(n), "aic": j - 2 * c, "hqic": j - q * c * math.log(math.log(n))}


def estimate(df: DataFrame, columns: list[str], order: str, f: Moments, names: list[str], start: list[float], steps: str = "two_step", hac: bool = True, bounds: Bounds | None = None, by: str | None = None) -> DataFrame:
    """term, estimate, std_error; with j, j_p and the selection criteria as terms."""

    def go(t, v):
        m = gmm(f, np.array(start), v, steps, hac, bounds)
        c = selection_criteria(m["j"], m["df"] + len(names), len(names), m["n"])
        return tidy(("term", "estimate", "std_error"), [*zip(names, m["theta"], np.sqrt(np.maximum(np.diag(m["cov"]), 0)), strict=True), ("j", m["j"], None), ("j_p", m["j_p"], None), *[(f"mmsc_{k}", x, None) for k, x in c.items()]])

    return per_series(df, columns, order, go, "term string, estimate double, std_error double", by)


def linear_solve(zx: np.ndarray, zy: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Coefficients from cross products of instruments with regressors and outcome."""
    return guarded_inverse(zx.T @ w @ zx) @ zx.T @ w @ zy


def sandwich(zx: np.ndarray, w: np.ndarray, d: np.ndarray) -> np.ndarray:
    a = guarded_inverse(zx.T @ w @ zx)
    return a @ zx.T @ w @ d @ w @ zx @ a


# -- simulated ----------------------------------------------------------------


def autocovariance_contributions(y: np.ndarray, lags: int = 1) -> np.ndarray:
    """A row a time: levels, then products of deviations at lags 0.., each variable pair's lower triangle at lag 0 and own lags beyond."""
    y = y.reshape(len(y), -1)
    z = y - y.mean(0)
    k = y.shape[1]
    out = [y[lags:]]
    out += [(z[lags:, i] * z[lags:, j])[:, None] for i in range(k) for j in range(i + 1)]
    out += [(z[lags:, i] * z[lags - h : len(z) - h, i])[:, None] for h in range(1, lags + 1) for i in range(k)]
    return np.hstack(out)


def autocovariance_moments(y: np.ndarray, lags: int = 1) -> np.ndarray:
    return autocovariance_contributions(y, lags).mean(0)


def smm(simulate: Callable[[np.ndarray, int, np.random.Generator], np.ndarray], start: np.ndarray, data: np.ndarray, moments=autocovariance_contributions, ratio: int = 5, burn: int = 100, bounds: Bounds | None = None, seed: int = 1) -> dict:
    """Two steps: identity weights, then the data moments' inverse covariance. simulate(theta, rows, rng) gives data of the same shape."""
    n, own = len(data), moments(data)
    target = own.mean(0)
    b = bounds or Bounds([None] * len(start), [None] * len(start))

    def gap(x):
        sim = simulate(b.bound(x), ratio * n + burn, np.random.default_rng(seed))[burn:]
        return moments(sim).mean(0) - target

    w, phi = np.diag(1 / np.maximum(own.var(0), 1e-12)), b.free(np.asarray(start, float))
    for _ in range(2):
        phi = nelder_mead(lambda x, w=w: float((lambda g: g @ w @ g)(gap(x))), phi, 0.2, 200 * len(phi))
        w = weighting(own)
    d = numerical_gradient(lambda t: gap(b.free(t)), b.bound(phi), 1e-3)
    cov = (1 + 1 / ratio) * guarded_inverse(d.T @ w @ d) / n
    g = gap(phi)
    j = float(n * ratio / (1 + ratio) * g @ w @ g)
    df = len(target) - len(phi)
    return {"theta": b.bound(phi), "cov": cov, "j": j, "df": df, "j_p": dist.chi2_sf(j, df) if df > 0 else float("nan")}


def estimate_simulated(df: DataFrame, columns: list[str], order: str, simulate, names: list[str], start: list[float], bounds: Bounds | None = None, lags: int = 1, seed: int = 1, by: str | None = None) -> DataFrame:
    """term, estimate, std_error; with j and j_p as terms."""

    def go(t, v):
        m = smm(simulate, np.array(start), v, lambda y: autocovariance_contributions(y, lags), bounds=bounds, seed=seed)
        return tidy(("term", "estimate", "std_error"), [*zip(names, m["theta"], np.sqrt(np.maximum(np.diag(m["cov"]), 0)), strict=True), ("j", m["j"], None), ("j_p", m["j_p"], None)])

    return per_series(df, columns, order, go, "term string, estimate double, std_error double", by)


def simulate_autoregression(theta: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Mean, coefficient, spread."""
    e = rng.normal(size=n) * theta[2]
    y = np.empty(n)
    y[0] = theta[0]
    for k in range(1, n):
        y[k] = theta[0] + theta[1] * (y[k - 1] - theta[0]) + e[k]
    return y[:, None]


# -- panel autoregressions -----------------------------------------------------


class PanelVar:
    """Coefficients (lag by lag) and residual covariance of a panel autoregression: within least squares, or differences or forward deviations with collapsed instruments in one, two or more steps, with level moments (system) if asked."""

    def __init__(self, df: DataFrame, columns: list[str], unit: str, time: str, p: int = 1, method: str = "within", window: int = 3, steps: int = 2, system: bool = False):
        self.columns, self.p, self.k = columns, p, len(columns)
        self.spark, k = df.sparkSession, len(columns)
        self.j = self.j_df = self.m = None
        if method == "within":
            names = [f"{c}_l{j}" for j in range(1, p + 1) for c in columns]
            d = df.select(unit, time, *[F.col(c).cast("double").alias(c) for c in columns])
            d = d.withColumns({f"{c}_l{j}": panel_shift(d, c, j, unit, time) for j in range(1, p + 1) for c in columns}).dropna()
            from ..plans.gram import Moments as Gram

            g = Gram.of(demean(d, [*columns, *names], [unit]), [*columns, *names])
            self.b = np.column_stack([g.solve(c, names)[0] for c in columns])
            yy, xy, xx = g.sub(columns), g.sub(names, columns), g.sub(names)
            units = d.select(F.count_distinct(unit)).first()[0]
            self.n = g.n
            self.sigma = (yy - self.b.T @ xy - xy.T @ self.b + self.b.T @ xx @ self.b) / (g.n - units - k * p)
            return

        def parts(t, v):
            """Transformed left sides, regressors and instruments of a unit."""
            at = {int(x): i for i, x in enumerate(t)}
            ys, xs, zs = [], [], []
            for x, i in at.items():
                if method == "fd":
                    ok = all(x - j in at for j in range(1, p + 2))
                    if ok:
                        ys.append(v[i] - v[at[x - 1]])
                        xs.append(np.concatenate([v[at[x - j]] - v[at[x - j - 1]] for j in range(1, p + 1)]))
                else:
                    ok = all(x - j in at for j in range(1, p + 1)) and any(y > x and all(y - j in at for j in range(1, p + 1)) for y in at)
                    if ok:
                        later = [y for y in at if y > x and all(y - j in at for j in range(1, p + 1))]
                        s = math.sqrt(len(later) / (len(later) + 1))
                        ys.append(s * (v[i] - np.mean([v[at[y]] for y in later], axis=0)))
                        xs.append(s * np.concatenate([v[at[x - j]] - np.mean([v[at[y - j]] for y in later], axis=0) for j in range(1, p + 1)]))
                if ok:
                    first = 2 if method == "fd" else 1
                    z = [v[at[x - l]] if x - l in at else np.zeros(k) for l in range(first, first + window)]  # noqa: E741
                    zs.append(np.concatenate([*z, *([np.zeros(k)] if system else [])]))
                if system and all(x - j in at for j in range(1, p + 2)):
                    ys.append(v[i])
                    xs.append(np.concatenate([v[at[x - j]] for j in range(1, p + 1)]))
                    zs.append(np.concatenate([np.zeros(k * window), v[at[x - 1]] - v[at[x - 2]]]))
            return np.array(ys), np.array(xs), np.array(zs)

        m, x = k * (window + (1 if system else 0)), k * p

        def first(t, v):
            ys, xs, zs = parts(t, v)
            if not len(ys):
                return np.zeros(m * x + m * k + m * m + 2)
            h = zs.T @ zs
            if method == "fd" and len(zs) > 1:  # neighbouring differences share a shock
                h = 2 * h - zs[1:].T @ zs[:-1] - zs[:-1].T @ zs[1:]
            return np.concatenate(((zs.T @ xs).ravel(), (zs.T @ ys).ravel(), h.ravel(), [len(ys), 1.0]))

        s = _unit_sums(df, columns, time, unit, first)
        zx, zy, h = s[: m * x].reshape(m, x), s[m * x : m * x + m * k].reshape(m, k), s[m * x + m * k : m * x + m * k + m * m].reshape(m, m)
        self.n, self.units, self.m, self.zx, self.zy = int(s[-2]), int(s[-1]), m, zx, zy
        w = np.kron(np.eye(k), guarded_inverse(h))
        big, left = np.kron(np.eye(k), zx), zy.T.ravel()
        b = linear_solve(big, left, w)
        for _ in range(max(1, steps)):
            coef = b.reshape(k, x).T

            def second(t, v, coef=coef):
                ys, xs, zs = parts(t, v)
                if not len(ys):
                    return np.zeros((m * k) ** 2 + k * k)
                e = ys - xs @ coef
                g = (zs.T @ e).T.ravel()
                return np.concatenate((np.outer(g, g).ravel(), (e.T @ e).ravel()))

            s = _unit_sums(df, columns, time, unit, second)
            omega, ee = s[: (m * k) ** 2].reshape(m * k, m * k), s[(m * k) ** 2 :].reshape(k, k)
            if steps == 1:
                break
            w = guarded_inverse(omega)
            b = linear_solve(big, left, w)
        self.b = b.reshape(k, x).T
        self.cov = sandwich(big, w, omega)
        g = left - big @ b
        self.j, self.j_df = float(g @ guarded_inverse(omega) @ g), m * k - x * k
        self.sigma = ee / self.n / (2 if method == "fd" else 1)

    def moving_average(self, horizon: int) -> np.ndarray:
        k = self.k
        a = [self.b[j * k : (j + 1) * k].T for j in range(self.p)]
        out = [np.eye(k)]
        for h in range(1, horizon):
            out.append(sum(out[h - 1 - j] @ a[j] for j in range(min(self.p, h))))
        return np.array(out)

    def responses(self, horizon: int, kind: str = "oirf") -> np.ndarray:
        """Orthogonal, or generalised (each shock in its own spread)."""
        phi = self.moving_average(horizon)
        return phi @ np.linalg.cholesky(self.sigma) if kind == "oirf" else phi @ self.sigma / np.sqrt(np.diag(self.sigma))

    def shares(self, horizon: int) -> np.ndarray:
        s = np.cumsum(self.responses(horizon) ** 2, axis=0)
        return s / s.sum(2, keepdims=True)

    @property
    def roots(self) -> np.ndarray:
        b = np.vstack([np.zeros((1, self.k)), self.b])
        return np.sort(np.abs(np.linalg.eigvals(companion(b, self.k, self.p))))[::-1]


def panel_coefficients(m: PanelVar) -> DataFrame:
    """equation, term, estimate, std_error (null for within)."""
    names = [f"{c}_l{j}" for j in range(1, m.p + 1) for c in m.columns]
    se = np.sqrt(np.maximum(np.diag(m.cov), 0)).reshape(m.k, -1).T if hasattr(m, "cov") else None
    return rows(m.spark, [{"equation": c, "term": t, "estimate": float(m.b[i, j]), "std_error": None if se is None else float(se[i, j])} for j, c in enumerate(m.columns) for i, t in enumerate(names)], "equation string, term string, estimate double, std_error double")


def panel_cube(m: PanelVar, what: str = "oirf", horizon: int = 8) -> DataFrame:
    """horizon, variable, shock, value: oirf, girf or fevd."""
    a = m.shares(horizon) if what == "fevd" else m.responses(horizon, what)
    return rows(m.spark, [{"horizon": h, "variable": m.columns[i], "shock": m.columns[j], "value": float(a[h, i, j])} for h in range(horizon) for i in range(m.k) for j in range(m.k)], "horizon int, variable string, shock string, value double")


def panel_stability(m: PanelVar) -> DataFrame:
    return rows(m.spark, [{"root": i + 1, "modulus": float(v)} for i, v in enumerate(m.roots)], "root int, modulus double")


def panel_tests(m: PanelVar) -> DataFrame:
    """statistic, value: Hansen's j, its df and p value, and the selection criteria."""
    if m.j is None:
        raise ValueError("only moment estimates have over-identifying restrictions")
    c = selection_criteria(m.j, m.m * m.k, m.k * m.k * m.p, m.n)
    got = {"j": m.j, "df": float(m.j_df), "p_value": dist.chi2_sf(m.j, m.j_df) if m.j_df > 0 else float("nan"), **{f"mmsc_{k}": v for k, v in c.items()}}
    return rows(m.spark, [{"statistic": k, "value": float(v)} for k, v in got.items()], "statistic string, value double")


def panel_lag_selection(df: DataFrame, columns: list[str], unit: str, time: str, most: int = 3, window: int = 4) -> DataFrame:
    """p, j, j_p, bic, aic, hqic by difference moments."""
    out = []
    for p in range(1, most + 1):
        m = PanelVar(df, columns, unit, time, p, "fd", window + p - 1)
        c = selection_criteria(m.j, m.m * m.k, m.k * m.k * p, m.n)
        out.append({"p": p, "j": m.j, "j_p": dist.chi2_sf(m.j, m.j_df) if m.j_df > 0 else None, **c})
    return rows(df.sparkSession, out, "p int, j double, j_p double, bic double, aic double, hqic double")


def panel_bootstrap(df: DataFrame, columns: list[str], unit: str, time: str, p: int = 1, horizon: int = 6, draws: int = 50, level: float = 0.95, seed: int = 1) -> DataFrame:
    """horizon, variable, shock, value, lower, upper: units drawn with replacement, within estimates from the units' cross products.

    A replicate is a row: it weights the units' products, which are one small matrix a unit.
    """
    spark, k = df.sparkSession, len(columns)
    names = [f"{c}_l{j}" for j in range(1, p + 1) for c in columns]
    d = df.select(unit, time, *[F.col(c).cast("double").alias(c) for c in columns])
    d = d.withColumns({f"{c}_l{j}": panel_shift(d, c, j, unit, time) for j in range(1, p + 1) for c in columns}).dropna()
    d = demean(d, [*columns, *names], [unit])
    w = [*columns, *names]
    g = d.groupBy(unit).agg(F.count("*").cast("double").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(w) for j, b in enumerate(w) if j <= i])
    pairs = [(i, j) for i in range(len(w)) for j in range(i + 1)]
    # Poisson weights of a replicate are drawn where the unit's products lie, and summed by replicate.
    draw = g.select(F.posexplode(F.sequence(F.lit(0), F.lit(draws))).alias("_p", "draw"), unit, "n", *[f"s{i}_{j}" for i, j in pairs])

    def weigh(batches):
        for pdf in batches:
            u = pd.util.hash_array(pdf[unit].astype(str).to_numpy())
            c = [1 if r == 0 else np.random.default_rng([seed, int(r), int(h % (1 << 32))]).poisson(1.0) for r, h in zip(pdf.draw, u, strict=True)]
            out = pdf[["draw", "n", *[f"s{i}_{j}" for i, j in pairs]]].copy()
            for q in out.columns[1:]:
                out[q] = out[q] * c
            yield out.groupby("draw", as_index=False).sum()

    cols = ", ".join(["draw int", "n double", *[f"s{i}_{j} double" for i, j in pairs]])
    sums = draw.drop("_p").mapInPandas(weigh, cols).groupBy("draw").agg(*[F.sum(q).alias(q) for q in ["n", *[f"s{i}_{j}" for i, j in pairs]]])

    def respond(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                m = np.zeros((len(w), len(w)))
                for (i, j), v in zip(pairs, r[2:], strict=True):
                    m[i, j] = m[j, i] = v
                b = guarded_inverse(m[k:, k:]) @ m[k:, :k]
                one = PanelVar.__new__(PanelVar)
                one.b, one.k, one.p = b, k, p
                one.sigma = (m[:k, :k] - b.T @ m[k:, :k]) / r[1] + 1e-12 * np.eye(k)
                a = one.responses(horizon)
                out += [(int(r[0]), h, columns[i], columns[j], float(a[h, i, j])) for h in range(horizon) for i in range(k) for j in range(k)]
            yield pd.DataFrame(out, columns=["draw", "horizon", "variable", "shock", "value"])

    got = sums.mapInPandas(respond, "draw int, horizon int, variable string, shock string, value double")
    a = (1 - level) / 2
    keys = ["horizon", "variable", "shock"]
    bands = got.where("draw > 0").groupBy(*keys).agg(F.percentile("value", a).alias("lower"), F.percentile("value", 1 - a).alias("upper"))
    return got.where("draw = 0").drop("draw").join(bands, keys)


def serial_correlation(df: DataFrame, columns: list[str], unit: str, time: str, p: int = 1, order: int = 2, window: int = 3) -> DataFrame:
    """order, statistic, p_value of residual autocovariances in differences, from sums over units (first equation)."""
    m = PanelVar(df, columns, unit, time, p, "fd", window)
    coef = m.b

    def f(t, v):
        at = {int(x): i for i, x in enumerate(t)}
        e = {}
        for x, i in at.items():
            if all(x - j in at for j in range(1, p + 2)):
                r = np.concatenate([v[at[x - j]] - v[at[x - j - 1]] for j in range(1, p + 1)])
                e[x] = float((v[i] - v[at[x - 1]] - r @ coef)[0])
        out = []
        for o in range(1, order + 1):
            c = sum(e[x] * e[x - o] for x in e if x - o in e)
            out += [c, c * c]
        return np.array(out)

    s = _unit_sums(df, columns, time, unit, f)
    out = []
    for o in range(1, order + 1):
        z = s[2 * o - 2] / math.sqrt(s[2 * o - 1])
        out.append({"order": o, "statistic": float(z), "p_value": float(2 * (1 - dist.norm_cdf(abs(z))))})
    return rows(df.sparkSession, out, "order int, statistic double, p_value double")
