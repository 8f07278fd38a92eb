"""More of local projections: several shocks, orthogonal shocks, smoothing, states, treatment, forecasts, variance shares."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions import dist
from ..functions.linalg import guarded_inverse, ols
from ..functions.linalg import lags as lag_matrix
from .kernels import per_series, tidy
from .multivariate import Var
from .series import nelder_mead, newey_west

RESPONSE = "horizon int, variable string, value double, std_error double, lower double, upper double"


def automatic_bandwidth(h: int, n: int) -> int:
    return max(h + 1, int(4 * (n / 100) ** (2 / 9)))


def project(y: np.ndarray, target: np.ndarray, shock: np.ndarray, h: int, lags: int, bandwidth: int | None = None, controls: np.ndarray | None = None):
    """Coefficients, covariance, residuals and design of target(t + h) on the shock, a constant, lags of y and controls; the shock comes first."""
    n = len(y)
    _, x = lag_matrix(y[: n - h], lags)
    cols = [shock[lags : n - h].reshape(len(x), -1), x] + ([controls[lags : n - h]] if controls is not None else [])
    x = np.hstack(cols)
    b, e, inv = ols(target[lags + h :], x)
    return b, newey_west(x, e, inv, bandwidth if bandwidth is not None else automatic_bandwidth(h, len(x))), e, x


def _band(b: float, se: float, z: float) -> tuple:
    return b, se, b - z * se, b + z * se


def several_shocks(df: DataFrame, columns: list[str], shocks: list[str], order: str, horizon: int = 12, lags: int = 4, level: float = 0.95, by: str | None = None) -> DataFrame:
    """shock, horizon, variable, value, std_error, lower, upper: one projection a shock."""
    z = dist.norm_ppf(0.5 + level / 2)

    def f(t, y):
        out = []
        for s in shocks:
            for h in range(horizon + 1):
                for i, c in enumerate(columns):
                    b, v, _, _ = project(y, y[:, i], y[:, columns.index(s)], h, lags)
                    out.append((s, h, c, *_band(b[0], math.sqrt(v[0, 0]), z)))
        return tidy(("shock", "horizon", "variable", "value", "std_error", "lower", "upper"), out)

    return per_series(df, columns, order, f, "shock string, " + RESPONSE, by)


def orthogonal_shocks(y: np.ndarray, p: int) -> np.ndarray:
    """Recursive shocks of an autoregression, NaN in the first p rows."""
    return np.vstack([np.full((p, y.shape[1]), np.nan), Var(y, p).shocks()])


def structural(df: DataFrame, columns: list[str], order: str, horizon: int = 12, lags: int = 4, p: int | None = None, level: float = 0.95, by: str | None = None) -> DataFrame:
    """shock, horizon, variable, value, std_error, lower, upper: shocks of a recursive autoregression of p lags, then projections."""
    z = dist.norm_ppf(0.5 + level / 2)

    def f(t, y):
        q = p or lags
        e, out = orthogonal_shocks(y, q), []
        for j, s in enumerate(columns):
            for h in range(horizon + 1):
                for i, c in enumerate(columns):
                    b, v, _, _ = project(y[q:], y[q:, i], e[q:, j], h, lags)
                    out.append((s, h, c, *_band(b[0], math.sqrt(v[0, 0]), z)))
        return tidy(("shock", "horizon", "variable", "value", "std_error", "lower", "upper"), out)

    return per_series(df, columns, order, f, "shock string, " + RESPONSE, by)


def against_var(df: DataFrame, columns: list[str], order: str, horizon: int = 12, lags: int = 4, by: str | None = None) -> DataFrame:
    """shock, horizon, variable, projection, autoregression: both responses side by side."""

    def f(t, y):
        e, theta = orthogonal_shocks(y, lags), Var(y, lags).irf(horizon + 1)
        return tidy(("shock", "horizon", "variable", "projection", "autoregression"), [(s, h, c, project(y[lags:], y[lags:, i], e[lags:, j], h, lags)[0][0], theta[h, i, j]) for j, s in enumerate(columns) for h in range(horizon + 1) for i, c in enumerate(columns)])

    return per_series(df, columns, order, f, "shock string, horizon int, variable string, projection double, autoregression double", by)


def instrument_tests(df: DataFrame, columns: list[str], shock: str, instruments: list[str], order: str, variable: str, horizon: int = 4, lags: int = 2, threshold: float = 10.0, by: str | None = None) -> DataFrame:
    """horizon, first_stage_f, weak (F under the threshold), value, j_stat, j_p (null if exactly identified)."""
    k, v = columns.index(shock), columns.index(variable)

    def f(t, a):
        y, z = a[:, : len(columns)], a[:, len(columns) :]
        out = []
        for h in range(horizon + 1):
            n = len(y)
            _, w = lag_matrix(y[: n - h], lags)
            part = lambda q: q - w @ np.linalg.lstsq(w, q, rcond=None)[0]
            d, m, r = part(y[lags : n - h, k]), part(z[lags : n - h]), part(y[lags + h :, v])
            pi = np.linalg.lstsq(m, d, rcond=None)[0]
            fit, e = m @ pi, d - m @ pi
            q = m.shape[1]
            dof = len(d) - w.shape[1] - q
            first = (fit @ fit / q) / (e @ e / dof)
            b = (fit @ r) / (fit @ d)
            u = r - b * d
            g = m.T @ u
            j = float(g @ np.linalg.solve(m.T @ m, g) / (u @ u / len(u))) if q > 1 else None
            out.append((h, first, bool(first < threshold), b, j, dist.chi2_sf(j, q - 1) if q > 1 else None))
        return tidy(("horizon", "first_stage_f", "weak", "value", "j_stat", "j_p"), out)

    return per_series(df, [*columns, *instruments], order, f, "horizon int, first_stage_f double, weak boolean, value double, j_stat double, j_p double", by)


# -- smoothing ------------------------------------------------------------------


def bspline(x: np.ndarray, degree: int, inner: int) -> np.ndarray:
    """Basis over [min, max] with evenly spaced interior knots (Cox-de Boor)."""
    lo, hi = float(min(x)), float(max(x))
    knots = np.concatenate((np.full(degree + 1, lo), np.linspace(lo, hi, inner + 2)[1:-1], np.full(degree + 1, hi)))
    x = np.asarray(x, float)
    b = np.array([(knots[i] <= x) & ((x < knots[i + 1]) | ((x == hi) & (knots[i + 1] == hi))) for i in range(len(knots) - 1)], float)
    for d in range(1, degree + 1):
        new = []
        for i in range(len(knots) - d - 1):
            left, right = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            new.append((b[i] * (x - knots[i]) / left if left > 0 else 0 * x) + (b[i + 1] * (knots[i + d + 1] - x) / right if right > 0 else 0 * x))
        b = np.array(new)
    return b.T


def basis(spark, horizon: int, degree: int = 3, inner: int = 4) -> DataFrame:
    """horizon, basis (number), value."""
    b = bspline(np.arange(horizon + 1), degree, inner)
    return spark.createDataFrame([(int(h), k, float(b[h, k])) for h in range(len(b)) for k in range(b.shape[1])], "horizon int, basis int, value double")


def smooth(value: np.ndarray, se: np.ndarray, lam: float, degree: int = 3, inner: int = 4) -> np.ndarray:
    """The matrix that takes responses to smoothed ones: penalised splines weighted by 1 / se^2."""
    b = bspline(np.arange(len(value)), degree, inner)
    d = np.diff(np.eye(b.shape[1]), 2, axis=0)
    w = np.diag(1 / np.maximum(se, 1e-12) ** 2)
    return b @ guarded_inverse(b.T @ w @ b + lam * d.T @ d + 1e-10 * np.eye(b.shape[1])) @ b.T @ w


def _path(y: np.ndarray, i: int, k: int, horizon: int, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Responses, errors, and their covariance across horizons from the scores of the common rows."""
    values, scores = [], []
    n = len(y)
    rows = n - lags - horizon
    se = []
    for h in range(horizon + 1):
        b, v, e, x = project(y, y[:, i], y[:, k], h, lags)
        values.append(b[0])
        se.append(math.sqrt(v[0, 0]))
        scores.append((guarded_inverse(x.T @ x)[0] @ (x * e[:, None]).T)[:rows])
    s = np.array(scores).T
    cov = s.T @ s
    for j in range(1, horizon + 1):
        c = s[j:].T @ s[:-j] * (1 - j / (horizon + 1))
        cov += c + c.T
    return np.array(values), np.array(se), cov


def smoothed(df: DataFrame, columns: list[str], shock: str, order: str, horizon: int = 12, lags: int = 4, lam: float = 1.0, degree: int = 3, inner: int = 4, level: float = 0.95, by: str | None = None) -> DataFrame:
    """horizon, variable, raw, value, std_error, lower, upper."""
    z = dist.norm_ppf(0.5 + level / 2)
    k = columns.index(shock)

    def f(t, y):
        out = []
        for i, c in enumerate(columns):
            v, se, cov = _path(y, i, k, horizon, lags)
            s = smooth(v, se, lam, degree, inner)
            for h, (raw, x, e) in enumerate(zip(v, s @ v, np.sqrt(np.maximum(np.diag(s @ cov @ s.T), 0)), strict=True)):
                out.append((h, c, raw, *_band(x, e, z)))
        return tidy(("horizon", "variable", "raw", "value", "std_error", "lower", "upper"), out)

    return per_series(df, columns, order, f, "horizon int, variable string, raw double, value double, std_error double, lower double, upper double", by)


def choose_smoothing(df: DataFrame, columns: list[str], shock: str, variable: str, order: str, horizon: int = 12, lags: int = 4, grid: tuple = (0.01, 0.1, 1.0, 10.0, 100.0), folds: int = 5, by: str | None = None) -> DataFrame:
    """lam, error, best: each fold of consecutive horizons is predicted from the others."""
    i, k = columns.index(variable), columns.index(shock)

    def f(t, y):
        v, se, _ = _path(y, i, k, horizon, lags)
        b = bspline(np.arange(len(v)), 3, 4)
        d = np.diff(np.eye(b.shape[1]), 2, axis=0)
        parts = [np.arange(j, len(v), folds) for j in range(folds)]
        err = []
        for lam in grid:
            total = 0.0
            for p in parts:
                w = 1 / np.maximum(se, 1e-12) ** 2
                w[p] = 0
                c = guarded_inverse(b.T @ (b * w[:, None]) + lam * d.T @ d + 1e-10 * np.eye(b.shape[1])) @ b.T @ (w * v)
                total += float((((v - b @ c) / se)[p] ** 2).sum())
            err.append(total / len(v))
        return {"lam": list(grid), "error": err, "best": [e == min(err) for e in err]}

    return per_series(df, columns, order, f, "lam double, error double, best boolean", by)


# -- states -----------------------------------------------------------------------


def transition(z: np.ndarray, kind: str, gamma: float = 1.5, c: float = 0.0) -> np.ndarray:
    """logistic 1 / (1 + exp(-gamma (z - c))), exponential 1 - exp(-gamma (z - c)^2), indicator z >= c."""
    if kind == "logistic":
        return 1 / (1 + np.exp(-np.clip(gamma * (z - c), -500, 500)))
    if kind == "exponential":
        return 1 - np.exp(-gamma * (z - c) ** 2)
    if kind == "indicator":
        return (z >= c).astype(float)
    raise ValueError(f"transition {kind} is not known")


def transitions(df: DataFrame, state: str, order: str, gamma: float = 1.5, c: float = 0.0, by: str | None = None) -> DataFrame:
    """order, logistic, exponential, indicator of the state."""
    kind = df.schema[order].dataType.simpleString()
    return per_series(df, [state], order, lambda t, v: {order: t} | {k: transition(v[:, 0], k, gamma, c) for k in ("logistic", "exponential", "indicator")}, f"{order} {kind}, logistic double, exponential double, indicator double", by)


def _two_states(y, s, i, k, h, lags, gamma, c):
    n = len(y)
    _, x = lag_matrix(y[: n - h], lags)
    base = np.column_stack([y[lags : n - h, k], x])
    w = transition(s[lags - 1 : n - h - 1], "logistic", gamma, c)[:, None]
    z = np.hstack([w * base, (1 - w) * base])
    b, e, inv = ols(y[lags + h :, i], z)
    return b, e, inv, z, base.shape[1]


def state_parameters(y: np.ndarray, s: np.ndarray, i: int, k: int, lags: int, gamma0: float = 1.5) -> tuple[float, float]:
    """Slope and place of the logistic transition with the least squares at horizon 0."""
    lo, hi = np.quantile(s, (0.1, 0.9))

    def loss(q):
        g, c = math.exp(min(max(q[0], -3), 4)), min(max(q[1], lo), hi)
        return float((_two_states(y, s, i, k, 0, lags, g, c)[1] ** 2).sum())

    q = nelder_mead(loss, np.array([math.log(gamma0), float(np.median(s))]), 0.3, 200)
    return math.exp(min(max(q[0], -3), 4)), float(min(max(q[1], lo), hi))


def state_test(df: DataFrame, columns: list[str], shock: str, state: str, variable: str, order: str, horizon: int = 4, lags: int = 2, by: str | None = None) -> DataFrame:
    """horizon, gamma, threshold, high, low, statistic, p_value: Wald test that both states respond alike; transition estimated."""
    k, i = columns.index(shock), columns.index(variable)

    def f(t, v):
        y, s = v[:, :-1], v[:, -1]
        s = (s - s.mean()) / s.std()
        g, c = state_parameters(y, s, i, k, lags)
        out = []
        for h in range(horizon + 1):
            b, e, inv, z, m = _two_states(y, s, i, k, h, lags, g, c)
            cov = newey_west(z, e, inv, automatic_bandwidth(h, len(z)))
            w = (b[0] - b[m]) ** 2 / (cov[0, 0] + cov[m, m] - 2 * cov[0, m])
            out.append((h, g, c, b[0], b[m], w, dist.chi2_sf(w, 1)))
        return tidy(("horizon", "gamma", "threshold", "high", "low", "statistic", "p_value"), out)

    return per_series(df, [*columns, state], order, f, "horizon int, gamma double, threshold double, high double, low double, statistic double, p_value double", by)


# -- treatment ----------------------------------------------------------------------


def propensity(d: np.ndarray, x: np.ndarray, link: str = "logit", steps: int = 60) -> np.ndarray:
    """Chances of treatment given covariates (a constant is added)."""
    z = np.column_stack([np.ones(len(d)), x])
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        eta = np.clip(z @ b, -30, 30)
        if link == "logit":
            p = 1 / (1 + np.exp(-eta))
            w, g = p * (1 - p), d - p
        else:
            p = np.clip(np.array([dist.norm_cdf(v) for v in eta]), 1e-10, 1 - 1e-10)
            pdf = dist.norm_pdf(eta)
            w, g = pdf**2 / (p * (1 - p)), (d - p) * pdf / (p * (1 - p))
        step = guarded_inverse((z * np.maximum(w, 1e-12)[:, None]).T @ z) @ (z.T @ g)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    eta = z @ b
    return 1 / (1 + np.exp(-np.clip(eta, -700, 700))) if link == "logit" else np.array([dist.norm_cdf(v) for v in eta])


def inverse_weights(d: np.ndarray, p: np.ndarray, trim: tuple[float, float] = (0.01, 0.99), normalise: bool = True) -> np.ndarray:
    p = np.clip(p, *trim)
    w = np.where(d > 0.5, 1 / p, 1 / (1 - p))
    if normalise:
        for g in (d > 0.5, d <= 0.5):
            w[g] *= g.sum() / w[g].sum()
    return w


def treatment_projection(df: DataFrame, columns: list[str], treatment: str, covariates: list[str], variable: str, order: str, horizon: int = 6, lags: int = 2, doubly_robust: bool = False, link: str = "logit", level: float = 0.95, by: str | None = None) -> DataFrame:
    """horizon, value, std_error, lower, upper of the average effect: weighted by inverse chances, or augmented by outcome regressions."""
    zc = dist.norm_ppf(0.5 + level / 2)
    i = columns.index(variable)

    def f(t, v):
        m = len(columns)
        y, d, x = v[:, :m], v[:, m], v[:, m + 1 :]
        p = np.clip(propensity(d, x, link), 0.01, 0.99)
        w, out = inverse_weights(d, p), []
        for h in range(horizon + 1):
            n = len(y)
            _, z = lag_matrix(y[: n - h], lags)
            z = np.hstack([z, x[lags : n - h]])
            target, dd, pp, ww = y[lags + h :, i], d[lags : n - h], p[lags : n - h], w[lags : n - h]
            if doubly_robust:
                mu = [z @ ols(target[dd == g], z[dd == g])[0] for g in (0, 1)]
                psi = mu[1] - mu[0] + dd * (target - mu[1]) / pp - (1 - dd) * (target - mu[0]) / (1 - pp)
                one = np.ones((len(psi), 1))
                se = math.sqrt(newey_west(one, psi - psi.mean(), np.array([[1 / len(psi)]]), automatic_bandwidth(h, len(psi)))[0, 0])
                out.append((h, *_band(psi.mean(), se, zc)))
            else:
                r = np.sqrt(ww)
                zz = np.column_stack([dd, z]) * r[:, None]
                b, e, inv = ols(target * r, zz)
                out.append((h, *_band(b[0], math.sqrt(newey_west(zz, e, inv, automatic_bandwidth(h, len(zz)))[0, 0]), zc)))
        return tidy(("horizon", "value", "std_error", "lower", "upper"), out)

    return per_series(df, [*columns, treatment, *covariates], order, f, "horizon int, value double, std_error double, lower double, upper double", by)


def overlap(df: DataFrame, treatment: str, covariates: list[str], order: str, link: str = "logit", by: str | None = None) -> DataFrame:
    """term, raw, weighted (standardised differences of treated and others), and rows least and most for the chances."""

    def f(t, v):
        d, x = v[:, 0], v[:, 1:]
        p = propensity(d, x, link)
        w = inverse_weights(d, p)
        out = [("least", p.min(), None), ("most", p.max(), None), ("effective_rows", float(w.sum() ** 2 / (w @ w)), None)]
        for c, z in zip(covariates, x.T, strict=True):
            one, none = d > 0.5, d <= 0.5
            s = math.sqrt((z[one].var(ddof=1) + z[none].var(ddof=1)) / 2)
            out.append((c, (z[one].mean() - z[none].mean()) / s, (np.average(z[one], weights=w[one]) - np.average(z[none], weights=w[none])) / s))
        return tidy(("term", "raw", "weighted"), out)

    return per_series(df, [treatment, *covariates], order, f, "term string, raw double, weighted double", by)


# -- forecasts and shares -----------------------------------------------------------


def forecast(df: DataFrame, columns: list[str], shock: str, order: str, path: list[float], lags: int = 4, level: float = 0.95, by: str | None = None) -> DataFrame:
    """horizon 1.., variable, forecast, lower, upper: direct projections from the last row plus responses to a path of shocks from now on."""
    z = dist.norm_ppf(0.5 + level / 2)
    k = columns.index(shock)

    def f(t, y):
        out, n = [], len(y)
        last = np.concatenate(([1.0], *[y[n - 1 - j] for j in range(lags)]))
        for h in range(1, len(path) + 1):
            for i, c in enumerate(columns):
                _, x = lag_matrix(y[: n - h + 1], lags)
                x = np.column_stack([y[lags : n - h + 1, k], x])
                b, e, inv = ols(y[lags + h - 1 :, i], x)
                resp = [project(y, y[:, i], y[:, k], s, lags)[0][0] for s in range(h)]
                base = b[1:] @ last
                v = base + sum(r * path[h - 1 - s] for s, r in enumerate(resp))
                se = math.sqrt(e @ e / (len(e) - x.shape[1]))
                out.append((h, c, v, v - z * se, v + z * se))
        return tidy(("horizon", "variable", "forecast", "lower", "upper"), out)

    return per_series(df, columns, order, f, "horizon int, variable string, forecast double, lower double, upper double", by)


def variance_shares(df: DataFrame, columns: list[str], order: str, variable: str, horizon: int = 8, lags: int = 2, by: str | None = None) -> DataFrame:
    """shock, horizon, share: R2 of projection forecast errors on the shocks from t to t + h."""
    i = columns.index(variable)

    def f(t, y):
        e = orthogonal_shocks(y, lags)[lags:]
        y = y[lags:]
        out, n = [], len(y)
        for j, s in enumerate(columns):
            for h in range(horizon + 1):
                _, x = lag_matrix(y[: n - h], lags)
                err = ols(y[lags + h :, i], x)[1]
                z = np.column_stack([e[lags + q : n - h + q, j] for q in range(h + 1)])
                z = z - z.mean(0)
                fit = z @ np.linalg.lstsq(z, err, rcond=None)[0]
                out.append((s, h, float(fit @ fit / (err @ err))))
        return tidy(("shock", "horizon", "share"), out)

    return per_series(df, columns, order, f, "shock string, horizon int, share double", by)


def historical(df: DataFrame, columns: list[str], order: str, variable: str, horizon: int = 12, lags: int = 2, by: str | None = None) -> DataFrame:
    """order, shock, value: contributions of the last shocks by projected responses, up to the horizon."""
    kind = df.schema[order].dataType.simpleString()
    i = columns.index(variable)

    def f(t, y):
        e, out = orthogonal_shocks(y, lags), []
        for j, s in enumerate(columns):
            r = [project(y[lags:], y[lags:, i], e[lags:, j], h, lags)[0][0] for h in range(horizon + 1)]
            for k in range(lags, len(y)):
                out.append((t[k], s, sum(r[h] * e[k - h, j] for h in range(min(horizon, k - lags) + 1))))
        return tidy((order, "shock", "value"), out)

    return per_series(df, columns, order, f, f"{order} {kind}, shock string, value double", by)


def gmm(df: DataFrame, columns: list[str], shock: str, order: str, variable: str, horizon: int = 4, lags: int = 2, by: str | None = None) -> DataFrame:
    """horizon, value, std_error, j_stat: the projection as exactly identified moments E[x (y - x b)] = 0 with a HAC sandwich."""
    i, k = columns.index(variable), columns.index(shock)

    def f(t, y):
        out = []
        for h in range(horizon + 1):
            b, v, e, x = project(y, y[:, i], y[:, k], h, lags)
            g = x.T @ e / len(e)
            out.append((h, b[0], math.sqrt(v[0, 0]), float(len(e) * g @ g)))
        return tidy(("horizon", "value", "std_error", "j_stat"), out)

    return per_series(df, columns, order, f, "horizon int, value double, std_error double, j_stat double", by)
