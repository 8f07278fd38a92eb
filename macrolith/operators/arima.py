"""Exact likelihoods and forecasts of ARIMA models, long memory, general state space."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..functions import dist
from ..functions.linalg import ols
from .dynamics import kalman
from .kernels import per_series, tidy
from .series import adf, arma, nelder_mead, run

FORECAST = "horizon int, forecast double, std_error double, lower double, upper double"


def system(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, loading and shock vector of an ARMA in companion form."""
    k = max(len(ar), len(ma) + 1)
    t = np.zeros((k, k))
    t[: len(ar), 0] = ar
    t[:-1, 1:] = np.eye(k - 1)
    r = np.zeros(k)
    r[0], r[1 : 1 + len(ma)] = 1, ma
    z = np.zeros(k)
    z[0] = 1
    return t, z, r


def stationary(ar: np.ndarray) -> bool:
    return not len(ar) or np.abs(np.roots(np.concatenate(([1.0], -ar)))).max() < 1 - 1e-8


def exact(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Concentrated log-likelihood, shock variance and innovations of a centred ARMA."""
    if not stationary(ar) or not stationary(-ma):
        return -1e300, float("nan"), y
    t, z, r = system(ar, ma)
    k = len(z)
    q = np.outer(r, r)
    p = np.linalg.solve(np.eye(k * k) - np.kron(t, t), q.ravel()).reshape(k, k)
    a, n = np.zeros(k), len(y)
    v, f = np.empty(n), np.empty(n)
    for i in range(n):
        v[i], f[i] = y[i] - a[0], p[0, 0]
        g = p[:, 0] / f[i]
        a, p = t @ (a + g * v[i]), t @ (p - np.outer(g, p[0])) @ t.T + q
    s = float((v * v / f).mean())
    return -n / 2 * (math.log(2 * math.pi * s) + 1) - 0.5 * float(np.log(f).sum()), s, v / np.sqrt(f)


def maximum_likelihood(y: np.ndarray, p: int, q: int) -> dict:
    """ARMA with a mean by exact likelihood, from the conditional estimates."""
    mean = y.mean()
    start = arma(y, p, q)
    x0 = np.concatenate(([0.0], start["ar"], np.clip(start["ma"], -0.95, 0.95)))
    if not stationary(x0[1 : 1 + p]):
        x0[1 : 1 + p] *= 0.9 / np.abs(np.roots(np.concatenate(([1.0], -x0[1 : 1 + p])))).max()
    sd = y.std() / math.sqrt(len(y)) or 1.0
    loss = lambda b: -exact(y - mean - b[0] * sd, b[1 : 1 + p], b[1 + p :])[0]
    b = nelder_mead(loss, x0, 0.1, 400 * (1 + p + q))
    ll, s, e = exact(y - mean - b[0] * sd, b[1 : 1 + p], b[1 + p :])
    k = 2 + p + q
    mu = mean + b[0] * sd
    return {"mean": mu, "const": mu * (1 - b[1 : 1 + p].sum()), "ar": b[1 : 1 + p], "ma": b[1 + p :], "sigma2": s, "loglik": ll, "aic": -2 * ll + 2 * k, "bic": -2 * ll + math.log(len(y)) * k, "residuals": e}


def estimate(df: DataFrame, column: str, order: str, p: int = 1, q: int = 0, d: int = 0, by: str | None = None) -> DataFrame:
    """term, estimate of an ARIMA(p, d, q) by exact likelihood."""

    def f(t, y):
        m = maximum_likelihood(np.diff(y, d), p, q)
        names = ["const", *[f"ar{j + 1}" for j in range(p)], *[f"ma{j + 1}" for j in range(q)], "sigma2", "loglik", "aic", "bic"]
        return {"term": names, "estimate": [m["const"], *m["ar"], *m["ma"], m["sigma2"], m["loglik"], m["aic"], m["bic"]]}

    return run(df, column, order, f, "term string, estimate double", by)


def psi_weights(ar: np.ndarray, ma: np.ndarray, d: int, n: int) -> np.ndarray:
    """Moving-average weights of the integrated process."""
    full = np.concatenate(([1.0], -np.asarray(ar, float)))
    for _ in range(d):
        full = np.convolve(full, [1.0, -1.0])
    psi = np.zeros(n)
    for k in range(n):
        psi[k] = (1.0 if not k else ma[k - 1] if k <= len(ma) else 0.0) - sum(full[j] * psi[k - j] for j in range(1, min(k, len(full) - 1) + 1))
    return psi


def path(y: np.ndarray, m: dict, d: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Point forecasts in levels and their standard errors."""
    x = np.diff(y, d)
    e = np.zeros(len(x))
    p, q = len(m["ar"]), len(m["ma"])
    for k in range(p, len(x)):
        e[k] = x[k] - m["const"] - sum(m["ar"][j] * x[k - 1 - j] for j in range(p)) - sum(m["ma"][j] * e[k - 1 - j] for j in range(q) if k - 1 - j >= 0)
    xs, es = list(x), list(e)
    for _ in range(steps):
        xs.append(m["const"] + sum(m["ar"][j] * xs[-1 - j] for j in range(p)) + sum(m["ma"][j] * es[-1 - j] for j in range(q)))
        es.append(0.0)
    out = np.array(xs[len(x) :])
    for k in range(d, 0, -1):
        out = np.diff(y, k - 1)[-1] + np.cumsum(out)
    psi = psi_weights(m["ar"], m["ma"], d, steps)
    return out, np.sqrt(m["sigma2"] * np.cumsum(psi**2))


def forecast(df: DataFrame, column: str, order: str, p: int = 1, q: int = 0, d: int = 0, steps: int = 8, level: float = 0.95, by: str | None = None) -> DataFrame:
    """horizon, forecast, std_error, lower, upper of AR, MA, ARMA and ARIMA models."""
    z = dist.norm_ppf(0.5 + level / 2)

    def f(t, y):
        v, s = path(y, maximum_likelihood(np.diff(y, d), p, q), d, steps)
        return {"horizon": np.arange(1, steps + 1), "forecast": v, "std_error": s, "lower": v - z * s, "upper": v + z * s}

    return run(df, column, order, f, FORECAST, by)


def orders(df: DataFrame, column: str, order: str, most_p: int = 3, most_q: int = 2, most_d: int = 2, criterion: str = "bic", by: str | None = None) -> DataFrame:
    """p, d, q, aic, bic of the model chosen: d by unit-root tests at 5 %, then the grid."""

    def f(t, y):
        d = 0
        while d < most_d and adf(np.diff(y, d), 1)[0] > -2.86:
            d += 1
        x = np.diff(y, d)
        best = min(((p, q, arma(x, p, q)) for p in range(most_p + 1) for q in range(most_q + 1)), key=lambda r: r[2][criterion])
        return {"p": [best[0]], "d": [d], "q": [best[1]], "aic": [best[2]["aic"]], "bic": [best[2]["bic"]]}

    return run(df, column, order, f, "p int, d int, q int, aic double, bic double", by)


# -- long memory ------------------------------------------------------------------


def fractional_weights(d: float, n: int) -> np.ndarray:
    """Of (1 - L)^d."""
    w = np.ones(n)
    for k in range(1, n):
        w[k] = w[k - 1] * (k - 1 - d) / k
    return w


def fractional_difference(y: np.ndarray, d: float, trunc: int = 200) -> np.ndarray:
    w = fractional_weights(d, min(len(y), trunc + 1))
    return np.convolve(y, w)[: len(y)]


def arfima(y: np.ndarray, p: int, q: int, trunc: int = 200) -> dict:
    """d in (-0.5, 0.5) and the ARMA part by conditional sum of squares; the start is the best of a grid."""
    z = y - y.mean()

    def inner(d):
        return arma(fractional_difference(z, d, trunc), p, q)

    rss = lambda d: float((inner(d)["residuals"] ** 2).sum())
    grid = np.linspace(-0.45, 0.45, 13)
    k = int(np.argmin([rss(d) for d in grid]))
    lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(25):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if rss(a) < rss(b) else (a, hi)
    d = (lo + hi) / 2
    return inner(d) | {"d": d, "mean": y.mean()}


def estimate_arfima(df: DataFrame, column: str, order: str, p: int = 0, q: int = 0, by: str | None = None) -> DataFrame:
    def f(t, y):
        m = arfima(y, p, q)
        return {"term": ["d", "mean", *[f"ar{j + 1}" for j in range(p)], *[f"ma{j + 1}" for j in range(q)], "sigma2", "loglik"], "estimate": [m["d"], m["mean"], *m["ar"], *m["ma"], m["sigma2"], m["loglik"]]}

    return run(df, column, order, f, "term string, estimate double", by)


def forecast_arfima(df: DataFrame, column: str, order: str, p: int = 0, q: int = 0, steps: int = 8, level: float = 0.95, trunc: int = 200, by: str | None = None) -> DataFrame:
    """As forecast(), by the truncated autoregressive form of (1 - L)^d."""
    z = dist.norm_ppf(0.5 + level / 2)

    def f(t, y):
        m = arfima(y, p, q, trunc)
        w = fractional_weights(m["d"], min(len(y) + steps, trunc + 1))
        x = list(y - m["mean"])
        short = m | {"const": m["const"]}
        u, _ = path(fractional_difference(y - m["mean"], m["d"], trunc), short, 0, steps)
        out = []
        for h in range(steps):
            v = u[h] - sum(w[k] * x[-k] for k in range(1, min(len(w) - 1, len(x)) + 1))
            x.append(v)
            out.append(v + m["mean"])
        psi = np.convolve(psi_weights(m["ar"], m["ma"], 0, steps), fractional_weights(-m["d"], steps))[:steps]
        s = np.sqrt(m["sigma2"] * np.cumsum(psi**2))
        out = np.array(out)
        return {"horizon": np.arange(1, steps + 1), "forecast": out, "std_error": s, "lower": out - z * s, "upper": out + z * s}

    return run(df, column, order, f, FORECAST, by)


# -- state space ---------------------------------------------------------------------


def state_space(y: np.ndarray, build: Callable[[np.ndarray], tuple], start: np.ndarray, kappa: float = 1e6, steps: int = 600) -> tuple[np.ndarray, float, tuple]:
    """Parameters, log-likelihood and system of a user builder: parameters -> (T, Z, Q, H)."""

    def ll(x):
        t, z, q, h = build(x)
        k = t.shape[0]
        return kalman(y, t, z, q, h, np.zeros(k), np.eye(k) * kappa)[0]

    best = nelder_mead(lambda x: -ll(x), np.asarray(start, float), 0.3, steps)
    return best, ll(best), build(best)


def estimate_state_space(df: DataFrame, column: str, order: str, build: Callable, start: list[float], names: list[str], by: str | None = None) -> DataFrame:
    """term, estimate by prediction-error decomposition."""

    def f(t, y):
        x, ll, _ = state_space(y, build, np.array(start))
        return {"term": [*names, "loglik"], "estimate": [*x, ll]}

    return run(df, column, order, f, "term string, estimate double", by)


def forecast_state_space(df: DataFrame, column: str, order: str, build: Callable, start: list[float], steps: int = 8, level: float = 0.95, by: str | None = None) -> DataFrame:
    z0 = dist.norm_ppf(0.5 + level / 2)

    def f(t, y):
        _, _, (tr, z, q, h) = state_space(y, build, np.array(start))
        k = tr.shape[0]
        _, a, p = kalman(y, tr, z, q, h, np.zeros(k), np.eye(k) * 1e6)
        a, p, out = a[-1], p[-1], []
        for s in range(1, steps + 1):
            a, p = tr @ a, tr @ p @ tr.T + q
            v, se = float(z @ a), math.sqrt(float(z @ p @ z) + h)
            out.append((s, v, se, v - z0 * se, v + z0 * se))
        return tidy(("horizon", "forecast", "std_error", "lower", "upper"), out)

    return run(df, column, order, f, FORECAST, by)


def level_model(x: np.ndarray) -> tuple:
    """Random walk and noise; parameters are log variances."""
    v = np.exp(np.clip(x, -30, 30))
    return np.eye(1), np.ones(1), np.array([[v[1]]]), float(v[0])


def varying_coefficients(df: DataFrame, y: str, x: list[str], order: str, by: str | None = None) -> DataFrame:
    """order, term, estimate, std_error: smoothed random-walk coefficients, log variances by likelihood."""
    kind = df.schema[order].dataType.simpleString()
    names = ["const", *x]

    def f(t, v):
        yy, z = v[:, 0], np.column_stack([np.ones(len(v)), v[:, 1:]])
        k = z.shape[1]
        b, e, _ = ols(yy, z)
        s = math.log(e.var() + 1e-12)
        a0, p0 = b, np.eye(k) * 1e4 * max(1.0, float(np.abs(b).max()) ** 2)
        parts = lambda q: (np.diag(np.exp(np.clip(q[1:], -40, 20))), math.exp(min(max(q[0], -40), 40)))
        best = nelder_mead(lambda q: -kalman(yy, np.eye(k), z, *parts(q), a0, p0)[0], np.concatenate(([s], np.full(k, s - 6))), 0.5, 250)
        _, a, p = kalman(yy, np.eye(k), z, *parts(best), a0, p0, True)
        return {order: np.repeat(t, k), "term": np.tile(names, len(t)), "estimate": a.ravel(), "std_error": np.sqrt(np.maximum(np.array([np.diag(c) for c in p]), 0)).ravel()}

    return per_series(df, [y, *x], order, f, f"{order} {kind}, term string, estimate double, std_error double", by)
