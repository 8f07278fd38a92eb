"""State space, structural breaks, regime switching, long memory, and multivariate volatility: kernels, one series or system each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions import dist
from ..functions.linalg import lags as lag_matrix
from ..functions.linalg import ols
from .kernels import per_series
from .series import arma, garch, nelder_mead, run

# -- state space ------------------------------------------------------------


def kalman(y: np.ndarray, t: np.ndarray, z: np.ndarray, q: np.ndarray, h: float, a: np.ndarray, p: np.ndarray, smooth: bool = False):
    """Log-likelihood, filtered (or smoothed) states; z may have a row a time. NaN observations are skipped."""
    n, k = len(y), len(a)
    zs = np.broadcast_to(z, (n, k))
    ll, fa, fp, pa_, pp = 0.0, np.zeros((n, k)), np.zeros((n, k, k)), np.zeros((n, k)), np.zeros((n, k, k))
    for i in range(n):
        a, p = (t @ a, t @ p @ t.T + q) if i else (a, p)
        pa_[i], pp[i] = a, p
        if y[i] == y[i]:
            f = zs[i] @ p @ zs[i] + h
            v = y[i] - zs[i] @ a
            g = p @ zs[i] / f
            a, p = a + g * v, p - np.outer(g, zs[i] @ p)
            if i >= k or f < 1e6:
                ll -= 0.5 * (math.log(2 * math.pi * f) + v * v / f)
        fa[i], fp[i] = a, p
    if smooth:
        for i in range(n - 2, -1, -1):
            c = fp[i] @ t.T @ np.linalg.pinv(pp[i + 1])
            fa[i] = fa[i] + c @ (fa[i + 1] - pa_[i + 1])
            fp[i] = fp[i] + c @ (fp[i + 1] - pp[i + 1]) @ c.T
    return ll, fa, fp


def _structural(y: np.ndarray, trend: bool):
    s = max(np.nanvar(np.diff(y)), 1e-12)
    t = np.array([[1.0, 1.0], [0.0, 1.0]]) if trend else np.eye(1)
    z = np.array([1.0, 0.0]) if trend else np.ones(1)
    k = len(z)

    def parts(p):
        v = s * np.exp(np.clip(p, -25, 10))
        return np.diag(v[1:]), v[0]

    first = y[~np.isnan(y)][0]
    a, p0 = np.concatenate(([first], np.zeros(k - 1))), np.eye(k) * 1e7 * s
    best = min((nelder_mead(lambda p: -kalman(y, t, z, *parts(p), a, p0)[0], np.array(x), 0.5, 600) for x in ([0.0] + [-1.0] * k, [-1.0] + [-3.0] * k)), key=lambda p: -kalman(y, t, z, *parts(p), a, p0)[0])
    ll, level, _ = kalman(y, t, z, *parts(best), a, p0, True)
    q, h = parts(best)
    return ll, level, np.diag(q), h


def local_level(df: DataFrame, column: str, order: str, trend: bool = False, by: str | None = None) -> DataFrame:
    """Smoothed level (and slope) with maximum-likelihood variances: order, value, level, var_obs, var_level, loglik."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        ll, level, q, h = _structural(y, trend)
        return {order: t, "value": y, "level": level[:, 0], "var_obs": h, "var_level": q[0], "loglik": ll}

    return run(df, column, order, f, f"{order} {kind}, value double, level double, var_obs double, var_level double, loglik double", by)


def order_selection(df: DataFrame, column: str, order: str, most_p: int = 3, most_q: int = 2, by: str | None = None) -> DataFrame:
    """p, q, aic, bic of every ARMA in the grid."""

    def f(t, y):
        fits = [(p, q, arma(y, p, q)) for p in range(most_p + 1) for q in range(most_q + 1)]
        return {"p": [p for p, _, _ in fits], "q": [q for _, q, _ in fits], "aic": [m["aic"] for *_, m in fits], "bic": [m["bic"] for *_, m in fits]}

    return run(df, column, order, f, "p int, q int, aic double, bic double", by)


def gph(df: DataFrame, column: str, order: str, power: float = 0.5, by: str | None = None) -> DataFrame:
    """Log-periodogram estimate of the memory d: d, std_error, m."""

    def f(t, y):
        n = len(y)
        m = int(n**power)
        w = 2 * math.pi * np.arange(1, m + 1) / n
        p = np.abs(np.fft.fft(y - y.mean())[1 : m + 1]) ** 2 / (2 * math.pi * n)
        x = -2 * np.log(2 * np.sin(w / 2))
        z = x - x.mean()
        return {"d": [z @ np.log(p) / (z @ z)], "std_error": [math.pi / math.sqrt(6 * z @ z)], "m": [m]}

    return run(df, column, order, f, "d double, std_error double, m int", by)


# -- breaks and bubbles -----------------------------------------------------


def recursive_residuals(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    n, k = x.shape
    inv = np.linalg.inv(x[:k].T @ x[:k])
    b = inv @ x[:k].T @ y[:k]
    out = np.empty(n - k)
    for i in range(k, n):
        g = inv @ x[i]
        f = 1 + x[i] @ g
        e = y[i] - x[i] @ b
        out[i - k] = e / math.sqrt(f)
        b = b + g * e / f
        inv = inv - np.outer(g, g) / f
    return out


def cusum(df: DataFrame, y: str, x: list[str], order: str, by: str | None = None) -> DataFrame:
    """order, cusum, bound (5 %), cusumsq over the rows after the first ones."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, v):
        z = np.column_stack([np.ones(len(v)), v[:, 1:]])
        w = recursive_residuals(v[:, 0], z)
        m = len(w)
        s = math.sqrt(ols(v[:, 0], z)[1] @ ols(v[:, 0], z)[1] / m)
        return {order: t[-m:], "cusum": np.cumsum(w) / s, "bound": 0.948 * (math.sqrt(m) + 2 * np.arange(1, m + 1) / math.sqrt(m)), "cusumsq": np.cumsum(w * w) / (w @ w)}

    return per_series(df, [y, *x], order, f, f"{order} {kind}, cusum double, bound double, cusumsq double", by)


def sup_f(df: DataFrame, y: str, x: list[str], order: str, trim: float = 0.15, by: str | None = None) -> DataFrame:
    """Break of unknown date: sup_f, ave_f, exp_f and the order value of the largest F."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, v):
        z = np.column_stack([np.ones(len(v)), v[:, 1:]])
        n, k = z.shape
        rss = lambda a, b: float((ols(v[a:b, 0], z[a:b])[1] ** 2).sum())
        total = rss(0, n)
        ks = range(max(k + 1, int(trim * n)), min(n - k - 1, int((1 - trim) * n)))
        w = np.array([(lambda r: (total - r) / k / (r / (n - 2 * k)))(rss(0, b) + rss(b, n)) for b in ks])
        return {"sup_f": [w.max()], "ave_f": [w.mean()], "exp_f": [math.log(np.exp(np.minimum(w / 2, 600)).mean())], "at": [t[ks[int(w.argmax())]]]}

    return per_series(df, [y, *x], order, f, f"sup_f double, ave_f double, exp_f double, at {kind}", by)


def bai_perron(df: DataFrame, column: str, order: str, most: int = 3, trim: float = 0.15, by: str | None = None) -> DataFrame:
    """Mean breaks by dynamic programming: breaks, rss, bic, dates (comma-joined order values) for 0..most breaks."""

    def f(t, y):
        n = len(y)
        h = max(2, int(trim * n))
        s, q = np.concatenate(([0], np.cumsum(y))), np.concatenate(([0], np.cumsum(y * y)))
        cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
        best, cut = [[math.inf] * (n + 1) for _ in range(most + 1)], [[0] * (n + 1) for _ in range(most + 1)]
        for b in range(h, n + 1):
            best[0][b] = cost(0, b)
        for m in range(1, most + 1):
            for b in range((m + 1) * h, n + 1):
                for a in range(m * h, b - h + 1):
                    c = best[m - 1][a] + cost(a, b)
                    if c < best[m][b]:
                        best[m][b], cut[m][b] = c, a
        out = []
        for m in range(most + 1):
            if best[m][n] < math.inf:
                at, b = [], n
                for j in range(m, 0, -1):
                    b = cut[j][b]
                    at.append(str(t[b]))
                out.append((m, best[m][n], n * math.log(max(best[m][n], 1e-300) / n) + (2 * m + 1) * math.log(n), ",".join(reversed(at))))
        return dict(zip(("breaks", "rss", "bic", "dates"), zip(*out, strict=True), strict=True))

    return run(df, column, order, f, "breaks int, rss double, bic double, dates string", by)


def zivot_andrews(df: DataFrame, column: str, order: str, lags: int = 0, trim: float = 0.15, by: str | None = None) -> DataFrame:
    """Unit root against one break in the mean: statistic and the order value of the break."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        d = np.diff(y)
        n = len(d) - lags
        base = [np.ones(n), np.arange(n, dtype=float), y[lags:-1], *[d[lags - j : len(d) - j] for j in range(1, lags + 1)]]
        got = []
        for b in range(int(trim * n), int((1 - trim) * n)):
            x = np.column_stack([*base, (np.arange(n) >= b).astype(float)])
            c, e, inv = ols(d[lags:], x)
            got.append((c[2] / math.sqrt(e @ e / (n - x.shape[1]) * inv[2, 2]), t[b + lags + 1]))
        best = min(got)
        return {"statistic": [best[0]], "at": [best[1]]}

    return run(df, column, order, f, f"statistic double, at {kind}", by)


def explosive(df: DataFrame, column: str, order: str, window: int | None = None, by: str | None = None) -> DataFrame:
    """Right-tailed recursive tests: sadf, gsadf. ``breaks.bubble_tests`` has their p values."""
    from .breaks import recursive_roots, smallest_window

    def f(t, y):
        first, most = recursive_roots(y, window or smallest_window(len(y)))
        return {"test": ["sadf", "gsadf"], "statistic": [first.max(), most.max()]}

    return run(df, column, order, f, "test string, statistic double", by)


# -- regimes ----------------------------------------------------------------


def markov_switching(y: np.ndarray, regimes: int = 2, steps: int = 300, tol: float = 1e-8) -> dict:
    """Normal regimes with their own mean and variance, by expectation-maximisation with Hamilton's filter."""
    k, n = regimes, len(y)
    mu = np.quantile(y, (np.arange(k) + 0.5) / k)
    var, p, start = np.full(k, y.var()), np.full((k, k), 0.1 / max(1, k - 1)), np.full(k, 1 / k)
    np.fill_diagonal(p, 0.9)
    last = -math.inf
    for _ in range(steps):
        dens = np.exp(-0.5 * (y[:, None] - mu) ** 2 / var) / np.sqrt(2 * math.pi * var) + 1e-300
        a, c = np.zeros((n, k)), np.zeros(n)
        for i in range(n):
            v = (start if not i else a[i - 1] @ p) * dens[i]
            c[i] = v.sum()
            a[i] = v / c[i]
        b = np.ones((n, k))
        for i in range(n - 2, -1, -1):
            b[i] = p @ (dens[i + 1] * b[i + 1]) / c[i + 1]
        g = a * b
        g /= g.sum(1, keepdims=True)
        x = sum(np.outer(a[i], dens[i + 1] * b[i + 1]) * p / c[i + 1] for i in range(n - 1))
        p = x / x.sum(1, keepdims=True)
        mu = (g * y[:, None]).sum(0) / g.sum(0)
        var = np.maximum((g * (y[:, None] - mu) ** 2).sum(0) / g.sum(0), 1e-6 * y.var())
        start = g[0]
        ll = float(np.log(c).sum())
        if ll - last < tol * abs(ll):
            break
        last = ll
    o = np.argsort(mu)
    return {"mu": mu[o], "var": var[o], "p": p[np.ix_(o, o)], "loglik": ll, "smoothed": g[:, o]}


def estimate_markov_switching(df: DataFrame, column: str, order: str, regimes: int = 2, by: str | None = None) -> DataFrame:
    def f(t, y):
        m = markov_switching(y, regimes)
        r = range(regimes)
        return {"term": [*[f"mu{i}" for i in r], *[f"sigma2{i}" for i in r], *[f"p{i}{j}" for i in r for j in r], "loglik"], "estimate": [*m["mu"], *m["var"], *m["p"].ravel(), m["loglik"]]}

    return run(df, column, order, f, "term string, estimate double", by)


def state_local_projection(df: DataFrame, columns: list[str], shock: str, state: str, order: str, gamma: float = 3.0, horizon: int = 6, lags: int = 2, by: str | None = None) -> DataFrame:
    """horizon, variable, high, low: responses in both states, weights logistic in the standardised lagged state."""
    k = columns.index(shock)

    def f(t, v):
        y, s = v[:, :-1], v[:, -1]
        s = (s - s.mean()) / s.std()
        out = []
        for h in range(horizon + 1):
            _, x = lag_matrix(y[: len(y) - h], lags)
            w = 1 / (1 + np.exp(-gamma * s[lags - 1 : len(y) - h - 1]))[:, None]
            base = np.column_stack([y[lags : len(y) - h, k], x])
            z = np.hstack([w * base, (1 - w) * base])
            for i, c in enumerate(columns):
                b = ols(y[lags + h :, i], z)[0]
                out.append((h, c, b[0], b[base.shape[1]]))
        return dict(zip(("horizon", "variable", "high", "low"), zip(*out, strict=True), strict=True))

    return per_series(df, [*columns, state], order, f, "horizon int, variable string, high double, low double", by)


def nardl(df: DataFrame, y: str, x: str, order: str, p: int = 1, q: int = 1, by: str | None = None) -> DataFrame:
    """Partial sums of rises and falls of x in an ARDL: term, estimate with lr_plus and lr_minus."""

    def f(t, v):
        d = np.diff(v[:, 1])
        w = np.column_stack([v[1:, 0], np.cumsum(np.maximum(d, 0)), np.cumsum(np.minimum(d, 0))])
        m = max(p, q)
        cols, names = [np.ones(len(w) - m)], ["const"]
        for i, (c, n, first) in enumerate(((y, p, 1), ("plus", q, 0), ("minus", q, 0))):
            for j in range(first, n + 1):
                cols.append(w[m - j : len(w) - j, i])
                names.append(f"{c}_l{j}")
        b = ols(w[m:, 0], np.column_stack(cols))[0]
        gap = 1 - b[1 : 1 + p].sum()
        plus, minus = b[1 + p : 2 + p + q].sum() / gap, b[2 + p + q :].sum() / gap
        return {"term": [*names, "lr_plus", "lr_minus"], "estimate": [*b, plus, minus]}

    return per_series(df, [y, x], order, f, "term string, estimate double", by)


# -- multivariate volatility ------------------------------------------------


def dynamic_correlation(df: DataFrame, columns: list[str], order: str, constant: bool = False, by: str | None = None) -> DataFrame:
    """Two steps: GARCH(1, 1) each, then constant (ccc) or dynamic (dcc) correlations: order, one, two, correlation."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, v):
        z = np.column_stack([(c - c.mean()) / np.sqrt(garch(c)["h"]) for c in v.T])
        n, k = z.shape
        base = np.corrcoef(z.T)

        def path(a, b):
            q, out = base.copy(), np.empty((n, k, k))
            for i in range(n):
                d = 1 / np.sqrt(np.diag(q))
                out[i] = q * np.outer(d, d)
                q = (1 - a - b) * base + a * np.outer(z[i], z[i]) + b * q
            return out

        def loss(p):
            a, b = p
            if a < 0 or b < 0 or a + b >= 0.999:
                return 1e300
            r = path(a, b)
            return 0.5 * float((np.linalg.slogdet(r)[1] + np.einsum("ij,ij->i", z, np.linalg.solve(r, z[:, :, None])[:, :, 0])).sum())

        r = np.broadcast_to(base, (n, k, k)) if constant else path(*nelder_mead(loss, np.array([0.03, 0.9]), 0.05, 120))
        pairs = [(i, j) for i in range(k) for j in range(i)]
        return {order: np.repeat(t, len(pairs)), "one": [columns[i] for i, _ in pairs] * n, "two": [columns[j] for _, j in pairs] * n, "correlation": np.array([[r[m, i, j] for i, j in pairs] for m in range(n)]).ravel()}

    return per_series(df, columns, order, f, f"{order} {kind}, one string, two string, correlation double", by)


def sign_bias(df: DataFrame, column: str, order: str, by: str | None = None) -> DataFrame:
    """Engle and Ng on standardised GARCH residuals: joint statistic, p_value."""

    def f(t, y):
        e = (y - y.mean()) / np.sqrt(garch(y)["h"])
        low = (e[:-1] < 0).astype(float)
        x = np.column_stack([np.ones(len(low)), low, low * e[:-1], (1 - low) * e[:-1]])
        z = e[1:] ** 2
        r = ols(z, x)[1]
        s = len(z) * (1 - r @ r / ((z - z.mean()) ** 2).sum())
        return {"statistic": [s], "p_value": [dist.chi2_sf(s, 3)]}

    return run(df, column, order, f, "statistic double, p_value double", by)


# -- rational expectations --------------------------------------------------


def solve_linear(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, steps: int = 100, tol: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """Solves A E y(t+1) + B y(t) + C y(t-1) + D e(t) = 0 by cyclic reduction: y(t) = G y(t-1) + H e(t)."""
    a0, b0, c0, hat = a.copy(), b.copy(), c.copy(), b.copy()
    for _ in range(steps):
        inv = np.linalg.inv(b0)
        up, down = a0 @ inv @ c0, c0 @ inv @ a0
        hat = hat - up
        a0, b0, c0 = -a0 @ inv @ a0, b0 - up - down, -c0 @ inv @ c0
        if np.abs(a0).max() < tol or np.abs(c0).max() < tol:
            break
    g = -np.linalg.solve(hat, c)
    return g, -np.linalg.solve(a @ g + b, d)


def linear_irf(spark, models: list[tuple], names: list[str], shocks: list[str], horizon: int = 12) -> DataFrame:
    """id, horizon, variable, shock, value for many parameterisations (id, A, B, C, D): models are rows, solved in parallel."""
    import pandas as pd

    flat = [(int(i), *[np.asarray(m, float).ravel().tolist() for m in ms]) for i, *ms in models]
    n, s = len(names), len(shocks)

    def go(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b, c = (np.array(r[j]).reshape(n, n) for j in (1, 2, 3))
                g, h = solve_linear(a, b, c, np.array(r[4]).reshape(n, s))
                y = h
                for k in range(horizon):
                    out += [(r[0], k, names[i], shocks[j], float(y[i, j])) for i in range(n) for j in range(s)]
                    y = g @ y
            yield pd.DataFrame(out, columns=["id", "horizon", "variable", "shock", "value"])

    df = spark.createDataFrame(flat, "id long, a array<double>, b array<double>, c array<double>, d array<double>")
    return df.repartition("id").mapInPandas(go, "id long, horizon int, variable string, shock string, value double")
