"""Systems of equations, long-run covariances, cointegrating and distributed-lag regressions in more forms, spectra."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.linalg import guarded_inverse, ols
from ..functions.linalg import lags as lag_matrix
from ..plans.gram import Moments
from .describe import rows
from .further import _unit_sums, midas_weights
from .kernels import per_series, tidy
from .series import _taper, andrews_bandwidth, arma, kernel_weight, long_run_covariance, nelder_mead, run

# -- simultaneous equations ------------------------------------------------------


def three_stage(df: DataFrame, equations: dict[str, tuple[str, list[str]]], instruments: list[str]) -> DataFrame:
    """equation, term, estimate, std_error: two-stage residual covariance, then generalised least squares on projected regressors; one Gram aggregate. Each equation is (left side, regressors), with a constant."""
    names = sorted({c for y, x in equations.values() for c in [y, *x]} | set(instruments))
    d = df.dropna(subset=names)
    m = Moments.of(d, names)
    z = ["const", *instruments]
    zz = guarded_inverse(m.sub(z))
    eqs = list(equations.items())
    xs = [["const", *x] for _, (_, x) in eqs]
    if any(len(x) > len(z) for x in xs):
        raise ValueError("an equation has more regressors than there are instruments")
    proj = lambda a, b: m.sub(a, z) @ zz @ m.sub(z, b)
    two = [guarded_inverse(proj(x, x)) @ proj(x, [y])[:, 0] for (_, (y, _)), x in zip(eqs, xs, strict=True)]
    k = len(eqs)
    s = np.zeros((k, k))
    for i in range(k):
        for j in range(k):
            yi, yj = eqs[i][1][0], eqs[j][1][0]
            s[i, j] = (m.sub([yi], [yj])[0, 0] - two[i] @ m.sub(xs[i], [yj])[:, 0] - two[j] @ m.sub(xs[j], [yi])[:, 0] + two[i] @ m.sub(xs[i], xs[j]) @ two[j]) / m.n
    w = np.linalg.inv(s)
    a = np.block([[w[i, j] * proj(xs[i], xs[j]) for j in range(k)] for i in range(k)])
    c = np.concatenate([sum(w[i, j] * proj(xs[i], [eqs[j][1][0]])[:, 0] for j in range(k)) for i in range(k)])
    inv = guarded_inverse(a)
    b, se, out, at = inv @ c, np.sqrt(np.diag(inv)), [], 0
    for (name, _), x in zip(eqs, xs, strict=True):
        for t in x:
            out.append({"equation": name, "term": t, "estimate": float(b[at]), "std_error": float(se[at])})
            at += 1
    return rows(df.sparkSession, out, "equation string, term string, estimate double, std_error double")


# -- long-run covariance -------------------------------------------------------------


def one_sided(u: np.ndarray, bandwidth: float | None = None, kernel: str = "bartlett") -> np.ndarray:
    """Sum over j >= 0 of weighted autocovariances E u(t) u(t + j)'."""
    u = u.reshape(len(u), -1)
    u = u - u.mean(0)
    n = len(u)
    bw = andrews_bandwidth(u, kernel) if bandwidth is None else bandwidth
    out = u.T @ u / n
    last = min(n - 1, int(math.floor(bw)))
    for j, w in zip(range(1, last + 1), kernel_weight(np.arange(1, last + 1), bw, kernel), strict=True):
        out = out + w * u[:-j].T @ u[j:] / n
    return out


def newey_west_bandwidth(u: np.ndarray, kernel: str = "bartlett") -> float:
    """Newey and West (1994): plug-in from a first truncated sum."""
    x = u.reshape(len(u), -1)
    x = (x - x.mean(0)).sum(1)
    n = len(x)
    q, c = {"bartlett": (1, 1.1447), "parzen": (2, 2.6614), "quadratic_spectral": (2, 1.3221), "tukey_hanning": (2, 1.7462)}[kernel]
    first = int({"bartlett": 4 * (n / 100) ** (2 / 9), "parzen": 4 * (n / 100) ** (4 / 25), "quadratic_spectral": 4 * (n / 100) ** (2 / 25), "tukey_hanning": 4 * (n / 100) ** (4 / 25)}[kernel])
    g = np.array([x[j:] @ x[: n - j] / n for j in range(first + 1)])
    j = np.arange(1, first + 1)
    s0 = g[0] + 2 * g[1:].sum()
    sq = 2 * (j**q * g[1:]).sum()
    return float(c * (abs(sq / s0) ** 2 * n) ** (1 / (2 * q + 1))) if s0 else 0.0


def var_prewhitened(u: np.ndarray, most: int | None = None, criterion: str = "bic") -> tuple[np.ndarray, int]:
    """Long-run covariance of an autoregression fitted to the series, and its lag."""
    u = u.reshape(len(u), -1)
    u = u - u.mean(0)
    n, k = u.shape
    top = int(n ** (1 / 3)) if most is None else most
    best = None
    for p in range(top + 1):
        z, x = lag_matrix(u, p, False)
        z, x = z[top - p :], x[top - p :]
        e = z - x @ np.linalg.lstsq(x, z, rcond=None)[0] if p else z
        v = np.linalg.slogdet(e.T @ e / len(e))[1] + (2 if criterion == "aic" else math.log(len(e))) * k * k * p / len(e)
        if best is None or v < best[0]:
            best = (v, p)
    p = best[1]
    z, x = lag_matrix(u, p, False)
    b = np.linalg.lstsq(x, z, rcond=None)[0] if p else np.zeros((0, k))
    e = z - x @ b
    a = np.eye(k) - sum((b[j * k : (j + 1) * k].T for j in range(p)), np.zeros((k, k)))
    inv = np.linalg.inv(a)
    return inv @ (e.T @ e / len(e)) @ inv.T, p


ESTIMATORS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "bartlett": lambda u: long_run_covariance(u),
    "parzen": lambda u: long_run_covariance(u, kernel="parzen"),
    "quadratic_spectral": lambda u: long_run_covariance(u, kernel="quadratic_spectral"),
    "tukey_hanning": lambda u: long_run_covariance(u, kernel="tukey_hanning"),
    "newey_west": lambda u: long_run_covariance(u, newey_west_bandwidth(u)),
    "one_sided": one_sided,
    "varhac": lambda u: var_prewhitened(u)[0],
    "short_run": lambda u: (u - u.mean(0)).T @ (u - u.mean(0)) / len(u),
}


def register_estimator(name: str, f: Callable[[np.ndarray], np.ndarray]) -> None:
    """A covariance estimator of one's own: rows of series -> matrix. It must be picklable, as it runs in kernels."""
    ESTIMATORS[name] = f


def long_run(df: DataFrame, columns: list[str], order: str, estimators: list[str], by: str | None = None) -> DataFrame:
    """estimator, row, column, value."""
    funcs = {e: ESTIMATORS[e] for e in estimators}

    def f(t, u):
        out = []
        for name, g in funcs.items():
            m = g(u)
            out += [(name, columns[i], columns[j], m[i, j]) for i in range(len(columns)) for j in range(len(columns))]
        return tidy(("estimator", "row", "column", "value"), out)

    return per_series(df, columns, order, f, "estimator string, row string, column string, value double", by)


def bandwidths(df: DataFrame, column: str, order: str, by: str | None = None) -> DataFrame:
    """kernel, andrews, newey_west, varhac_lag."""

    def f(t, y):
        k = ["bartlett", "parzen", "quadratic_spectral", "tukey_hanning"]
        return {"kernel": k, "andrews": [andrews_bandwidth(y, a) for a in k], "newey_west": [newey_west_bandwidth(y, a) for a in k], "varhac_lag": var_prewhitened(y)[1]}

    return run(df, column, order, f, "kernel string, andrews double, newey_west double, varhac_lag int", by)


# -- cointegrating regressions -----------------------------------------------------------


def fully_modified(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (constant first), cross products, long-run variance of the errors given the regressors."""
    z = np.column_stack([np.ones(len(y)), x])
    e = ols(y, z)[1][1:]
    u = np.column_stack([e, np.diff(x, axis=0)])
    u = u - np.concatenate(([0.0], u[:, 1:].mean(0)))
    bw = andrews_bandwidth(u)
    om, one = long_run_covariance(u, bw, demean=False), one_sided(u, bw)
    o22 = np.linalg.inv(om[1:, 1:])
    plus = y[1:] - u[:, 1:] @ o22 @ om[1:, 0]
    bias = one[1:, 0] - one[1:, 1:] @ o22 @ om[1:, 0]
    zt = z[1:]
    inv = guarded_inverse(zt.T @ zt)
    return inv @ (zt.T @ plus - len(u) * np.concatenate(([0.0], bias))), zt.T @ zt, float(om[0, 0] - om[0, 1:] @ o22 @ om[1:, 0])


def canonical(df: DataFrame, y: str, x: list[str], order: str, by: str | None = None) -> DataFrame:
    """term, estimate, std_error of the canonical cointegrating regression (Park, 1992)."""

    def f(t, v):
        yy, xx = v[:, 0], v[:, 1:]
        z = np.column_stack([np.ones(len(yy)), xx])
        b0, e, _ = ols(yy, z)
        dx = np.diff(xx, axis=0)
        u = np.column_stack([e[1:], dx - dx.mean(0)])
        n = len(u)
        bw = andrews_bandwidth(u)
        om, lam, sig = long_run_covariance(u, bw, demean=False), one_sided(u, bw), u.T @ u / n
        w = u @ np.linalg.solve(sig, lam[:, 1:])
        o22 = np.linalg.inv(om[1:, 1:])
        xs = xx[1:] - w
        shift = np.linalg.solve(sig, lam[:, 1:]) @ b0[1:]
        shift[1:] += o22 @ om[1:, 0]
        ys = yy[1:] - u @ shift
        zs = np.column_stack([np.ones(n), xs])
        b, _, inv = ols(ys, zs)
        s = om[0, 0] - om[0, 1:] @ o22 @ om[1:, 0]
        return {"term": ["const", *x], "estimate": b, "std_error": np.sqrt(s * np.diag(inv))}

    return per_series(df, [y, *x], order, f, "term string, estimate double, std_error double", by)


def panel_cointegration(df: DataFrame, y: str, x: list[str], unit: str, time: str, pooled: bool = False) -> DataFrame:
    """term, estimate, std_error: fully modified by unit, averaged, or pooled with unit weights."""
    k = len(x)

    def f(t, v):
        b, g, s = fully_modified(v[:, 0], v[:, 1:])
        # Slopes only: cross products after the constant.
        q = g[1:, 1:] - np.outer(g[1:, 0], g[0, 1:]) / g[0, 0]
        se = np.linalg.inv(q) * s
        return np.concatenate((b[1:], (b[1:] / np.sqrt(np.diag(se))), (q / s).ravel(), (q / s) @ b[1:], [1.0]))

    a = _unit_sums(df, [y, *x], time, unit, f)
    n = a[-1]
    if pooled:
        q = a[2 * k : 2 * k + k * k].reshape(k, k)
        inv = guarded_inverse(q)
        b, se = inv @ a[2 * k + k * k : -1], np.sqrt(np.diag(inv))
    else:
        b = a[:k] / n
        tbar = a[k : 2 * k] / math.sqrt(n)
        se = np.abs(b / tbar)
    return rows(df.sparkSession, [{"term": c, "estimate": float(v), "std_error": float(s)} for c, v, s in zip(x, b, se, strict=True)], "term string, estimate double, std_error double")


def pooled_mean_group(df: DataFrame, y: str, x: list[str], unit: str, time: str, steps: int = 50, tol: float = 1e-8) -> DataFrame:
    """term (long-run slopes, then phi, the mean speed of adjustment), pmg, mean_group, hausman, hausman_p: a common long run with unit short runs, by alternating unit regressions and a pooled step."""
    k = len(x)

    def unit_fit(v, theta):
        d = np.diff(v, axis=0)
        z = np.column_stack([np.ones(len(d)), d[:, 1:]])
        ec = v[:-1, 0] - v[:-1, 1:] @ theta
        w = np.column_stack([ec, z])
        b, e, _ = ols(d[:, 0], w)
        return d, z, b, float(e @ e / len(e))

    def own(t, v):
        d = np.diff(v, axis=0)
        w = np.column_stack([v[:-1], np.ones(len(d)), d[:, 1:]])
        b, e, inv = ols(d[:, 0], w)
        th = -b[1 : 1 + k] / b[0]
        return np.concatenate((th, th**2, [b[0], b[0] ** 2, 1.0]))

    a = _unit_sums(df, [y, *x], time, unit, own)
    n = a[-1]
    mg, mg_var = a[:k] / n, (a[k : 2 * k] / n - (a[:k] / n) ** 2) / max(1.0, n - 1)
    theta = mg.copy()
    for _ in range(steps):

        def pool(t, v, th=theta):
            d, z, b, s = unit_fit(v, th)
            part = lambda q: q - z @ np.linalg.lstsq(z, q, rcond=None)[0]
            px, r = part(v[:-1, 1:]) * b[0], part(d[:, 0] - b[0] * v[:-1, 0])
            return np.concatenate(((px.T @ px / s).ravel(), -px.T @ r / s, [b[0], 1.0]))

        q = _unit_sums(df, [y, *x], time, unit, pool)
        inv = guarded_inverse(q[: k * k].reshape(k, k))
        new = inv @ q[k * k : k * k + k]
        done = np.abs(new - theta).max() < tol * (1 + np.abs(new).max())
        theta = new
        if done:
            break
    gap = mg - theta
    v = np.maximum(mg_var - np.diag(inv), 1e-12)
    h = float((gap**2 / v).sum())
    out = [{"term": c, "pmg": float(theta[i]), "mean_group": float(mg[i]), "hausman": h, "hausman_p": float(dist.chi2_sf(h, k))} for i, c in enumerate(x)]
    out.append({"term": "phi", "pmg": float(q[-2] / q[-1]), "mean_group": float(a[2 * k] / n), "hausman": None, "hausman_p": None})
    return rows(df.sparkSession, out, "term string, pmg double, mean_group double, hausman double, hausman_p double")


# -- distributed lags ----------------------------------------------------------------


#: Pesaran, Shin and Smith (2001), unrestricted constant, 5 %: lower and upper bound of F for 0..4 regressors.
BOUNDS_5 = ((8.21, 8.21), (4.94, 5.73), (3.79, 4.85), (3.23, 4.35), (2.86, 4.01))


def asymmetric(v: np.ndarray) -> np.ndarray:
    """y and partial sums of rises and falls of x."""
    d = np.diff(v[:, 1])
    return np.column_stack([v[1:, 0], np.cumsum(np.maximum(d, 0)), np.cumsum(np.minimum(d, 0))])


def asymmetric_multipliers(df: DataFrame, y: str, x: str, order: str, p: int = 1, q: int = 1, horizon: int = 8, by: str | None = None) -> DataFrame:
    """part (multiplier at a horizon; long_run, symmetry, bounds), name, at, value, p_value: cumulated responses to a lasting rise and fall, Wald tests of symmetry, and the bounds F with its 5 % limits."""

    def f(t, v):
        w = asymmetric(v)
        m = max(p, q)
        cols, names = [np.ones(len(w) - m)], ["const"]
        for i, (c, n, first) in enumerate((("y", p, 1), ("plus", q, 0), ("minus", q, 0))):
            for j in range(first, n + 1):
                cols.append(w[m - j : len(w) - j, i])
                names.append(f"{c}{j}")
        z = np.column_stack(cols)
        b, e, inv = ols(w[m:, 0], z)
        cov = e @ e / (len(e) - z.shape[1]) * inv
        phi, up, down = b[1 : 1 + p], b[1 + p : 2 + p + q], b[2 + p + q :]
        out, paths = [], {}
        for name, c in (("plus", up), ("minus", down)):
            path: list[float] = []
            for h in range(horizon + 1):
                path.append(sum(phi[j] * path[h - 1 - j] for j in range(p) if h - 1 - j >= 0) + float(c[: h + 1].sum()))
            paths[name] = path
            out += [("multiplier", name, h, s, None) for h, s in enumerate(path)]
        gap = 1 - phi.sum()
        lr = {"plus": up.sum() / gap, "minus": down.sum() / gap}
        g = np.zeros(len(b))
        g[1 : 1 + p] = (lr["plus"] - lr["minus"]) / gap
        g[1 + p : 2 + p + q], g[2 + p + q :] = 1 / gap, -1 / gap
        wald = (lr["plus"] - lr["minus"]) ** 2 / float(g @ cov @ g)
        out += [("long_run", k, 0, s, None) for k, s in lr.items()]
        out.append(("symmetry", "long_run", 0, wald, dist.chi2_sf(wald, 1)))
        r = np.zeros(len(b))
        r[1 + p], r[2 + p + q] = 1, -1
        short = float(r @ b) ** 2 / float(r @ cov @ r)
        out.append(("symmetry", "impact", 0, short, dist.chi2_sf(short, 1)))
        d = np.diff(w, axis=0)
        dz = np.column_stack([np.ones(len(e)), *[d[m - 1 - j : len(d) - j, 0] for j in range(1, p)], *[d[m - 1 - j : len(d) - j, i] for i in (1, 2) for j in range(q)]])
        r0 = ols(d[m - 1 :, 0], dz)[1]
        out.append(("bounds", "f", 0, (r0 @ r0 - e @ e) / 3 / (e @ e / (len(e) - z.shape[1])), None))
        out += [("bounds", k, 0, s, None) for k, s in zip(("lower_5", "upper_5"), BOUNDS_5[2], strict=True)]
        return tidy(("part", "name", "at", "value", "p_value"), out)

    return per_series(df, [y, x], order, f, "part string, name string, at int, value double, p_value double", by)


def midas_forecast(y: np.ndarray, x: np.ndarray, new: np.ndarray, kind: str = "expalmon", level: float = 0.95) -> tuple[float, float, float]:
    """Forecast and band from a new block of high-frequency values (latest first), weights fitted to rows x."""
    k = x.shape[1]

    def loss(t):
        return float((ols(y, np.column_stack([np.ones(len(y)), x @ midas_weights(t, k, kind)]))[1] ** 2).sum())

    t = nelder_mead(loss, np.array([0.0, -0.05] if kind == "expalmon" else [1.0, 3.0]), 0.1)
    z = np.column_stack([np.ones(len(y)), x @ midas_weights(t, k, kind)])
    b, e, inv = ols(y, z)
    q = np.array([1.0, new @ midas_weights(t, k, kind)])
    s = math.sqrt(e @ e / (len(y) - 2 - len(t)) * (1 + q @ inv @ q))
    v, c = float(q @ b), dist.norm_ppf(0.5 + level / 2)
    return v, v - c * s, v + c * s


def forecast_mixed(df: DataFrame, y: str, x: str, order: str, ratio: int, k: int = 6, kind: str = "expalmon", by: str | None = None) -> DataFrame:
    """value, lower, upper of the next low-frequency y; df has the high-frequency x, and y in the last row of each low period (NaN elsewhere and in the last, open period)."""
    from .factors import panel_kernel

    def f(t, v):
        at = np.flatnonzero(~np.isnan(v[:, 0]))
        at = at[at >= k - 1]
        xs = np.array([v[i - k + 1 : i + 1, 1][::-1] for i in at])
        got = midas_forecast(v[at, 0], xs, v[-k:, 1][::-1], kind)
        return {"value": [got[0]], "lower": [got[1]], "upper": [got[2]]}

    return panel_kernel(df, [y, x], order, f, "value double, lower double, upper double", by)


# -- spectra --------------------------------------------------------------------------


def taper(n: int, kind: str) -> np.ndarray:
    """rectangular, bartlett, hann, hamming, blackman, tukey (half cosine) or flat_top."""
    if kind == "tukey":
        k = np.arange(n)
        a = 0.5 * (n - 1) / 2
        w = np.ones(n)
        w[k < a] = 0.5 * (1 - np.cos(math.pi * k[k < a] / a))
        w[k > n - 1 - a] = 0.5 * (1 - np.cos(math.pi * (n - 1 - k[k > n - 1 - a]) / a))
        return w
    if kind == "flat_top":
        x = 2 * math.pi * np.arange(n) / (n - 1)
        return 0.21557895 - 0.41663158 * np.cos(x) + 0.277263158 * np.cos(2 * x) - 0.083578947 * np.cos(3 * x) + 0.006947368 * np.cos(4 * x)
    return _taper(n, kind)


def welch(x: np.ndarray, y: np.ndarray, segment: int = 0, overlap: float = 0.5, window: str = "hann") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Frequencies (radians), both spectra, the cross spectrum, and the segments averaged."""
    n = len(x)
    m = segment or max(8, n // 4)
    step = max(1, int(m * (1 - overlap)))
    w = taper(m, window)
    starts = range(0, n - m + 1, step)
    sx = sy = sxy = 0
    for a in starts:
        fx, fy = (np.fft.rfft((v[a : a + m] - v[a : a + m].mean()) * w) for v in (x, y))
        sx, sy, sxy = sx + np.abs(fx) ** 2, sy + np.abs(fy) ** 2, sxy + fx * np.conj(fy)
    k = len(starts)
    scale = 2 * math.pi * (w @ w) * k
    return 2 * math.pi * np.arange(len(sx)) / m, sx / scale, sy / scale, sxy / scale, k


def burg(y: np.ndarray, p: int) -> tuple[np.ndarray, float]:
    """Autoregressive coefficients and error variance."""
    f, b, a, e = y[1:].astype(float), y[:-1].astype(float), np.zeros(0), float(y @ y / len(y))
    for k in range(p):
        r = 2 * float(f @ b) / float(f @ f + b @ b)
        a = np.concatenate((a - r * a[::-1], [r])) if k else np.array([r])
        f, b = (f - r * b)[1:], (b - r * f)[:-1]
        e *= 1 - r * r
    return a, e


def spectral_density(df: DataFrame, column: str, order: str, method: str = "welch", points: int = 33, by: str | None = None) -> DataFrame:
    """frequency (radians), density, lower, upper (95 % chi-square; null for ar): welch, smoothed (Daniell) or ar (Burg, lag by AIC)."""

    def f(t, y):
        z = y - y.mean()
        n = len(z)
        if method == "welch":
            w, s, _, _, k = welch(z, z)
            dof = 2 * k
        elif method == "smoothed":
            p = np.abs(np.fft.rfft(z)) ** 2 / (2 * math.pi * n)
            p[0] = p[1]
            m = max(1, int(math.sqrt(n) / 2))
            q = np.concatenate((p[m:0:-1], p, p[-2 : -m - 2 : -1]))
            s = np.convolve(q, np.full(2 * m + 1, 1 / (2 * m + 1)), "valid")
            w, dof = 2 * math.pi * np.arange(len(p)) / n, 2 * (2 * m + 1)
        else:
            top = min(20, n // 4)
            p = min(range(1, top + 1), key=lambda k: n * math.log(burg(z, k)[1]) + 2 * k)
            a, e = burg(z, p)
            w = np.linspace(0, math.pi, points)
            s = e / (2 * math.pi) / np.abs(1 - np.exp(-1j * np.outer(w, np.arange(1, p + 1))) @ a) ** 2
            return {"frequency": w, "density": s, "lower": None, "upper": None}
        return {"frequency": w, "density": s, "lower": dof * s / dist.chi2_ppf(0.975, dof), "upper": dof * s / dist.chi2_ppf(0.025, dof)}

    return run(df, column, order, f, "frequency double, density double, lower double, upper double", by)


def cross_spectrum(df: DataFrame, x: str, y: str, order: str, segment: int = 0, window: str = "hann", by: str | None = None) -> DataFrame:
    """frequency, co, quad, coherence (squared), phase, gain (of y on x)."""

    def f(t, v):
        w, sx, sy, c, _ = welch(v[:, 0], v[:, 1], segment, window=window)
        ok = np.maximum(sx * sy, 1e-300)
        return {"frequency": w, "co": c.real, "quad": -c.imag, "coherence": np.abs(c) ** 2 / ok, "phase": np.angle(c), "gain": np.abs(c) / np.maximum(sx, 1e-300)}

    return per_series(df, [x, y], order, f, "frequency double, co double, quad double, coherence double, phase double, gain double", by)


def band_power(density: DataFrame, low: float, high: float) -> DataFrame:
    """power between two frequencies, share of all: trapezoids over the rows of a density."""
    from pyspark.sql import Window

    w = Window.orderBy("frequency")  # rows are frequencies of one density
    d = density.select("frequency", "density", F.lead("frequency").over(w).alias("f2"), F.lead("density").over(w).alias("d2")).where("f2 is not null")
    area = (F.col("f2") - F.col("frequency")) * (F.col("density") + F.col("d2")) / 2
    inside = (F.col("frequency") >= low) & (F.col("f2") <= high)
    return d.agg(F.sum(F.when(inside, area).otherwise(0.0)).alias("power"), (F.sum(F.when(inside, area).otherwise(0.0)) / F.sum(area)).alias("share"))


def response(w: np.ndarray, filter: str, lam: float = 1600.0, low: float = 6, high: float = 32, k: int = 12, h: int = 8) -> np.ndarray:
    """Frequency response of the cycle of hp, baxter_king or the random-walk form of hamilton."""
    from .series import baxter_king_weights

    if filter == "hp":
        a = 4 * (1 - np.cos(w)) ** 2 * lam
        return a / (1 + a) + 0j
    if filter == "baxter_king":
        b = baxter_king_weights(low, high, k)
        return b[0] + 2 * np.cos(np.outer(w, np.arange(1, k + 1))) @ b[1:] + 0j
    if filter == "hamilton":
        return 1 - np.exp(-1j * w * h)
    raise ValueError(f"filter {filter} is not known")


def transfer_function(spark, filter: str, points: int = 65, **options) -> DataFrame:
    """frequency, gain, phase of a filter's cycle."""
    w = np.linspace(1e-6, math.pi, points)
    return rows(spark, [{"frequency": float(a), "gain": float(abs(v)), "phase": float(np.angle(v))} for a, v in zip(w, response(w, filter, **options), strict=True)], "frequency double, gain double, phase double")


def filtered_spectrum(df: DataFrame, column: str, order: str, filter: str, by: str | None = None, **options) -> DataFrame:
    """frequency, power (of the periodogram), gain, passed: what of a series' variance at each frequency a filter's cycle lets through."""

    def f(t, y):
        p = np.abs(np.fft.rfft(y - y.mean())) ** 2 / (2 * math.pi * len(y))
        w = 2 * math.pi * np.arange(1, len(p)) / len(y)
        g = np.abs(response(w, filter, **options))
        return {"frequency": w, "power": p[1:], "gain": g, "passed": p[1:] * g * g}

    return run(df, column, order, f, "frequency double, power double, gain double, passed double", by)


def beveridge_nelson_arma(df: DataFrame, column: str, order: str, p: int = 1, q: int = 1, terms: int = 500, by: str | None = None) -> DataFrame:
    """order, value, trend, cycle: an ARMA in differences, the trend being y plus the truncated sum of expected changes."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        d = np.diff(y)
        m = arma(d, p, q)
        mu = m["const"] / (1 - m["ar"].sum())
        e = np.concatenate((np.zeros(len(d) - len(m["residuals"])), m["residuals"]))
        trend = np.empty(len(y))
        trend[0] = y[0]
        for i in range(len(d)):
            z = [d[i - j] - mu if i - j >= 0 else 0.0 for j in range(max(p, 1))]
            s = [e[i - j] if i - j >= 0 else 0.0 for j in range(max(q, 1))]
            total = 0.0
            for _ in range(terms):
                v = sum(m["ar"][j] * z[j] for j in range(p)) + sum(m["ma"][j] * s[j] for j in range(q))
                z, s = [v, *z[:-1]], [0.0, *s[:-1]]
                total += v
                if abs(v) < 1e-14:
                    break
            trend[i + 1] = y[i + 1] + total
        return {order: t, "value": y, "trend": trend, "cycle": y - trend}

    return run(df, column, order, f, f"{order} {kind}, value double, trend double, cycle double", by)
