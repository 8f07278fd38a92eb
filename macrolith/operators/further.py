"""Further panel, cointegration, mixed-frequency, nonparametric, nowcasting and identification operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.linalg import guarded_inverse
from ..functions.linalg import lags as lag_matrix
from ..functions.linalg import ols
from ..plans.gram import Moments, gram
from .describe import bounded, rows
from .kernels import per_series
from .multivariate import CUBE, Var, _cube
from .regression import coefficient_table
from .series import adf, kpss, long_run_covariance, nelder_mead, phillips_perron, run
from .transforms import demean

# -- panels -----------------------------------------------------------------


def panel_iv(df: DataFrame, y: str, exog: list[str], endog: list[str], instruments: list[str], unit: str) -> DataFrame:
    """Within two-stage least squares, errors clustered by unit."""
    cols = [y, *exog, *endog, *instruments]
    d = demean(df.dropna(subset=cols).select(unit, *[F.col(c).cast("double").alias(c) for c in cols]), cols, [unit])
    m = Moments.of(d, cols)
    x, z = exog + endog, exog + instruments
    pi = np.linalg.solve(m.sub(z), m.sub(z, x))
    a = guarded_inverse(pi.T @ m.sub(z, x))
    b = a @ pi.T @ m.sub(z, [y])[:, 0]
    e = F.col(y)
    for v, c in zip(b, x, strict=True):
        e = e - float(v) * F.col(c)
    fitted = [sum((float(pi[j, i]) * F.col(c) for j, c in enumerate(z)), F.lit(0.0)) for i in range(len(x))]
    scores = d.groupBy(unit).agg(*[F.sum(e * h).alias(f"s{i}") for i, h in enumerate(fitted)])
    g, meat = gram(scores, [f"s{i}" for i in range(len(x))])
    return coefficient_table(df.sparkSession, x, b, a @ meat[1:, 1:] @ a.T * g / (g - 1))


def _unit_sums(df: DataFrame, columns: list[str], order: str, unit: str, f) -> np.ndarray:
    """Sum over units of a vector made from each unit's rows; only sums leave the cluster."""
    got = per_series(df, columns, order, lambda t, v: (lambda a: {"at": range(len(a)), "v": a})(f(t, v)), "at int, v double", unit)
    return np.array([r.v for r in got.groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()])


def difference_gmm(df: DataFrame, y: str, x: list[str], unit: str, time: str, lags: int = 3) -> DataFrame:
    """Arellano-Bond in two steps with collapsed instruments (levels of y at lags 2..lags + 1, differences of x): coefficient rows and hansen_j."""
    k, m = 1 + len(x), lags + len(x)

    def parts(t, v):
        """Rows where consecutive periods allow the differences."""
        at = {int(p): i for i, p in enumerate(t)}
        xs, ys, zs, when = [], [], [], []
        for p, i in at.items():
            if all(p - j in at for j in (1, 2)):
                a, b, c = v[i], v[at[p - 1]], v[at[p - 2]]
                xs.append(np.concatenate(([b[0] - c[0]], a[1:] - b[1:])))
                ys.append(a[0] - b[0])
                zs.append(np.concatenate(([v[at[p - j], 0] if p - j in at else 0.0 for j in range(2, lags + 2)], a[1:] - b[1:])))
                when.append(p)
        return np.array(xs).reshape(-1, k), np.array(ys), np.array(zs).reshape(-1, m), np.array(when)

    def first(t, v):
        a, b, z, when = parts(t, v)
        gap = np.abs(np.subtract.outer(when, when)) if len(when) else np.zeros((0, 0))
        h = np.where(gap == 0, 2.0, np.where(gap == 1, -1.0, 0.0))
        return np.concatenate(((z.T @ a).ravel(), z.T @ b, (z.T @ h @ z).ravel(), [len(b)]))

    s = _unit_sums(df, [y, *x], time, unit, first)
    zx, zy, w = s[: m * k].reshape(m, k), s[m * k : m * k + m], guarded_inverse(s[m * k + m : -1].reshape(m, m))
    one = np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy)

    def second(t, v):
        a, b, z, _ = parts(t, v)
        g = z.T @ (b - a @ one)
        return np.outer(g, g).ravel()

    w = guarded_inverse(_unit_sums(df, [y, *x], time, unit, second).reshape(m, m))
    inv = guarded_inverse(zx.T @ w @ zx)
    b = inv @ zx.T @ w @ zy
    g = zy - zx @ b
    j = float(g @ w @ g)
    names = [f"{y}_l1", *x]
    se = np.sqrt(np.diag(inv))
    out = [{"term": n, "estimate": float(v), "std_error": float(q)} for n, v, q in zip(names, b, se, strict=True)]
    return rows(df.sparkSession, [*out, {"term": "hansen_j", "estimate": j, "std_error": None}], "term string, estimate double, std_error double")


def panel_var(df: DataFrame, columns: list[str], unit: str, time: str, p: int = 1) -> DataFrame:
    """Fixed-effects vector autoregression, lags by time value: equation, term, estimate. One Gram aggregate for all equations."""
    from .transforms import panel_shift

    d = df.select(unit, time, *[F.col(c).cast("double").alias(c) for c in columns])
    names = [f"{c}_l{j}" for j in range(1, p + 1) for c in columns]
    d = d.withColumns({f"{c}_l{j}": panel_shift(d, c, j, unit, time) for j in range(1, p + 1) for c in columns}).dropna()
    m = Moments.of(demean(d, [*columns, *names], [unit]), [*columns, *names])
    out = [{"equation": c, "term": t, "estimate": float(v)} for c in columns for t, v in zip(names, m.solve(c, names)[0], strict=True)]
    return rows(df.sparkSession, out, "equation string, term string, estimate double")


def levin_lin_chu(df: DataFrame, y: str, unit: str, time: str, lags: int = 0) -> DataFrame:
    """Pooled rho and its unadjusted t after unit regressions on a constant (and lags), scaled by unit: statistic rows."""

    def f(t, v):
        s, d = v[:, 0], np.diff(v[:, 0])
        x = np.column_stack([np.ones(len(d) - lags), *[d[lags - j : len(d) - j] for j in range(1, lags + 1)]])
        e, u = ols(d[lags:], x)[1], ols(s[lags:-1], x)[1]
        r = e - u * (u @ e) / (u @ u)
        sd = math.sqrt(r @ r / max(1, len(r)))
        return np.array([u @ e / sd**2, u @ u / sd**2, e @ e / sd**2, len(e), 1.0])

    ue, uu, ee, n, k = _unit_sums(df, [y], time, unit, f)
    rho = ue / uu
    s2 = (ee - rho * ue) / n
    return rows(df.sparkSession, [{"statistic": "rho", "value": rho}, {"statistic": "t", "value": rho / math.sqrt(s2 / uu)}, {"statistic": "units", "value": k}], "statistic string, value double")


def hadri(df: DataFrame, y: str, unit: str, time: str) -> DataFrame:
    """Stationarity of all units: mean KPSS statistic, standardised (constant): lm, z, p_value."""
    got = per_series(df, [y], time, lambda t, v: {"k": [kpss(v[:, 0], "constant", 0)[0]]}, "k double", unit).agg(F.avg("k").alias("lm"), F.count("*").alias("n")).first()
    z = math.sqrt(got.n) * (got.lm - 1 / 6) / math.sqrt(1 / 45)
    return rows(df.sparkSession, [{"lm": got.lm, "z": z, "p_value": 1 - dist.norm_cdf(z)}], "lm double, z double, p_value double")


def cips(df: DataFrame, y: str, unit: str, time: str) -> DataFrame:
    """Unit regressions augmented by cross-section means; unit t values averaged: cips, units."""
    means = df.groupBy(time).agg(F.avg(y).alias("_mean"))

    def f(t, v):
        d, dm = np.diff(v[:, 0]), np.diff(v[:, 1])
        x = np.column_stack([v[:-1, 0], np.ones(len(d)), v[:-1, 1], dm])
        b, e, inv = ols(d, x)
        return {"k": [b[0] / math.sqrt(e @ e / (len(d) - 4) * inv[0, 0])]}

    return per_series(df.join(means, time), [y, "_mean"], time, f, "k double", unit).agg(F.avg("k").alias("cips"), F.count("*").alias("units"))


def kao(df: DataFrame, y: str, x: list[str], unit: str, time: str) -> DataFrame:
    """Residual cointegration with common slopes: rho and the t of the pooled residual autoregression."""
    d = demean(df.dropna(subset=[y, *x]).select(unit, time, *[F.col(c).cast("double").alias(c) for c in [y, *x]]), [y, *x], [unit])
    b = Moments.of(d, [y, *x]).solve(y, x)[0]
    e = F.col(y)
    for v, c in zip(b, x, strict=True):
        e = e - float(v) * F.col(c)
    s = _unit_sums(d.withColumn("_e", e), ["_e"], time, unit, lambda t, v: np.array([v[1:, 0] @ v[:-1, 0], v[:-1, 0] @ v[:-1, 0], v[1:, 0] @ v[1:, 0], len(v) - 1.0]))
    rho = s[0] / s[1]
    s2 = (s[2] - rho * s[0]) / s[3]
    return rows(df.sparkSession, [{"statistic": "rho", "value": rho}, {"statistic": "t", "value": (rho - 1) / math.sqrt(s2 / s[1])}], "statistic string, value double")


def pedroni(df: DataFrame, y: str, x: list[str], unit: str, time: str) -> DataFrame:
    """Unit cointegrating regressions; means of the residuals' statistics over units: group_rho, group_pp, group_adf."""

    def f(t, v):
        e = ols(v[:, 0], np.column_stack([np.ones(len(v)), v[:, 1:]]))[1]
        z, r, _ = phillips_perron(e, "none")
        return {"r": [r], "p": [z], "a": [adf(e, 1, "none")[0]]}

    g = per_series(df, [y, *x], time, f, "r double, p double, a double", unit).agg(F.count("*").alias("n"), *[(F.sum(c) / F.sqrt(F.count("*"))).alias(c) for c in "rpa"]).first()
    return rows(df.sparkSession, [{"statistic": a, "value": g[c], "units": g.n} for a, c in (("group_rho", "r"), ("group_pp", "p"), ("group_adf", "a"))], "statistic string, value double, units long")


# -- cointegration and mixed frequency ----------------------------------------


def vecm(df: DataFrame, columns: list[str], order: str, p: int = 2, rank: int = 1, by: str | None = None) -> DataFrame:
    """matrix (beta, alpha, gamma), row, column, value of an error-correction model with p lags in levels and a constant; beta is normalised on the first variables."""

    def f(t, y):
        d, n = np.diff(y, axis=0), y.shape[1]
        z0, z1 = d[p - 1 :], y[p - 1 : -1]
        x = np.hstack([np.ones((len(z0), 1)), *[d[p - 1 - j : len(d) - j] for j in range(1, p)]])
        q = lambda a: a - x @ np.linalg.lstsq(x, a, rcond=None)[0]
        r0, r1 = q(z0), q(z1)
        s00, s11, s01 = r0.T @ r0, r1.T @ r1, r0.T @ r1
        w, v = np.linalg.eig(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01)))
        beta = v.real[:, np.argsort(-w.real)[:rank]]
        beta = beta @ np.linalg.inv(beta[:rank])
        b = ols(z0, np.hstack([z1 @ beta, x]))[0]
        out = [("beta", columns[i], f"r{j + 1}", beta[i, j]) for i in range(n) for j in range(rank)]
        out += [("alpha", columns[i], f"r{j + 1}", b[j, i]) for i in range(n) for j in range(rank)]
        terms = ["const", *[f"d_{c}_l{j}" for j in range(1, p) for c in columns]]
        out += [("gamma", columns[i], terms[j], b[rank + j, i]) for i in range(n) for j in range(len(terms))]
        return dict(zip(("matrix", "row", "column", "value"), zip(*out, strict=True), strict=True))

    return per_series(df, columns, order, f, "matrix string, row string, column string, value double", by)


def phillips_ouliaris(df: DataFrame, y: str, x: list[str], order: str, by: str | None = None) -> DataFrame:
    def f(t, v):
        z, r, _ = phillips_perron(ols(v[:, 0], np.column_stack([np.ones(len(v)), v[:, 1:]]))[1], "none")
        return {"z_t": [z], "z_rho": [r]}

    return per_series(df, [y, *x], order, f, "z_t double, z_rho double", by)


def gregory_hansen(df: DataFrame, y: str, x: list[str], order: str, trim: float = 0.15, by: str | None = None) -> DataFrame:
    """Cointegration with a shift in the constant at an unknown date: least residual ADF t, and the date."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, v):
        n = len(v)
        got = []
        for b in range(int(trim * n), int((1 - trim) * n)):
            z = np.column_stack([np.ones(n), (np.arange(n) >= b).astype(float), v[:, 1:]])
            got.append((adf(ols(v[:, 0], z)[1], 0, "none")[0], t[b]))
        s, at = min(got)
        return {"statistic": [s], "at": [at]}

    return per_series(df, [y, *x], order, f, f"statistic double, at {kind}", by)


def midas_weights(theta: np.ndarray, k: int, kind: str = "expalmon") -> np.ndarray:
    j = np.arange(1, k + 1)
    if kind == "expalmon":
        w = np.exp(np.clip(sum(a * j ** (i + 1) for i, a in enumerate(theta)), -500, 500))
    elif kind == "beta":
        u = np.clip((j - 0.5) / k, 1e-9, 1 - 1e-9)
        w = u ** (theta[0] - 1) * (1 - u) ** (theta[1] - 1)
    else:
        raise ValueError(f"weights {kind} are not known")
    return w / w.sum()


def midas(low: DataFrame, high: DataFrame, y: str, x: str, order: str, ratio: int, k: int = 6, kind: str = "expalmon") -> DataFrame:
    """low has (order, y), high has (order, x) with order running ratio times as fast: term, estimate. unrestricted gives one coefficient a lag.

    The k latest high-frequency values up to the end of low period t are joined as one array a low row.
    """
    h = high.select(F.col(order).alias("_h"), F.col(x).cast("double").alias("_x"))
    want = low.select(order, F.col(y).cast("double").alias("_y"), F.posexplode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_p", "_j")).withColumn("_h", F.col(order) * ratio + ratio - 1 - F.col("_j"))
    d = want.join(h, "_h").groupBy(order, "_y").agg(F.sort_array(F.collect_list(F.struct("_j", "_x"))).alias("v")).where(F.size("v") == k)
    got = bounded(d.select(order, "_y", F.col("v._x").alias("x")), 1_000_000, "low-frequency periods").sort_values(order)  # one series
    yy, xx = got["_y"].to_numpy(), np.stack(got["x"].to_numpy())
    if kind == "unrestricted":
        b = ols(yy, np.column_stack([np.ones(len(yy)), xx]))[0]
        names = ["const", *[f"lag{j}" for j in range(k)]]
    else:

        def loss(t):
            return float((ols(yy, np.column_stack([np.ones(len(yy)), xx @ midas_weights(t, k, kind)]))[1] ** 2).sum())

        t = nelder_mead(loss, np.array([0.0, -0.05] if kind == "expalmon" else [1.0, 3.0]), 0.1)
        b = np.concatenate((ols(yy, np.column_stack([np.ones(len(yy)), xx @ midas_weights(t, k, kind)]))[0], t))
        names = ["const", "slope", "theta1", "theta2"]
    return rows(low.sparkSession, [{"term": n, "estimate": float(v)} for n, v in zip(names, b, strict=True)], "term string, estimate double")


# -- nonparametrics, smooth transition ----------------------------------------


def kernel_regression(df: DataFrame, y: str, x: str, points: int = 11, bandwidth: float | None = None) -> DataFrame:
    """x, fitted: local linear fit at equally spaced points, one aggregate over all rows."""
    n, lo, hi, sd = df.agg(F.count(x), F.min(x), F.max(x), F.stddev_samp(x)).first()
    h = bandwidth or 1.06 * sd * n**-0.2
    xs = np.linspace(lo, hi, points)
    aggs = []
    for i, v in enumerate(xs):
        u = (F.col(x) - float(v)) / h
        w = F.exp(-u * u / 2)
        aggs += [F.sum(w).alias(f"a{i}"), F.sum(w * u).alias(f"b{i}"), F.sum(w * u * u).alias(f"c{i}"), F.sum(w * F.col(y)).alias(f"d{i}"), F.sum(w * u * F.col(y)).alias(f"e{i}")]
    c = lambda k, i: F.col(f"{k}{i}")
    out = [F.struct(F.lit(float(v)).alias("x"), ((c("c", i) * c("d", i) - c("b", i) * c("e", i)) / (c("a", i) * c("c", i) - c("b", i) * c("b", i))).alias("fitted")) for i, v in enumerate(xs)]
    return df.agg(*aggs).select(F.inline(F.array(*out)))


def lowess(df: DataFrame, y: str, x: str, share: float = 0.5, rounds: int = 2, by: str | None = None) -> DataFrame:
    """x, fitted: locally weighted lines with robust reweighting, a kernel per group."""

    def f(t, v):
        a, b = v[:, 1], v[:, 0]
        n = len(a)
        k = max(3, int(share * n))
        robust, fit = np.ones(n), np.zeros(n)
        for _ in range(rounds + 1):
            for i in range(n):
                d = np.abs(a - a[i])
                w = np.clip(1 - (d / max(np.partition(d, k - 1)[k - 1], 1e-300)) ** 3, 0, None) ** 3 * robust
                m = w @ a / w.sum()
                s = w @ (a - m) ** 2
                fit[i] = w @ b / w.sum() + ((w * (a - m)) @ b / s * (a[i] - m) if s > 1e-300 else 0)
            e = b - fit
            robust = np.clip(1 - (e / max(6 * np.median(np.abs(e)), 1e-300)) ** 2, 0, None) ** 2
        return {"x": a, "fitted": fit}

    return per_series(df.withColumn("_o", F.col(x)), [y, x], "_o", f, "x double, fitted double", by)


def smooth_transition(df: DataFrame, column: str, order: str, p: int = 1, by: str | None = None) -> DataFrame:
    """Logistic transition autoregression by a grid over speed and place, refined: term, estimate, with the F of the third-order linearity test."""

    def f(t, y):
        z, x = lag_matrix(y, p)
        z, s = z[:, 0], x[:, 1]

        def design(g, c):
            w = 1 / (1 + np.exp(-np.clip(np.exp(g) * (s - c) / s.std(), -500, 500)))[:, None]
            return np.hstack([x, w * x])

        loss = lambda q: float((ols(z, design(*q))[1] ** 2).sum())
        start = min(((g, c) for g in np.log([1, 3, 10, 30]) for c in np.quantile(s, np.linspace(0.2, 0.8, 13))), key=loss)
        g, c = nelder_mead(loss, np.array(start), 0.1, 300)
        b = ols(z, design(g, c))[0]
        e0 = ols(z, x)[1]
        aux = np.hstack([x, *[x[:, 1:] * s[:, None] ** j for j in (1, 2, 3)]])
        e1 = ols(z, aux)[1]
        q, dof = 3 * p, len(z) - aux.shape[1]
        names = [f"{r}_{n}" for r in ("base", "shift") for n in ["const", *[f"ar{j + 1}" for j in range(p)]]]
        return {"term": [*names, "gamma", "c", "ssr", "linearity_f"], "estimate": [*b, math.exp(g), c, loss((g, c)), ((e0 @ e0 - e1 @ e1) / q) / (e1 @ e1 / dof)]}

    return run(df, column, order, f, "term string, estimate double", by)


def local_whittle(df: DataFrame, column: str, order: str, power: float = 0.65, by: str | None = None) -> DataFrame:
    """Semiparametric memory: d, std_error."""

    def f(t, y):
        n = len(y)
        m = int(n**power)
        w = 2 * math.pi * np.arange(1, m + 1) / n
        p = np.abs(np.fft.fft(y - y.mean())[1 : m + 1]) ** 2
        loss = lambda d: math.log((p * w ** (2 * d)).mean()) - 2 * d * np.log(w).mean()
        grid = np.linspace(-0.49, 1.0, 150)
        k = int(np.argmin([loss(d) for d in grid]))
        # The loss is convex in d: golden section between the neighbours.
        lo, hi = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
        r = (math.sqrt(5) - 1) / 2
        while hi - lo > 1e-12:
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        return {"d": [(lo + hi) / 2], "std_error": [1 / (2 * math.sqrt(m))]}

    return run(df, column, order, f, "d double, std_error double", by)


# -- nowcasting ---------------------------------------------------------------


def factor_fill(x: np.ndarray, r: int = 1, steps: int = 500, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Missing cells from r principal components, alternating until they settle: filled data and factors."""
    hole = np.isnan(x)
    mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    sd[sd == 0] = 1
    z = np.where(hole, 0.0, (x - mean) / sd)
    for _ in range(steps):
        u, s, v = np.linalg.svd(z, full_matrices=False)
        low = (u[:, :r] * s[:r]) @ v[:r]
        new = np.where(hole, low, z)
        moved = np.abs(new - z).max()
        z = new
        if moved < tol:
            break
    return z * sd + mean, u[:, :r] * s[:r]


def nowcast(df: DataFrame, columns: list[str], order: str, target: str, r: int = 1, by: str | None = None) -> DataFrame:
    """Ragged edges filled by common factors: order, value (of the target, filled), is_nowcast. Missing values are NULL."""
    kind = df.schema[order].dataType.simpleString()
    k = columns.index(target)
    d = df.select(*([by] if by else []), order, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns])

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[columns].to_numpy(float)
        out = pd.DataFrame({order: pdf[order], "value": factor_fill(x, r)[0][:, k], "is_nowcast": np.isnan(x[:, k])})
        if by:
            out.insert(0, by, pdf[by].iloc[0])
        return out

    head = f"{by} {df.schema[by].dataType.simpleString()}, " if by else ""
    return d.withColumn("_series", F.lit(1)).groupBy(by or "_series").applyInPandas(go, f"{head}{order} {kind}, value double, is_nowcast boolean")


# -- identification, expectations ---------------------------------------------


def identify_by_volatility(df: DataFrame, columns: list[str], order: str, regime: str, p: int = 1, horizon: int = 8, by: str | None = None) -> DataFrame:
    """Impact from residual covariances in two known regimes (column regime is 0 or 1); shocks are ordered by their variance ratio."""

    def f(t, v):
        m = Var(v[:, :-1], p)
        s = v[p:, -1] > 0.5
        a, b = (m.u[k].T @ m.u[k] / k.sum() for k in (~s, s))
        root = np.linalg.cholesky(a)
        inv = np.linalg.inv(root)
        w, q = np.linalg.eigh(inv @ b @ inv.T)
        impact = root @ q[:, ::-1]
        impact = impact * np.where(impact[np.abs(impact).argmax(0), np.arange(len(w))] < 0, -1, 1)
        return _cube(m.moving_average(horizon) @ impact, columns)

    return per_series(df, [*columns, regime], order, f, CUBE, by)


def identify_by_independence(df: DataFrame, columns: list[str], order: str, p: int = 1, horizon: int = 8, seed: int = 1, by: str | None = None) -> DataFrame:
    """Impact from non-Gaussian shocks: symmetric fixed-point independent components with the log-cosh contrast."""

    def f(t, y):
        m = Var(y, p)
        root = np.linalg.cholesky(m.sigma)
        z = np.linalg.solve(root, m.u.T)
        n = len(z)
        w = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]
        for _ in range(500):
            g = np.tanh(w @ z)
            new = g @ z.T / z.shape[1] - (1 - g * g).mean(1)[:, None] * w
            u, _, vt = np.linalg.svd(new)
            new = u @ vt
            done = np.abs(np.abs(np.diag(new @ w.T)) - 1).max() < 1e-10
            w = new
            if done:
                break
        impact = root @ w.T
        order_ = np.argsort(np.abs(impact).argmax(0), kind="stable")
        impact = impact[:, order_]
        impact = impact * np.where(impact[np.abs(impact).argmax(0), np.arange(n)] < 0, -1, 1)
        return _cube(m.moving_average(horizon) @ impact, columns)

    return per_series(df, columns, order, f, CUBE, by)


def perfect_foresight(f, start: np.ndarray, end: np.ndarray, x: np.ndarray, steps: int = 50, tol: float = 1e-10) -> np.ndarray:
    """Path y of f(y(t-1), y(t), y(t+1), x(t)) = 0 between given ends, by Newton on the stacked system with numerical blocks."""
    t, n = len(x), len(start)
    y = np.linspace(start, end, t + 2)
    for _ in range(steps):
        r, jac = np.zeros(t * n), np.zeros((t * n, t * n))
        for k in range(t):
            a = [y[k], y[k + 1], y[k + 2]]
            base = f(*a, x[k])
            r[k * n : (k + 1) * n] = base
            for j, block in enumerate((k - 1, k, k + 1)):
                if 0 <= block < t:
                    for i in range(n):
                        h = 1e-6 * max(1.0, abs(a[j][i]))
                        b = [v.copy() for v in a]
                        b[j][i] += h
                        jac[k * n : (k + 1) * n, block * n + i] = (f(*b, x[k]) - base) / h
        if np.abs(r).max() < tol:
            break
        y[1:-1] -= np.linalg.solve(jac, r).reshape(t, n)
    return y


def propensity_projection(df: DataFrame, y: str, treated: str, covariates: list[str], trim: float = 0.01) -> DataFrame:
    """Effect of a binary treatment: inverse-probability (ate_ipw) and doubly robust (ate_aipw) means, logit score trimmed; native aggregates."""
    from .regression import binary, linear
    from .regression import ols as fit_ols

    d = df.dropna(subset=[y, treated, *covariates])
    s = binary(d, treated, covariates)
    p = F.greatest(F.least(1 / (1 + F.exp(-linear(s.b, s.terms))), F.lit(1 - trim)), F.lit(trim))
    one, zero = fit_ols(d.where(F.col(treated) > 0.5), y, covariates, "ols"), fit_ols(d.where(F.col(treated) <= 0.5), y, covariates, "ols")
    w = F.col(treated)
    q = d.select(F.col(y).alias("y"), w.alias("w"), p.alias("p"), linear(one.b, one.terms).alias("m1"), linear(zero.b, zero.terms).alias("m0"))
    ipw = F.sum(F.expr("w * y / p")) / F.sum(F.expr("w / p")) - F.sum(F.expr("(1 - w) * y / (1 - p)")) / F.sum(F.expr("(1 - w) / (1 - p)"))
    dr = F.expr("m1 - m0 + w * (y - m1) / p - (1 - w) * (y - m0) / (1 - p)")
    return q.agg(ipw.alias("ate_ipw"), F.avg(dr).alias("ate_aipw"), (F.stddev_samp(dr) / F.sqrt(F.count("*"))).alias("std_error"), F.count("*").alias("n"))


def forecast_encompassing(df: DataFrame, actual: str, one: str, two: str, order: str, by: str | None = None) -> DataFrame:
    """Harvey, Leybourne and Newbold: does one encompass two? statistic, p_value."""

    def f(t, v):
        e1, e2 = v[:, 0] - v[:, 1], v[:, 0] - v[:, 2]
        d = e1 * (e1 - e2)
        s = d.mean() / math.sqrt(long_run_covariance(d, 0)[0, 0] / len(d)) * math.sqrt((len(d) - 1) / len(d))
        return {"statistic": [s], "p_value": [dist.t_two_sided(s, len(d) - 1)]}

    return per_series(df, [actual, one, two], order, f, "statistic double, p_value double", by)
