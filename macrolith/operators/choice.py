"""After estimation of limited dependent variables: chances, effects, checks; further robust, penalised, instrumented and selected regressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import normal_cdf
from ..functions.linalg import guarded_inverse
from ..plans.gram import Moments, gram
from ..plans.likelihood import by_indices, maximise
from ..plans.ordered import exact_quantiles
from ..plans.store import Kept
from .describe import rows, value_ranks
from .limited import log_cdf, log_pdf, mills
from .regression import Fit, _auxiliary, _test, binary, coefficient_table, linear, ols

PHI = 1 / math.sqrt(2 * math.pi)


def estimates(table: DataFrame) -> dict[str, float]:
    return {r.term: r.estimate for r in table.select("term", "estimate").collect()}


def _index(b: dict[str, float], x: list[str], prefix: str = "") -> Column:
    out = F.lit(float(b.get(f"{prefix}const", 0.0)))
    for c in x:
        out = out + float(b[f"{prefix}{c}"]) * F.col(c)
    return out


def _pdf(z: Column, link: str) -> Column:
    p = 1 / (1 + F.exp(-z))
    return p * (1 - p) if link == "logit" else PHI * F.exp(-z * z / 2)


def _cdf(z: Column, link: str) -> Column:
    return 1 / (1 + F.exp(-z)) if link == "logit" else normal_cdf(z)


# -- ordered and multinomial -------------------------------------------------------


def ordered_chances(df: DataFrame, table: DataFrame, x: list[str], grades: list, link: str = "logit") -> DataFrame:
    """The rows with a column p_{grade} each."""
    b = estimates(table)
    s = _index({k: v for k, v in b.items() if k in x}, x)
    cuts = [float(b[f"cut{i + 1}"]) for i in range(len(grades) - 1)]
    below = [F.lit(0.0), *[_cdf(c - s, link) for c in cuts], F.lit(1.0)]
    return df.withColumns({f"p_{g}": below[i + 1] - below[i] for i, g in enumerate(grades)})


def ordered_effects(df: DataFrame, table: DataFrame, x: list[str], grades: list, link: str = "logit") -> DataFrame:
    """grade, term, effect: average derivative of each grade's chance."""
    b = estimates(table)
    s = _index({k: v for k, v in b.items() if k in x}, x)
    cuts = [float(b[f"cut{i + 1}"]) for i in range(len(grades) - 1)]
    d = [F.lit(0.0), *[_pdf(c - s, link) for c in cuts], F.lit(0.0)]
    r = df.agg(*[F.avg(d[i] - d[i + 1]).alias(f"a{i}") for i in range(len(grades))]).first()
    return rows(df.sparkSession, [{"grade": str(g), "term": c, "effect": float(b[c] * r[i])} for i, g in enumerate(grades) for c in x], "grade string, term string, effect double")


def _shares(b: dict[str, float], x: list[str], grades: list) -> list[Column]:
    e = [F.lit(1.0), *[F.exp(_index(b, x, f"{g}:")) for g in grades[1:]]]
    total = e[0]
    for v in e[1:]:
        total = total + v
    return [v / total for v in e]


def multinomial_chances(df: DataFrame, table: DataFrame, x: list[str], grades: list) -> DataFrame:
    p = _shares(estimates(table), x, grades)
    return df.withColumns({f"p_{g}": v for g, v in zip(grades, p, strict=True)})


def multinomial_effects(df: DataFrame, table: DataFrame, x: list[str], grades: list) -> DataFrame:
    """grade, term, effect: average of p_j (b_j - sum p_k b_k)."""
    b, k = estimates(table), len(grades)
    d = multinomial_chances(df, table, x, grades)
    p = [F.col(f"p_{g}") for g in grades]
    r = d.agg(*[F.avg(p[i]).alias(f"m{i}") for i in range(k)], *[F.avg(p[i] * p[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]).first()
    out = []
    for i, g in enumerate(grades):
        for c in x:
            beta = [0.0 if j == 0 else b[f"{grades[j]}:{c}"] for j in range(k)]
            out.append({"grade": str(g), "term": c, "effect": float(beta[i] * r[f"m{i}"] - sum(beta[j] * r[f"c{i}_{j}"] for j in range(k)))})
    return rows(df.sparkSession, out, "grade string, term string, effect double")


def tobit_effects(df: DataFrame, table: DataFrame, x: list[str], lower: float = 0.0) -> DataFrame:
    """kind (unconditional, conditional, probability), term, effect: averages for censoring from below."""
    b = estimates(table)
    s = float(b["sigma"])
    z = (_index(b, x) - lower) / s
    cdf, lam = F.greatest(normal_cdf(z), F.lit(1e-12)), PHI * F.exp(-z * z / 2) / F.greatest(normal_cdf(z), F.lit(1e-12))
    r = df.agg(F.avg(cdf).alias("u"), F.avg(1 - lam * (z + lam)).alias("c"), F.avg(PHI * F.exp(-z * z / 2) / s).alias("p")).first()
    return rows(df.sparkSession, [{"kind": k, "term": c, "effect": float(b[c] * r[a])} for k, a in (("unconditional", "u"), ("conditional", "c"), ("probability", "p")) for c in x], "kind string, term string, effect double")


def brant(df: DataFrame, y: str, x: list[str], grades: list) -> DataFrame:
    """Parallel slopes of an ordered logit: a row a regressor and one for all: test, statistic, df1, df2 (null), p_value. Binary logits of y above each grade and their joint covariance from one pass of products."""
    k, c = len(x) + 1, len(grades) - 1
    d = df.dropna(subset=[y, *x])
    fits = []
    for i in range(c):
        d = d.withColumn(f"_y{i}", (F.col(y) > F.lit(grades[i])).cast("double"))
        fits.append(binary(d, f"_y{i}", x, "logit"))
    p = [1 / (1 + F.exp(-linear(f.b, f.terms))) for f in fits]
    cols = [F.lit(1.0), *[F.col(q) for q in x]]
    big = np.zeros((c * k, c * k))
    for i in range(c):
        for j in range(i, c):
            # Cov of the marks y > i and y > j (j above i) is P(y > j) (1 - P(y > i)).
            w = p[j] * (1 - p[i])
            got = d.agg(*[F.sum(w * cols[a] * cols[b]) for a in range(k) for b in range(k)]).first()
            m = fits[i].inv @ np.array(got, float).reshape(k, k) @ fits[j].inv
            big[i * k : (i + 1) * k, j * k : (j + 1) * k] = m
            big[j * k : (j + 1) * k, i * k : (i + 1) * k] = m.T
    b = np.concatenate([f.b for f in fits])

    def wald(which: list[int]) -> tuple[float, int]:
        r = []
        for q in which:
            for i in range(1, c):
                v = np.zeros(c * k)
                v[q], v[i * k + q] = 1, -1
                r.append(v)
        r = np.array(r)
        return float((r @ b) @ guarded_inverse(r @ big @ r.T) @ (r @ b)), len(r)

    out = [(name, *wald([q + 1])) for q, name in enumerate(x)] + [("all", *wald(list(range(1, k))))]
    return rows(df.sparkSession, [{"test": n, "statistic": s, "df1": float(m), "df2": None, "p_value": float(dist.chi2_sf(s, m))} for n, s, m in out], "test string, statistic double, df1 double, df2 double, p_value double")


def independence_of_alternatives(df: DataFrame, y: str, x: list[str], omit, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Hausman and McFadden: coefficients without a category against those with all (both as multinomial tables): test, statistic, df1, df2, p_value."""
    big, small = ({r.term: (r.estimate, r.std_error) for r in t.select("term", "estimate", "std_error").collect()} for t in tables)
    names = [t for t in small if t in big and not t.startswith(f"{omit}:")]
    d = np.array([small[t][0] - big[t][0] for t in names])
    v = np.array([small[t][1] ** 2 - big[t][1] ** 2 for t in names])
    ok = v > 1e-12
    s = float((d[ok] ** 2 / v[ok]).sum())
    return _test(df.sparkSession, "hausman_iia", s, int(ok.sum()), dist.chi2_sf(s, int(ok.sum())) if ok.any() else float("nan"))


# -- selection by likelihood --------------------------------------------------------


def heckman_ml(df: DataFrame, y: str, x: list[str], selected: str, z: list[str], steps: int = 15) -> DataFrame:
    """Coefficient rows of outcome and selection (prefix s:), then sigma and rho, by maximum likelihood; the outcome may be null where not selected."""
    d = df.withColumn("_y", F.coalesce(F.col(y).cast("double"), F.lit(0.0)))
    sel = binary(d, selected, z, "probit")
    f = ols(d.where(F.col(selected) > 0.5), y, x, "ols")
    kx, kz = len(x) + 1, len(z) + 1
    cols = ["_y", selected, *x, *[c for c in z if c not in x]]
    at = {c: i for i, c in enumerate(cols)}

    def log(theta, v):
        one = np.ones(len(v))
        m = np.column_stack([one, *[v[:, at[c]] for c in x]]) @ theta[:kx]
        g = np.column_stack([one, *[v[:, at[c]] for c in z]]) @ theta[kx : kx + kz]
        s, r = math.exp(theta[-2]), math.tanh(theta[-1])
        e = (v[:, 0] - m) / s
        return np.where(v[:, 1] > 0.5, log_pdf(e) - theta[-2] + log_cdf((g + r * e) / math.sqrt(1 - r * r)), log_cdf(-g))

    def derivatives(theta, v):
        one = np.ones((len(v), 1))
        dx, dz = np.hstack([one, v[:, [at[c] for c in x]]]), np.hstack([one, v[:, [at[c] for c in z]]])
        s, sh, ch = math.exp(theta[-2]), math.sinh(theta[-1]), math.cosh(theta[-1])
        on = (v[:, 1] > 0.5).astype(float)
        g = dz @ theta[kx : kx + kz]
        # e and all that hangs on the outcome are zero where it isn't selected; there w = -g.
        e = on * (v[:, 0] - dx @ theta[:kx]) / s
        w = np.where(on > 0, g * ch + e * sh, -g)
        chance = log_cdf(w)
        a, b = mills(w, chance)
        wm, wg, wp, wa = -on * sh / s, np.where(on > 0, ch, -1.0), -e * sh, on * (g * sh + e * ch)
        ll = float((chance + on * (log_pdf(e) - theta[-2])).sum())
        first = [e / s + a * wm, a * wg, e * e - on + a * wp, a * wa]
        second = {
            (0, 0): -on / s**2 - b * wm * wm, (0, 1): -b * wm * wg, (0, 2): -2 * e / s - b * wm * wp + a * on * sh / s, (0, 3): -b * wm * wa - a * on * ch / s,
            (1, 1): -b * wg * wg, (1, 2): -b * wg * wp, (1, 3): -b * wg * wa + a * on * sh,
            (2, 2): -2 * e * e - b * wp * wp + a * e * sh, (2, 3): -b * wp * wa - a * e * ch,
            (3, 3): -b * wa * wa + a * on * w,
        }
        return by_indices(ll, [dx, dz, one, one], first, second)

    fill = d.fillna(0.0, subset=[c for c in x])
    m = maximise(fill, cols, log, np.concatenate((f.b, sel.b, [0.5 * math.log(f.rss / f.n), 0.0])), steps, derivatives=derivatives)
    s, r = math.exp(m.theta[-2]), math.tanh(m.theta[-1])
    jac = np.diag([1.0] * (kx + kz) + [s, 1 - r * r])
    return coefficient_table(df.sparkSession, ["const", *x, "s:const", *[f"s:{c}" for c in z], "sigma", "rho"], np.concatenate((m.theta[:-2], [s, r])), jac @ m.cov @ jac)


# -- robust regression -----------------------------------------------------------


def fast_s(df: DataFrame, y: str, x: list[str], resamples: int = 50, refine: int = 3, seed: int = 1, sample: int = 5000) -> tuple[np.ndarray, float]:
    """S estimate: elemental fits on a bounded sample of rows (``sample``), the best refined there; then reweighted on all rows by aggregates."""
    c0 = 1.5476450
    cols = [y, *x]
    d = df.dropna(subset=cols).select(*[F.col(c).cast("double").alias(c) for c in cols])
    v = d.orderBy(F.xxhash64(*cols)).limit(sample).toPandas().to_numpy(float)
    yy, z = v[:, 0], np.column_stack([np.ones(len(v)), v[:, 1:]])
    k, rng = z.shape[1], np.random.default_rng(seed)
    rho = lambda u: np.minimum(1.0, 1 - (1 - np.minimum(1, (u / c0) ** 2)) ** 3)

    def scale(e):
        s = np.median(np.abs(e)) / 0.6745 or 1e-12
        for _ in range(50):
            new = s * math.sqrt(rho(e / s).mean() / 0.5)
            if abs(new - s) < 1e-10 * s:
                break
            s = new
        return s

    def step(b, s, times):
        for _ in range(times):
            u = (yy - z @ b) / s
            w = np.where(np.abs(u) < c0, (1 - (u / c0) ** 2) ** 2, 0.0)
            b = guarded_inverse((z * w[:, None]).T @ z) @ (z * w[:, None]).T @ yy
            s = scale(yy - z @ b)
        return b, s

    best = []
    for _ in range(resamples):
        at = rng.choice(len(v), k, replace=False)
        if abs(np.linalg.det(z[at])) < 1e-12:
            continue
        b = np.linalg.solve(z[at], yy[at])
        b, s = step(b, scale(yy - z @ b), 2)
        best.append((s, tuple(b)))
    best.sort()
    s, b = min((step(np.array(b), s, 50)[::-1] for s, b in best[:5]), key=lambda q: q[0])
    terms = ["const", *x]
    for _ in range(refine):
        u = F.abs((F.col(y) - linear(b, terms)) / float(s)) / c0
        w = F.when(u < 1, F.pow(1 - u * u, 2)).otherwise(0.0)
        m = Moments.of(d.select(y, *x, w.alias("_w")), cols, "_w")
        b = m.solve(y, terms)[0]
        u = F.least(F.lit(1.0), F.pow((F.col(y) - linear(b, terms)) / float(s) / c0, 2))
        s = s * math.sqrt(d.agg(F.avg(1 - F.pow(1 - u, 3))).first()[0] / 0.5)
    return b, float(s)


def mm_regression(df: DataFrame, y: str, x: list[str], resamples: int = 50, steps: int = 50, tol: float = 1e-8, seed: int = 1) -> DataFrame:
    """Coefficient rows of the bisquare M estimate at the S scale, and the scale."""
    b, s = fast_s(df, y, x, resamples, seed=seed)
    k, terms = 4.685, ["const", *x]
    d = df.dropna(subset=[y, *x])
    for _ in range(steps):
        u = F.abs((F.col(y) - linear(b, terms)) / float(s)) / k
        m = Moments.of(d.select(y, *x, F.when(u < 1, F.pow(1 - u * u, 2)).otherwise(0.0).alias("_w")), [y, *x], "_w")
        new = m.solve(y, terms)[0]
        done = np.abs(new - b).max() < tol * (1 + np.abs(new).max())
        b = new
        if done:
            break
    r = (F.col(y) - linear(b, terms)) / float(s)
    psi = F.when(F.abs(r) < k, r * F.pow(1 - F.pow(r / k, 2), 2)).otherwise(0.0)
    dpsi = F.when(F.abs(r) < k, (1 - F.pow(r / k, 2)) * (1 - 5 * F.pow(r / k, 2))).otherwise(0.0)
    n, pp, dd = d.agg(F.count("*"), F.sum(psi * psi), F.avg(dpsi)).first()
    inv = Moments.of(d, [y, *x]).solve(y, terms)[1]
    v = s * s * pp / (n - len(terms)) / dd**2 * inv
    table = coefficient_table(df.sparkSession, terms, b, v)
    return table.unionByName(rows(df.sparkSession, [{"term": "scale", "estimate": float(s)}], "term string, estimate double"), allowMissingColumns=True)


# -- selection ------------------------------------------------------------------------


def general_to_specific(df: DataFrame, y: str, pool: list[str], p_value: float = 0.05) -> DataFrame:
    """term, estimate: from every single deletion a path drops the least significant regressor while a restriction test against the full model stands; the final models' best by bic. One Gram aggregate."""
    m = Moments.of(df.dropna(subset=[y, *pool]), [y, *pool])
    full = m.solve(y, ["const", *pool])[2]
    dof = m.n - len(pool) - 1

    def fit(x):
        b, inv, rss = m.solve(y, ["const", *x])
        s = rss / (m.n - len(x) - 1)
        return b, np.array([dist.t_two_sided(v / math.sqrt(s * inv[i, i]), m.n - len(x) - 1) for i, v in enumerate(b)])[1:], rss

    def allowed(rss, gone):
        return gone == 0 or dist.f_sf((rss - full) / gone / (full / dof), gone, dof) > p_value

    ends: dict[tuple, float] = {}
    for first in [None, *pool]:
        x = [c for c in pool if c != first]
        if first is not None and not allowed(fit(x)[2], 1):
            continue
        while x:
            _, p, _ = fit(x)
            i = int(np.argmax(p))
            if p[i] <= p_value:
                break
            less = [c for c in x if c != x[i]]
            if not allowed(fit(less)[2], len(pool) - len(less)):
                break
            x = less
        ends[tuple(x)] = m.n * math.log(fit(x)[2] / m.n) + math.log(m.n) * (len(x) + 2)
    chosen = list(min(ends, key=ends.get))
    b = m.solve(y, ["const", *chosen])[0]
    return rows(df.sparkSession, [{"term": t, "estimate": float(v)} for t, v in zip(["const", *chosen], b, strict=True)], "term string, estimate double")


def penalised_path(df: DataFrame, y: str, x: list[str], alpha: float = 1.0, points: int = 20, ratio: float = 1e-3, criterion: str = "bic") -> DataFrame:
    """lam, term, estimate, chosen: an elastic-net path on one Gram matrix, the penalty by aic, bic or ebic."""
    from .regression import _standard

    d = df.dropna(subset=[y, *x])
    m = Moments.of(d, [y, *x])
    s, xy, sd, ym = _standard(m, y, x)
    var = m.sub([y])[0, 0] / m.n - ym**2
    top = np.abs(xy).max() / max(alpha, 1e-3)
    b, got = np.zeros(len(x)), []
    for lam in np.geomspace(top, top * ratio, points):
        for _ in range(5000):
            old = b.copy()
            for j in range(len(x)):
                r = xy[j] - s[j] @ b + b[j]
                b[j] = math.copysign(max(abs(r) - lam * alpha, 0.0), r) / (1 + lam * (1 - alpha))
            if np.abs(b - old).max() < 1e-11:
                break
        rss = max(1e-300, var - 2 * b @ xy + b @ s @ b)
        k = int((b != 0).sum())
        pen = {"aic": 2 * k, "bic": math.log(m.n) * k, "ebic": math.log(m.n) * k + 2 * k * math.log(max(2, len(x)))}[criterion]
        raw = b / sd
        got.append((float(lam), m.n * math.log(rss) + pen, [float(ym - raw @ (m.sub(x, ["const"])[:, 0] / m.n)), *map(float, raw)]))
    best = min(got, key=lambda g: g[1])[0]
    return rows(df.sparkSession, [{"lam": lam, "term": t, "estimate": v, "chosen": lam == best} for lam, _, b in got for t, v in zip(["const", *x], b, strict=True)], "lam double, term string, estimate double, chosen boolean")


# -- instruments and diagnostics -----------------------------------------------------


def weak_instruments(df: DataFrame, exog: list[str], endog: list[str], instruments: list[str]) -> DataFrame:
    """statistic, value: Cragg-Donald and Kleibergen-Paap (robust) rank F, and first-stage F of each endogenous column."""
    cols = [*exog, *endog, *instruments]
    d = df.dropna(subset=cols)
    m = Moments.of(d, cols)
    own, z = ["const", *exog], instruments
    o = guarded_inverse(m.sub(own))
    part = lambda a, b: m.sub(a, b) - m.sub(a, own) @ o @ m.sub(own, b)
    zz, zx, xx = part(z, z), part(z, endog), part(endog, endog)
    pi = guarded_inverse(zz) @ zx
    n, k, l = m.n, len(endog), len(z)  # noqa: E741
    s = (xx - zx.T @ pi) / (n - l - len(own))
    cd = float(np.min(np.linalg.eigvals(np.linalg.solve(s, pi.T @ zz @ pi)).real)) / l
    # Robust covariance of the first-stage coefficients.
    gamma = o @ m.sub(own, z)
    resid = []
    full = [m.solve(c, [*own, *z])[0] for c in endog]
    for c, b in zip(endog, full, strict=True):
        resid.append(F.col(c) - linear(b, [*own, *z]))
    zt = [F.col(c) - linear(gamma[:, i], own) for i, c in enumerate(z)]
    g = d.select(*[(e * q).alias(f"s{i}_{j}") for i, e in enumerate(resid) for j, q in enumerate(zt)])
    names = [f"s{i}_{j}" for i in range(k) for j in range(l)]
    meat = gram(g, names)[1][1:, 1:]
    a = np.kron(np.eye(k), guarded_inverse(zz))
    v = a @ meat @ a.T * n / (n - l - len(own))
    if k == 1:
        kp = float(pi[:, 0] @ guarded_inverse(v) @ pi[:, 0]) / l
    else:
        # Rank test: the least singular direction of the scaled coefficients.
        lx, lz = np.linalg.cholesky(guarded_inverse(s)), np.linalg.cholesky(zz)
        th = lz.T @ pi @ lx
        u, sv, vt = np.linalg.svd(th)
        q = u[:, k - 1 :]
        w = vt[k - 1 :]
        r = np.kron(w @ lx.T, q.T @ lz.T)
        lam = (q.T @ th @ w.T).T.ravel()
        kp = float(lam @ guarded_inverse(r @ v @ r.T) @ lam) / l
    out = [("cragg_donald", cd), ("kleibergen_paap", kp)]
    for c in endog:
        r0, r1 = m.solve(c, own)[2], m.solve(c, [*own, *z])[2]
        out.append((f"first_stage_{c}", (r0 - r1) / l / (r1 / (n - l - len(own)))))
    return rows(df.sparkSession, [{"statistic": a, "value": float(b)} for a, b in out], "statistic string, value double")


def breusch_godfrey(fit: Fit, order: str, lags: int = 1) -> DataFrame:
    """Residuals on regressors and lagged residuals (zero before the first row): n R2 and its F form. The order must have distinct values."""
    from ..plans.ordered import ordered_lags

    x = [t for t in fit.terms if t != "const"]
    d = fit.df.withColumn("_u", fit.residual())
    d = ordered_lags(d, "_u", order, lags)
    names = [f"_u_l{j}" for j in range(1, lags + 1)]
    d = d.fillna(0.0, subset=names)
    n, r2, _ = _auxiliary(d, "_u", [*x, *names])
    dof = n - len(fit.terms) - lags
    f = r2 / lags / ((1 - r2) / dof)
    return rows(fit.df.sparkSession, [{"test": "breusch_godfrey", "statistic": float(n * r2), "df1": float(lags), "df2": None, "p_value": float(dist.chi2_sf(n * r2, lags))}, {"test": "breusch_godfrey_f", "statistic": float(f), "df1": float(lags), "df2": float(dof), "p_value": float(dist.f_sf(f, lags, dof))}], "test string, statistic double, df1 double, df2 double, p_value double")


def siegel_tukey(df: DataFrame, y: str, group: str) -> DataFrame:
    """Equal spread of two groups: normal approximation of the rank sum, ranks being dealt from both ends (ties get their mean): test, statistic, df1, df2, p_value."""
    d = df.select(F.col(y).cast("double").alias("y"), F.col(group).alias("g")).where("y is not null and g is not null")
    kept = Kept(d.groupBy("y", "g").agg(F.count("*").alias("c")))
    cells = kept.rows.groupBy("g").agg(F.sum("c").alias("n")).orderBy("g").limit(3).collect()
    if len(cells) != 2:
        kept.drop()
        raise ValueError("a two-sample test needs two groups")
    a, b = cells
    n = a.n + b.n
    values = kept.rows.groupBy("y").agg(F.sum("c").alias("_c"), F.sum(F.when(F.col("g") == F.lit(a.g), F.col("c")).otherwise(0)).alias("own"))
    # Places as doubles: squares of half the rows exceed an integer from some 93,000 rows on.
    r, c = F.col("r"), F.col("_c")
    lo = r - (c - 1) / 2  # first and last place of a value
    hi = r + (c - 1) / 2
    half = float((n + 1) // 2)

    def total(m):
        """Sum of the ranks of places 1..m: from the bottom 1, 4, 5, 8, 9.., from the top 2, 3, 6, 7.."""
        low = F.least(m, F.lit(half))
        # Place i <= half has rank 2 i - 1 if i is odd, else 2 i.
        s_low = low * low + F.floor(low / 2)
        # Place i > half counts j = n + 1 - i from the top: rank 2 j if j is odd, else 2 j - 1.
        up = lambda j: j * (j + 1) - F.floor(j / 2)
        s_high = F.when(m > half, up(F.lit(n - half)) - up(F.lit(float(n)) - m)).otherwise(0.0)
        return s_low + s_high

    scored = value_ranks(values, "y", "r").select("_c", "own", ((total(hi) - total(lo - 1)) / c).alias("s"))
    k, m = (n + 1) // 2, n // 2
    mean = (k * k + k // 2 + m * (m + 1) - m // 2) / n
    gap = F.col("s") - mean
    over, var = scored.agg(F.sum(F.col("own") * gap), F.sum(c * gap * gap) / n).first()
    kept.drop()
    z = over / math.sqrt(var * a.n * b.n / (n - 1))
    return _test(df.sparkSession, "siegel_tukey", z, 1, 2 * (1 - dist.norm_cdf(abs(z))))


def signed_rank(df: DataFrame, y: str, pair: str) -> DataFrame:
    """Wilcoxon of y - pair: normal approximation with ties, zeros left out.

    Distances and their counts are stored once: computed again, a sum of doubles may differ in its last digit.
    """
    d = df.select((F.col(y) - F.col(pair)).alias("d")).where("d is not null and d <> 0")
    kept = Kept(d.groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("_c"), F.count_if(F.col("d") > 0).alias("up")))
    r = F.col("r")
    n, w, ss = value_ranks(kept.rows, "a", "r").agg(F.sum("_c"), F.sum(F.col("up") * r), F.sum(F.col("_c") * r * r)).first()
    kept.drop()
    z = (w - n * (n + 1) / 4) / math.sqrt(ss / 4)
    return _test(df.sparkSession, "signed_rank", z, 1, 2 * (1 - dist.norm_cdf(abs(z))))


#: Distributions that edf_tests knows: their parameters from mean, spread, and log moments.
DISTRIBUTIONS = ("normal", "exponential", "logistic", "gumbel", "weibull", "lognormal")


def edf_tests(df: DataFrame, y: str, distribution: str = "normal", theta: tuple[float, float] | None = None) -> DataFrame:
    """test (ks, cramer_von_mises, anderson_darling, watson), statistic, first, second (parameters, by moments if not given)."""
    from .describe import edf_of

    d = df.select(F.col(y).cast("double").alias("y")).where("y is not null")
    n, m, s, lm, ls = d.agg(F.count("*"), F.avg("y"), F.stddev_samp("y"), F.avg(F.log("y")), F.stddev_samp(F.log("y"))).first()
    if theta is None:
        theta = {
            "normal": lambda: (m, s),
            "exponential": lambda: (m, 0.0),
            "logistic": lambda: (m, s * math.sqrt(3) / math.pi),
            "gumbel": lambda: (m - 0.5772156649015329 * s * math.sqrt(6) / math.pi, s * math.sqrt(6) / math.pi),
            "weibull": lambda: (lambda k: (k, math.exp(lm + 0.5772156649015329 / k)))(math.pi / (ls * math.sqrt(6))),
            "lognormal": lambda: (lm, ls),
        }[distribution]()
    a, b = theta
    x = F.col("y")
    p = {
        "normal": lambda: normal_cdf((x - a) / b),
        "exponential": lambda: 1 - F.exp(-x / a),
        "logistic": lambda: 1 / (1 + F.exp(-(x - a) / b)),
        "gumbel": lambda: F.exp(-F.exp(-(x - a) / b)),
        "weibull": lambda: 1 - F.exp(-F.pow(x / b, a)),
        "lognormal": lambda: normal_cdf((F.log(x) - a) / b),
    }[distribution]()
    got = edf_of(d, p, n)
    return rows(df.sparkSession, [{"test": k, "statistic": float(v), "first": float(a), "second": float(b)} for k, v in got.items()], "test string, statistic double, first double, second double")


def median_scale(df: DataFrame, column: str) -> float:
    """Median absolute deviation over 0.6745."""
    m = exact_quantiles(df, {column: [0.5]})[column][0]
    return exact_quantiles(df.select(F.abs(F.col(column) - m).alias("a")), {"a": [0.5]})["a"][0] / 0.6744897501960817

