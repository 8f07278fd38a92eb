"""Limited dependent variables, robust and instrumented estimation, variable selection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import normal_cdf
from ..functions.linalg import guarded_inverse
from ..plans.gram import Moments, gram
from ..plans.likelihood import Maximum, by_indices, maximise
from ..plans.ordered import exact_quantiles
from .describe import rows
from .regression import Fit, binary, coefficient_table, linear, ols


def cdf(z: np.ndarray) -> np.ndarray:
    return dist.norm_cdf_array(z)


def log_cdf(z: np.ndarray) -> np.ndarray:
    """Of the normal; by its tail expansion far below."""
    far = z < -8
    with np.errstate(all="ignore"):
        near = np.log(np.maximum(cdf(np.where(far, 0, z)), 1e-300))
        tail = -0.5 * z * z - np.log(-np.where(far, z, -1.0)) - 0.5 * math.log(2 * math.pi)
    return np.where(far, tail, near)


def log_pdf(z: np.ndarray) -> np.ndarray:
    return -0.5 * z * z - 0.5 * math.log(2 * math.pi)


def mills(z: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First derivative of log_cdf and the second with its sign turned, given log_cdf(z)."""
    far = z < -8
    t = np.where(far, z, -1.0)
    first = np.where(far, -t - 1 / t, np.exp(log_pdf(np.where(far, 0.0, z)) - np.where(far, 0.0, log)))
    return first, np.where(far, 1 - 1 / (t * t), first * (z + first))


def _table(df: DataFrame, terms: list[str], m: Maximum, theta: np.ndarray | None = None, cov: np.ndarray | None = None) -> DataFrame:
    return coefficient_table(df.sparkSession, [*terms], m.theta if theta is None else theta, m.cov if cov is None else cov)


def ordered(df: DataFrame, y: str, x: list[str], link: str = "logit") -> DataFrame:
    """Ordered logit or probit: slopes and cutpoints cut1.. as one coefficient table."""
    grades = [r[0] for r in df.select(F.col(y)).where(F.col(y).isNotNull()).distinct().orderBy(y).limit(51).collect()]
    if len(grades) > 50:
        raise ValueError("more than 50 grades")
    counts = dict(df.groupBy(y).count().where(F.col(y).isNotNull()).collect())
    share = np.cumsum([counts[g] for g in grades])[:-1] / sum(counts.values())
    start = np.log(share / (1 - share)) if link == "logit" else np.array([dist.norm_ppf(s) for s in share])
    k, c = len(x), len(grades) - 1
    at = np.array(grades, float)
    p = (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))) if link == "logit" else cdf

    def log(theta, v):
        cuts = np.concatenate(([-1e9], theta[k] + np.concatenate(([0.0], np.cumsum(np.exp(theta[k + 1 :])))), [1e9]))
        g = np.searchsorted(at, v[:, 0])
        s = v[:, 1:] @ theta[:k]
        return np.log(np.maximum(p(cuts[g + 1] - s) - p(cuts[g] - s), 1e-300))

    m = maximise(df, [y, *x], log, np.concatenate((np.zeros(k), start[:1], np.log(np.diff(start)))))
    gaps = np.exp(m.theta[k + 1 :])
    jac = np.zeros((k + c, k + c))
    jac[: k + 1, : k + 1] = np.eye(k + 1)
    for i in range(1, c):
        jac[k + i, k] = 1
        jac[k + i, k + 1 : k + 1 + i] = gaps[:i]
    theta = np.concatenate((m.theta[:k], m.theta[k] + np.concatenate(([0.0], np.cumsum(gaps)))))
    return _table(df, [*x, *[f"cut{i + 1}" for i in range(c)]], m, theta, jac @ m.cov @ jac.T)


def multinomial(df: DataFrame, y: str, x: list[str]) -> DataFrame:
    """Multinomial logit against the smallest category: terms are {category}:{regressor}."""
    grades = [r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().orderBy(y).limit(51).collect()]
    if len(grades) > 50:
        raise ValueError("more than 50 categories")
    index = F.create_map(*[F.lit(v) for k, g in enumerate(grades) for v in (g, float(k))])
    k, c = len(x) + 1, len(grades) - 1

    def log(theta, v):
        z = np.column_stack([np.ones(len(v)), v[:, 1:]])
        s = np.column_stack([np.zeros(len(v)), z @ theta.reshape(c, k).T])
        top = s.max(1)
        return s[np.arange(len(v)), v[:, 0].astype(int)] - top - np.log(np.exp(s - top[:, None]).sum(1))

    m = maximise(df.withColumn("_k", index[F.col(y)]), ["_k", *x], log, np.zeros(c * k))
    return _table(df, [f"{g}:{t}" for g in grades[1:] for t in ["const", *x]], m)


def tobit(df: DataFrame, y: str, x: list[str], lower: float = 0.0, upper: float = math.inf) -> DataFrame:
    """Censored normal regression; the last term is sigma."""
    f = ols(df, y, x, "ols")

    def log(theta, v):
        z = np.column_stack([np.ones(len(v)), v[:, 1:]]) @ theta[:-1]
        s = np.exp(theta[-1])
        q = v[:, 0]
        return np.where(q <= lower, log_cdf((lower - z) / s), np.where(q >= upper, log_cdf((z - upper) / s), log_pdf((q - z) / s) - theta[-1]))

    def derivatives(theta, v):
        one = np.ones((len(v), 1))
        design = np.hstack([one, v[:, 1:]])
        z, s, q = design @ theta[:-1], math.exp(theta[-1]), v[:, 0]
        low, high = q <= lower, q >= upper
        cut = low | high
        e = (q - z) / s
        # Rows inside the bounds, then those at one of them.
        first = [np.where(cut, 0.0, e / s), np.where(cut, 0.0, e * e - 1)]
        second = {(0, 0): np.where(cut, 0.0, -1 / s**2), (0, 1): np.where(cut, 0.0, -2 * e / s), (1, 1): np.where(cut, 0.0, -2 * e * e)}
        ll = float(np.where(cut, 0.0, log_pdf(e) - theta[-1]).sum())
        if cut.any():
            w = np.where(low[cut], lower - z[cut], z[cut] - upper) / s
            chance = log_cdf(w)
            a, b = mills(w, chance)
            wz = np.where(low[cut], -1 / s, 1 / s)
            ll += float(chance.sum())
            first[0][cut], first[1][cut] = a * wz, -a * w
            second[0, 0][cut], second[0, 1][cut], second[1, 1][cut] = -b * wz * wz, b * wz * w - a * wz, -b * w * w + a * w
        return by_indices(ll, [design, one], first, second)

    return _scaled(df, maximise(df, [y, *x], log, np.concatenate((f.b, [0.5 * math.log(f.rss / f.n)])), derivatives=derivatives), x)


def truncated(df: DataFrame, y: str, x: list[str], lower: float = 0.0) -> DataFrame:
    """Regression on rows above a truncation point only; the last term is sigma."""
    d = df.where(F.col(y) > lower)
    f = ols(d, y, x, "ols")

    def log(theta, v):
        z = np.column_stack([np.ones(len(v)), v[:, 1:]]) @ theta[:-1]
        s = np.exp(theta[-1])
        return log_pdf((v[:, 0] - z) / s) - theta[-1] - log_cdf((z - lower) / s)

    return _scaled(d, maximise(d, [y, *x], log, np.concatenate((f.b, [0.5 * math.log(f.rss / f.n)]))), x)


def _scaled(df: DataFrame, m: Maximum, x: list[str]) -> DataFrame:
    s = math.exp(m.theta[-1])
    j = np.diag([1.0] * (len(m.theta) - 1) + [s])
    return _table(df, ["const", *x, "sigma"], m, np.concatenate((m.theta[:-1], [s])), j @ m.cov @ j)


def heckman(df: DataFrame, y: str, x: list[str], selected: str, z: list[str]) -> DataFrame:
    """Two steps: probit of selection, then least squares with the inverse Mills ratio; terms end with lambda and sigma."""
    sel = binary(df, selected, z, "probit")
    eta = linear(sel.b, sel.terms)
    mills = F.exp(-eta * eta / 2) / math.sqrt(2 * math.pi) / F.greatest(normal_cdf(eta), F.lit(1e-12))
    d = df.where(F.col(selected) > 0.5).withColumn("lambda", mills).withColumn("_delta", F.col("lambda") * (F.col("lambda") + eta))
    f = ols(d, y, [*x, "lambda"], "ols")
    delta = f.df.agg(F.avg("_delta")).first()[0]
    sigma = math.sqrt(f.rss / f.n + delta * f.b[-1] ** 2)
    return rows(df.sparkSession, [{"term": t, "estimate": float(v)} for t, v in zip([*f.terms, "sigma", "rho"], [*f.b, sigma, f.b[-1] / sigma], strict=True)], "term string, estimate double")


#: Tuning constants for 95 % efficiency at the normal.
TUNING = {"huber": 1.345, "bisquare": 4.685}


def robust_regression(df: DataFrame, y: str, x: list[str], psi: str = "huber", steps: int = 50, tol: float = 1e-8) -> Fit:
    """M estimation by reweighted least squares; scale from the median absolute residual, one weighted Gram aggregate a step."""
    df = df.dropna(subset=[y, *x])
    f = ols(df, y, x, "ols")
    k = TUNING[psi]
    for _ in range(steps):
        e = f.residual()
        s = exact_quantiles(df.select(F.abs(e).alias("a")), {"a": [0.5]})["a"][0] / 0.6744897501960817
        u = F.abs(e) / (k * s)
        w = F.when(u <= 1, 1.0).otherwise(1 / u) if psi == "huber" else F.when(u < 1, F.pow(1 - u * u, 2)).otherwise(0.0)
        m = Moments.of(df.select(y, *x, w.alias("_w")), [y, *x], "_w")
        b, _, _ = m.solve(y, f.terms)
        moved = np.abs(b - f.b).max()
        f.b = b
        if moved < tol * (1 + np.abs(b).max()):
            break
    e = f.residual()
    r = F.abs(e) / s
    p = (F.when(r <= k, e).otherwise(F.signum(e) * k * s) if psi == "huber" else F.when(r < k, e * F.pow(1 - F.pow(r / k, 2), 2)).otherwise(0.0)) / s
    d = (F.when(r <= k, 1.0).otherwise(0.0) if psi == "huber" else F.when(r < k, (1 - F.pow(r / k, 2)) * (1 - 5 * F.pow(r / k, 2))).otherwise(0.0))
    pp, dd = df.agg(F.sum(p * p), F.avg(d)).first()
    f.v = s * s * pp / (f.n - len(f.terms)) / dd**2 * f.inv
    f.extra = {"scale": s}
    return f


def select_variables(df: DataFrame, y: str, pool: list[str], method: str = "forward", criterion: str = "bic") -> DataFrame:
    """forward, backward or best subset by aic or bic: one Gram aggregate, then no further look at the data. term, estimate."""
    m = Moments.of(df.dropna(subset=[y, *pool]), [y, *pool])

    def ic(x):
        rss = m.solve(y, ["const", *x])[2]
        return m.n * math.log(rss / m.n) + (2 if criterion == "aic" else math.log(m.n)) * (len(x) + 2)

    if method == "best":
        if len(pool) > 16:
            raise ValueError("best subset takes 16 variables at most")
        subsets = [[c for k, c in enumerate(pool) if bits >> k & 1] for bits in range(1 << len(pool))]
        chosen = min(subsets, key=ic)
    else:
        chosen = [] if method == "forward" else list(pool)
        while True:
            options = [[*chosen, c] for c in pool if c not in chosen] if method == "forward" else [[o for o in chosen if o != c] for c in chosen]
            best = min(options, key=ic, default=None)
            if best is None or ic(best) >= ic(chosen):
                break
            chosen = best
    b = m.solve(y, ["const", *chosen])[0]
    return rows(df.sparkSession, [{"term": t, "estimate": float(v)} for t, v in zip(["const", *chosen], b, strict=True)], "term string, estimate double")


def gmm(df: DataFrame, y: str, x: list[str], instruments: list[str]) -> DataFrame:
    """Linear two-step GMM with a constant among both: coefficient rows, then j_stat (its p-value beside it)."""
    df = df.dropna(subset=[y, *x, *instruments])
    m = Moments.of(df, list(dict.fromkeys([y, *x, *instruments])))
    xs, zs = ["const", *x], ["const", *instruments]
    zx, zy = m.sub(zs, xs) / m.n, m.sub(zs, [y])[:, 0] / m.n
    w = guarded_inverse(m.sub(zs) / m.n)
    b = np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy)
    for _ in range(2):
        e = F.col(y) - linear(b, xs)
        s = gram(df.select(*[(e * (F.lit(1.0) if z == "const" else F.col(z))).alias(f"g{i}") for i, z in enumerate(zs)]), [f"g{i}" for i in range(len(zs))])[1][1:, 1:] / m.n
        w = guarded_inverse(s)
        b = np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy)
    g = zy - zx @ b
    j = float(m.n * g @ w @ g)
    v = guarded_inverse(zx.T @ w @ zx) / m.n
    over = len(zs) - len(xs)
    out = [{"term": t, "estimate": float(a), "std_error": float(math.sqrt(s)), "p_value": 2 * (1 - dist.norm_cdf(abs(a / math.sqrt(s))))} for t, a, s in zip(xs, b, np.diag(v), strict=True)]
    return rows(df.sparkSession, [*out, {"term": "j_stat", "estimate": j, "std_error": None, "p_value": dist.chi2_sf(j, over) if over else None}], "term string, estimate double, std_error double, p_value double")


def jarque_bera(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, statistic, p_value: native moments."""
    parts = []
    for c in columns:
        jb = F.count(c) / 6 * (F.pow(F.skewness(c), 2) + F.pow(F.kurtosis(c), 2) / 4)
        parts.append(F.struct(F.lit(c).alias("variable"), jb.alias("statistic"), F.exp(-jb / 2).alias("p_value")))
    return df.agg(F.array(*parts).alias("v")).select(F.inline("v"))


def mardia(df: DataFrame, columns: list[str]) -> DataFrame:
    """Multivariate kurtosis against the normal, from squared distances in one aggregate: n, kurtosis, statistic, p_value."""
    m = Moments.of(df.dropna(subset=columns), columns)
    mean = m.sub(columns, ["const"])[:, 0] / m.n
    inv = np.linalg.inv(m.sub(columns) / m.n - np.outer(mean, mean))
    q = F.lit(0.0)
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            q = q + float(inv[i, j]) * (F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j]))
    k = df.dropna(subset=columns).agg(F.avg(q * q)).first()[0]
    p = len(columns)
    s = (k - p * (p + 2)) / math.sqrt(8 * p * (p + 2) / m.n)
    return rows(df.sparkSession, [{"n": m.n, "kurtosis": k, "statistic": s, "p_value": 2 * (1 - dist.norm_cdf(abs(s)))}], "n long, kurtosis double, statistic double, p_value double")


def lp_did(df: DataFrame, y: str, unit: str, time: str, first: str, horizon: int = 5, pre: int = 3) -> DataFrame:
    """Local-projection differences: for each horizon, y(t + h) - y(t - 1) of units treated at t against units not treated by t + h, with period effects. horizon, estimate, n."""
    from .transforms import panel_shift

    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.coalesce(F.col(first), F.lit(0)).alias("g"), F.col(y).cast("double").alias("y"))
    hs = [h for h in range(-pre, horizon + 1) if h != -1]
    d = d.withColumn("_b", panel_shift(d, "y", 1, "u", "t"))
    for h in hs:
        d = d.withColumn(f"_h{h}".replace("-", "m"), panel_shift(d, "y", -h, "u", "t") - F.col("_b"))
    out = None
    for h in hs:
        c = f"_h{h}".replace("-", "m")
        clean = d.where((F.col("g") == F.col("t")) | (F.col("g") == 0) | (F.col("g") > F.col("t") + max(h, 0))).select("t", (F.col("g") == F.col("t")).cast("double").alias("s"), F.col(c).alias("dy")).dropna()
        by = clean.groupBy("t").agg(F.avg("s").alias("ms"), F.avg("dy").alias("md"), F.sum(F.col("s") * F.col("dy")).alias("sd"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.count("*").alias("n"))
        one = by.agg(F.try_divide(F.sum(F.col("sd") - F.col("n") * F.col("ms") * F.col("md")), F.sum(F.col("ss") - F.col("n") * F.col("ms") * F.col("ms"))).alias("estimate"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(h).alias("horizon"), "estimate", "n")
        out = one if out is None else out.union(one)
    return out


def mean_group(df: DataFrame, y: str, x: list[str], unit: str) -> DataFrame:
    """Regressions by unit as grouped aggregates of one row a unit, averaged: term, estimate, std_error."""
    if len(x) == 1:
        by = df.groupBy(unit).agg(F.regr_slope(F.col(y), F.col(x[0])).alias("b"), F.regr_intercept(F.col(y), F.col(x[0])).alias("a")).where("b is not null")
        return by.agg(F.array(*[F.struct(F.lit(t).alias("term"), F.avg(c).alias("estimate"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias("std_error")) for t, c in (("const", "a"), (x[0], "b"))]).alias("v")).select(F.inline("v"))
    from ..functions.linalg import ols as solve
    from .kernels import per_series

    got = per_series(df.withColumn("_t", F.lit(0)), [y, *x], "_t", lambda _, v: {"term": ["const", *x], "b": solve(v[:, 0], np.column_stack([np.ones(len(v)), v[:, 1:]]))[0]}, "term string, b double", unit)
    return got.groupBy("term").agg(F.avg("b").alias("estimate"), (F.stddev_samp("b") / F.sqrt(F.count("b"))).alias("std_error"))
