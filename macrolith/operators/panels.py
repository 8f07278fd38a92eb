"""More of panel models: autocorrelated and cross-correlated errors, Hausman-Taylor, discrete outcomes with unit effects, further difference-in-differences estimators and their checks.

Unit likelihoods are kernels, one unit each; only sums over units leave them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.linalg import guarded_inverse
from ..plans.gram import Moments, gram
from ..plans.store import Kept
from .describe import rows
from .further import _unit_sums
from .limited import log_cdf
from .panel import EventEffects, fixed_effects, group_time_att
from .regression import Fit, coefficient_table, ols, robust
from .transforms import demean, panel_shift, two_way_demean

# -- errors -----------------------------------------------------------------------


def pcse(df: DataFrame, y: str, x: list[str], unit: str, time: str, pairwise: bool = False) -> Fit:
    """Pooled least squares with panel-corrected errors (Beck and Katz); casewise uses the periods that all units have, pairwise those of each pair.

    The covariance of units is a matrix of units, so their number is the model's size.
    """
    fit = ols(df, y, x, "ols")
    e = fit.residual()
    d = fit.df.select(F.col(unit).alias("u"), F.col(time).alias("t"), e.alias("e"), F.lit(1.0).alias("const"), *[F.col(c).cast("double").alias(c) for c in x])
    units = [r.u for r in d.select("u").distinct().orderBy("u").limit(2001).collect()]
    if len(units) > 2000:
        raise ValueError("panel-corrected errors take 2000 units at most")
    # A row a period; products of units are summed in Arrow batches, so periods may be as many as there are.
    wide = d.groupBy("t").pivot("u", units).agg(F.first("e")).toDF("t", *[f"_u{i}" for i in range(len(units))])
    names = [f"_u{i}" for i in range(len(units))]
    full = wide.dropna(subset=names)
    whole = not pairwise and full.limit(1).count() > 0
    n, g = gram(full if whole else wide.fillna(0.0, subset=names), names)
    s = g[1:, 1:] / n
    if pairwise:
        s = g[1:, 1:] / np.maximum(gram(wide.select(*[F.col(c).isNotNull().cast("double").alias(c) for c in names]), names)[1][1:, 1:], 1)
    at = {u: i for i, u in enumerate(units)}
    terms = fit.terms

    def period(g):
        k = [at[u] for u in g.u]
        q = g[terms].to_numpy(float)
        m = (q.T @ s[np.ix_(k, k)] @ q).ravel()
        return pd.DataFrame({"at": range(len(m)), "v": m})

    # All rows of a period meet in one task, at most one a unit.
    got = d.groupBy("t").applyInPandas(period, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    meat = np.array([r.v for r in got]).reshape(len(terms), len(terms))
    fit.v = fit.inv @ meat @ fit.inv
    fit.cov = "pcse"
    return fit


def prais_winsten(df: DataFrame, y: str, x: list[str], unit: str, time: str, common: bool = True) -> Fit:
    """Quasi-differences with a common (or a unit's own) first autocorrelation of least-squares residuals; a unit's first row is scaled by the root of 1 - rho^2. extra: rho."""
    fit = ols(df, y, x, "ols")
    d = fit.df.withColumn("_e", fit.residual())
    d = d.withColumn("_l", panel_shift(d, "_e", 1, unit, time))
    both = d.where("_l is not null")
    r = (F.sum(F.col("_e") * F.col("_l")) / F.sum(F.col("_l") * F.col("_l"))).alias("_rho")
    rho = both.agg(r).first()[0] if common else None
    d = d.withColumn("_rho", F.lit(float(rho))) if common else d.join(both.groupBy(unit).agg(F.greatest(F.lit(-0.99), F.least(F.lit(0.99), r)).alias("_rho")), unit)
    cols = [y, *x]
    d = d.withColumns({f"_p_{c}": panel_shift(d, c, 1, unit, time) for c in cols})
    first = F.col(f"_p_{y}").isNull()
    scale = F.sqrt(1 - F.col("_rho") * F.col("_rho"))
    d = d.select(unit, time, *[F.when(first, F.col(c) * scale).otherwise(F.col(c) - F.col("_rho") * F.col(f"_p_{c}")).alias(c) for c in cols], F.when(first, scale).otherwise(1 - F.col("_rho")).alias("intercept"))
    m = Moments.of(d, [*cols, "intercept"])
    terms = ["intercept", *x]
    b, inv, rss = m.solve(y, terms)
    out = Fit(y, terms, b, inv, inv * rss / (m.n - len(terms)), m.n, rss, m.sub([y])[0, 0], d, "ols")
    out.extra = {"rho": rho}
    return out


def hausman_taylor(df: DataFrame, y: str, exog: list[str], endog: list[str], fixed_exog: list[str], fixed_endog: list[str], unit: str, time: str) -> DataFrame:
    """Coefficient rows: within slopes, then random-effects weights with deviations, exogenous means and fixed exogenous columns as instruments."""
    vary, fixed = [*exog, *endog], [*fixed_exog, *fixed_endog]
    fe = fixed_effects(df, y, vary, unit, time, cov="ols")
    s_e = fe.extra["s2_e"]
    d = df.dropna(subset=[y, *vary, *fixed]).select(unit, time, *[F.col(c).cast("double").alias(c) for c in [y, *vary, *fixed]])
    resid = F.col(y)
    for c, b in zip(vary, fe.b, strict=True):
        resid = resid - float(b) * F.col(c)
    means = d.groupBy(unit).agg(F.avg(resid).alias("_d"), F.count("*").alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in [y, *vary]], *[F.first(c).alias(c) for c in fixed])
    # Fixed slopes from unit means, instrumented by the exogenous ones.
    z = [*fixed_exog, *[f"_m_{c}" for c in exog]]
    m = Moments.of(means, ["_d", *fixed, *z[len(fixed_exog) :]])
    xs, zs = ["const", *fixed], ["const", *z]
    pi = guarded_inverse(m.sub(zs)) @ m.sub(zs, xs)
    g = guarded_inverse(pi.T @ m.sub(zs, xs)) @ pi.T @ m.sub(zs, ["_d"])[:, 0]
    e = F.col("_d")
    for c, b in zip(xs, g, strict=True):
        e = e - float(b) * (F.lit(1.0) if c == "const" else F.col(c))
    s_b, hn = means.agg(F.avg(e * e), F.count("*") / F.sum(1 / F.col("_n"))).first()
    s_u = max(0.0, s_b - s_e / hn)
    theta = 1 - F.sqrt(F.lit(s_e) / (s_e + F.col("_n") * s_u))
    j = d.join(means.select(unit, "_n", *[f"_m_{c}" for c in [y, *vary]]), unit).withColumn("_th", theta)
    w = j.select(
        (F.col(y) - F.col("_th") * F.col(f"_m_{y}")).alias("y"), (1 - F.col("_th")).alias("const_"), *[(F.col(c) - F.col("_th") * F.col(f"_m_{c}")).alias(c) for c in vary], *[((1 - F.col("_th")) * F.col(c)).alias(c) for c in fixed],
        *[(F.col(c) - F.col(f"_m_{c}")).alias(f"_w_{c}") for c in vary], *[((1 - F.col("_th")) * F.col(f"_m_{c}")).alias(f"_b_{c}") for c in exog],
    )
    xs = ["const_", *vary, *fixed]
    zs = ["const_", *[f"_w_{c}" for c in vary], *[f"_b_{c}" for c in exog], *fixed_exog]
    m = Moments.of(w, sorted({"y", *xs, *zs}))
    zz = guarded_inverse(m.sub(zs))
    a = m.sub(xs, zs) @ zz
    inv = guarded_inverse(a @ m.sub(zs, xs))
    b = inv @ a @ m.sub(zs, ["y"])[:, 0]
    rss = m.sub(["y"])[0, 0] - 2 * b @ m.sub(xs, ["y"])[:, 0] + b @ m.sub(xs) @ b
    return coefficient_table(df.sparkSession, ["const", *vary, *fixed], b, inv * rss / (m.n - len(xs)))


# -- discrete outcomes ----------------------------------------------------------


def unit_maximum(df: DataFrame, columns: list[str], unit: str, time: str, log: Callable[[np.ndarray, np.ndarray], float], theta: np.ndarray, steps: int = 30, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum of a sum of unit log-likelihoods log(theta, the unit's rows) by Newton steps: theta, covariance, log-likelihood."""
    k = len(theta)

    def derivatives(t, v, th=None):
        h = 1e-4 * (1 + np.abs(th))
        e = np.diag(h)
        at = lambda q: log(th + q, v)
        mid = at(0 * h)
        up, down = [at(x) for x in e], [at(-x) for x in e]
        g = [(a - b) / (2 * s) for a, b, s in zip(up, down, h, strict=True)]
        hess = np.zeros((k, k))
        for i in range(k):
            hess[i, i] = (up[i] - 2 * mid + down[i]) / h[i] ** 2
            for j in range(i):
                hess[i, j] = hess[j, i] = (at(e[i] + e[j]) - at(e[i] - e[j]) - at(e[j] - e[i]) + at(-e[i] - e[j])) / (4 * h[i] * h[j])
        return np.concatenate(([mid], g, hess.ravel()))

    for _ in range(steps):
        s = _unit_sums(df, columns, time, unit, lambda t, v, th=theta: derivatives(t, v, th))
        ll, g, hess = s[0], s[1 : 1 + k], s[1 + k :].reshape(k, k)
        w, q = np.linalg.eigh(-hess)
        move = q @ ((q.T @ g) / np.maximum(np.abs(w), 1e-8 * max(1.0, np.abs(w).max())))
        if abs(g @ move) < tol * max(1.0, abs(ll)) * 1e-3:
            break
        sizes = 0.5 ** np.arange(6)
        tried = _unit_sums(df, columns, time, unit, lambda t, v, th=theta, mv=move: np.array([log(th + z * mv, v) for z in sizes]))
        best = int(np.argmax(tried))
        if tried[best] <= ll:
            break
        theta = theta + sizes[best] * move
    return theta, guarded_inverse(-hess), float(ll)


def conditional_logsum(s: np.ndarray, ones: int) -> float:
    """Log of the sum over all ways to choose that many rows of exp of their scores: a recursion over rows."""
    f = np.full(ones + 1, -math.inf)
    f[0] = 0.0
    for v in s:
        f[1:] = np.logaddexp(f[1:], f[:-1] + v)
    return float(f[ones])


def hermite(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of a standard normal expectation."""
    x, w = np.polynomial.hermite.hermgauss(n)
    return x * math.sqrt(2), w / math.sqrt(math.pi)


def _random_effect(link: str, quadrature: int):
    node, weight = hermite(quadrature)

    def log(theta, v):
        q = 2 * v[:, 0] - 1
        s = np.column_stack([np.ones(len(v)), v[:, 1:]]) @ theta[:-1]
        z = q[:, None] * (s[:, None] + math.exp(min(theta[-1], 5.0)) * node)
        each = -np.logaddexp(0, -z) if link == "logit" else log_cdf(z)
        t = each.sum(0) + np.log(weight)
        m = t.max()
        return float(m + math.log(np.exp(t - m).sum()))

    return log


def panel_binary(df: DataFrame, y: str, x: list[str], unit: str, time: str, link: str = "logit", model: str = "re", quadrature: int = 12) -> DataFrame:
    """Coefficient rows: pooled (errors by unit), fe (conditional logit; units without variation drop out), re (normal unit effects, last term sigma_u), cre (with unit means).

    Each Newton step reads the panel twice, so it is computed once and kept: joins that it comes from don't run, nor broadcast their tables, in each pass.
    """
    kept = [Kept(df.dropna(subset=[y, *x]).select(unit, time, *[F.col(c).cast("double").alias(c) for c in [y, *x]]))]
    names = list(x)
    if model == "cre":
        means = kept[0].rows.groupBy(unit).agg(*[F.avg(c).alias(f"mean_{c}") for c in x])
        kept.append(Kept(kept[0].rows.join(means, unit)))
        names += [f"mean_{c}" for c in x]
    try:
        return _unit_binary(kept[-1].rows, y, names, unit, time, link, model, quadrature)
    finally:
        for k in kept:
            k.drop()


def _unit_binary(d: DataFrame, y: str, x: list[str], unit: str, time: str, link: str, model: str, quadrature: int) -> DataFrame:
    if model == "fe":
        if link != "logit":
            raise ValueError("unit effects can be conditioned out of a logit only")

        def log(theta, v):
            n = int(round(v[:, 0].sum()))
            if n in (0, len(v)):
                return 0.0
            s = v[:, 1:] @ theta
            return float(s @ v[:, 0]) - conditional_logsum(s, n)

        b, cov, _ = unit_maximum(d, [y, *x], unit, time, log, np.zeros(len(x)))
        return coefficient_table(d.sparkSession, x, b, cov)
    if model == "pooled":

        def log(theta, v):
            z = (2 * v[:, 0] - 1) * (np.column_stack([np.ones(len(v)), v[:, 1:]]) @ theta)
            return float((-np.logaddexp(0, -z) if link == "logit" else log_cdf(z)).sum())

        b, cov, _ = unit_maximum(d, [y, *x], unit, time, log, np.zeros(1 + len(x)))

        def score(t, v):
            h = 1e-5
            g = np.array([(log(b + h * e, v) - log(b - h * e, v)) / (2 * h) for e in np.eye(len(b))])
            return np.concatenate((np.outer(g, g).ravel(), [1.0]))

        s = _unit_sums(d, [y, *x], time, unit, score)
        g = s[-1]
        return coefficient_table(d.sparkSession, ["const", *x], b, cov @ s[:-1].reshape(len(b), len(b)) @ cov * g / (g - 1))
    b, cov, _ = unit_maximum(d, [y, *x], unit, time, _random_effect(link, quadrature), np.concatenate((np.zeros(1 + len(x)), [-0.5])))
    sigma = math.exp(b[-1])
    jac = np.diag([1.0] * (len(b) - 1) + [sigma])
    return coefficient_table(d.sparkSession, ["const", *x, "sigma_u"], np.concatenate((b[:-1], [sigma])), jac @ cov @ jac)


def panel_margins(df: DataFrame, table: DataFrame, x: list[str], link: str = "logit", quadrature: int = 12) -> DataFrame:
    """term, effect: average effects on the chance of 1, over rows and (with a term sigma_u) over normal unit effects. table holds the coefficient rows."""
    b = {r.term: r.estimate for r in table.select("term", "estimate").collect()}
    node, weight = hermite(quadrature) if "sigma_u" in b else (np.zeros(1), np.ones(1))
    eta = F.lit(float(b.get("const", 0.0)))
    for c in x:
        eta = eta + float(b[c]) * F.col(c)
    total = F.lit(0.0)
    for z, w in zip(node, weight, strict=True):
        s = eta + float(z * b.get("sigma_u", 0.0))
        p = 1 / (1 + F.exp(-s))
        total = total + float(w) * (p * (1 - p) if link == "logit" else F.exp(-s * s / 2) / math.sqrt(2 * math.pi))
    scale = df.agg(F.avg(total)).first()[0]
    return rows(df.sparkSession, [{"term": c, "effect": float(b[c] * scale)} for c in x], "term string, effect double")


# -- difference-in-differences ---------------------------------------------------


def sun_abraham(df: DataFrame, y: str, unit: str, time: str, first: str, leads: int = 3, horizon: int = 3) -> DataFrame:
    """event_time, estimate, std_error: cohort by event time marks in a two-way regression, averaged with cohort shares; the reference is -1."""
    return sun_abraham_effects(df, y, unit, time, first, leads, horizon).table(df.sparkSession)


def sun_abraham_effects(df: DataFrame, y: str, unit: str, time: str, first: str, leads: int = 3, horizon: int = 3) -> EventEffects:
    d = df.select(unit, time, F.coalesce(F.col(first), F.lit(0)).alias("_g"), F.col(y).cast("double").alias(y)).dropna(subset=[y])
    cohorts = [r for r in d.where("_g > 0").groupBy("_g").agg(F.count_distinct(unit).alias("n")).orderBy("_g").limit(101).collect()]
    if len(cohorts) > 100:
        raise ValueError("more than 100 cohorts")
    ks = [k for k in range(-leads, horizon + 1) if k != -1]
    e = F.greatest(F.lit(-leads), F.least(F.lit(horizon), F.col(time) - F.col("_g")))
    names, cells = [], []
    for r in cohorts:
        for k in ks:
            names.append(f"c{r['_g']}_{k}".replace("-", "m"))
            cells.append(((F.col("_g") == r["_g"]) & (e == k)).cast("double").alias(names[-1]))
    w = two_way_demean(d.select(unit, time, y, *cells), [y, *names], unit, time)
    m = Moments.of(w, [y, *names])
    # Cells that no row has, or that unit and time effects span, have no coefficient.
    kept = [n for n in names if m.sub([n])[0, 0] > 1e-9]
    b, inv, rss = m.solve(y, kept)
    fit = Fit(y, kept, b, inv, inv, m.n, rss, m.sub([y])[0, 0], w)
    v = robust(fit, "cluster", unit)
    found, weight = [], []
    for k in ks:
        g = np.array([next((float(r.n) for r in cohorts if n == f"c{r['_g']}_{k}".replace("-", "m")), 0.0) for n in kept])
        if g.sum():
            found.append(k)
            weight.append(g / g.sum())
    a = np.array(weight).reshape(len(found), len(kept))
    return EventEffects(found, a @ b, a @ v @ a.T)


def long_differences(df: DataFrame, y: str, unit: str, time: str, first: str, control: str = "notyet", draws: int = 50, seed: int = 1) -> DataFrame:
    """event_time, att, std_error, n: cohort long differences from the period before treatment, averaged over cohorts; errors from units drawn with Poisson weights."""
    att = group_time_att(df, y, unit, time, first, control)
    point = att.groupBy((F.col("t") - F.col("cohort")).cast("int").alias("event_time")).agg((F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"), F.sum("n_treated").alias("n"))
    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.coalesce(F.col(first), F.lit(0)).alias("g"), F.col(y).cast("double").alias("y"))
    # Weight by inverse of the Poisson(1) distribution at a hash of unit and draw.
    d = d.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    r = F.pmod(F.xxhash64("u", "draw", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    cum, weight = math.exp(-1), F.lit(0)
    steps = []
    total = 0.0
    for k in range(6):
        total += cum / math.factorial(k)
        steps.append(total)
    for s in steps:
        weight = weight + (r > s).cast("int")
    d = d.withColumn("w", weight)
    cohorts = sorted(x.g for x in d.where("g > 0").select("g").distinct().limit(1001).collect())
    base = d.select("u", "draw", F.col("t").alias("bt"), F.col("y").alias("by"))
    wide = d.withColumn("cohort", F.explode(F.array(*[F.lit(c) for c in cohorts]))).where((F.col("g") == F.col("cohort")) | (F.col("g") == 0 if control == "never" else (F.col("g") == 0) | (F.col("g") > F.greatest("t", "cohort"))))
    wide = wide.withColumn("bt", F.col("cohort") - 1).join(base, ["u", "draw", "bt"])
    tr, dy = F.col("g") == F.col("cohort"), F.col("y") - F.col("by")
    wm = lambda c: F.sum(F.when(c, dy * F.col("w"))) / F.sum(F.when(c, F.col("w")))
    cell = wide.groupBy("draw", "cohort", "t").agg((wm(tr) - wm(~tr)).alias("att"), F.sum(F.when(tr, F.col("w"))).alias("n")).where("att is not null and n > 0")
    each = cell.groupBy("draw", (F.col("t") - F.col("cohort")).cast("int").alias("event_time")).agg((F.sum(F.col("att") * F.col("n")) / F.sum("n")).alias("att"))
    return point.join(each.groupBy("event_time").agg(F.stddev("att").alias("std_error")), "event_time", "left").select("event_time", "att", "std_error", "n")


def pooled_projection(df: DataFrame, y: str, unit: str, time: str, first: str, post: int = 3, pre: int = 2) -> DataFrame:
    """window (post, pre), estimate, std_error, n: mean outcome of the window less that before treatment, switchers against clean controls, period effects out."""
    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.coalesce(F.col(first), F.lit(0)).alias("g"), F.col(y).cast("double").alias("y"))
    out = []
    for name, lo, hi in (("post", 0, post), ("pre", -pre - 1, -2)):
        z = d
        cols = []
        for h in range(lo, hi + 1):
            z = z.withColumn(f"_y{h - lo}", panel_shift(d, "y", -h, "u", "t"))
            cols.append(f"_y{h - lo}")
        z = z.withColumn("_b", panel_shift(d, "y", 1, "u", "t"))
        z = z.where((F.col("g") == F.col("t")) | (F.col("g") == 0) | (F.col("g") > F.col("t") + max(hi, 0)))
        z = z.withColumn("_d", sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols) - F.col("_b")).withColumn("_s", (F.col("g") == F.col("t")).cast("double")).dropna(subset=["_d"])
        w = demean(z.select("u", "t", "_d", "_s"), ["_d", "_s"], ["t"])
        m = Moments.of(w, ["_d", "_s"])
        b, inv, rss = m.solve("_d", ["_s"])
        fit = Fit("_d", ["_s"], b, inv, inv, m.n, rss, 1.0, w)
        out.append({"window": name, "estimate": float(b[0]), "std_error": float(math.sqrt(robust(fit, "cluster", "u")[0, 0])), "n": m.n})
    return rows(df.sparkSession, out, "window string, estimate double, std_error double, n long")


def pretrend(effects: EventEffects, spark) -> DataFrame:
    """statistic, df, p_value: are all effects before event time -1 zero, by their joint covariance."""
    at = [i for i, k in enumerate(effects.times) if k < -1]
    b, v = effects.b[at], effects.v[np.ix_(at, at)]
    s = float(b @ guarded_inverse(v) @ b) if at else 0.0
    return rows(spark, [{"statistic": s, "df": len(at), "p_value": float(dist.chi2_sf(s, len(at))) if at else None}], "statistic double, df int, p_value double")


def weights(df: DataFrame, unit: str, time: str, first: str) -> DataFrame:
    """cohort, t, weight: cohort share times (1 - D) / (D (1 - D)), D the share of units treated by t; periods with D of 0 or 1 have none."""
    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.coalesce(F.col(first), F.lit(0)).alias("g"))
    n = d.select(F.count_distinct("u")).first()[0]
    cohort = d.where("g > 0").groupBy("g").agg((F.count_distinct("u") / F.lit(float(n))).alias("s"))
    # Cohorts and periods are few: one row each.
    times = d.select("t").distinct()
    share = times.join(cohort.select(F.col("g").alias("_g"), F.col("s").alias("_s")), F.col("_g") <= F.col("t")).groupBy("t").agg(F.sum("_s").alias("D"))
    cells = times.join(cohort.select("g"), F.col("t") >= F.col("g"))
    return cells.join(share, "t").join(cohort, "g").where("D > 0 and D < 1").select(F.col("g").alias("cohort"), "t", (F.col("s") * (1 - F.col("D")) / (F.col("D") * (1 - F.col("D")))).alias("weight"))
