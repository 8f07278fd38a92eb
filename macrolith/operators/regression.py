"""Cross-section regression: least squares with robust errors, instrumental variables, penalised and binary models, diagnostics.

Coefficients come from one Gram aggregate; robust covariances from a second
aggregate over residuals written as column expressions. Nothing is collected
but small matrices.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import normal_cdf
from ..functions.linalg import guarded_inverse
from ..plans.gram import Moments, gram
from .describe import rows

COEFFICIENTS = "term string, estimate double, std_error double, stat double, p_value double, ci_lower double, ci_upper double"


def linear(b: np.ndarray, terms: list[str]) -> Column:
    out = F.lit(0.0)
    for v, t in zip(b, terms, strict=True):
        out = out + (F.lit(float(v)) if t == "const" else F.lit(float(v)) * F.col(t))
    return out


@dataclass
class Fit:
    y: str
    terms: list[str]
    b: np.ndarray
    inv: np.ndarray
    v: np.ndarray
    n: int
    rss: float
    tss: float
    df: DataFrame
    cov: str = "ols"
    extra: dict = field(default_factory=dict)

    @property
    def dof(self) -> int:
        return self.n - len(self.terms)

    def residual(self) -> Column:
        return F.col(self.y) - linear(self.b, self.terms)

    def predict(self, df: DataFrame, name: str = "fitted") -> DataFrame:
        return df.withColumn(name, linear(self.b, self.terms))

    def table(self, level: float = 0.95) -> DataFrame:
        return coefficient_table(self.df.sparkSession, self.terms, self.b, self.v, self.dof, level)

    def summary(self) -> DataFrame:
        k = len(self.terms)
        s2 = self.rss / self.n
        ll = -self.n / 2 * (math.log(2 * math.pi) + math.log(s2) + 1)
        r2 = 1 - self.rss / self.tss
        slopes = [i for i, t in enumerate(self.terms) if t != "const"]
        bs = self.b[slopes]
        f = float(bs @ guarded_inverse(self.v[np.ix_(slopes, slopes)]) @ bs / len(slopes))
        vals = {"n": float(self.n), "r2": r2, "adj_r2": 1 - (1 - r2) * (self.n - 1) / self.dof, "sigma": math.sqrt(self.rss / self.dof), "f_stat": f, "f_p": dist.f_sf(f, len(slopes), self.dof), "loglik": ll, "aic": -2 * ll + 2 * (k + 1), "bic": -2 * ll + math.log(self.n) * (k + 1)}
        return rows(self.df.sparkSession, [{"statistic": a, "value": float(x)} for a, x in vals.items()], "statistic string, value double")


def coefficient_table(spark, terms: list[str], b: np.ndarray, v: np.ndarray, dof: float | None = None, level: float = 0.95) -> DataFrame:
    """Tidy rows; t with dof, else normal. The covariance of all terms goes with the estimates as their column's metadata (``results.covariance``)."""
    crit = dist.t_ppf(0.5 + level / 2, dof) if dof else dist.norm_ppf(0.5 + level / 2)
    out = []
    for t, x, s in zip(terms, b, np.sqrt(np.maximum(np.diag(v), 0)), strict=True):
        z = x / s if s > 0 else float("nan")
        p = (dist.t_two_sided(z, dof) if dof else 2 * (1 - dist.norm_cdf(abs(z)))) if s > 0 else float("nan")
        out.append({"term": t, "estimate": float(x), "std_error": float(s), "stat": float(z), "p_value": float(p), "ci_lower": float(x - crit * s), "ci_upper": float(x + crit * s)})
    table = rows(spark, out, COEFFICIENTS)
    pairs = [[float(c) if math.isfinite(c) else None for c in r] for r in np.asarray(v, float)]
    return table.withMetadata("estimate", {"covariance": json.dumps({"terms": list(terms), "values": pairs})})


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def ols(df: DataFrame, y: str, x: list[str], cov: str = "hc1", cluster: str | None = None, weight: str | None = None, constant: bool = True) -> Fit:
    """Least squares, weighted if asked. cov: ols, hc0, hc1, hc2, hc3, cluster."""
    df = _complete(df, [y, *x, *([weight] if weight else [])])
    m = Moments.of(df, [y, *x], weight)
    terms = (["const"] if constant else []) + x
    b, inv, rss = m.solve(y, terms)
    tss = m.sub([y])[0, 0] - m.sub([y], ["const"])[0, 0] ** 2 / m.sub(["const"])[0, 0]
    fit = Fit(y, terms, b, inv, inv * rss / (m.n - len(terms)), m.n, rss, tss, df, cov)
    if cov != "ols":
        fit.v = robust(fit, cov, cluster, weight)
    return fit


def robust(fit: Fit, cov: str, cluster: str | None = None, weight: str | None = None) -> np.ndarray:
    n, k, terms = fit.n, len(fit.terms), fit.terms
    w = F.col(weight) if weight else F.lit(1.0)
    e = fit.residual()
    cols = [F.lit(1.0) if t == "const" else F.col(t) for t in terms]
    if cov == "cluster":
        scores = fit.df.groupBy(cluster).agg(*[F.sum(w * e * c).alias(f"s{i}") for i, c in enumerate(cols)])
        g, meat = gram(scores, [f"s{i}" for i in range(k)])
        return fit.inv @ meat[1:, 1:] @ fit.inv * (g / (g - 1)) * ((n - 1) / (n - k))
    u = w * e
    if cov in ("hc2", "hc3"):
        h = F.lit(0.0)
        for i in range(k):
            for j in range(k):
                h = h + F.lit(float(fit.inv[i, j])) * cols[i] * cols[j]
        h = F.least(w * h, F.lit(1 - 1e-10))
        u = u / (F.sqrt(1 - h) if cov == "hc2" else 1 - h)
    elif cov not in ("hc0", "hc1"):
        raise ValueError(f"covariance {cov} is not known")
    d = fit.df.select(u.alias("_u"), *[c.alias(f"_c{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = d.agg(*[F.sum(F.col("_u") * F.col("_u") * F.col(f"_c{i}") * F.col(f"_c{j}")) for i, j in pairs]).first()
    meat = np.zeros((k, k))
    for (i, j), v in zip(pairs, got, strict=True):
        meat[i, j] = meat[j, i] = v
    return fit.inv @ meat @ fit.inv * (n / (n - k) if cov == "hc1" else 1.0)


def vif(df: DataFrame, x: list[str]) -> DataFrame:
    m = Moments.of(_complete(df, x), x)
    out = []
    for c in x:
        _, _, rss = m.solve(c, ["const", *[o for o in x if o != c]])
        tss = m.sub([c])[0, 0] - m.sub([c], ["const"])[0, 0] ** 2 / m.n
        out.append({"term": c, "vif": tss / max(rss, 1e-300)})
    return rows(df.sparkSession, out, "term string, vif double")


def iv(df: DataFrame, y: str, exog: list[str], endog: list[str], instruments: list[str], method: str = "tsls", fuller: float = 1.0, cov: str = "ols") -> Fit:
    """k-class estimators: tsls, liml, fuller. extra: first_stage_f, sargan, sargan_p, kappa."""
    df = _complete(df, [y, *exog, *endog, *instruments])
    m = Moments.of(df, [y, *exog, *endog, *instruments])
    own = ["const", *exog]
    x, z = own + endog, own + instruments
    zz = guarded_inverse(m.sub(z))
    proj = lambda a, b: m.sub(a, z) @ zz @ m.sub(z, b)
    kappa = 1.0
    if method in ("liml", "fuller"):
        w = [y, *endog]
        o1 = guarded_inverse(m.sub(own))
        w1 = m.sub(w) - m.sub(w, own) @ o1 @ m.sub(own, w)
        w2 = m.sub(w) - proj(w, w)
        kappa = float(np.min(np.linalg.eigvals(np.linalg.solve(w2, w1)).real))
        if method == "fuller":
            kappa -= fuller / (m.n - len(z))
    a = m.sub(x) * (1 - kappa) + kappa * proj(x, x)
    c = m.sub(x, [y]) * (1 - kappa) + kappa * proj(x, [y])
    inv = guarded_inverse(a)
    b = (inv @ c)[:, 0]
    yy, xy = m.sub([y])[0, 0], m.sub(x, [y])[:, 0]
    rss = float(yy - 2 * b @ xy + b @ m.sub(x) @ b)
    tss = yy - m.sub([y], ["const"])[0, 0] ** 2 / m.n
    fit = Fit(y, x, b, inv, inv * rss / (m.n - len(x)), m.n, rss, tss, df, cov)
    ze = m.sub(z, [y])[:, 0] - m.sub(z, x) @ b
    over = len(instruments) - len(endog)
    sargan = float(ze @ zz @ ze / (rss / m.n))
    _, _, r0 = m.solve(endog[0], own)
    _, _, r1 = m.solve(endog[0], z)
    fit.extra = {"kappa": kappa, "first_stage_f": (r0 - r1) / len(instruments) / (r1 / (m.n - len(z))), "sargan": sargan if over else float("nan"), "sargan_p": dist.chi2_sf(sargan, over) if over else float("nan")}
    if cov != "ols":
        hat = np.linalg.solve(m.sub(z), m.sub(z, x))  # fitted regressors as combinations of z
        e = fit.residual()
        cols = [linear(hat[:, i], z) for i in range(len(x))]
        d = df.select(*[(e * c).alias(f"s{i}") for i, c in enumerate(cols)])
        _, meat = gram(d, [f"s{i}" for i in range(len(x))])
        fit.v = inv @ meat[1:, 1:] @ inv * (m.n / (m.n - len(x)) if cov == "hc1" else 1)
    return fit


def _standard(m: Moments, y: str, x: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    mean = m.sub(x, ["const"])[:, 0] / m.n
    s = m.sub(x) / m.n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(s))
    ym = m.sub([y], ["const"])[0, 0] / m.n
    xy = (m.sub(x, [y])[:, 0] / m.n - mean * ym) / sd
    return s / np.outer(sd, sd), xy, sd, ym


def elastic_net(df: DataFrame, y: str, x: list[str], lam: float, alpha: float = 1.0, tol: float = 1e-12) -> DataFrame:
    """Coordinate descent on the Gram matrix of columns scaled by their population spread; alpha 0 ridge, 1 lasso. term, estimate."""
    m = Moments.of(_complete(df, [y, *x]), [y, *x])
    s, xy, sd, ym = _standard(m, y, x)
    b = np.zeros(len(x))
    if alpha == 0:
        b = np.linalg.solve(s + lam * np.eye(len(x)), xy)
    else:
        for _ in range(100_000):
            old = b.copy()
            for j in range(len(x)):
                r = xy[j] - s[j] @ b + b[j]
                b[j] = math.copysign(max(abs(r) - lam * alpha, 0.0), r) / (1 + lam * (1 - alpha))
            if np.abs(b - old).max() < tol:
                break
    raw = b / sd
    const = ym - raw @ (m.sub(x, ["const"])[:, 0] / m.n)
    return rows(df.sparkSession, [{"term": t, "estimate": float(v)} for t, v in zip(["const", *x], [const, *raw], strict=True)], "term string, estimate double")


def binary(df: DataFrame, y: str, x: list[str], link: str = "logit", cov: str = "ols", maxiter: int = 50, tol: float = 1e-10) -> Fit:
    """Logit or probit by Fisher scoring: one weighted Gram aggregate a step. extra: loglik, pseudo_r2, steps."""
    df = _complete(df, [y, *x])
    terms = ["const", *x]
    b = np.zeros(len(terms))
    for step in range(1, maxiter + 1):
        eta = F.greatest(F.least(linear(b, terms), F.lit(30.0)), F.lit(-30.0))
        d = df.withColumn("_eta", eta)
        if link == "logit":
            p = 1 / (1 + F.exp(-F.col("_eta")))
            d = d.withColumn("_p", p).withColumn("_w", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-12))).withColumn("_z", F.col("_eta") + (F.col(y) - F.col("_p")) / F.col("_w"))
        else:
            dens = F.exp(-F.col("_eta") * F.col("_eta") / 2) / math.sqrt(2 * math.pi)
            d = d.withColumn("_p", F.greatest(F.least(normal_cdf("_eta"), F.lit(1 - 1e-12)), F.lit(1e-12))).withColumn("_f", dens)
            d = d.withColumn("_w", F.greatest(F.col("_f") * F.col("_f") / (F.col("_p") * (1 - F.col("_p"))), F.lit(1e-12))).withColumn("_z", F.col("_eta") + (F.col(y) - F.col("_p")) / F.greatest(F.col("_f"), F.lit(1e-12)))
        m = Moments.of(d.select("_z", "_w", *x), ["_z", *x], "_w")
        new, inv, _ = m.solve("_z", terms)
        done = np.abs(new - b).max() < tol * (1 + np.abs(b).max())
        b = new
        if done:
            break
    eta = linear(b, terms)
    p = 1 / (1 + F.exp(-eta)) if link == "logit" else normal_cdf(eta)
    r = df.select(F.col(y).alias("y"), F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15)).alias("p")).agg(F.sum(F.when(F.col("y") > 0.5, F.log("p")).otherwise(F.log(1 - F.col("p")))), F.avg("y"), F.count("*")).first()
    null = r[2] * (r[1] * math.log(r[1]) + (1 - r[1]) * math.log(1 - r[1]))
    fit = Fit(y, terms, b, inv, inv, r[2], 0.0, 1.0, df, cov, {"loglik": r[0], "pseudo_r2": 1 - r[0] / null, "steps": step, "link": link})
    if cov in ("hc0", "hc1"):
        cols = [F.lit(1.0) if t == "const" else F.col(t) for t in terms]
        if link != "logit":
            raise ValueError("robust errors are for the logit only")
        d = df.select(*[((F.col(y) - p) * c).alias(f"s{i}") for i, c in enumerate(cols)])
        _, meat = gram(d, [f"s{i}" for i in range(len(terms))])
        fit.v = inv @ meat[1:, 1:] @ inv * (r[2] / (r[2] - len(terms)) if cov == "hc1" else 1)
    return fit


def classification_table(fit: Fit, threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn, accuracy, sensitivity, specificity."""
    p = 1 / (1 + F.exp(-linear(fit.b, fit.terms)))
    d = fit.df.select((p >= threshold).alias("hat"), (F.col(fit.y) > 0.5).alias("y"))
    c = d.agg(F.count_if(F.col("hat") & F.col("y")).alias("tp"), F.count_if(F.col("hat") & ~F.col("y")).alias("fp"), F.count_if(~F.col("hat") & ~F.col("y")).alias("tn"), F.count_if(~F.col("hat") & F.col("y")).alias("fn"))
    return c.select("tp", "fp", "tn", "fn", ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))).alias("accuracy"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("sensitivity"), (F.col("tn") / (F.col("tn") + F.col("fp"))).alias("specificity"))


def marginal_effects(fit: Fit) -> DataFrame:
    """Average marginal effects of a logit: term, effect."""
    p = 1 / (1 + F.exp(-linear(fit.b, fit.terms)))
    scale = fit.df.agg(F.avg(p * (1 - p))).first()[0]
    return rows(fit.df.sparkSession, [{"term": t, "effect": float(v * scale)} for t, v in zip(fit.terms, fit.b, strict=True) if t != "const"], "term string, effect double")


def odds_ratios(fit: Fit, level: float = 0.95) -> DataFrame:
    z = dist.norm_ppf(0.5 + level / 2)
    out = []
    for t, b, s in zip(fit.terms, fit.b, np.sqrt(np.diag(fit.v)), strict=True):
        o = math.exp(b)
        out.append({"term": t, "odds_ratio": o, "std_error": o * s, "ci_lower": o - z * o * s, "ci_upper": o + z * o * s})
    return rows(fit.df.sparkSession, out, "term string, odds_ratio double, std_error double, ci_lower double, ci_upper double")


def _test(spark, name: str, stat: float, df1: float, p: float, df2: float | None = None) -> DataFrame:
    return rows(spark, [{"test": name, "statistic": float(stat), "df1": float(df1), "df2": df2, "p_value": float(p)}], "test string, statistic double, df1 double, df2 double, p_value double")


def _auxiliary(d: DataFrame, u: str, x: list[str]) -> tuple[int, float, float]:
    """n, R2 and explained sum of squares of u on a constant and x."""
    m = Moments.of(d, [u, *x])
    _, _, rss = m.solve(u, ["const", *x])
    tss = m.sub([u])[0, 0] - m.sub([u], ["const"])[0, 0] ** 2 / m.n
    return m.n, 1 - rss / tss, tss - rss


def heteroskedasticity(fit: Fit, kind: str = "white", cross: bool = True) -> DataFrame:
    """white, breusch_pagan (studentised), glejser, harvey: n R2 of an auxiliary regression."""
    x = [t for t in fit.terms if t != "const"]
    e = fit.residual()
    u = {"white": e * e, "breusch_pagan": e * e, "glejser": F.abs(e), "harvey": F.log(F.greatest(e * e, F.lit(1e-300)))}[kind]
    d = fit.df.select(u.alias("_u"), *x)
    names = list(x)
    if kind == "white":
        extra = {f"_{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(x) for b in (x[i:] if cross else [a])}
        d, names = d.withColumns(extra), names + list(extra)
    n, r2, _ = _auxiliary(d, "_u", names)
    return _test(fit.df.sparkSession, kind, n * r2, len(names), dist.chi2_sf(n * r2, len(names)))


def reset(fit: Fit, powers: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """F test of powers of the fitted values (standardised first, which leaves the test as it is)."""
    d = fit.predict(fit.df, "_f")
    m, s = d.agg(F.avg("_f"), F.stddev_pop("_f")).first()
    d = d.withColumns({f"_p{k}": F.pow((F.col("_f") - m) / s, k) for k in powers})
    x = [t for t in fit.terms if t != "const"]
    mo = Moments.of(d, [fit.y, *x, *[f"_p{k}" for k in powers]])
    _, _, rss = mo.solve(fit.y, [*fit.terms, *[f"_p{k}" for k in powers]])
    q, dof = len(powers), fit.n - len(fit.terms) - len(powers)
    f = (fit.rss - rss) / q / (rss / dof)
    return _test(fit.df.sparkSession, "reset", f, q, dist.f_sf(f, q, dof), float(dof))


def chow(df: DataFrame, y: str, x: list[str], split: Column) -> DataFrame:
    """F test that the rows where split holds have the same coefficients."""
    total = ols(df, y, x, "ols")
    a, b = ols(df.where(split), y, x, "ols"), ols(df.where(~split), y, x, "ols")
    k, dof = len(total.terms), total.n - 2 * len(total.terms)
    f = (total.rss - a.rss - b.rss) / k / ((a.rss + b.rss) / dof)
    return _test(df.sparkSession, "chow", f, k, dist.f_sf(f, k, dof), float(dof))


def influence(fit: Fit) -> DataFrame:
    """Adds leverage, student (internal), rstudent (external), cooks_d and dffits to the rows."""
    cols = [F.lit(1.0) if t == "const" else F.col(t) for t in fit.terms]
    k = len(cols)
    h = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            h = h + F.lit(float(fit.inv[i, j])) * cols[i] * cols[j]
    s2 = fit.rss / fit.dof
    d = fit.df.withColumn("_e", fit.residual()).withColumn("leverage", h)
    e, h = F.col("_e"), F.col("leverage")
    d = d.withColumn("student", e / F.sqrt(s2 * (1 - h)))
    r = F.col("student")
    d = d.withColumn("rstudent", r * F.sqrt((fit.dof - 1) / (fit.dof - r * r)))
    return d.withColumn("cooks_d", r * r * h / (1 - h) / k).withColumn("dffits", F.col("rstudent") * F.sqrt(h / (1 - h))).drop("_e")
