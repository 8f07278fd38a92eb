"""Panel regression and difference-in-differences over (unit, time) rows, by joins of group means and Gram aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.linalg import guarded_inverse
from ..plans.gram import Moments, shared_products
from .describe import bounded, rows
from .regression import Fit, _test, coefficient_table, ols, robust
from .transforms import demean, panel_shift, two_way_demean

#: Units whose pairs are looked at one by one.
UNITS = 1_000
#: Periods (or cells of cohort and period) of a panel that the driver takes.
PERIODS = 1_000_000


def _within(df: DataFrame, y: str, x: list[str], unit: str, time: str, two_way: bool) -> DataFrame:
    d = df.dropna(subset=[y, *x]).select(unit, time, *[F.col(c).cast("double").alias(c) for c in [y, *x]])
    return two_way_demean(d, [y, *x], unit, time) if two_way else demean(d, [y, *x], [unit])


def fixed_effects(df: DataFrame, y: str, x: list[str], unit: str, time: str, two_way: bool = False, cov: str = "cluster") -> Fit:
    """Within regression on unit effects, with two_way also time effects; balanced or not, of units that times connect."""
    d = _within(df, y, x, unit, time, two_way)
    m = Moments.of(d, [y, *x])
    b, inv, rss = m.solve(y, x)
    g = d.select(F.count_distinct(unit), F.count_distinct(time)).first()
    absorbed = g[0] + (g[1] - 1 if two_way else 0)
    fit = Fit(y, x, b, inv, inv * rss / (m.n - absorbed - len(x)), m.n, rss, m.sub([y])[0, 0], d, cov)
    fit.extra = {"groups": g[0], "absorbed": absorbed, "unit": unit, "time": time, "raw": df, "s2_e": rss / (m.n - absorbed - len(x))}
    if cov == "cluster":
        fit.v = robust(fit, "cluster", unit)
    elif cov == "driscoll_kraay":
        fit.v = _driscoll_kraay(fit, time)
    elif cov != "ols":
        fit.v = robust(fit, cov)
    return fit


def _driscoll_kraay(fit: Fit, time: str, bandwidth: int | None = None) -> np.ndarray:
    """Scores summed by time, one row a time, then a Bartlett sum."""
    e = fit.residual()
    s = fit.df.groupBy(time).agg(*[F.sum(e * F.col(c)).alias(f"s{i}") for i, c in enumerate(fit.terms)])
    s = bounded(s, PERIODS, "periods").sort_values(time).to_numpy(float)[:, 1:]
    t = len(s)
    bw = int(4 * (t / 100) ** (2 / 9)) if bandwidth is None else bandwidth
    meat = s.T @ s
    for j in range(1, bw + 1):
        g = s[j:].T @ s[:-j]
        meat += (1 - j / (bw + 1)) * (g + g.T)
    return fit.inv @ meat @ fit.inv


def between(df: DataFrame, y: str, x: list[str], unit: str) -> Fit:
    return ols(df.dropna(subset=[y, *x]).groupBy(unit).agg(*[F.avg(c).alias(c) for c in [y, *x]]), y, x, "ols")


def random_effects(df: DataFrame, y: str, x: list[str], unit: str, time: str) -> Fit:
    """Swamy-Arora; the harmonic mean of group sizes in the unit variance, a theta for each unit."""
    fe = fixed_effects(df, y, x, unit, time, cov="ols")
    be = between(df, y, x, unit)
    d = df.dropna(subset=[y, *x]).select(unit, time, *[F.col(c).cast("double").alias(c) for c in [y, *x]])
    sizes = d.groupBy(unit).agg(F.count("*").alias("_t"), *[F.avg(c).alias(f"_m_{c}") for c in [y, *x]])
    harmonic = 1 / sizes.agg(F.avg(1 / F.col("_t"))).first()[0]
    s2e = fe.extra["s2_e"]
    s2u = max(0.0, be.rss / (be.n - len(be.terms)) - s2e / harmonic)
    q = d.join(sizes, unit).withColumn("_th", 1 - F.sqrt(s2e / (s2e + F.col("_t") * s2u))).withColumn("_one", 1 - F.col("_th"))
    q = q.withColumns({c: F.col(c) - F.col("_th") * F.col(f"_m_{c}") for c in [y, *x]})
    m = Moments.of(q, [y, *x, "_one"])
    terms = ["_one", *x]
    b, inv, rss = m.solve(y, terms)
    fit = Fit(y, terms, b, inv, inv * rss / (m.n - len(terms)), m.n, rss, m.sub([y])[0, 0], q)
    fit.extra = {"s2_e": s2e, "s2_u": s2u, "groups": fe.extra["groups"]}
    return fit


def first_differences(df: DataFrame, y: str, x: list[str], unit: str, time: str) -> Fit:
    d = df.select(unit, time, *[(F.col(c) - panel_shift(df, c, 1, unit, time)).alias(c) for c in [y, *x]]).dropna()
    m = Moments.of(d, [y, *x])
    b, inv, rss = m.solve(y, x)
    fit = Fit(y, x, b, inv, inv * rss / (m.n - len(x)), m.n, rss, m.sub([y])[0, 0], d, "cluster")
    fit.v = robust(fit, "cluster", unit)
    return fit


def correlated_random_effects(df: DataFrame, y: str, x: list[str], unit: str, time: str) -> Fit:
    """Group means join the regressors (Mundlak); clustered by unit."""
    d = df.dropna(subset=[y, *x])
    means = d.groupBy(unit).agg(*[F.avg(c).alias(f"{c}_mean") for c in x])
    return ols(d.join(means, unit), y, [*x, *[f"{c}_mean" for c in x]], "cluster", unit)


def panel_table(fit: Fit, level: float = 0.95) -> DataFrame:
    return coefficient_table(fit.df.sparkSession, ["const" if t == "_one" else t for t in fit.terms], fit.b, fit.v, None, level)


def hausman(fe: Fit, re: Fit) -> DataFrame:
    k = [re.terms.index(t) for t in fe.terms]
    d = fe.b - re.b[k]
    v = fe.inv * fe.extra["s2_e"] - re.v[np.ix_(k, k)]
    w = float(d @ guarded_inverse(v) @ d)
    return _test(fe.df.sparkSession, "hausman", w, len(d), dist.chi2_sf(max(w, 0), len(d)))


def breusch_pagan_lm(df: DataFrame, y: str, x: list[str], unit: str) -> DataFrame:
    fit = ols(df, y, x, "ols")
    by = fit.df.groupBy(unit).agg(F.sum(fit.residual()).alias("s"), F.count("*").alias("t"))
    s, t = by.agg(F.sum(F.col("s") * F.col("s")), F.avg("t")).first()
    lm = fit.n / (2 * (t - 1)) * (s / fit.rss - 1) ** 2
    return _test(df.sparkSession, "breusch_pagan_lm", lm, 1, dist.chi2_sf(lm, 1))


def unit_effects_f(fe: Fit) -> DataFrame:
    pooled = ols(fe.extra["raw"], fe.y, fe.terms, "ols")
    q, dof = fe.extra["groups"] - 1, fe.n - fe.extra["groups"] - len(fe.terms)
    f = (pooled.rss - fe.rss) / q / (fe.rss / dof)
    return _test(fe.df.sparkSession, "unit_effects_f", f, q, dist.f_sf(f, q, dof), float(dof))


def modified_wald(fe: Fit) -> DataFrame:
    """Group-wise heteroskedasticity."""
    e = fe.residual()
    by = fe.df.groupBy(fe.extra["unit"]).agg(F.avg(e * e).alias("s"), F.count("*").alias("t"))
    s2 = fe.rss / fe.n
    w, n = by.agg(F.sum(F.pow(F.col("s") - s2, 2) / (2 * F.col("s") * F.col("s") / F.col("t"))), F.count("*")).first()
    return _test(fe.df.sparkSession, "modified_wald", w, n, dist.chi2_sf(w, n))


def pesaran_cd(fe: Fit) -> DataFrame:
    """Cross-section dependence. The sum over pairs of units comes from squares of sums by time when the panel is balanced; else sums over the periods that each pair shares are added up as matrices of units, ``UNITS`` at most."""
    u, t = fe.extra["unit"], fe.extra["time"]
    d = fe.df.select(F.col(u).alias("u"), F.col(t).alias("t"), fe.residual().alias("e"))
    stats = d.groupBy("u").agg(F.avg("e").alias("m"), F.stddev_pop("e").alias("s"), F.count("*").alias("n"))
    n_units, lo, hi = stats.agg(F.count("*"), F.min("n"), F.max("n")).first()
    total_t = d.select(F.count_distinct("t")).first()[0]
    z = d.join(stats, "u").select("u", "t", ((F.col("e") - F.col("m")) / F.col("s")).alias("z"), "e")
    if lo == hi == total_t:
        sq = z.groupBy("t").agg(F.sum("z").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
        rho = (sq - n_units * total_t) / 2 / total_t
        cd = math.sqrt(2 * total_t / (n_units * (n_units - 1))) * rho
    else:
        units = [r.u for r in stats.select("u").orderBy("u").limit(UNITS + 1).collect()]
        if len(units) > UNITS:
            raise ValueError(f"an unbalanced panel has {UNITS} units at most here")
        wide = z.groupBy("t").pivot("u", units).agg(F.first("e")).toDF("t", *[f"_u{i}" for i in range(len(units))])
        k, s, q, p = shared_products(wide, wide.columns[1:])
        with np.errstate(all="ignore"):
            m = s / k
            sd = np.sqrt(np.maximum(q / k - m * m, 0))
            r = (p / k - m * m.T) / (sd * sd.T)
        used = np.triu((k > 2) & np.isfinite(r), 1)
        cd = math.sqrt(2 / (n_units * (n_units - 1))) * float((np.sqrt(k) * np.where(used, r, 0.0))[used].sum())
    return _test(fe.df.sparkSession, "pesaran_cd", cd, 1, 2 * (1 - dist.norm_cdf(abs(cd))))


def wooldridge_ar(df: DataFrame, y: str, x: list[str], unit: str, time: str) -> DataFrame:
    """First-difference residuals on their lag, clustered: is the slope -0.5?"""
    fd = first_differences(df, y, x, unit, time)
    d = fd.df.withColumn("_e", fd.residual())
    d = d.withColumn("_l", panel_shift(d, "_e", 1, unit, time)).dropna(subset=["_l"])
    f = ols(d, "_e", ["_l"], "cluster", unit)
    w = float((f.b[1] + 0.5) ** 2 / f.v[1, 1])
    g = d.select(F.count_distinct(unit)).first()[0]
    return _test(df.sparkSession, "wooldridge_ar", w, 1, dist.f_sf(w, 1, g - 1), float(g - 1))


# -- difference-in-differences; first is the first treated time, 0 or null: never -----------------


@dataclass
class EventEffects:
    """Effects by event time (the reference is left out) and their covariance."""

    times: list[int]
    b: np.ndarray
    v: np.ndarray

    def table(self, spark) -> DataFrame:
        return rows(spark, [{"event_time": int(k), "estimate": float(x), "std_error": float(math.sqrt(max(s, 0)))} for k, x, s in zip(self.times, self.b, np.diag(self.v), strict=True)], "event_time int, estimate double, std_error double")

    def covariance(self, spark) -> DataFrame:
        """event_time, other_time, value: a row a pair."""
        return rows(spark, [{"event_time": int(k), "other_time": int(m), "value": float(self.v[i, j])} for i, k in enumerate(self.times) for j, m in enumerate(self.times)], "event_time int, other_time int, value double")


def event_study(df: DataFrame, y: str, unit: str, time: str, first: str, leads: int = 3, horizon: int = 5) -> DataFrame:
    """Two-way fixed effects event study: event_time, estimate, std_error; reference -1, ends are binned."""
    return event_effects(df, y, unit, time, first, leads, horizon).table(df.sparkSession)


def event_effects(df: DataFrame, y: str, unit: str, time: str, first: str, leads: int = 3, horizon: int = 5) -> EventEffects:
    e = F.when(F.col(first) > 0, F.greatest(F.lit(-leads), F.least(F.lit(horizon), F.col(time) - F.col(first))))
    ks = [k for k in range(-leads, horizon + 1) if k != -1]
    names = [f"e{k}".replace("-", "m") for k in ks]
    d = df.select(unit, time, F.col(y).cast("double").alias(y), *[F.coalesce((e == k).cast("double"), F.lit(0.0)).alias(n) for k, n in zip(ks, names, strict=True)])
    d = d.dropna(subset=[y])
    w = two_way_demean(d, [y, *names], unit, time)
    m = Moments.of(w, [y, *names])
    b, inv, rss = m.solve(y, names)
    fit = Fit(y, names, b, inv, inv, m.n, rss, m.sub([y])[0, 0], w)
    return EventEffects(ks, b, robust(fit, "cluster", unit))


def group_time_att(df: DataFrame, y: str, unit: str, time: str, first: str, control: str = "never") -> DataFrame:
    """cohort, t, att, n_treated, n_control: mean change since the period before treatment, less that of never (or notyet) treated units."""
    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.coalesce(F.col(first), F.lit(0)).alias("g"), F.col(y).cast("double").alias("y"))
    cohorts = sorted(r.g for r in d.where("g > 0").select("g").distinct().limit(1001).collect())
    if len(cohorts) > 1000:
        raise ValueError("more than 1000 cohorts")
    base = d.select("u", F.col("t").alias("bt"), F.col("y").alias("by"))
    # A control row serves each cohort that it is clean for; cohorts are few, their number is the output's.
    wide = d.withColumn("cohort", F.explode(F.array(*[F.lit(c) for c in cohorts]))).where((F.col("g") == F.col("cohort")) | (F.col("g") == 0 if control == "never" else (F.col("g") == 0) | (F.col("g") > F.greatest("t", "cohort"))))
    wide = wide.withColumn("bt", F.col("cohort") - 1).join(base, ["u", "bt"])
    treated = F.col("g") == F.col("cohort")
    got = wide.withColumn("dy", F.col("y") - F.col("by")).groupBy("cohort", "t").agg(F.avg(F.when(treated, F.col("dy"))).alias("a"), F.avg(F.when(~treated, F.col("dy"))).alias("b"), F.count_if(treated).alias("n_treated"), F.count_if(~treated).alias("n_control"))
    return got.where("n_treated > 0 and n_control > 0").select("cohort", "t", (F.col("a") - F.col("b")).alias("att"), "n_treated", "n_control")


def aggregate_att(att: DataFrame) -> DataFrame:
    """event_time, att: group-time effects weighted by treated counts."""
    return att.groupBy((F.col("t") - F.col("cohort")).cast("int").alias("event_time")).agg((F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"))


def imputation(df: DataFrame, y: str, unit: str, time: str, first: str) -> DataFrame:
    """event_time, att, n: two-way effects fitted on untreated cells, effects of treated cells averaged. A period without any untreated cell has no effect to compare with and is left out."""
    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.coalesce(F.col(first), F.lit(0)).alias("g"), F.col(y).cast("double").alias("y")).dropna()
    clean = d.where("g = 0 or t < g")
    times = sorted(r.t for r in clean.select("t").distinct().limit(1001).collect())
    if len(times) > 1000:
        raise ValueError("more than 1000 periods")
    # Unit effects go by demeaning, time effects are the coefficients of period marks: one Gram aggregate.
    names = [f"t{k}" for k in range(1, len(times))]
    marked = clean.select("u", "y", *[(F.col("t") == v).cast("double").alias(n) for n, v in zip(names, times[1:], strict=True)])
    effect, _, _ = Moments.of(demean(marked, ["y", *names], ["u"]), ["y", *names]).solve("y", names)
    spark = df.sparkSession
    b = spark.createDataFrame([(v, float(e)) for v, e in zip(times, [0.0, *effect], strict=True)], f"t {d.schema['t'].dataType.simpleString()}, b double")
    a = clean.join(F.broadcast(b), "t").groupBy("u").agg(F.avg(F.col("y") - F.col("b")).alias("a"))
    eff = d.where("g > 0 and t >= g").join(a, "u").join(b, "t").select((F.col("t") - F.col("g")).cast("int").alias("event_time"), (F.col("y") - F.col("a") - F.col("b")).alias("e"))
    return eff.groupBy("event_time").agg(F.avg("e").alias("att"), F.count("*").alias("n"))


def bacon(df: DataFrame, y: str, unit: str, time: str, first: str) -> DataFrame:
    """kind, treated, control, weight, estimate: every two-group comparison of a balanced staggered panel. Only cell means by (cohort, t) are joined."""
    d = df.select(F.col(unit).alias("u"), F.col(time).alias("t"), F.coalesce(F.col(first), F.lit(0)).alias("g"), F.col(y).cast("double").alias("y"))
    cells = bounded(d.groupBy("g", "t").agg(F.avg("y").alias("m"), F.count("*").alias("n")), PERIODS, "cells of cohort and period")
    times = np.sort(cells.t.unique())
    size = cells.groupby("g").n.max()
    total = size.sum()
    mean = {(r.g, r.t): r.m for r in cells.itertuples()}
    out = []

    def did(a, b, post, pre):
        mu = lambda g, ts: np.mean([mean[g, t] for t in ts])
        return (mu(a, post) - mu(a, pre)) - (mu(b, post) - mu(b, pre))

    late = sorted(g for g in size.index if g > 0)
    share = lambda g, ts: np.mean(ts >= g)
    for g in late:
        if 0 in size.index:
            s, dbar = (size[g] + size[0]) / total, share(g, times)
            p = size[g] / (size[g] + size[0])
            if 0 < dbar < 1:
                out.append(("treated_vs_never", g, 0, s * s * p * (1 - p) * dbar * (1 - dbar), did(g, 0, times[times >= g], times[times < g])))
        for h in late:
            if h <= g:
                continue
            s, p = (size[g] + size[h]) / total, size[g] / (size[g] + size[h])
            dg, dh = share(g, times), share(h, times)
            pre, mid, post = times[times < g], times[(times >= g) & (times < h)], times[times >= h]
            if len(pre) and len(mid):
                out.append(("earlier_vs_later", g, h, (s * (1 - dh)) ** 2 * p * (1 - p) * (dg - dh) / (1 - dh) * (1 - dg) / (1 - dh), did(g, h, mid, pre)))
            if len(mid) and len(post):
                out.append(("later_vs_earlier", h, g, (s * dg) ** 2 * p * (1 - p) * dh / dg * (dg - dh) / dg, did(h, g, post, mid)))
    w = sum(o[3] for o in out) or 1.0
    return rows(df.sparkSession, [{"kind": a, "treated": int(b), "control": int(c), "weight": float(x / w), "estimate": float(e)} for a, b, c, x, e in out], "kind string, treated int, control int, weight double, estimate double")


def panel_unit_roots(df: DataFrame, y: str, unit: str, time: str, lags: int = 0) -> DataFrame:
    """test, statistic, p_value: mean of unit ADF t (ips_tbar), and its standardised form (ips_w)."""
    from .kernels import per_series
    from .series import adf

    t = per_series(df, [y], time, lambda _, v: (lambda a: {"t_stat": [a[0]], "n": [a[2]]})(adf(v[:, 0], lags)), "t_stat double, n int", unit)
    got = t.agg(F.avg("t_stat").alias("tbar"), F.count("*").alias("n")).first()
    # Limit mean and variance of the ADF t with a constant (Im, Pesaran and Shin, 2003).
    mean, var = -1.533, 0.706
    z = math.sqrt(got.n) * (got.tbar - mean) / math.sqrt(var)
    return rows(df.sparkSession, [{"test": "ips_tbar", "statistic": got.tbar, "p_value": None}, {"test": "ips_w", "statistic": z, "p_value": dist.norm_cdf(z)}], "test string, statistic double, p_value double")


def dumitrescu_hurlin(df: DataFrame, y: str, x: str, unit: str, time: str, lags: int = 1) -> DataFrame:
    """Panel causality from x to y: test, statistic, p_value."""
    from ..functions.linalg import ols as solve
    from .kernels import per_series

    def f(_, v):
        n = len(v) - lags
        own = [v[lags - j : len(v) - j, 0] for j in range(1, lags + 1)]
        other = [v[lags - j : len(v) - j, 1] for j in range(1, lags + 1)]
        full = np.column_stack([np.ones(n), *own, *other])
        e0, e1 = solve(v[lags:, 0], full[:, : 1 + lags])[1], solve(v[lags:, 0], full)[1]
        s = e1 @ e1 / (n - full.shape[1])
        return {"w": [(e0 @ e0 - e1 @ e1) / s], "n": [n]}

    got = per_series(df, [y, x], time, f, "w double, n int", unit).agg(F.avg("w").alias("w"), F.count("*").alias("k"), F.avg("n").alias("n")).first()
    zbar = math.sqrt(got.k / (2 * lags)) * (got.w - lags)
    t = got.n
    ztilde = math.sqrt(got.k / (2 * lags) * (t - 2 * lags - 5) / (t - lags - 3)) * ((t - 2 * lags - 3) / (t - 2 * lags - 1) * got.w - lags)
    return rows(df.sparkSession, [{"test": k, "statistic": s, "p_value": 2 * (1 - dist.norm_cdf(abs(s)))} for k, s in (("w_bar", got.w), ("z_bar", zbar), ("z_tilde", ztilde))][1:] + [{"test": "w_bar", "statistic": got.w, "p_value": None}], "test string, statistic double, p_value double")

