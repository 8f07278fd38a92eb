"""Descriptive statistics, association and equality tests, from single aggregates or ranks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import normal_cdf, normal_quantile
from ..plans.ordered import exact_quantiles, running_sum
from ..plans.store import Kept, stored


def rows(spark, records: list[dict], schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v.item() if isinstance(v, np.generic) else v
    return spark.createDataFrame([tuple(clean(r.get(n)) for n in names) for r in records], schema)


def bounded(df: DataFrame, most: int, what: str) -> pd.DataFrame:
    """Rows that a model needs on the driver, as many as its size; more than ``most`` are an error."""
    got = df.limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} {what}")
    return got


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, n, mean, sd, min, q25, median, q75, max, skewness, excess kurtosis; finite values only."""
    finite = df.select(*[F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")).alias(c) for c in columns])
    q = exact_quantiles(finite, {c: [0.25, 0.5, 0.75] for c in columns})
    parts = []
    for c in columns:
        x, few = F.col(c), F.count(c) <= 2
        parts.append(F.struct(F.lit(c).alias("variable"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), *[F.lit(v).cast("double").alias(n) for v, n in zip(q[c], ("q25", "median", "q75"), strict=True)], F.max(x).alias("max"), F.when(few, 0.0).otherwise(F.skewness(x)).alias("skewness"), F.when(few, 0.0).otherwise(F.kurtosis(x)).alias("kurtosis")))
    return finite.agg(F.array(*parts).alias("v")).select(F.inline("v"))


def value_ranks(counts: DataFrame, column: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Average ranks of distinct values from their counts _c. The counts are read several times, so they must be stored if they come from sums whose last digits may differ from run to run."""
    keys = by or []
    if keys:
        run = F.sum("_c").over(Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.withColumn("_run", run)
    else:
        counts = running_sum(counts, column, "_c", "_run")
    return counts.withColumn(name, F.col("_run") - F.col("_c") + (F.col("_c") + 1) / 2).drop("_run")


def rank_average(df: DataFrame, column: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Average ranks through counts by value: only distinct values are ordered, not rows.

    Rows are stored first, as ranks are joined to them by value: a sum of doubles
    that is computed twice may differ in its last digit and would lose its row.
    """
    keys = by or []
    df = stored(df)
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_c"))
    return df.join(value_ranks(counts, column, name, by).select(*keys, column, name), [*keys, column])


def correlation_test(df: DataFrame, x: str, y: str, method: str = "pearson", level: float = 0.95) -> DataFrame:
    """One row: method, n, estimate, statistic, p_value, lower, upper (Fisher's z)."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("a"), F.col(y).alias("b"))
    if method == "spearman":
        d = rank_average(rank_average(d, "a", "ra"), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    elif method != "pearson":
        raise ValueError(f"method {method} is not known")
    n, r = d.agg(F.count("*"), F.corr("a", "b")).first()
    t = r * math.sqrt((n - 2) / max(1e-300, 1 - r * r))
    z, half = math.atanh(min(max(r, -1 + 1e-15), 1 - 1e-15)), dist.norm_ppf(0.5 + level / 2) / math.sqrt(n - 3)
    return rows(df.sparkSession, [{"method": method, "n": n, "estimate": r, "statistic": t, "p_value": dist.t_two_sided(t, n - 2), "lower": math.tanh(z - half), "upper": math.tanh(z + half)}], "method string, n long, estimate double, statistic double, p_value double, lower double, upper double")


#: Distinct value pairs that one kernel counts.
KENDALL_PAIRS = 2_000_000


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b: counted from the table of distinct value pairs in a kernel, which takes KENDALL_PAIRS of them at most; more raise ValueError."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")).agg(F.count("*").alias("n"))

    def tau(pdf):
        pdf = pdf.sort_values(["a", "b"])
        _, bi = np.unique(pdf.b.to_numpy(), return_inverse=True)
        n, a = pdf.n.to_numpy(float), pdf.a.to_numpy()
        tree = np.zeros(bi.max() + 2 if len(bi) else 2)
        con = dis = 0.0
        held: list[tuple[int, float]] = []
        seen = 0.0
        for k in range(len(n)):
            if k and a[k] != a[k - 1]:
                for j, m in held:
                    i = j + 1
                    while i < len(tree):
                        tree[i] += m
                        i += i & -i
                    seen += m
                held = []
            below, i = 0.0, bi[k]
            while i > 0:
                below += tree[i]
                i -= i & -i
            upto, i = 0.0, bi[k] + 1
            while i > 0:
                upto += tree[i]
                i -= i & -i
            con += n[k] * below
            dis += n[k] * (seen - upto)
            held.append((bi[k], n[k]))
        total = n.sum()
        pairs = total * (total - 1) / 2
        tx = sum(g * (g - 1) / 2 for g in pdf.groupby("a").n.sum())
        ty = sum(g * (g - 1) / 2 for g in pdf.groupby("b").n.sum())
        return pd.DataFrame({"n": [int(total)], "tau": [(con - dis) / math.sqrt((pairs - tx) * (pairs - ty))]})

    cells = cells.limit(KENDALL_PAIRS + 1).withColumn("k", F.lit(1))
    if cells.count() > KENDALL_PAIRS:
        raise ValueError(f"more than {KENDALL_PAIRS} distinct pairs")
    return cells.groupBy("k").applyInPandas(tau, "n long, tau double")


def t_test(df: DataFrame, y: str, group: str | None = None, mu: float = 0.0, equal_var: bool = False, pair: str | None = None) -> DataFrame:
    """One row: kind, estimate, statistic, df, p_value. With pair, of y - pair; with group (two values), pooled or Welch."""
    spark = df.sparkSession
    if group is None:
        x = F.col(y) - F.col(pair) if pair else F.col(y)
        n, m, v = df.agg(F.count(x), F.avg(x), F.var_samp(x)).first()
        t, dof, kind, est = (m - mu) / math.sqrt(v / n), n - 1, "paired" if pair else "one-sample", m
    else:
        g = df.where(F.col(y).isNotNull()).groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_samp(y).alias("v")).orderBy(group).limit(3).collect()
        if len(g) != 2:
            raise ValueError("a two-sample test needs two groups")
        (n1, m1, v1), (n2, m2, v2) = [(r.n, r.m, r.v) for r in g]
        est = m1 - m2
        if equal_var:
            s = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
            t, dof, kind = (est - mu) / math.sqrt(s * (1 / n1 + 1 / n2)), n1 + n2 - 2, "pooled"
        else:
            a, b = v1 / n1, v2 / n2
            t, dof, kind = (est - mu) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)), "welch"
    return rows(spark, [{"kind": kind, "estimate": est, "statistic": t, "df": float(dof), "p_value": dist.t_two_sided(t, dof)}], "kind string, estimate double, statistic double, df double, p_value double")


_TEST = "test string, statistic double, df1 double, df2 double, p_value double"


#: Groups that tests of their equality take.
GROUPS = 2_000


def _one_way(cells: list, k: int, n: float) -> tuple[float, float, float]:
    grand = sum(c.n * c.m for c in cells) / n
    between = sum(c.n * (c.m - grand) ** 2 for c in cells)
    within = sum((c.n - 1) * c.v for c in cells)
    return between / (k - 1) / (within / (n - k)), k - 1, n - k


def equality_tests(df: DataFrame, y: str, group: str) -> DataFrame:
    """Battery over groups: anova, welch, bartlett, levene, brown_forsythe, kruskal_wallis, van_der_waerden, mood_median; f_variance and mann_whitney with two groups."""
    d = df.select(F.col(y).cast("double").alias("y"), F.col(group).alias("g")).where("y is not null and g is not null")
    cells_of = lambda x, c: x.groupBy("g").agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.coalesce(F.var_samp(c), F.lit(0.0)).alias("v")).orderBy("g").collect()
    if d.select("g").distinct().limit(GROUPS + 1).count() > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    cells = cells_of(d, "y")
    k, n = len(cells), sum(c.n for c in cells)
    out = []

    def add(test, stat, d1, d2, p):
        out.append({"test": test, "statistic": float(stat), "df1": float(d1), "df2": d2 if d2 is None else float(d2), "p_value": float(p)})

    f, a, b = _one_way(cells, k, n)
    add("anova", f, a, b, dist.f_sf(f, a, b))
    w = [c.n / c.v for c in cells]
    mean = sum(x * c.m for x, c in zip(w, cells, strict=True)) / sum(w)
    lam = sum((1 - x / sum(w)) ** 2 / (c.n - 1) for x, c in zip(w, cells, strict=True))
    f = sum(x * (c.m - mean) ** 2 for x, c in zip(w, cells, strict=True)) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam)
    add("welch", f, k - 1, (k * k - 1) / (3 * lam), dist.f_sf(f, k - 1, (k * k - 1) / (3 * lam)))
    pooled = sum((c.n - 1) * c.v for c in cells) / (n - k)
    scale = 1 + (sum(1 / (c.n - 1) for c in cells) - 1 / (n - k)) / (3 * (k - 1))
    stat = ((n - k) * math.log(pooled) - sum((c.n - 1) * math.log(c.v) for c in cells)) / scale
    add("bartlett", stat, k - 1, None, dist.chi2_sf(stat, k - 1))
    # Each group's values in a column of its own, so that all medians come from the same passes.
    medians = exact_quantiles(d.select("y", *[F.when(F.col("g") == F.lit(c.g), F.col("y")).alias(f"y{i}") for i, c in enumerate(cells)]), {"y": [0.5]} | {f"y{i}": [0.5] for i in range(k)})
    pick = lambda v: F.create_map(*[F.lit(x) for c, m in zip(cells, v, strict=True) for x in (c.g, float(m))])[F.col("g")]
    spread = d.select("g", F.abs(F.col("y") - pick([c.m for c in cells])).alias("a"), F.abs(F.col("y") - pick([medians[f"y{i}"][0] for i in range(k)])).alias("b"))
    for test, c in (("levene", "a"), ("brown_forsythe", "b")):
        f, p, q = _one_way(cells_of(spread, c), k, n)
        add(test, f, p, q, dist.f_sf(f, p, q))
    kept = Kept(rank_average(d, "y", "r"))
    ranked = kept.rows
    by_rank = cells_of(ranked, "r")
    ss = ranked.agg(F.var_samp("r")).first()[0]
    stat = sum(c.n * (c.m - (n + 1) / 2) ** 2 for c in by_rank) / ss
    add("kruskal_wallis", stat, k - 1, None, dist.chi2_sf(stat, k - 1))
    scores = ranked.select("r").distinct().withColumn("z", normal_quantile(F.col("r") / (n + 1)))
    scored = ranked.join(scores, "r")
    z = cells_of(scored, "z")
    v = scored.agg(F.sum(F.col("z") * F.col("z"))).first()[0] / (n - 1)
    stat = sum(c.n * c.m**2 for c in z) / v
    add("van_der_waerden", stat, k - 1, None, dist.chi2_sf(stat, k - 1))
    median = medians["y"][0]
    over = {r.g: r.c for r in d.groupBy("g").agg(F.count_if(F.col("y") > median).alias("c")).collect()}
    share = sum(over.values()) / n
    stat = sum((over[c.g] - c.n * share) ** 2 / (c.n * share * (1 - share)) for c in cells)
    add("mood_median", stat, k - 1, None, dist.chi2_sf(stat, k - 1))
    if k == 2:
        f = cells[0].v / cells[1].v
        p = dist.f_sf(f, cells[0].n - 1, cells[1].n - 1)
        add("f_variance", f, cells[0].n - 1, cells[1].n - 1, 2 * min(p, 1 - p))
        u = by_rank[0].n * by_rank[0].m - cells[0].n * (cells[0].n + 1) / 2
        sd = math.sqrt(cells[0].n * cells[1].n * ss / n)
        zs = (u - cells[0].n * cells[1].n / 2) / sd
        add("mann_whitney", zs, 1, None, 2 * (1 - dist.norm_cdf(abs(zs))))
    kept.drop()
    return rows(df.sparkSession, out, _TEST)


def edf_of(d: DataFrame, p: Column, n: int) -> dict[str, float]:
    """ks, cramer_von_mises, anderson_darling and watson of column y against the distribution function p; one row a distinct value, sums over its places in closed form."""
    values = d.groupBy("y").agg(F.count("*").alias("c")).withColumn("p", F.greatest(F.least(p, F.lit(1 - 1e-16)), F.lit(1e-300)))
    v = running_sum(values, "y", "c", "hi").withColumn("hi", F.col("hi").cast("long")).withColumn("lo", F.col("hi") - F.col("c"))
    u, l, c, q = F.col("hi") / n, F.col("lo") / n, F.col("c"), F.col("p")  # noqa: E741
    got = v.agg(
        F.max(F.greatest(u - q, q - l)).alias("ks"),
        F.sum(c * (F.pow(q - (u + l) / 2, 2) + F.pow(u - l, 2) / 12 - 1.0 / (12.0 * n * n))).alias("w"),
        F.sum(c * ((u + l) * F.log(q) + (2 - u - l) * F.log(1 - q))).alias("a"),
        (F.sum(q * c) / n).alias("mean"),
    ).first()
    w = got.w + 1 / (12 * n)
    return {"ks": got.ks, "cramer_von_mises": w, "anderson_darling": -n - got.a, "watson": w - n * (got.mean - 0.5) ** 2}


def edf_statistics(df: DataFrame, y: str) -> DataFrame:
    """Fit of a normal with estimated moments: lilliefors (KS), cramer_von_mises, anderson_darling, watson."""
    d = df.select(F.col(y).cast("double").alias("y")).where("y is not null")
    n, m, s = d.agg(F.count("*"), F.avg("y"), F.stddev_samp("y")).first()
    got = edf_of(d, normal_cdf((F.col("y") - m) / s), n)
    return rows(df.sparkSession, [{"test": "lilliefors" if k == "ks" else k, "n": n, "statistic": x} for k, x in got.items()], "test string, n long, statistic double")
