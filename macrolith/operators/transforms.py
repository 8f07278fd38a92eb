"""Stationarity transforms, panel lags by time value, demeaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import blocked, running_sum

#: Rows lost by code; a logarithm is charged one in the form for many columns.
LOSS = {1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 6: 2, 7: 2}


def tcode(x: Column, code: int, w) -> Column:
    """1 level, 2 difference, 3 second difference, 4 log, 5 log difference, 6 second log difference, 7 difference of growth rates."""
    d = lambda c: c - F.lag(c).over(w)
    d2 = lambda c: c - 2 * F.lag(c).over(w) + F.lag(c, 2).over(w)
    if code == 7:
        one, two = F.lag(x).over(w), F.lag(x, 2).over(w)
        return x / one - one / two
    return {1: lambda: x, 2: lambda: d(x), 3: lambda: d2(x), 4: lambda: F.log(x), 5: lambda: d(F.log(x)), 6: lambda: d2(F.log(x))}[code]()


def apply_tcodes(df: DataFrame, codes: dict[str, int], order: str, by: list[str] | None = None, trim: bool = True) -> DataFrame:
    """Each column by its code; a column with a value of 0 or less falls back from 4 and up to 2; leading rows go to the longest loss."""
    logs = [c for c, k in codes.items() if k >= 4]
    if logs:
        low = df.agg(*[F.min(c).alias(c) for c in logs]).first()
        codes = {c: 2 if c in logs and low[c] is not None and low[c] <= 0 else k for c, k in codes.items()}
    lost = max([1 if k == 4 else LOSS[k] for k in codes.values()], default=0)
    d, w, place = _frames(df, order, by, 2)
    out = d.withColumns({c: tcode(F.col(c), k, w) for c, k in codes.items()} | {"_k": place})
    return (out.where(F.col("_k") > lost) if trim else out).where("not _halo").drop("_k", *_MARKS)


_MARKS = ("_block", "_place", "_halo")


def _frames(df: DataFrame, order: str, by: list[str] | None, before: int, after: int = 0):
    """Rows, a window and the place in it: of groups, or of stretches of the whole order with their neighbours' rows."""
    if by:
        w = Window.partitionBy(*by).orderBy(order)
        return df.withColumn("_halo", F.lit(False)), w, F.row_number().over(w)
    d, _ = blocked(df, order, before, after)
    return d, Window.partitionBy("_block").orderBy("_place"), F.col("_place")


def inverse_tcode(df: DataFrame, column: str, code: int, order: str, previous: list[float]) -> DataFrame:
    """Levels again from a transformed column and the one or two levels before it (oldest first)."""
    x = F.col(column)
    run = lambda d, c, name: running_sum(d, order, c, name)
    if code == 1:
        return df
    if code == 4:
        return df.withColumn(column, F.exp(x))
    base = [F.log(F.lit(float(p))) if code in (5, 6) else F.lit(float(p)) for p in previous]
    df = run(df, column, "_s")
    if code in (2, 5):
        level = base[-1] + F.col("_s")
    elif code in (3, 6):
        df = run(df.withColumn("_d", base[1] - base[0] + F.col("_s")), "_d", "_t")
        level = base[1] + F.col("_t")
    else:
        df = run(df.withColumn("_d", F.log1p(base[1] / base[0] - 1 + F.col("_s"))), "_d", "_t")
        level = base[1] * F.exp(F.col("_t"))
    return df.withColumn(column, F.exp(level) if code in (5, 6) else level).drop("_d", "_s", "_t")


def panel_shift(df: DataFrame, column: str, k: int, unit: str, time: str) -> Column:
    """The value k time units earlier (later if negative) in the unit; null where that time has no row.

    Times are unique in a unit, so the row sought lies at most k rows away; a
    range frame finds it by value in one sort, without a self join.
    """
    w = Window.partitionBy(unit).orderBy(time).rangeBetween(-k, -k)
    return F.first(F.col(column)).over(w)


def panel_lag(df: DataFrame, column: str, unit: str, time: str, k: int = 1, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"lag{k}_{column}", panel_shift(df, column, k, unit, time))


def panel_lead(df: DataFrame, column: str, unit: str, time: str, k: int = 1, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"lead{k}_{column}", panel_shift(df, column, -k, unit, time))


def panel_diff(df: DataFrame, column: str, unit: str, time: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"d_{column}", F.col(column) - panel_shift(df, column, 1, unit, time))


def demean(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """x less its group mean. Means are aggregated first, so a hot group is combined before the shuffle."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    out = df.join(means, by)
    return out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def two_way_demean(df: DataFrame, columns: list[str], unit: str, time: str) -> DataFrame:
    """The residuals of each column on unit and time effects; rows with a null in any column or key are left out.

    Balanced panels take means out in one pass. Others are solved for the time
    effects (``time_effects``); the unit effects are means of what is left.
    """
    d = df.dropna(subset=[unit, time, *columns])
    cells = d.groupBy(unit, time).agg(F.count("*").alias("n"))
    count, most, units, times = cells.agg(F.count("*"), F.max("n"), F.count_distinct(unit), F.count_distinct(time)).first()
    if count and (most, count) != (1, units * times):
        effects = time_effects(d, columns, unit, time)
        left = d.join(effects, time).withColumns({c: F.col(c) - F.col(f"_b_{c}") for c in columns}).drop(*[f"_b_{c}" for c in columns])
        return demean(left, columns, [unit])
    grand = d.agg(*[F.avg(c).alias(c) for c in columns]).first()
    for key, tag in ((unit, "u"), (time, "t")):
        d = d.join(d.groupBy(key).agg(*[F.avg(c).alias(f"_{tag}_{c}") for c in columns]), key)
    return d.withColumns({c: F.col(c) - F.col(f"_u_{c}") - F.col(f"_t_{c}") + F.lit(grand[c]) for c in columns}).drop(*[f"_{g}_{c}" for g in "ut" for c in columns])


def time_effects(df: DataFrame, columns: list[str], unit: str, time: str, tol: float = 1e-12, most: int = 1000) -> DataFrame:
    """time, _b_{column}: effects of the times when units have effects too, by conjugate gradients.

    Unit effects are solved out, which leaves one equation a time. Vectors are
    rows by time, all columns side by side; a step is two aggregates over the
    panel's cells, weighted by rows, so neither units nor times need fit on one
    machine. Steps end when the scaled residuals have fallen to ``tol``; if they
    haven't after ``most`` steps, that is an error.
    """
    from ..plans.store import Kept

    k = range(len(columns))
    cells = Kept(df.groupBy(F.col(unit).alias("u"), F.col(time).alias("t")).agg(F.count("*").cast("double").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]))
    c = cells.rows
    means = c.groupBy("u").agg(*[(F.sum(f"s{i}") / F.sum("n")).alias(f"m{i}") for i in k])
    start = c.join(means, "u").groupBy("t").agg(F.sum("n").alias("d"), *[F.sum(F.col(f"s{i}") - F.col("n") * F.col(f"m{i}")).alias(f"r{i}") for i in k])
    # Residuals that are rounding of the column itself are as good as zero.
    least = [1e-30 * (v or 0.0) for v in c.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.col("n")) for i in k]).first()]
    state = start.select("t", "d", *[F.lit(0.0).alias(f"b{i}") for i in k], *[F.col(f"r{i}") for i in k], *[(F.col(f"r{i}") / F.col("d")).alias(f"p{i}") for i in k])
    now, held, first = state, None, None
    for _ in range(most):
        p = c.join(now.select("t", *[f"p{i}" for i in k]), "t").groupBy("u").agg(*[(F.sum(F.col("n") * F.col(f"p{i}")) / F.sum("n")).alias(f"m{i}") for i in k])
        through = c.join(p, "u").groupBy("t").agg(*[F.sum(F.col("n") * F.col(f"m{i}")).alias(f"g{i}") for i in k])
        both = Kept(now.join(through, "t").select(*now.columns, *[(F.col("d") * F.col(f"p{i}") - F.col(f"g{i}")).alias(f"q{i}") for i in k]))
        sums = both.rows.agg(*[F.sum(F.col(f"{a}{i}") * F.col(f"{b}{i}") / (F.lit(1.0) if a == "p" else F.col("d"))) for i in k for a, b in (("r", "r"), ("p", "q"), ("r", "q"), ("q", "q"))]).first()
        if held:
            held.drop()
        held = both
        rr, pq, rq, qq = (sums[j::4] for j in range(4))
        first = first or [v or 0.0 for v in rr]
        if all((v or 0.0) <= max(tol * tol * f, z) for v, f, z in zip(rr, first, least, strict=True)):
            break
        alpha = [a / b if b and b > 0 and a > 0 else 0.0 for a, b in zip(rr, pq, strict=True)]
        beta = [max(0.0, a - 2 * x * b + x * x * d) / a if a > 0 else 0.0 for a, b, d, x in zip(rr, rq, qq, alpha, strict=True)]
        r = [F.col(f"r{i}") - F.lit(alpha[i]) * F.col(f"q{i}") for i in k]
        now = held.rows.select("t", "d", *[(F.col(f"b{i}") + F.lit(alpha[i]) * F.col(f"p{i}")).alias(f"b{i}") for i in k], *[r[i].alias(f"r{i}") for i in k], *[(r[i] / F.col("d") + F.lit(beta[i]) * F.col(f"p{i}")).alias(f"p{i}") for i in k])
    else:
        raise RuntimeError(f"time effects haven't settled after {most} steps")
    cells.drop()
    return held.rows.select(F.col("t").alias(time), *[F.col(f"b{i}").alias(f"_b_{x}") for i, x in enumerate(columns)])


def lag_design(df: DataFrame, columns: list[str], p: int, order: str, by: list[str] | None = None) -> DataFrame:
    """Columns and their lags 1..p as {column}_l{j}; rows without all lags go."""
    d, w, place = _frames(df, order, by, p)
    out = d.withColumns({f"{c}_l{j}": F.lag(c, j).over(w) for j in range(1, p + 1) for c in columns} | {"_k": place})
    return out.where((F.col("_k") > p) & ~F.col("_halo")).drop("_k", *_MARKS)
