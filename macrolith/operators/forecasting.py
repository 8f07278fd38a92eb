"""Forecast evaluation and combination, native aggregates throughout."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..plans.gram import Moments
from .describe import rows
from .kernels import per_series
from .series import long_run_covariance


def accuracy(df: DataFrame, actual: str, forecasts: list[str], by: list[str] | None = None) -> DataFrame:
    """forecast, n, me, mae, rmse, mape, theil_u1: one pass, all forecasts over the rows that have all."""
    d = df.dropna(subset=[actual, *forecasts])
    a = F.col(actual)
    parts = []
    for c in forecasts:
        e = a - F.col(c)
        rm = F.sqrt(F.avg(e * e))
        parts.append(F.struct(F.lit(c).alias("forecast"), F.count("*").alias("n"), F.avg(e).alias("me"), F.avg(F.abs(e)).alias("mae"), rm.alias("rmse"), (100 * F.avg(F.abs(e / a))).alias("mape"), (rm / (F.sqrt(F.avg(a * a)) + F.sqrt(F.avg(F.col(c) * F.col(c))))).alias("theil_u1")))
    keys = by or []
    return d.groupBy(*keys).agg(F.array(*parts).alias("v")).select(*keys, F.inline("v"))


def diebold_mariano(df: DataFrame, actual: str, one: str, two: str, order: str, horizon: int = 1, power: int = 2, by: str | None = None) -> DataFrame:
    """statistic (small-sample corrected), df, p_value of equal accuracy."""

    def f(t, v):
        d = np.abs(v[:, 0] - v[:, 1]) ** power - np.abs(v[:, 0] - v[:, 2]) ** power
        n = len(d)
        z = d - d.mean()
        lr = z @ z / n + 2 * sum(z[j:] @ z[:-j] / n for j in range(1, horizon))
        s = d.mean() / math.sqrt(max(lr, 1e-300) / n) * math.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
        return {"statistic": [s], "df": [n - 1], "p_value": [dist.t_two_sided(s, n - 1)]}

    return per_series(df, [actual, one, two], order, f, "statistic double, df int, p_value double", by)


def clark_west(df: DataFrame, actual: str, small: str, large: str, order: str, by: str | None = None) -> DataFrame:
    def f(t, v):
        d = (v[:, 0] - v[:, 1]) ** 2 - ((v[:, 0] - v[:, 2]) ** 2 - (v[:, 1] - v[:, 2]) ** 2)
        s = d.mean() / math.sqrt(long_run_covariance(d, 0)[0, 0] / len(d))
        return {"statistic": [s], "p_value": [1 - dist.norm_cdf(s)]}

    return per_series(df, [actual, small, large], order, f, "statistic double, p_value double", by)


def mincer_zarnowitz(df: DataFrame, actual: str, forecast: str) -> DataFrame:
    """const, slope, statistic (F of 0 and 1), p_value."""
    m = Moments.of(df.dropna(subset=[actual, forecast]), [actual, forecast])
    b, inv, rss = m.solve(actual, ["const", forecast])
    d = b - np.array([0, 1])
    s = float(d @ np.linalg.solve(inv * rss / (m.n - 2), d)) / 2
    return rows(df.sparkSession, [{"const": float(b[0]), "slope": float(b[1]), "statistic": s, "p_value": dist.f_sf(s, 2, m.n - 2)}], "const double, slope double, statistic double, p_value double")


def combine(df: DataFrame, actual: str, forecasts: list[str], method: str = "mean") -> DataFrame:
    """Adds column combined: mean, median, inverse_mse or least_squares weights from all rows."""
    if method == "mean":
        return df.withColumn("combined", sum(F.col(c) for c in forecasts) / len(forecasts))
    if method == "median":
        return df.withColumn("combined", _row_median(forecasts))
    d = df.dropna(subset=[actual, *forecasts])
    if method == "inverse_mse":
        mse = d.agg(*[F.avg(F.pow(F.col(actual) - F.col(c), 2)) for c in forecasts]).first()
        w, const = np.array([1 / m for m in mse]), 0.0
        w = w / w.sum()
    elif method == "least_squares":
        m = Moments.of(d, [actual, *forecasts])
        b, _, _ = m.solve(actual, ["const", *forecasts])
        const, w = float(b[0]), b[1:]
    else:
        raise ValueError(f"method {method} is not known")
    return df.withColumn("combined", sum((F.lit(float(a)) * F.col(c) for a, c in zip(w, forecasts, strict=True)), F.lit(const)))


def _row_median(columns: list[str]):
    s, n = F.array_sort(F.array(*columns)), len(columns)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def naive_forecasts(df: DataFrame, column: str, order: str, lags: dict[str, int], by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or [])).orderBy(order)
    return df.withColumns({k: F.lag(column, j).over(w) for k, j in lags.items()})
