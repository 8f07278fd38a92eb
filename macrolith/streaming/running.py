"""Sufficient statistics of a stream: regressions and moments kept up to date by windowed aggregates with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    d = stream.withColumn(time, F.col(time).cast("timestamp"))
    return d.withWatermark(time, late) if stream.isStreaming else d


def windowed_moments(stream: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """start, [by], n, mean, sd per tumbling window; works on batch frames too."""
    d = _timed(stream, time, late)
    got = d.groupBy(F.window(time, width).alias("w"), *(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return got.select(F.col("w.start").alias("start"), *(by or []), "n", "mean", "sd")


def windowed_regression(stream: DataFrame, time: str, y: str, x: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, n, slope, intercept per tumbling window."""
    d = _timed(stream, time, late)
    got = d.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))
    return got.select(F.col("w.start").alias("start"), "n", "slope", "intercept")
