"""One grouped kernel per series: rows of a series are sorted by time inside the kernel, many series run in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_series(df: DataFrame, columns: list[str], order: str, f: Callable[[np.ndarray, np.ndarray], dict], schema: str, by: str | None = None) -> DataFrame:
    """f(times, values) -> columns of the result; values have one column a variable. Rows that miss a value are left out.

    Without by there is one series, which is one task whatever is done to it.
    """
    key = by or "_series"
    d = df.select(*([by] if by else [F.lit("all").alias("_series")]), order, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = pd.DataFrame(f(pdf[order].to_numpy(), pdf[columns].to_numpy(float)))
        if by:
            out.insert(0, by, pdf[key].iloc[0])
        return out.replace([np.inf, -np.inf], np.nan)

    kind = f"{by} {df.schema[by].dataType.simpleString()}, " if by else ""
    return d.groupBy(key).applyInPandas(go, kind + schema)


def tidy(names: tuple[str, ...], rows: list[tuple]) -> dict:
    """Columns of a kernel's result from its rows."""
    return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}
