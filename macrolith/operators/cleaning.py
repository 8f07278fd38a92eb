"""Row filters, diagnosis and repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import blocked
from ..plans.store import stored

INF = float("inf")


def _bad(c: str) -> Column:
    x = F.col(c)
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(INF))


def dropna(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without rows that miss a value, or have an infinite one, in the columns."""
    return df.where(~reduce(lambda a, b: a | b, [_bad(c) for c in columns]))


def keep_rows(df: DataFrame, order: list[str], positions: list[int]) -> DataFrame:
    """Rows by their 1-based position in an order."""
    if len(order) == 1:
        d, _ = blocked(df, order[0])
        return d.where(F.col("_place").isin(positions)).drop("_block", "_place", "_halo")
    # Of several columns: ranges of the order, stored so that they stay what they are, then places within and the rows of the ranges before.
    d = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, shift = 0, []
    for r in d.groupBy("_range").count().orderBy("_range").collect():  # one row a partition
        shift += [F.lit(r["_range"]), F.lit(before)]
        before += r["count"]
    if not shift:
        return df.limit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.create_map(*shift)[F.col("_range")]
    return d.withColumn("_row", place).where(F.col("_row").isin(positions)).drop("_row", "_range")


def diagnose(df: DataFrame, columns: list[str], short: int = 10) -> DataFrame:
    """One row a variable: rows, missing, infinite, constant, short. One pass over the data."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        ok = F.when(~_bad(c), x)
        parts.append(F.struct(F.lit(c).alias("variable"), F.count("*").alias("n"), F.count_if(x.isNull() | F.isnan(x)).alias("n_missing"), F.count_if(F.abs(x) == INF).alias("n_inf"), F.coalesce(F.min(ok) == F.max(ok), F.lit(False)).alias("is_constant"), (F.count("*") < short).alias("is_short")))
    return df.agg(F.array(*parts).alias("v")).select(F.inline("v"))


def interpolate(df: DataFrame, column: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Linear by row position inside, nearest value at both ends; within groups."""
    if not by:
        return _interpolate_all(df, column, order)
    w = Window.partitionBy(*by).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = F.when(~_bad(column), F.col(column))
    d = df.withColumn("_k", F.row_number().over(w)).withColumn("_x", x)
    at = F.when(F.col("_x").isNotNull(), F.col("_k"))
    d = d.withColumns({"_x0": F.last("_x", True).over(back), "_k0": F.last(at, True).over(back), "_x1": F.first("_x", True).over(ahead), "_k1": F.first(at, True).over(ahead)})
    between = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col("_k") - F.col("_k0")) / (F.col("_k1") - F.col("_k0"))
    value = F.coalesce(F.col("_x"), F.when(F.col("_x0").isNull(), F.col("_x1")).when(F.col("_x1").isNull(), F.col("_x0")).otherwise(between))
    return d.withColumn(column, value).drop("_k", "_x", "_x0", "_k0", "_x1", "_k1")


def _interpolate_all(df: DataFrame, column: str, order: str) -> DataFrame:
    """Over a whole order: stretches of it side by side, which know the nearest values of the others from one row a stretch."""
    d, sizes = blocked(df, order)
    d = d.withColumn("_x", F.when(~_bad(column), F.col(column)))
    known = F.struct("_x", "_place")
    ends = {r["_block"]: (r.first, r.last) for r in d.where("_x is not null").groupBy("_block").agg(F.min_by(known, "_place").alias("first"), F.max_by(known, "_place").alias("last")).collect()}
    none = (None, None)
    before, after, seen = [], [], none
    for k in range(len(sizes)):
        before.append(seen)
        seen = (ends[k][1]["_x"], ends[k][1]["_place"]) if k in ends else seen
    seen = none
    for k in reversed(range(len(sizes))):
        after.insert(0, seen)
        seen = (ends[k][0]["_x"], ends[k][0]["_place"]) if k in ends else seen
    of = lambda v, i, kind: F.create_map(*[F.lit(z) if j % 2 == 0 else F.lit(z).cast(kind) for k, p in enumerate(v) for j, z in enumerate((k, p[i]))])[F.col("_block")]
    w = Window.partitionBy("_block").orderBy("_place")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("_x").isNotNull(), F.col("_place"))
    d = d.withColumns({
        "_x0": F.coalesce(F.last("_x", True).over(back), of(before, 0, "double")), "_k0": F.coalesce(F.last(at, True).over(back), of(before, 1, "long")),
        "_x1": F.coalesce(F.first("_x", True).over(ahead), of(after, 0, "double")), "_k1": F.coalesce(F.first(at, True).over(ahead), of(after, 1, "long")),
    })
    between = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col("_place") - F.col("_k0")) / (F.col("_k1") - F.col("_k0"))
    value = F.coalesce(F.col("_x"), F.when(F.col("_x0").isNull(), F.col("_x1")).when(F.col("_x1").isNull(), F.col("_x0")).otherwise(between))
    return d.withColumn(column, value).drop("_x", "_x0", "_k0", "_x1", "_k1", "_block", "_place", "_halo")


def fix(df: DataFrame, columns: list[str], method: str = "listwise", order: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Infinite to missing, then listwise deletion, interpolation or mean fill (within groups), then constant columns go."""
    df = df.withColumns({c: F.when(~_bad(c), F.col(c)) for c in columns})
    if method == "listwise":
        df = dropna(df, columns)
    elif method == "interpolate":
        for c in columns:
            df = interpolate(df, c, order, by)
    elif method == "mean":
        if by:
            df = df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(Window.partitionBy(*by))) for c in columns})
        else:
            means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
            df = df.fillna({c: means[c] for c in columns if means[c] is not None})
    else:
        raise ValueError(f"method {method} is not known")
    flat = df.agg(*[(F.min(c) == F.max(c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if flat[c]])
