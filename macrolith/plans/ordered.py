"""Running sums over a global order without one task that gets all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def running_sum(df: DataFrame, order: str, value: str, name: str, parts: int = PARTS) -> DataFrame:
    """Adds the sum of value over all rows up to this one in the order; order values must be distinct.

    Rows are bucketed by approximate quantiles of the order, summed inside each
    bucket by a window, and shifted by the total of the buckets before.
    """
    cuts = sorted(set(df.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 2000)).first()[0] or []))
    d = df.withColumn("_bucket", _stretch(order, cuts))
    totals = dict(d.groupBy("_bucket").agg(F.sum(value)).collect())  # one row a bucket
    keys = sorted(totals)
    before = dict(zip(keys, [0, *accumulate(totals[k] for k in keys)], strict=False))
    shift = F.create_map(*[F.lit(x) for k in keys for x in (k, float(before[k]))]) if keys else F.create_map(F.lit(0), F.lit(0.0))
    w = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn(name, F.sum(value).over(w) + shift[F.col("_bucket")]).drop("_bucket")


#: Rows of a stretch that are worth a task, and stretches at most.
STRETCH, MOST_PARTS = 250_000, 256


def _stretch(order: str, cuts: list) -> Column:
    """How many of the sorted cuts lie below the order's value, by halving."""

    def of(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(order) > F.lit(cuts[mid]), of(mid + 1, hi)).otherwise(of(lo, mid))

    return of(0, len(cuts))


def blocked(df: DataFrame, order: str, before: int = 0, after: int = 0, parts: int | None = None, total: int | None = None) -> tuple[DataFrame, list[int]]:
    """Rows with _block (consecutive stretches of the order), _place (1-based position among all) and _halo, and the rows of each block.

    With before or after, each block also has that many rows of its neighbours,
    marked _halo, so that windows over a block see them. Blocks come from
    approximate quantiles and are merged until each has rows enough for its
    neighbours; their number follows the rows (total, counted if not given)
    unless parts says it. Order values must be distinct.
    """
    if parts is None:
        total = df.count() if total is None else total
        parts = max(1, min(MOST_PARTS, -(-total // STRETCH)))
    if parts == 1:
        total = df.count() if total is None else total
        # Always 0, but no constant to the optimizer, so the window keeps its key.
        d = df.withColumn("_block", F.pmod(F.hash(order), F.lit(1)))
        d = d.withColumn("_place", F.row_number().over(Window.partitionBy("_block").orderBy(order)).cast("long"))
        return d.withColumn("_halo", F.lit(False)), [total]
    cuts = df.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    d = df.withColumn("_block", _stretch(order, sorted(set(cuts))))
    counts = dict(d.groupBy("_block").count().collect())  # at most parts rows
    least, block, sizes = max(1, before, after), {}, []
    held = 0
    for k in sorted(counts):
        block[k] = len(sizes)
        held += counts[k]
        if held >= least:
            sizes.append(held)
            held = 0
    if held and sizes:
        sizes[-1] += held
        block = {k: min(v, len(sizes) - 1) for k, v in block.items()}
    elif held:
        sizes = [held]
    sizes = sizes or [0]
    start = [0, *accumulate(sizes)][:-1]
    at = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), k + 1)
    d = d.withColumn("_block", at([block.get(k, 0) for k in range(parts)], F.col("_block")))
    d = d.withColumn("_place", (F.row_number().over(Window.partitionBy("_block").orderBy(order)) + at(start, F.col("_block"))).cast("long"))
    if not before and not after:
        return d.withColumn("_halo", F.lit(False)), sizes
    own, size = F.col("_place") - at(start, F.col("_block")), at(sizes, F.col("_block"))
    to = F.filter(
        F.array(F.col("_block"), F.when(own > size - before, F.col("_block") + 1), F.when(own <= after, F.col("_block") - 1)),
        lambda b: b.isNotNull() & (b >= 0) & (b < len(sizes)),
    )
    names = [c for c in d.columns if c != "_block"]
    out = d.select(*[F.col(f"`{c}`") for c in names], F.col("_block").alias("_own"), F.explode(to).alias("_block"))
    return out.withColumn("_halo", F.col("_own") != F.col("_block")).drop("_own"), sizes


def ordered_lags(df: DataFrame, column: str, order: str, lags: int) -> DataFrame:
    """Adds {column}_l1..: values so many rows before in the order, null where there is none."""
    d, _ = blocked(df, order, lags)
    w = Window.partitionBy("_block").orderBy("_place")
    return d.withColumns({f"{column}_l{j}": F.lag(column, j).over(w) for j in range(1, lags + 1)}).where("not _halo").drop("_block", "_place", "_halo")


#: Values that a quantile's bracket may hold when they are looked at one by one.
BRACKET = 100_000


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation (type 7) of several columns, without one buffer of all distinct values.

    Approximate quantiles give brackets about the ranks sought, one pass counts
    what lies below and inside, and the distinct values inside are read with
    their counts. A bracket that holds too many values is narrowed the same way.
    """
    todo = [(c, p) for c, ps in wanted.items() for p in ps]
    names = list(wanted)
    eps = 2e-4
    first = df.agg(*[F.count(c) for c in names], *[F.percentile_approx(F.col(c).cast("double"), [max(0.0, p - eps), min(1.0, p + eps)], 10_000) for c, p in todo]).first()
    size = dict(zip(names, first[: len(names)], strict=True))
    bracket = {k: tuple(v) if v else None for k, v in zip(todo, first[len(names) :], strict=True)}
    found: dict[tuple[str, float], float | None] = {k: None for k in todo if not size[k[0]]}
    for _ in range(20):
        open_ = [k for k in todo if k not in found]
        if not open_:
            break
        x = lambda k: F.col(k[0]).cast("double")
        counts = df.agg(*[F.count_if(x(k) < bracket[k][0]) for k in open_], *[F.count_if(x(k) <= bracket[k][1]) for k in open_]).first()
        m = len(open_)
        small = []
        for i, k in enumerate(open_):
            below, upto = counts[i], counts[m + i]
            lo, hi = bracket[k]
            rank = k[1] * (size[k[0]] - 1)
            low, high = int(rank), min(int(rank) + 1, size[k[0]] - 1)
            if low < below or high >= upto:  # the approximation missed; widen to everything on that side
                bracket[k] = (float("-inf") if low < below else lo, float("inf") if high >= upto else hi)
            elif lo == hi:
                found[k] = lo
            elif upto - below <= BRACKET:
                small.append((k, below, rank))
            else:
                # Narrow by approximate quantiles of the values inside.
                inside = df.select(x(k).alias("v")).where((F.col("v") >= lo) & (F.col("v") <= hi))
                part = upto - below
                q = [max(0.0, (low - below) / part - eps), min(1.0, (high - below) / part + eps)]
                new = tuple(inside.agg(F.percentile_approx("v", q, 10_000)).first()[0])
                if new == (lo, hi):
                    small.append((k, below, rank))
                bracket[k] = new
        if small:
            cells = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), x(k).alias("v"), ((x(k) >= bracket[k][0]) & (x(k) <= bracket[k][1])).alias("ok")) for i, (k, _, _) in enumerate(small)]), lambda s: F.coalesce(s["ok"], F.lit(False)))
            got = df.select(F.explode(cells).alias("s")).groupBy("s.i", "s.v").count().collect()
            for i, (k, below, rank) in enumerate(small):
                values = sorted((r.v, r["count"]) for r in got if r.i == i)
                ends = list(accumulate((c for _, c in values), initial=below))
                at = lambda n, values=values, ends=ends: next(v for (v, _), e in zip(values, ends[1:], strict=True) if n < e)
                low = int(rank)
                a, b = at(low), at(min(low + 1, size[k[0]] - 1))
                found[k] = a if a == b else a * (low + 1 - rank) + b * (rank - low)
    return {c: [found[c, p] for p in ps] for c, ps in wanted.items()}
