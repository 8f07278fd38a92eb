"""Breaks in regressions and explosive episodes, by prefix sums of cross products.

Cross products of any stretch of a series are the difference of two prefix sums,
so its regression is one small solve and all stretches are solved in batches;
nothing is refitted row by row. One series is one kernel, quadratic in its rows
and bounded by ``ROWS``; many run side by side by a group column.

Breaks (Bai and Perron, 1998, 2003): all coefficients may change; partitions of
least residual squares by dynamic programming; the number of breaks by testing
one more against so many, with p values from simulated Brownian bridges, or by
criteria. Episodes (Phillips, Shi and Yu, 2015): backward recursive unit-root
statistics against simulated quantiles; replicates are rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import guarded_inverse
from .kernels import per_series, tidy

#: Rows of one series that a kernel takes.
ROWS = 5_000


def _prefix(w: np.ndarray) -> np.ndarray:
    """Sums of products of the rows before each place."""
    if len(w) > ROWS:
        raise ValueError(f"a series has {ROWS} rows at most")
    out = np.zeros((len(w) + 1, w.shape[1], w.shape[1]))
    np.cumsum(w[:, :, None] * w[:, None, :], axis=0, out=out[1:])
    return out


# -- breaks ---------------------------------------------------------------------------


def segment_squares(y: np.ndarray, x: np.ndarray, least: int) -> np.ndarray:
    """Residual squares of the regression on rows a .. b - 1, for all a < b at least so far apart; infinite elsewhere."""
    n, k = x.shape
    scale = np.maximum(np.abs(x).max(0), 1e-300)
    mean = y.mean()
    g = _prefix(np.column_stack([x / scale, y - mean if (np.ptp(x, axis=0) == 0).any() else y]))
    out = np.full((n + 1, n + 1), np.inf)
    for a in range(n - least + 1):
        d = g[a + least :] - g[a]
        s, xy = d[:, :k, :k], d[:, :k, k]
        b = np.linalg.solve(s + 1e-12 * np.trace(s, axis1=1, axis2=2)[:, None, None] * np.eye(k), xy[..., None])[..., 0]
        out[a, a + least :] = np.maximum(0.0, d[:, k, k] - (b * xy).sum(1))
    return out


def partitions(r: np.ndarray, most: int) -> list[tuple[float, list[int]]]:
    """Least residual squares and break places (first rows of the later segments) for 0 .. most breaks, as far as there is room."""
    n = len(r) - 1
    best, cuts, out = r[0], [], []
    for m in range(most + 1):
        if m:
            total = best[:, None] + r
            cut = np.argmin(total, axis=0)
            best = total[cut, np.arange(n + 1)]
            cuts.append(cut)
        if not np.isfinite(best[n]):
            break
        at, b = [], n
        for c in reversed(cuts):
            b = int(c[b])
            at.append(b)
        out.append((float(best[n]), at[::-1]))
    return out


@lru_cache(maxsize=16)
def bridge_suprema(q: int, trim: float, replicates: int = 4000, steps: int = 500, seed: int = 5) -> np.ndarray:
    """Sorted draws of the supremum, over the inner part, of a q-dimensional bridge's square over its variance."""
    rng = np.random.default_rng(seed)
    at = np.arange(1, steps + 1) / steps
    inner = (at >= trim) & (at <= 1 - trim)
    out = []
    for _ in range(replicates // 200):
        w = np.cumsum(rng.normal(size=(200, steps, q)), axis=1) / math.sqrt(steps)
        b = w - at[None, :, None] * w[:, -1:, :]
        out.append(((b**2).sum(2) / (at * (1 - at) + 1e-300))[:, inner].max(1))
    return np.sort(np.concatenate(out))


def more_breaks(r: np.ndarray, at: list[int], squares: float, k: int) -> float:
    """The statistic of one break more: the largest fall of residual squares in any segment over their variance."""
    n = len(r) - 1
    ends = [0, *at, n]
    fall = 0.0
    for a, b in zip(ends, ends[1:], strict=False):
        split = r[a, a:b] + r[a:b, b]
        fall = max(fall, float(r[a, b] - split.min()) if np.isfinite(split).any() else 0.0)
    return fall / (squares / max(1, n - (len(at) + 1) * k))


def find_breaks(y: np.ndarray, x: np.ndarray, most: int = 5, trim: float = 0.15, level: float = 0.05) -> dict:
    """For 0 .. most breaks their places, squares, criteria, and the statistic and p value of one more; and the number that testing in turn ends at."""
    n, k = x.shape
    least = max(k + 1, int(trim * n))
    r = segment_squares(y, x, least)
    found = partitions(r, most)
    null = bridge_suprema(k, trim)
    rows_, chosen = [], None
    for m, (squares, at) in enumerate(found):
        free = (m + 1) * k + m
        bic = math.log(max(squares, 1e-300) / n) + free * math.log(n) / n
        lwz = math.log(max(squares, 1e-300) / max(1, n - free)) + free * 0.299 * math.log(n) ** 2.1 / n
        stat = p = None
        if m < most and m + 1 < len(found):
            stat = more_breaks(r, at, squares, k)
            below = np.searchsorted(null, stat) / len(null)
            p = 1 - below ** (m + 1)
        rows_.append((m, squares, bic, lwz, stat, p, at))
        if chosen is None and (p is None or p >= level):
            chosen = m
    return {"rows": rows_, "chosen": chosen if chosen is not None else len(found) - 1}


def break_tests(df: DataFrame, y: str, x: list[str], order: str, most: int = 5, trim: float = 0.15, level: float = 0.05, constant: bool = True, by: str | None = None) -> DataFrame:
    """breaks, rss, bic, lwz, statistic and p_value (of one break more), chosen (where testing in turn stops), dates (first order values of later segments, comma-joined)."""

    def f(t, v):
        z = np.column_stack([np.ones(len(v)), v[:, 1:]]) if constant else v[:, 1:]
        got = find_breaks(v[:, 0], z, most, trim, level)
        return tidy(("breaks", "rss", "bic", "lwz", "statistic", "p_value", "chosen", "dates"), [(m, s, b, w, q, p, m == got["chosen"], ",".join(str(t[k]) for k in at)) for m, s, b, w, q, p, at in got["rows"]])

    return per_series(df, [y, *x], order, f, "breaks int, rss double, bic double, lwz double, statistic double, p_value double, chosen boolean, dates string", by)


def break_coefficients(df: DataFrame, y: str, x: list[str], order: str, breaks: int | None = None, most: int = 5, trim: float = 0.15, level: float = 0.05, constant: bool = True, by: str | None = None) -> DataFrame:
    """segment (1..), first, last, n, term, estimate, std_error: the regression of each segment; as many breaks as testing in turn finds, unless breaks says."""
    kind = df.schema[order].dataType.simpleString()
    names = (["const"] if constant else []) + x

    def f(t, v):
        z = np.column_stack([np.ones(len(v)), v[:, 1:]]) if constant else v[:, 1:]
        got = find_breaks(v[:, 0], z, most if breaks is None else breaks, trim, level)
        m = got["chosen"] if breaks is None else min(breaks, len(got["rows"]) - 1)
        ends, out = [0, *got["rows"][m][6], len(v)], []
        for s, (a, b) in enumerate(zip(ends, ends[1:], strict=False), 1):
            inv = guarded_inverse(z[a:b].T @ z[a:b])
            c = inv @ (z[a:b].T @ v[a:b, 0])
            e = v[a:b, 0] - z[a:b] @ c
            se = np.sqrt(e @ e / max(1, b - a - len(c)) * np.diag(inv))
            out += [(s, t[a], t[b - 1], b - a, n, w, d) for n, w, d in zip(names, c, se, strict=True)]
        return tidy(("segment", "first", "last", "n", "term", "estimate", "std_error"), out)

    return per_series(df, [y, *x], order, f, f"segment int, first {kind}, last {kind}, n int, term string, estimate double, std_error double", by)


# -- explosive episodes -----------------------------------------------------------------


def smallest_window(n: int) -> int:
    return max(8, int((0.01 + 1.8 / math.sqrt(n)) * n))


def recursive_roots(y: np.ndarray, window: int, lags: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each end b = window .. n: the t statistic of y[:b], and the largest of y[a:b] over all starts that leave a window."""
    n, d = len(y), np.diff(y)
    z = (y - y.mean()) / (y.std() or 1.0)
    dz = d / (y.std() or 1.0)
    k = 2 + lags
    w = np.column_stack([np.ones(n - 1 - lags), z[lags:-1], *[dz[lags - j : len(d) - j] for j in range(1, lags + 1)], dz[lags:]])
    g = _prefix(w)
    first, most = np.full(n - window + 1, np.nan), np.full(n - window + 1, np.nan)
    for i, b in enumerate(range(window, n + 1)):
        # A stretch y[a:b] has the regression rows a .. b - 2 - lags.
        s = g[b - 1 - lags] - g[: b - window + 1]
        xx, xy = s[:, :k, :k], s[:, :k, k]
        inv = np.linalg.inv(xx + 1e-13 * np.trace(xx, axis1=1, axis2=2)[:, None, None] * np.eye(k))
        c = (inv @ xy[..., None])[..., 0]
        m = b - 1 - lags - np.arange(b - window + 1)
        v = np.maximum(s[:, k, k] - (c * xy).sum(1), 0) / np.maximum(m - k, 1)
        t = c[:, 1] / np.sqrt(np.maximum(v * inv[:, 1, 1], 1e-300))
        first[i], most[i] = t[0], t.max()
    return first, most


def _null(df: DataFrame, sizes: DataFrame, window: int | None, lags: int, replicates: int, seed: int) -> DataFrame:
    """n, replicate, place, bsadf, sadf, gsadf: the statistics of random walks with a drift of 1 / n; a row a replicate before its places."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, r in zip(pdf.n, pdf.replicate, strict=True):
                y = np.cumsum(np.random.default_rng([seed, int(n), int(r)]).normal(size=n) + 1 / n)
                w = window or smallest_window(n)
                first, most = recursive_roots(y, w, lags)
                yield pd.DataFrame({"n": int(n), "replicate": int(r), "place": np.arange(w, n + 1), "bsadf": most, "sadf": first.max(), "gsadf": most.max()})

    draws = sizes.select(F.col("n").cast("int").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).repartition("n", "replicate")
    return draws.mapInPandas(go, "n int, replicate int, place int, bsadf double, sadf double, gsadf double")


def _statistics(df: DataFrame, column: str, order: str, window: int | None, lags: int, by: str | None) -> DataFrame:
    kind = df.schema[order].dataType.simpleString()

    def f(t, v):
        n = len(v)
        w = window or smallest_window(n)
        if n < w + lags + 3:
            return {"n": [], order: [], "place": [], "sadf_path": [], "bsadf": []}
        first, most = recursive_roots(v[:, 0], w, lags)
        return {"n": n, order: t[w - 1 :], "place": np.arange(w, n + 1), "sadf_path": first, "bsadf": most}

    return per_series(df, [column], order, f, f"n int, {order} {kind}, place int, sadf_path double, bsadf double", by)


def bubble_tests(df: DataFrame, column: str, order: str, window: int | None = None, lags: int = 0, replicates: int = 500, seed: int = 7, by: str | None = None) -> DataFrame:
    """test (sadf, gsadf), statistic, cv_90, cv_95, cv_99, p_value: right-tailed, against simulated random walks of the same length."""
    keys = [by] if by else []
    s = _statistics(df, column, order, window, lags, by).groupBy(*keys, "n").agg(F.max("sadf_path").alias("sadf"), F.max("bsadf").alias("gsadf"))
    null = _null(df, s.select("n").distinct(), window, lags, replicates, seed).groupBy("n", "replicate").agg(F.first("sadf").alias("sadf0"), F.first("gsadf").alias("gsadf0"))
    both = s.join(null, "n")
    told = both.groupBy(*keys, "n", "sadf", "gsadf").agg(*[x for k in ("sadf", "gsadf") for x in (F.percentile(f"{k}0", F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99))).alias(f"{k}_cv"), ((1 + F.count_if(F.col(f"{k}0") >= F.col(k))) / (1 + F.count("*"))).alias(f"{k}_p"))])
    one = lambda k: F.struct(F.lit(k).alias("test"), F.col(k).alias("statistic"), *[F.col(f"{k}_cv")[i].alias(f"cv_{c}") for i, c in enumerate((90, 95, 99))], F.col(f"{k}_p").alias("p_value"))
    return told.select(*keys, F.inline(F.array(one("sadf"), one("gsadf"))))


def bubble_path(df: DataFrame, column: str, order: str, window: int | None = None, lags: int = 0, replicates: int = 500, level: float = 0.95, seed: int = 7, by: str | None = None) -> DataFrame:
    """order, bsadf, critical, explosive: the backward statistic of each end against its simulated quantile."""
    keys = [by] if by else []
    s = _statistics(df, column, order, window, lags, by)
    null = _null(df, s.select("n").distinct(), window, lags, replicates, seed).groupBy("n", "place").agg(F.percentile("bsadf", level).alias("critical"))
    return s.join(null, ["n", "place"]).select(*keys, order, "bsadf", "critical", (F.col("bsadf") > F.col("critical")).alias("explosive"))


def bubble_episodes(df: DataFrame, column: str, order: str, window: int | None = None, lags: int = 0, replicates: int = 500, level: float = 0.95, least: int = 1, seed: int = 7, by: str | None = None) -> DataFrame:
    """episode (1..), begin, end, rows, peak: runs of explosive ends of at least so many rows."""
    keys = [by] if by else []
    d = bubble_path(df, column, order, window, lags, replicates, level, seed, by).withColumn("_key", F.col(by) if by else F.lit(1))
    w = Window.partitionBy("_key").orderBy(order)
    # Rows of a run share the difference of two counts: of all rows and of explosive ones.
    runs = d.withColumn("_run", F.row_number().over(w) - F.sum(F.col("explosive").cast("int")).over(w)).where("explosive")
    told = runs.groupBy("_key", *keys, "_run").agg(F.min(order).alias("begin"), F.max(order).alias("end"), F.count("*").alias("rows"), F.max("bsadf").alias("peak")).where(F.col("rows") >= least)
    return told.withColumn("episode", F.row_number().over(Window.partitionBy("_key").orderBy("begin"))).select(*keys, "episode", "begin", "end", "rows", "peak")
