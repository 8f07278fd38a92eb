"""Univariate time series: correlation and spectra, white-noise tests, filters, unit roots, long-run variance, volatility.

The plain functions take numpy arrays; ``run`` puts one over every series of a
DataFrame through a grouped kernel.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.linalg import lags as lag_matrix
from ..functions.linalg import ols
from ..plans.lagged import unit_root_battery
from ..plans.ordered import blocked, exact_quantiles
from .describe import rows
from .kernels import per_series, tidy


def run(df: DataFrame, column: str, order: str, f, schema: str, by: str | None = None) -> DataFrame:
    return per_series(df, [column], order, lambda t, x: f(t, x[:, 0]), schema, by)


def default_lags(n: int) -> int:
    return max(1, min(n - 1, round(10 * math.log10(n))))


# -- correlation ------------------------------------------------------------


def acf(y: np.ndarray, lags: int = 0) -> np.ndarray:
    """Lags 0..K, the denominator being n at each."""
    n, z = len(y), y - y.mean()
    k = lags or default_lags(n)
    c = np.array([z[j:] @ z[: n - j] for j in range(k + 1)]) / n
    return c / c[0]


def pacf(y: np.ndarray, lags: int = 0) -> np.ndarray:
    """By the Durbin-Levinson recursion, lags 1..K."""
    r = acf(y, lags)
    out, phi, v = [], np.zeros(0), 1.0
    for k in range(1, len(r)):
        a = (r[k] - phi @ r[k - 1 : 0 : -1]) / v if k > 1 else r[1]
        phi = np.concatenate((phi - a * phi[::-1], [a]))
        v *= 1 - a * a
        out.append(a)
    return np.array(out)


def correlogram(df: DataFrame, column: str, order: str, lags: int = 0, by: str | None = None, level: float = 0.95) -> DataFrame:
    """lag, acf, pacf, q_stat, q_p, band."""
    z = dist.norm_ppf(0.5 + level / 2)

    def f(t, y):
        r, p, n = acf(y, lags)[1:], pacf(y, lags), len(y)
        k = np.arange(1, len(r) + 1)
        q = n * (n + 2) * np.cumsum(r * r / (n - k))
        return {"lag": k, "acf": r, "pacf": p, "q_stat": q, "q_p": [dist.chi2_sf(a, b) for a, b in zip(q, k, strict=True)], "band": z / math.sqrt(n)}

    return run(df, column, order, f, "lag int, acf double, pacf double, q_stat double, q_p double, band double", by)


def acf_native(df: DataFrame, column: str, order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """lag, acf from window lags and one aggregate: no kernel, for very many or very long series with a key."""
    keys = by or []
    w = Window.partitionBy(*keys).orderBy(order)
    mean = df.groupBy(*keys).agg(F.avg(column).alias("_m"))
    d = df.join(mean, keys) if keys else df.withColumn("_m", F.lit(mean.first()[0]))
    d = d.withColumn("_z", F.col(column) - F.col("_m"))
    d = d.withColumns({f"_l{k}": F.lag("_z", k).over(w) for k in range(1, lags + 1)})
    got = d.groupBy(*keys).agg(F.sum(F.col("_z") * F.col("_z")).alias("_0"), *[F.sum(F.col("_z") * F.col(f"_l{k}")).alias(f"_{k}") for k in range(1, lags + 1)])
    return got.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_{k}") / F.col("_0")).alias("acf")) for k in range(1, lags + 1)])))


def ccf(df: DataFrame, x: str, y: str, order: str, lags: int = 0, by: str | None = None) -> DataFrame:
    """lag -K..K, ccf of x at t + lag with y at t."""

    def f(t, v):
        n = len(v)
        k = lags or default_lags(n)
        a, b = (v - v.mean(0)).T
        s = n * a.std() * b.std()
        ks = np.arange(-k, k + 1)
        return {"lag": ks, "ccf": [(a[j:] @ b[: n - j] if j >= 0 else a[: n + j] @ b[-j:]) / s for j in ks]}

    return per_series(df, [x, y], order, f, "lag int, ccf double", by)


def portmanteau(df: DataFrame, column: str, order: str, lags: int = 0, fitdf: int = 0, by: str | None = None) -> DataFrame:
    """Ljung-Box, Box-Pierce and Durbin-Watson: test, statistic, df, p_value."""

    def f(t, y):
        n = len(y)
        r = acf(y, lags)[1:]
        k = np.arange(1, len(r) + 1)
        d = max(1, len(r) - fitdf)
        lb, bp = n * (n + 2) * (r * r / (n - k)).sum(), n * (r * r).sum()
        dw = (np.diff(y) ** 2).sum() / (y @ y)
        return {"test": ["ljung_box", "box_pierce", "durbin_watson"], "statistic": [lb, bp, dw], "df": [d, d, 0], "p_value": [dist.chi2_sf(lb, d), dist.chi2_sf(bp, d), None]}

    return run(df, column, order, f, "test string, statistic double, df int, p_value double", by)


def variance_ratio(df: DataFrame, column: str, order: str, q: tuple[int, ...] = (2, 4, 8, 16), by: str | None = None) -> DataFrame:
    """Lo-MacKinlay on first differences: q, vr, z, z_robust, p_value (robust)."""

    def f(t, y):
        d = np.diff(y)
        n, mu = len(d), d.mean()
        e = d - mu
        s1 = e @ e / (n - 1)
        out = []
        for k in [k for k in q if k < n]:
            long = y[k:] - y[:-k] - k * mu
            vr = long @ long / (k * (n - k + 1) * (1 - k / n)) / s1
            z = (vr - 1) / math.sqrt(2 * (2 * k - 1) * (k - 1) / (3 * k * n))
            theta = sum((2 * (k - j) / k) ** 2 * ((e[j:] ** 2) @ (e[: n - j] ** 2)) / (e @ e) ** 2 for j in range(1, k))
            zr = (vr - 1) / math.sqrt(theta)
            out.append((k, vr, z, zr, 2 * (1 - dist.norm_cdf(abs(zr)))))
        return dict(zip(("q", "vr", "z", "z_robust", "p_value"), zip(*out, strict=True), strict=True))

    return run(df, column, order, f, "q int, vr double, z double, z_robust double, p_value double", by)


def _taper(n: int, kind: str) -> np.ndarray:
    return {"rectangular": np.ones, "bartlett": np.bartlett, "hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman}[kind](n)


def periodogram(df: DataFrame, column: str, order: str, window: str = "rectangular", by: str | None = None) -> DataFrame:
    """frequency (radians), power."""

    def f(t, y):
        w = _taper(len(y), window)
        p = np.abs(np.fft.rfft((y - y.mean()) * w)) ** 2 / (2 * math.pi * (w @ w))
        return {"frequency": 2 * math.pi * np.arange(1, len(p)) / len(y), "power": p[1:]}

    return run(df, column, order, f, "frequency double, power double", by)


def white_noise(df: DataFrame, column: str, order: str, by: str | None = None) -> DataFrame:
    """Fisher's largest ordinate and Bartlett's cumulative periodogram: test, statistic, p_value."""

    def f(t, y):
        p = np.abs(np.fft.rfft(y - y.mean()))[1 : (len(y) - 1) // 2 + 1] ** 2
        m = len(p)
        g = p.max() / p.sum()
        exact = sum((-1) ** (k - 1) * math.comb(m, k) * (1 - k * g) ** (m - 1) for k in range(1, int(1 / g) + 1)) if m < 60 else 1 - (1 - math.exp(-g * m)) ** m
        c = np.cumsum(p)[:-1] / p.sum()
        k = np.arange(1, m)
        b = math.sqrt(m) * np.maximum(np.abs(c - k / m), np.abs(c - (k - 1) / m)).max()
        return {"test": ["fisher", "bartlett"], "statistic": [g, b], "p_value": [min(1.0, max(0.0, exact)), dist.kolmogorov_sf(b)]}

    return run(df, column, order, f, "test string, statistic double, p_value double", by)


# -- long-run variance ------------------------------------------------------


def kernel_weight(j: np.ndarray, bandwidth: float, kernel: str) -> np.ndarray:
    x = np.abs(j) / (bandwidth + 1 if kernel == "bartlett" else bandwidth)
    if kernel == "bartlett":
        return np.maximum(0, 1 - x)
    if kernel == "parzen":
        return np.where(x <= 0.5, 1 - 6 * x**2 + 6 * x**3, np.where(x <= 1, 2 * (1 - x) ** 3, 0))
    if kernel == "tukey_hanning":
        return np.where(x <= 1, 0.5 * (1 + np.cos(np.pi * x)), 0)
    if kernel == "quadratic_spectral":
        z = 6 * np.pi * np.maximum(x, 1e-12) / 5
        return np.where(x < 1e-12, 1, 3 / z**2 * (np.sin(z) / z - np.cos(z)))
    raise ValueError(f"kernel {kernel} is not known")


def andrews_bandwidth(u: np.ndarray, kernel: str = "bartlett") -> float:
    """AR(1) plug-in."""
    u = u.reshape(len(u), -1)
    num1 = num2 = den = 0.0
    for x in (u - u.mean(0)).T:
        r = min(0.97, max(-0.97, x[1:] @ x[:-1] / (x[:-1] @ x[:-1])))
        s = ((x[1:] - r * x[:-1]) ** 2).mean()
        num1 += 4 * r**2 * s**2 / ((1 - r) ** 6 * (1 + r) ** 2)
        num2 += 4 * r**2 * s**2 / (1 - r) ** 8
        den += s**2 / (1 - r) ** 4
    n = len(u)
    return {"bartlett": 1.1447 * (num1 / den * n) ** (1 / 3), "parzen": 2.6614 * (num2 / den * n) ** 0.2, "tukey_hanning": 1.7462 * (num2 / den * n) ** 0.2, "quadratic_spectral": 1.3221 * (num2 / den * n) ** 0.2}[kernel]


def long_run_covariance(u: np.ndarray, bandwidth: float | None = None, kernel: str = "bartlett", demean: bool = True) -> np.ndarray:
    u = u.reshape(len(u), -1)
    u = u - u.mean(0) if demean else u
    n = len(u)
    bw = andrews_bandwidth(u, kernel) if bandwidth is None else bandwidth
    out = u.T @ u / n
    last = n - 1 if kernel == "quadratic_spectral" else min(n - 1, int(math.floor(bw)))
    for j, w in zip(range(1, last + 1), kernel_weight(np.arange(1, last + 1), bw, kernel), strict=True):
        g = u[j:].T @ u[:-j] / n
        out += w * (g + g.T)
    return out


def newey_west(x: np.ndarray, e: np.ndarray, inv: np.ndarray, bandwidth: int) -> np.ndarray:
    return len(e) * inv @ long_run_covariance(x * e[:, None], bandwidth, demean=False) @ inv


def long_run_variance(df: DataFrame, column: str, order: str, bandwidth: float | None = None, kernel: str = "bartlett", by: str | None = None) -> DataFrame:
    return run(df, column, order, lambda t, y: {"n": [len(y)], "lrv": [long_run_covariance(y, bandwidth, kernel)[0, 0]]}, "n int, lrv double", by)


# -- filters ----------------------------------------------------------------


def hp(y: np.ndarray, lam: float = 1600.0) -> np.ndarray:
    """Trend of (I + lam D'D) trend = y by banded elimination, linear in the length."""
    n = len(y)
    if n < 3 or lam == 0:
        return y.astype(float).copy()
    d0, d1, d2 = np.full(n, 6.0), np.full(n - 1, -4.0), np.full(n - 2, 1.0)
    d0[[0, -1]], d0[[1, -2]] = 1.0, 5.0
    d1[[0, -1]] = -2.0
    if n == 3:
        d0[1] = 4.0
    d0, d1, d2 = 1 + lam * d0, lam * d1, lam * d2
    a, b, c = d0.tolist(), [*d1.tolist(), 0.0], [*d2.tolist(), 0.0, 0.0]
    x = y.astype(float).tolist()
    l1, l2 = [0.0] * n, [0.0] * n
    for i in range(n):  # LDL'
        if i >= 2:
            a[i] -= l2[i - 2] ** 2 * a[i - 2]
        if i >= 1:
            a[i] -= l1[i - 1] ** 2 * a[i - 1]
        u = b[i] - (l1[i - 1] * a[i - 1] * l2[i - 1] if i >= 1 else 0.0)
        l1[i], l2[i] = u / a[i], c[i] / a[i]
    for i in range(n):
        x[i] -= (l1[i - 1] * x[i - 1] if i >= 1 else 0.0) + (l2[i - 2] * x[i - 2] if i >= 2 else 0.0)
    x = [v / w for v, w in zip(x, a, strict=True)]
    for i in range(n - 2, -1, -1):
        x[i] -= l1[i] * x[i + 1] + (l2[i] * x[i + 2] if i + 2 < n else 0.0)
    return np.array(x)


def boosted_hp(y: np.ndarray, lam: float = 1600.0, stopping: str = "bic", most: int = 100) -> tuple[np.ndarray, int]:
    """Trend and rounds; bic stops where the criterion of the cycle first rises."""
    n = len(y)
    s = np.column_stack([hp(e, lam) for e in np.eye(n)]) if n <= 2000 else None
    cycle0 = y - hp(y, lam)
    cycle, best, rounds = cycle0.copy(), None, 1
    m = np.eye(n) - s if s is not None else None
    power = m.copy() if m is not None else None
    while rounds < most:
        if stopping == "bic" and m is not None:
            ic = cycle @ cycle / (cycle0 @ cycle0) + math.log(n) * np.trace(np.eye(n) - power) / np.trace(np.eye(n) - s)
            if best is not None and ic > best:
                break
            best = ic
            power = power @ m
        cycle = cycle - hp(cycle, lam)
        rounds += 1
    return y - cycle, rounds


def hamilton(y: np.ndarray, h: int = 8, p: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Trend and cycle from row h + p - 1 on."""
    first = h + p - 1
    x = np.column_stack([np.ones(len(y) - first), *[y[first - h - j : len(y) - h - j] for j in range(p)]])
    b, e, _ = ols(y[first:], x)
    return x @ b, e


def baxter_king_weights(low: float = 6, high: float = 32, k: int = 12) -> np.ndarray:
    """Weights of lags 0..k."""
    a, b = 2 * math.pi / high, 2 * math.pi / low
    j = np.arange(1, k + 1)
    w = np.concatenate(([(b - a) / math.pi], (np.sin(b * j) - np.sin(a * j)) / (math.pi * j)))
    return w - (w[0] + 2 * w[1:].sum()) / (2 * k + 1)


def baxter_king(df: DataFrame, column: str, order: str, low: float = 6, high: float = 32, k: int = 12, by: list[str] | None = None) -> DataFrame:
    """Native: cycle as a weighted sum of window lags and leads; k rows are lost at both ends."""
    d, w = df, Window.partitionBy(*(by or [])).orderBy(order)
    if not by:
        d, _ = blocked(df, order, k, k)
        w = Window.partitionBy("_block").orderBy("_place")
    b = baxter_king_weights(low, high, k)
    cycle = F.lit(float(b[0])) * F.col(column)
    for j in range(1, k + 1):
        cycle = cycle + F.lit(float(b[j])) * (F.lag(column, j).over(w) + F.lead(column, j).over(w))
    out = d.select(*(by or []), order, F.col(column).alias("value"), cycle.alias("cycle"), *([] if by else ["_halo"]))
    out = out.where("cycle is not null") if by else out.where("cycle is not null and not _halo").drop("_halo")
    return out.withColumn("trend", F.col("value") - F.col("cycle"))


def beveridge_nelson(y: np.ndarray, p: int = 2) -> np.ndarray:
    """Trend from an AR(p) in differences: y plus the long-run sum of expected changes."""
    d = np.diff(y)
    z, x = lag_matrix(d, p)
    b, _, _ = ols(z[:, 0], x)
    mu = b[0] / (1 - b[1:].sum())
    a = np.zeros((p, p))
    a[0], a[1:, :-1] = b[1:], np.eye(p - 1)
    m = (a @ np.linalg.inv(np.eye(p) - a))[0]
    state = np.column_stack([d[p - 1 - j : len(d) - j] - mu for j in range(p)])
    return np.concatenate((np.full(p, np.nan), y[p:] + state @ m))


def ideal_bandpass(y: np.ndarray, low: float, high: float) -> np.ndarray:
    """Keeps frequencies (cycles a row) within [low, high]."""
    z = np.fft.rfft(y - y.mean())
    f = np.fft.rfftfreq(len(y))
    return np.fft.irfft(np.where((f >= low) & (f <= high), z, 0), len(y))


FILTERS = {
    "hp": lambda y, **o: (lambda t: (t, y - t))(hp(y, **o)),
    "boosted_hp": lambda y, **o: (lambda t: (t, y - t))(boosted_hp(y, **o)[0]),
    "hamilton": lambda y, **o: tuple(np.concatenate((np.full(len(y) - len(v), np.nan), v)) for v in hamilton(y, **o)),
    "beveridge_nelson": lambda y, **o: (lambda t: (t, y - t))(beveridge_nelson(y, **o)),
    "ideal_bandpass": lambda y, **o: (lambda c: (y - c, c))(ideal_bandpass(y, **o)),
}


def trend_cycle(df: DataFrame, column: str, order: str, kind: str = "hp", by: str | None = None, **options) -> DataFrame:
    """order, value, trend, cycle; rows that a filter loses are left out."""
    kinds = df.schema[order].dataType.simpleString()

    def f(t, y):
        a, c = FILTERS[kind](y, **options)
        ok = ~np.isnan(c)
        return {order: t[ok], "value": y[ok], "trend": a[ok], "cycle": c[ok]}

    return run(df, column, order, f, f"{order} {kinds}, value double, trend double, cycle double", by)


# -- unit roots -------------------------------------------------------------


def _deterministic(n: int, kind: str) -> np.ndarray:
    t = np.arange(1, n + 1, dtype=float)
    return {"none": np.zeros((n, 0)), "constant": np.ones((n, 1)), "trend": np.column_stack([np.ones(n), t])}[kind]


#: Response surface of MacKinnon (2010) for one variable, levels 1, 5, 10 %: limit, 1/T, 1/T^2, 1/T^3.
MACKINNON = {
    "none": ((-2.56574, -2.2358, -3.627, 0.0), (-1.94100, -0.2686, -3.365, 31.223), (-1.61682, 0.2656, -2.714, 25.364)),
    "constant": ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)),
    "trend": ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380)),
}
#: Kwiatkowski et al. (1992), levels 1, 5, 10 %.
KPSS = {"constant": (0.739, 0.463, 0.347), "trend": (0.216, 0.146, 0.119)}


def critical_values(kind: str, n: int) -> list[float]:
    return [a + b / n + c / n**2 + d / n**3 for a, b, c, d in MACKINNON[kind]]


def adf(y: np.ndarray, lags: int | None = None, kind: str = "constant", most: int | None = None) -> tuple[float, int, int, float]:
    """t statistic, lags, rows used, rho; lags by AIC over one sample if not given."""
    d = np.diff(y)

    def fit(p: int, drop: int):
        z = d[drop:]
        x = [y[drop:-1][:, None], *[d[drop - j : len(d) - j][:, None] for j in range(1, p + 1)], _deterministic(len(z), kind)]
        x = np.hstack(x)
        b, e, inv = ols(z, x)
        s = e @ e / (len(z) - x.shape[1])
        return b[0] / math.sqrt(s * inv[0, 0]), len(z), b[0], len(z) * math.log(e @ e / len(z)) + 2 * x.shape[1]

    if lags is None:
        top = most if most is not None else int(12 * (len(y) / 100) ** 0.25)
        top = max(0, min(top, len(y) // 2 - 3))
        lags = min(range(top + 1), key=lambda p: fit(p, top)[3])
    t, n, rho, _ = fit(lags, lags)
    return t, lags, n, rho


def phillips_perron(y: np.ndarray, kind: str = "constant", bandwidth: int | None = None) -> tuple[float, float, int]:
    """Z_t, Z_rho, bandwidth."""
    x = np.hstack([y[:-1][:, None], _deterministic(len(y) - 1, kind)])
    b, e, inv = ols(y[1:], x)
    n = len(e)
    bw = int(4 * (n / 100) ** 0.25) if bandwidth is None else bandwidth
    g0, s2 = e @ e / n, e @ e / (n - x.shape[1])
    lr = long_run_covariance(e, bw, demean=False)[0, 0]
    se = math.sqrt(s2 * inv[0, 0])
    t = (b[0] - 1) / se
    return math.sqrt(g0 / lr) * t - (lr - g0) / 2 * n * se / math.sqrt(lr * s2), n * (b[0] - 1) - (lr - g0) / 2 * (n * se) ** 2 / s2, bw


def kpss(y: np.ndarray, kind: str = "constant", bandwidth: int | None = None) -> tuple[float, int]:
    x = _deterministic(len(y), kind)
    e = ols(y, x)[1]
    bw = int(4 * (len(y) / 100) ** 0.25) if bandwidth is None else bandwidth
    s = np.cumsum(e)
    return s @ s / (len(y) ** 2 * long_run_covariance(e, bw, demean=False)[0, 0]), bw


def df_gls(y: np.ndarray, lags: int, kind: str = "constant") -> float:
    """t statistic on locally demeaned (or detrended) data."""
    n = len(y)
    a = 1 - (7 if kind == "constant" else 13.5) / n
    x = _deterministic(n, kind)
    q = lambda v: np.concatenate((v[:1], v[1:] - a * v[:-1]))
    z = y - x @ ols(q(y), q(x))[0]
    return adf(z, lags, "none")[0]


def unit_root(df: DataFrame, column: str, order: str, kind: str = "constant", lags: int | None = None, by: str | None = None) -> DataFrame:
    """test (adf, phillips_perron, kpss, df_gls), statistic, lags, n, cv_1, cv_5, cv_10."""

    schema = "test string, statistic double, lags int, n int, cv_1 double, cv_5 double, cv_10 double"
    names = ("test", "statistic", "lags", "n", "cv_1", "cv_5", "cv_10")

    def told(a, p, n, z, bw, k, kb, gls, total):
        return [("adf", a, p, n, *critical_values(kind, n)), ("phillips_perron", z, bw, total - 1, *critical_values(kind, total - 1)), ("kpss", k, kb, total, *KPSS[kind]), ("df_gls", gls, p, n, *([None] * 3 if kind == "trend" else critical_values("none", n)))]

    def f(t, y):
        a, p, n, _ = adf(y, lags, kind)
        z, _, bw = phillips_perron(y, kind)
        return tidy(names, told(a, p, n, z, bw, *kpss(y, kind), df_gls(y, p, kind), len(y)))

    if by:
        return run(df, column, order, f, schema, by)
    (a, p, n), (z, bw), (k, kb), (gls,), total = unit_root_battery(df, column, order, kind, lags)
    return rows(df.sparkSession, [dict(zip(names, r, strict=True)) for r in told(a, p, n, z, bw, k, kb, gls, total)], schema)


# -- volatility and autoregression ------------------------------------------


def arch_lm(df: DataFrame, column: str, order: str, lags: int = 4, by: str | None = None) -> DataFrame:
    def f(t, y):
        z, x = lag_matrix((y - y.mean()) ** 2, lags)
        _, e, _ = ols(z[:, 0], x)
        r2 = 1 - e @ e / ((z - z.mean()) ** 2).sum()
        s = len(z) * r2
        return {"statistic": [s], "df": [lags], "p_value": [dist.chi2_sf(s, lags)]}

    return run(df, column, order, f, "statistic double, df int, p_value double", by)


def nelder_mead(f, x: np.ndarray, step: float = 0.1, steps: int = 2000, tol: float = 1e-10) -> np.ndarray:
    n = len(x)
    s = [x, *[x + step * (np.arange(n) == i) * max(1.0, abs(x[i])) for i in range(n)]]
    v = [f(p) for p in s]
    for _ in range(steps):
        order = np.argsort(v)
        s, v = [s[i] for i in order], [v[i] for i in order]
        if abs(v[-1] - v[0]) <= tol * (abs(v[0]) + tol):
            break
        c = np.mean(s[:-1], axis=0)
        r = 2 * c - s[-1]
        fr = f(r)
        if fr < v[0]:
            e = 3 * c - 2 * s[-1]
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            k = 0.5 * (c + (r if fr < v[-1] else s[-1]))
            fk = f(k)
            if fk < min(fr, v[-1]):
                s[-1], v[-1] = k, fk
            else:
                s = [s[0], *[0.5 * (p + s[0]) for p in s[1:]]]
                v = [v[0], *[f(p) for p in s[1:]]]
    return s[int(np.argmin(v))]


def garch(y: np.ndarray, kind: str = "garch") -> dict:
    """Gaussian (1, 1) fits of kind garch, gjr or egarch: parameters, loglik and the variance path."""
    e = y - y.mean()
    s0 = e.var()

    def path(p):
        h = np.empty(len(e))
        h[0] = s0
        if kind == "egarch":
            w, a, g, b = p
            lh = math.log(s0)
            for k in range(1, len(e)):
                z = e[k - 1] / math.exp(lh / 2)
                lh = min(50, max(-50, w + b * lh + a * (abs(z) - math.sqrt(2 / math.pi)) + g * z))
                h[k] = math.exp(lh)
        else:
            w, a, b, *g = p
            for k in range(1, len(e)):
                h[k] = w + (a + (g[0] * (e[k - 1] < 0) if g else 0)) * e[k - 1] ** 2 + b * h[k - 1]
        return h

    def loss(p):
        if kind != "egarch" and (min(p[0], p[1], p[2]) < 0 or p[1] + p[2] + (p[3] / 2 if kind == "gjr" else 0) >= 1 or (kind == "gjr" and p[1] + p[3] < 0)):
            return 1e300
        h = np.maximum(path(p), 1e-300)
        return 0.5 * (np.log(2 * math.pi * h) + e * e / h).sum()

    starts = {"garch": [s0 * 0.1, 0.1, 0.8], "gjr": [s0 * 0.1, 0.05, 0.8, 0.05], "egarch": [0.1 * math.log(s0), 0.1, 0.0, 0.9]}
    p = nelder_mead(loss, np.array(starts[kind]))
    p = nelder_mead(loss, p, 0.02)
    names = {"garch": ("omega", "alpha", "beta"), "gjr": ("omega", "alpha", "beta", "gamma"), "egarch": ("omega", "alpha", "gamma", "beta")}[kind]
    return {"params": dict(zip(names, p.tolist(), strict=True)), "loglik": -loss(p), "h": path(p)}


def estimate_garch(df: DataFrame, column: str, order: str, kind: str = "garch", by: str | None = None) -> DataFrame:
    """term, estimate; with the log-likelihood as a term."""

    def f(t, y):
        g = garch(y, kind)
        return {"term": [*g["params"], "loglik"], "estimate": [*g["params"].values(), g["loglik"]]}

    return run(df, column, order, f, "term string, estimate double", by)


def arma(y: np.ndarray, p: int, q: int) -> dict:
    """Conditional sum of squares for an ARMA with constant."""
    z = y - y.mean()

    def residuals(b):
        e = np.zeros(len(z))
        for k in range(max(p, 0), len(z)):
            e[k] = z[k] - b[0] - sum(b[1 + j] * z[k - 1 - j] for j in range(p)) - sum(b[1 + p + j] * e[k - 1 - j] for j in range(q) if k - 1 - j >= 0)
        return e[p:]

    start = np.zeros(1 + p + q)
    if p:
        z0, x = lag_matrix(z, p)
        start[: 1 + p] = ols(z0[:, 0], x)[0]
    b = start if not q else nelder_mead(lambda b: min(1e300, float((residuals(b) ** 2).sum())), start)
    e = residuals(b)
    n, k = len(e), 2 + p + q
    s = e @ e / n
    ll = -n / 2 * (math.log(2 * math.pi * s) + 1)
    const = y.mean() * (1 - b[1 : 1 + p].sum()) + b[0]
    return {"const": const, "ar": b[1 : 1 + p], "ma": b[1 + p :], "sigma2": s, "loglik": ll, "aic": -2 * ll + 2 * k, "bic": -2 * ll + math.log(n) * k, "residuals": e}


def estimate_arma(df: DataFrame, column: str, order: str, p: int = 1, q: int = 0, d: int = 0, by: str | None = None) -> DataFrame:
    """term, estimate of an ARIMA(p, d, q)."""

    def f(t, y):
        m = arma(np.diff(y, d), p, q)
        names = ["const", *[f"ar{j + 1}" for j in range(p)], *[f"ma{j + 1}" for j in range(q)], "sigma2", "loglik", "aic", "bic"]
        return {"term": names, "estimate": [m["const"], *m["ar"], *m["ma"], m["sigma2"], m["loglik"], m["aic"], m["bic"]]}

    return run(df, column, order, f, "term string, estimate double", by)


def forecast_ar(df: DataFrame, column: str, order: str, p: int = 1, steps: int = 8, level: float = 0.95, by: str | None = None) -> DataFrame:
    """horizon, forecast, std_error, lower, upper of an AR(p) by least squares."""
    z = dist.norm_ppf(0.5 + level / 2)

    def f(t, y):
        m = arma(y, p, 0)
        past, out, psi = list(y[::-1][:p]), [], [1.0]
        for h in range(steps):
            v = m["const"] + sum(a * x for a, x in zip(m["ar"], past, strict=False))
            past = [v, *past][:p]
            se = math.sqrt(m["sigma2"] * sum(x * x for x in psi))
            out.append((h + 1, v, se, v - z * se, v + z * se))
            psi.append(sum(m["ar"][j] * psi[-1 - j] for j in range(min(p, len(psi)))))
        return dict(zip(("horizon", "forecast", "std_error", "lower", "upper"), zip(*out, strict=True), strict=True))

    return run(df, column, order, f, "horizon int, forecast double, std_error double, lower double, upper double", by)


# -- nonlinear --------------------------------------------------------------


def threshold(y: np.ndarray, p: int = 1, d: int = 1, trim: float = 0.15) -> dict:
    """Two-regime threshold autoregression by a grid over the ordered threshold values."""
    z, x = lag_matrix(y, p)
    z = z[:, 0]
    s = y[p - d : len(y) - d]
    grid = np.sort(s)[int(trim * len(s)) : int((1 - trim) * len(s))]

    def ssr(c):
        low = s <= c
        return sum((ols(z[k], x[k])[1] ** 2).sum() for k in (low, ~low) if k.sum() > x.shape[1])

    c = min(grid, key=ssr)
    low = s <= c
    return {"threshold": c, "ssr": ssr(c), "linear_ssr": float((ols(z, x)[1] ** 2).sum()), "low": ols(z[low], x[low])[0], "high": ols(z[~low], x[~low])[0]}


def estimate_threshold(df: DataFrame, column: str, order: str, p: int = 1, d: int = 1, by: str | None = None) -> DataFrame:
    def f(t, y):
        m = threshold(y, p, d)
        names = [f"{r}_{c}" for r in ("low", "high") for c in ["const", *[f"ar{j + 1}" for j in range(p)]]]
        return {"term": ["threshold", "ssr", "linear_ssr", *names], "estimate": [m["threshold"], m["ssr"], m["linear_ssr"], *m["low"], *m["high"]]}

    return run(df, column, order, f, "term string, estimate double", by)


def kde(df: DataFrame, column: str, points: int = 21, bandwidth: float | None = None) -> DataFrame:
    """x, density: Gaussian kernel at equally spaced points, one aggregate over all rows with a row a point."""
    n, lo, hi, sd = df.agg(F.count(column), F.min(column), F.max(column), F.stddev_samp(column)).first()
    q = exact_quantiles(df, {column: [0.25, 0.75]})[column]
    h = bandwidth or 0.9 * min(sd, (q[1] - q[0]) / 1.349 or sd) * n**-0.2
    xs = np.linspace(lo, hi, points)
    sums = df.agg(*[F.sum(F.exp(-F.pow((F.col(column) - float(x)) / h, 2) / 2)).alias(f"d{i}") for i, x in enumerate(xs)])
    scale = n * h * math.sqrt(2 * math.pi)
    return sums.select(F.inline(F.array(*[F.struct(F.lit(float(x)).alias("x"), (F.col(f"d{i}") / scale).alias("density")) for i, x in enumerate(xs)])))
