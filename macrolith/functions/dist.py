"""Distribution functions in numpy: normal, t, chi-square, F, and their quantiles."""

from __future__ import annotations

import math

import numpy as np


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_cdf_array(z: np.ndarray) -> np.ndarray:
    """The same for arrays: its series near zero, its continued fraction in the tails."""
    z = np.asarray(z, float)
    a = np.minimum(np.abs(z), 40.0)
    x = np.minimum(a, 3.0)
    term = total = x.copy()
    for k in range(3, 120, 2):
        term = term * x * x / k
        total = total + term
        if not term.size or term.max() < 1e-17:
            break
    upper = 0.5 - np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi) * total
    far = a > 3
    if far.any():
        t = a[far]
        f = t.copy()
        for k in range(80, 0, -1):
            f = t + k / f
        upper[far] = np.exp(-0.5 * t * t) / math.sqrt(2 * math.pi) / f
    return np.where(z > 0, 1 - upper, upper)


def norm_pdf(x):
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def _quantile(cdf, p: float, lo: float, hi: float) -> float:
    """Bisection on an increasing function; the bracket grows as needed."""
    if not 0 < p < 1:
        raise ValueError("a quantile needs 0 < p < 1")
    while cdf(hi) < p:
        hi *= 2
    while cdf(lo) > p:
        lo = lo * 2 if lo < 0 else lo / 2
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-14 * max(1.0, abs(hi)):
            break
    return 0.5 * (lo + hi)


def norm_ppf(p: float) -> float:
    return _quantile(norm_cdf, p, -8.0, 8.0)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2) if x > 0 else 1.0


def chi2_ppf(p: float, df: float) -> float:
    return _quantile(lambda x: gamma_p(df / 2, x / 2), p, 1e-8, df + 10.0)


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def t_two_sided(x: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + x * x))


def t_ppf(p: float, df: float) -> float:
    return _quantile(lambda x: t_cdf(x, df), p, -8.0, 8.0)


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def kolmogorov_sf(x: float) -> float:
    """Limit distribution of the Kolmogorov statistic."""
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.05 else 1.0
