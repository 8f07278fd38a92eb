"""What event studies say when parallel trends may fail (Rambachan and Roth, 2023; intervals of Armstrong and Kolesar, 2018).

The earlier effects estimate the departure before treatment. Departures after
it are limited in one of two ways:

- smooth (``sd``): second differences of the departure's path are at most
  ``limit`` in size. The interval of fixed length is centred at an affine
  combination of all estimates whose weights on earlier ones cancel every linear
  trend. Its worst bias is ``limit`` times the sum of the absolute running sums
  of running sums of those weights; written in these, the trade-off of bias and
  variance is a lasso, solved by coordinate descent along its path.
- relative (``rm``): steps are at most ``limit`` times the largest step before.
  The identified set is widened by the errors of its ends, of which the largest
  earlier step is a part; ``uniform`` takes every earlier step for the largest
  in turn and returns the union, so ties don't matter.

Everything is a function of estimates and their full covariance.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions import dist
from .describe import rows
from .panel import EventEffects


def folded_normal(bias: float, level: float) -> float:
    """The number that the size of a unit normal with this mean exceeds with chance 1 - level."""
    lo, hi = 0.0, abs(bias) + 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if dist.norm_cdf(mid - bias) - dist.norm_cdf(-mid - bias) < level:
            lo = mid
        else:
            hi = mid
    return hi


def _lasso(q: np.ndarray, a: np.ndarray, penalty: float, u: np.ndarray) -> np.ndarray:
    """The least of u'qu / 2 + a'u + penalty * sum |u|, from a start."""
    u = u.copy()
    for _ in range(10_000):
        before = u.copy()
        for k in range(len(u)):
            g = a[k] + q[k] @ u - q[k, k] * u[k]
            u[k] = -math.copysign(max(0.0, abs(g) - penalty), g) / q[k, k]
        if np.abs(u - before).max(initial=0.0) <= 1e-12 * (1e-12 + np.abs(u).max(initial=0.0)):
            break
    return u


def fixed_length(b: np.ndarray, v: np.ndarray, pre: int, limit: float, weight: np.ndarray, level: float) -> tuple[float, float, float, np.ndarray]:
    """lower, upper, estimate and the weights of the shortest interval of fixed length under ``sd``."""
    post = len(b) - pre
    k = np.arange(1, post + 1)
    slope = float(weight @ k)
    after = sum(abs(float(weight[j:] @ k[: post - j])) for j in range(1, post))
    # u_m are the sums over earlier periods i > m of (i - m) * weight, counted back from the reference; u_0 is the slope to cancel.
    turn = np.zeros((pre, pre))
    for m in range(1, pre + 1):
        for at, x in ((m - 1, 1.0), (m, -2.0), (m + 1, 1.0)):
            if at < pre:
                turn[pre - m, at] += x  # estimates are ordered by event time, so the earliest comes first
    fixed = np.concatenate((turn[:, 0] * slope, weight))
    free = np.vstack([turn[:, 1:], np.zeros((post, pre - 1))])
    q, a = free.T @ v @ free, free.T @ v @ fixed

    def at(u: np.ndarray) -> tuple[float, np.ndarray]:
        w = fixed + free @ u
        se = math.sqrt(max(0.0, float(w @ v @ w)))
        bias = limit * (abs(slope) + float(np.abs(u).sum()) + after)
        return (folded_normal(bias / se, level) * se if se > 0 else bias), w

    u = np.linalg.lstsq(q, -a, rcond=None)[0] if pre > 1 else np.zeros(0)
    best = at(u)
    if pre > 1 and limit > 0:
        top = float(np.abs(a).max())
        path = [0.0, *np.geomspace(1e-6, 1.0, 60)]
        found = []
        for g in path:
            u = _lasso(q, a, g * top, u)
            found.append((at(u)[0], g, u))
        n = min(range(len(found)), key=lambda i: found[i][0])
        lo, hi = found[max(0, n - 1)][1], found[min(len(found) - 1, n + 1)][1]
        u = found[n][2]
        best = at(u)
        r = (math.sqrt(5) - 1) / 2
        for _ in range(60):
            x, y = hi - r * (hi - lo), lo + r * (hi - lo)
            ux, uy = _lasso(q, a, x * top, u), _lasso(q, a, y * top, u)
            fx, fy = at(ux), at(uy)
            best = min(best, fx, fy, key=lambda z: z[0])
            lo, hi = (lo, y) if fx[0] < fy[0] else (x, hi)
    half, w = best
    mid = float(w @ b)
    return mid - half, mid + half, mid, w


def relative(b: np.ndarray, v: np.ndarray, pre: int, limit: float, weight: np.ndarray, level: float, uniform: bool = False) -> tuple[float, float, float, float]:
    """lower, upper of the interval and of the identified set under ``rm``."""
    post = len(b) - pre
    steps = np.zeros((pre, len(b)))
    for r in range(pre):
        steps[r, r] = -1.0
        if r + 1 < pre:
            steps[r, r + 1] = 1.0
    size = steps @ b
    reach = limit * sum(abs(float(weight[i:].sum())) for i in range(post))
    own = np.concatenate((np.zeros(pre), weight))
    mid, far = float(own @ b), float(np.abs(size).max())
    z = dist.norm_ppf(0.5 + level / 2)
    error = lambda g: math.sqrt(max(0.0, float(g @ v @ g)))
    lower, upper = math.inf, -math.inf
    for r in range(pre) if uniform else [int(np.argmax(np.abs(size)))]:
        for sign in (1.0, -1.0) if uniform else [1.0 if size[r] >= 0 else -1.0]:
            d = sign * reach * steps[r]
            lower = min(lower, mid - float(d @ b) - z * error(own - d))
            upper = max(upper, mid + float(d @ b) + z * error(own + d))
    return lower, upper, mid - reach * far, mid + reach * far


def honest(beta: np.ndarray, cov: np.ndarray, pre: int, restriction: str = "rm", limit: float = 1.0, weight: np.ndarray | None = None, level: float = 0.95, uniform: bool = False) -> tuple[float, float]:
    """Interval of a combination of the effects after treatment (the first by default); estimates are ordered by event time without the reference."""
    beta, cov = np.asarray(beta, float), np.asarray(cov, float)
    post = len(beta) - pre
    if restriction not in ("rm", "sd") or pre < 1 or post < 1 or limit < 0 or cov.shape != (len(beta), len(beta)):
        raise ValueError("restriction must be rm or sd, with effects before and after, a limit of 0 or more and the covariance of all effects")
    w = np.eye(post)[0] if weight is None else np.asarray(weight, float)
    f = relative(beta, cov, pre, limit, w, level, uniform) if restriction == "rm" else fixed_length(beta, cov, pre, limit, w, level)
    return f[0], f[1]


def breakdown(beta: np.ndarray, cov: np.ndarray, pre: int, restriction: str = "rm", weight: np.ndarray | None = None, level: float = 0.95, uniform: bool = False) -> float:
    """The limit from which on the interval has zero: 0 if it always has, infinite if none up to 2^40 does."""

    def covers(limit: float) -> bool:
        lo, hi = honest(beta, cov, pre, restriction, limit, weight, level, uniform)
        return lo <= 0 <= hi

    lo, hi = 0.0, 1.0
    if covers(lo):
        return lo
    while not covers(hi):
        lo, hi = hi, 2 * hi
        if hi > 2.0**40:
            return math.inf
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if covers(mid) else (mid, hi)
    return (lo + hi) / 2


def honest_bounds(effects: EventEffects, spark, restriction: str = "rm", limits: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0), weight: np.ndarray | None = None, level: float = 0.95, uniform: bool = False) -> DataFrame:
    """limit, lower, upper, breakdown (as the function of that name, the same in each row; null if infinite)."""
    at = [i for i, k in enumerate(effects.times) if k != -1]
    b, v = effects.b[at], effects.v[np.ix_(at, at)]
    pre = sum(effects.times[i] < -1 for i in at)
    ends = breakdown(b, v, pre, restriction, weight, level, uniform)
    got = [honest(b, v, pre, restriction, m, weight, level, uniform) for m in limits]
    return rows(spark, [{"limit": float(m), "lower": float(lo), "upper": float(hi), "breakdown": float(ends) if math.isfinite(ends) else None} for m, (lo, hi) in zip(limits, got, strict=True)], "limit double, lower double, upper double, breakdown double")
