"""Seasonal adjustment in the manner of X-11: calendar and outlier regression with ARIMA errors, forecasts, iterated moving averages.

One series is one kernel. The steps: logs if that fits better, a seasonal ARIMA
found over a small grid, outliers by t values one at a time, forecasts of a
year at both ends, then three rounds of seasonal and trend averages with
extreme values weighted down.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions.linalg import ols
from .kernels import tidy
from .series import nelder_mead, run


def henderson(m: int) -> np.ndarray:
    """Weights of the Henderson average of m (odd) terms."""
    p = (m - 1) // 2
    n = p + 2
    i = np.arange(-p, p + 1, dtype=float)
    return 315 * ((n - 1) ** 2 - i**2) * (n**2 - i**2) * ((n + 1) ** 2 - i**2) * (3 * n**2 - 16 - 11 * i**2) / (8 * n * (n**2 - 1) * (4 * n**2 - 1) * (4 * n**2 - 9) * (4 * n**2 - 25))


def smooth(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Centred average; near the ends the weights that remain are scaled up and corrected to keep lines."""
    p, n = len(w) // 2, len(y)
    out = np.empty(n)
    for t in range(n):
        lo, hi = max(0, t - p), min(n, t + p + 1)
        k = w[lo - t + p : hi - t + p]
        if hi - lo == len(w):
            out[t] = k @ y[lo:hi]
        else:
            # Weighted line through what there is.
            x = np.arange(lo, hi) - t
            v = np.maximum(k, 1e-3 * np.abs(w).max())
            s0, s1, s2 = v.sum(), (v * x).sum(), (v * x * x).sum()
            out[t] = float((v * (s2 - s1 * x)) @ y[lo:hi] / (s0 * s2 - s1 * s1))
    return out


def centred(y: np.ndarray, s: int) -> np.ndarray:
    """2 x s average (s even) or s average; the ends go on as a line through the nearest half season of averages, since shorter averages would take in the season."""
    w = np.concatenate(([0.5], np.ones(s - 1), [0.5])) / s if s % 2 == 0 else np.ones(s) / s
    p, mid = len(w) // 2, np.convolve(y, w, "valid")
    k = max(2, min(len(mid), s // 2 + 1))
    x = np.arange(k)
    first, last = np.polyfit(x, mid[:k], 1), np.polyfit(x, mid[-k:], 1)
    return np.concatenate((np.polyval(first, np.arange(-p, 0)), mid, np.polyval(last, np.arange(k, k + p))))


def seasonal_average(y: np.ndarray, s: int, k: int = 3) -> np.ndarray:
    """3 x k average of each season over the years, which must not be missing; ends use what there is."""
    w = np.convolve(np.ones(3) / 3, np.ones(k) / k)
    out = np.empty(len(y))
    for j in range(s):
        c = y[j::s]
        p, n = len(w) // 2, len(c)
        for t in range(n):
            lo, hi = max(0, t - p), min(n, t + p + 1)
            v = w[lo - t + p : hi - t + p]
            out[j + t * s] = float(v @ c[lo:hi] / v.sum())
    return out


def _level(seasonal: np.ndarray, s: int) -> np.ndarray:
    """Centred average of a season, the nearest value being kept at both ends."""
    w = np.concatenate(([0.5], np.ones(s - 1), [0.5])) / s if s % 2 == 0 else np.ones(s) / s
    mid = np.convolve(seasonal, w, "valid")
    p = len(w) // 2
    return np.concatenate((np.full(p, mid[0]), mid, np.full(p, mid[-1])))


def extreme_weights(irregular: np.ndarray, centre: float, s: int, low: float = 1.5, high: float = 2.5) -> np.ndarray:
    """1 within low deviations, 0 beyond high, linear between; deviations over five years about each."""
    n, out = len(irregular), np.empty(len(irregular))
    d = irregular - centre
    for t in range(n):
        lo = max(0, min(t - 5 * s // 2, n - 5 * s))
        sd = math.sqrt(float((d[lo : lo + 5 * s] ** 2).mean())) or 1.0
        out[t] = min(1.0, max(0.0, (high - abs(d[t]) / sd) / (high - low)))
    return out


def decompose(y: np.ndarray, s: int, multiplicative: bool) -> dict[str, np.ndarray]:
    """seasonal, trend, irregular, adjusted of a series without missing values."""
    less = (lambda a, b: a / b) if multiplicative else (lambda a, b: a - b)
    more = (lambda a, b: a * b) if multiplicative else (lambda a, b: a + b)
    one = 1.0 if multiplicative else 0.0
    x = y.copy()
    seasonal = np.full(len(y), one)
    length = 13 if s == 12 else 5
    for turn in range(3):
        trend = centred(x, s) if not turn else smooth(less(x, seasonal), henderson(length))
        si = less(x, trend)
        seasonal = seasonal_average(si, s, 3 if not turn else 5)
        seasonal = less(seasonal, _level(seasonal, s))
        irregular = less(si, seasonal)
        w = extreme_weights(irregular, one, s)
        # Extremes give way to the seasonal part alone.
        x = more(more(trend, seasonal), w * irregular + (1 - w) * one) if not multiplicative else trend * seasonal * (w * irregular + (1 - w))
    si = less(x, trend)
    seasonal = seasonal_average(si, s, 5)
    seasonal = less(seasonal, _level(seasonal, s))
    adjusted = less(y, seasonal)
    trend = smooth(less(x, seasonal), henderson(length))
    return {"seasonal": seasonal, "trend": trend, "irregular": less(adjusted, trend), "adjusted": adjusted}


# -- regression with seasonal ARIMA errors ----------------------------------------


def _polynomials(par: np.ndarray, p: int, q: int, sp: int, sq: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    ar, ma = np.array([1.0]), np.array([1.0])
    ar = np.convolve(ar, np.concatenate(([1.0], -par[:p])))
    ma = np.convolve(ma, np.concatenate(([1.0], par[p : p + q])))
    if sp:
        ar = np.convolve(ar, np.concatenate(([1.0], np.zeros(s - 1), [-par[p + q]])))
    if sq:
        ma = np.convolve(ma, np.concatenate(([1.0], np.zeros(s - 1), [par[-1]])))
    return -ar[1:], ma[1:]


def difference(y: np.ndarray, d: int, sd: int, s: int) -> np.ndarray:
    for _ in range(d):
        y = np.diff(y, axis=0)
    for _ in range(sd):
        y = y[s:] - y[:-s]
    return y


def _whiten(z: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Conditional innovations, column by column."""
    z = z.reshape(len(z), -1)
    e = np.zeros_like(z)
    for t in range(len(z)):
        v = z[t].copy()
        for j in range(min(len(ar), t)):
            v -= ar[j] * z[t - 1 - j]
        for j in range(min(len(ma), t)):
            v -= ma[j] * e[t - 1 - j]
        e[t] = v
    return e


def regression_arima(y: np.ndarray, x: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, int, int], s: int) -> dict:
    """Coefficients by generalised least squares within a search over the ARIMA's parameters (conditional sum of squares)."""
    (p, d, q), (sp, sd, sq) = order, seasonal
    zy, zx = difference(y, d, sd, s), difference(x, d, sd, s) if x.shape[1] else np.zeros((len(y) - d - sd * s, 0))

    def parts(par):
        ar, ma = _polynomials(par, p, q, sp, sq, s)
        e = _whiten(np.column_stack([zy, zx]), ar, ma)
        b, r, inv = ols(e[:, 0], e[:, 1:]) if zx.shape[1] else (np.zeros(0), e[:, 0], np.zeros((0, 0)))
        return b, r, inv, ar, ma

    k = p + q + (1 if sp else 0) + (1 if sq else 0)
    loss = lambda par: 1e300 if (np.abs(par) > 0.98).any() else float((parts(par)[1] ** 2).sum())
    par = nelder_mead(loss, np.full(k, -0.3), 0.2, 60 * max(1, k)) if k else np.zeros(0)
    b, r, inv, ar, ma = parts(par)
    n = len(r)
    s2 = float(r @ r / n)
    ll = -n / 2 * (math.log(2 * math.pi * s2) + 1)
    m = k + x.shape[1] + 1
    return {"b": b, "t": b / np.sqrt(np.maximum(s2 * np.diag(inv), 1e-300)) if len(b) else b, "par": par, "ar": ar, "ma": ma, "sigma2": s2, "loglik": ll, "bic": -2 * ll + math.log(n) * m, "residuals": r, "order": order, "seasonal": seasonal}


def choose_model(y: np.ndarray, s: int) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """The model of least BIC among (p 1 q)(P 1 Q) with small orders."""
    none = np.zeros((len(y), 0))
    grid = [((p, 1, q), (0, 1, sq)) for p, q in ((0, 1), (1, 0), (1, 1), (0, 2), (2, 0)) for sq in (1, 0)]
    return min(grid, key=lambda g: regression_arima(y, none, *g, s)["bic"])


def calendar(start: int, n: int, s: int) -> np.ndarray:
    """Trading days: number of each weekday less Sundays in every month (or quarter) from month number start (year * 12 + month - 1)."""
    import datetime

    out = np.zeros((n, 6))
    per = 12 // s
    for k in range(n):
        count = np.zeros(7)
        for m in range(start + k * per, start + (k + 1) * per):
            day = datetime.date(m // 12, m % 12 + 1, 1)
            while day.month == m % 12 + 1:
                count[day.weekday()] += 1
                day += datetime.timedelta(1)
        out[k] = count[:6] - count[6]
    return out


def outliers(y: np.ndarray, x: np.ndarray, order, seasonal, s: int, critical: float = 3.8, most: int = 8, rate: float = 0.7) -> list[tuple[str, int]]:
    """Additive outliers, level shifts and temporary changes, the largest t value first, until none is over the limit."""
    n, found = len(y), []
    shapes = {"ao": lambda t: (np.arange(n) == t).astype(float), "ls": lambda t: np.where(np.arange(n) < t, -1.0, 0.0), "tc": lambda t: np.where(np.arange(n) >= t, rate ** np.maximum(0, np.arange(n) - t), 0.0)}
    cols = [x]
    for _ in range(most):
        m = regression_arima(y, np.column_stack(cols), order, seasonal, s)
        sd = np.median(np.abs(m["residuals"])) / 0.6745 or math.sqrt(m["sigma2"])
        best = ("", -1, 0.0)
        d = difference(np.eye(n), order[1], seasonal[1], s)
        for kind, shape in shapes.items():
            z = np.array([shape(t) for t in range(1 if kind == "ls" else 0, n)]).T
            e = _whiten(d @ z, m["ar"], m["ma"])
            v = (e * m["residuals"][:, None]).sum(0) / np.maximum(np.sqrt((e * e).sum(0)), 1e-12) / sd
            k = int(np.abs(v).argmax())
            if abs(v[k]) > abs(best[2]):
                best = (kind, k + (1 if kind == "ls" else 0), float(v[k]))
        if abs(best[2]) < critical or (best[0], best[1]) in found:
            break
        found.append((best[0], best[1]))
        cols.append(shapes[best[0]](best[1])[:, None])
    return found


def extend(y: np.ndarray, m: dict, s: int, ahead: int) -> np.ndarray:
    """Forecasts of a series with the model's ARIMA."""
    (_, d, _), (_, sd, _) = m["order"], m["seasonal"]
    full = np.concatenate(([1.0], -m["ar"]))
    for _ in range(d):
        full = np.convolve(full, [1.0, -1.0])
    for _ in range(sd):
        full = np.convolve(full, np.concatenate(([1.0], np.zeros(s - 1), [-1.0])))
    e, out = list(m["residuals"]), list(y)
    for _ in range(ahead):
        v = -sum(full[j] * out[-j] for j in range(1, len(full))) + sum(m["ma"][j] * e[-1 - j] for j in range(min(len(m["ma"]), len(e))))
        out.append(float(v))
        e.append(0.0)
    return np.array(out[len(y) :])


def adjust(y: np.ndarray, s: int = 12, start: int | None = None, transform: str = "auto", trading_day: bool = False, find_outliers: bool = True, critical: float = 3.8) -> dict:
    """All steps: seasonal, trend, irregular, adjusted, and what was chosen."""
    if len(y) < 3 * s:
        raise ValueError("three years are needed")
    none = np.zeros((len(y), 0))
    log = transform == "log"
    if transform == "auto" and (y > 0).all():
        air = ((0, 1, 1), (0, 1, 1))
        a, b = regression_arima(y, none, *air, s), regression_arima(np.log(y), none, *air, s)
        log = b["loglik"] - np.log(y).sum() > a["loglik"]
    z = np.log(y) if log else y.astype(float)
    model = choose_model(z, s)
    x = calendar(start, len(y), s) if trading_day and start is not None else none
    found = outliers(z, x, *model, s, critical) if find_outliers else []
    n = len(y)
    cols = [x]
    for kind, t in found:
        cols.append({"ao": (np.arange(n) == t).astype(float), "ls": np.where(np.arange(n) < t, -1.0, 0.0), "tc": np.where(np.arange(n) >= t, 0.7 ** np.maximum(0, np.arange(n) - t), 0.0)}[kind][:, None])
    reg = np.column_stack(cols)
    m = regression_arima(z, reg, *model, s)
    effect = reg @ m["b"] if reg.shape[1] else np.zeros(n)
    line = z - effect
    one = m | {"residuals": _whiten(difference(line, model[0][1], model[1][1], s), m["ar"], m["ma"])[:, 0]}
    after = extend(line, one, s, s)
    flip = line[::-1]
    two = m | {"residuals": _whiten(difference(flip, model[0][1], model[1][1], s), m["ar"], m["ma"])[:, 0]}
    long = np.concatenate((extend(flip, two, s, s)[::-1], line, after))
    got = {k: v[s : s + n] for k, v in decompose(np.exp(long) if log else long, s, log).items()}
    td = x @ m["b"][: x.shape[1]] if x.shape[1] else np.zeros(n)
    seasonal = got["seasonal"] * np.exp(td) if log else got["seasonal"] + td
    adjusted = y / seasonal if log else y - seasonal
    trend = got["trend"]
    for kind, t in found:
        if kind == "ls":  # shifts belong to the trend
            j = x.shape[1] + found.index((kind, t))
            step = reg[:, j] * m["b"][j]
            trend = trend * np.exp(step) if log else trend + step
    return {"seasonal": seasonal, "trend": trend, "adjusted": adjusted, "irregular": adjusted / trend if log else adjusted - trend, "log": log, "model": model, "outliers": found, "fit": m}


def x11(df: DataFrame, column: str, order: str, period: int = 12, by: str | None = None, **options) -> DataFrame:
    """order, value, seasonal, trend, irregular, adjusted."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        m = adjust(y, period, **options)
        return {order: t, "value": y} | {k: m[k] for k in ("seasonal", "trend", "irregular", "adjusted")}

    return run(df, column, order, f, f"{order} {kind}, value double, seasonal double, trend double, irregular double, adjusted double", by)


def x11_summary(df: DataFrame, column: str, order: str, period: int = 12, by: str | None = None, **options) -> DataFrame:
    """name, value: whether logs were taken, the orders, ARIMA parameters, sigma2, bic, and an entry an outlier (kind at order value) with its coefficient."""

    def f(t, y):
        m = adjust(y, period, **options)
        (p, d, q), (sp, sd, sq) = m["model"]
        out = [("log", float(m["log"])), ("p", p), ("d", d), ("q", q), ("P", sp), ("D", sd), ("Q", sq), ("sigma2", m["fit"]["sigma2"]), ("bic", m["fit"]["bic"])]
        out += [(f"parameter_{k + 1}", float(v)) for k, v in enumerate(m["fit"]["par"])]
        base = len(m["fit"]["b"]) - len(m["outliers"])
        out += [(f"{kind}_{t[k]}", float(m["fit"]["b"][base + i])) for i, (kind, k) in enumerate(m["outliers"])]
        return tidy(("name", "value"), [(a, float(b)) for a, b in out])

    return run(df, column, order, f, "name string, value double", by)
