"""The wider family of conditional variances: fits, summaries, news impact, tests, forecasts; covariances of systems; stochastic volatility.

One series or system is one kernel. Simulated forecasts are drawn inside the
kernel with a seed of its own, so they repeat.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from ..functions import dist
from ..functions.linalg import guarded_inverse
from .kernels import per_series, tidy
from .series import acf, nelder_mead, run

ABS_NORMAL = math.sqrt(2 / math.pi)


class Model:
    """A kind of conditional variance: names and start of its parameters, path of variances, bounds."""

    #: kind -> parameter names (of order one).
    NAMES = {
        "arch": ("omega", "alpha"),
        "garch": ("omega", "alpha", "beta"),
        "gjr": ("omega", "alpha", "beta", "gamma"),
        "egarch": ("omega", "alpha", "gamma", "beta"),
        "igarch": ("omega", "alpha"),
        "cgarch": ("omega", "rho", "phi", "alpha", "beta"),
        "aparch": ("omega", "alpha", "gamma", "beta", "delta"),
        "figarch": ("omega", "phi", "beta", "d"),
        "fiegarch": ("omega", "alpha", "gamma", "phi", "d"),
    }

    def __init__(self, kind: str, trunc: int = 200):
        if kind not in self.NAMES:
            raise ValueError(f"volatility {kind} is not known")
        self.kind, self.names, self.trunc = kind, self.NAMES[kind], trunc

    def start(self, s: float) -> np.ndarray:
        l = math.log(s)  # noqa: E741
        return np.array({"arch": [0.7 * s, 0.3], "garch": [0.1 * s, 0.1, 0.8], "gjr": [0.1 * s, 0.05, 0.8, 0.05], "egarch": [0.1 * l, 0.1, 0.0, 0.9], "igarch": [0.02 * s, 0.1], "cgarch": [s, 0.98, 0.03, 0.06, 0.8], "aparch": [0.1 * s, 0.1, 0.0, 0.8, 2.0], "figarch": [0.1 * s, 0.2, 0.4, 0.4], "fiegarch": [l, 0.1, 0.0, 0.3, 0.3]}[self.kind])

    def allowed(self, p: np.ndarray) -> bool:
        k = self.kind
        if k == "arch":
            return p[0] > 0 and 0 <= p[1] < 1
        if k == "garch":
            return p[0] > 0 and p[1] >= 0 and p[2] >= 0 and p[1] + p[2] < 1
        if k == "gjr":
            return p[0] > 0 and p[1] >= 0 and p[2] >= 0 and p[1] + p[3] >= 0 and p[1] + p[2] + p[3] / 2 < 1
        if k == "egarch":
            return abs(p[3]) < 1
        if k == "igarch":
            return p[0] > 0 and 0 <= p[1] < 1
        if k == "cgarch":
            return p[0] > 0 and 0 <= p[1] < 1 and 0 <= p[2] and p[3] >= 0 and p[4] >= 0 and p[3] + p[4] < p[1]
        if k == "aparch":
            return p[0] > 0 and p[1] >= 0 and abs(p[2]) < 1 and p[3] >= 0 and 0.3 < p[4] < 4 and p[1] + p[3] < 1
        if k == "figarch":
            return p[0] > 0 and 0 < p[3] < 1 and 0 <= p[2] < 1 and 0 <= p[1] <= (1 - p[3]) / 2 + p[2] and p[2] <= p[1] + p[3]
        return 0 <= p[4] < 0.5 and abs(p[3]) < 1

    def weights(self, p: np.ndarray) -> np.ndarray:
        """Of the squares in a fractional variance: 1 - (1 - phi L)(1 - L)^d / (1 - beta L), from lag 1."""
        _, phi, beta, d = p
        delta = np.empty(self.trunc)
        delta[0] = d
        for k in range(1, self.trunc):
            delta[k] = delta[k - 1] * (k - d) / (k + 1)
        lam = np.empty(self.trunc)
        lam[0] = phi - beta + d
        for k in range(1, self.trunc):
            lam[k] = beta * lam[k - 1] + ((k - d) / (k + 1) - phi) * delta[k - 1]
        return lam

    def path(self, e: np.ndarray, p: np.ndarray, s0: float, ahead: int = 0, draws: np.ndarray | None = None) -> np.ndarray:
        """Variances of the sample, and of ``ahead`` further times whose standard shocks are given."""
        n = len(e) + ahead
        h, x, k = np.empty(n), np.concatenate((e, np.zeros(ahead))), self.kind
        q, lh, hd = s0, math.log(s0), None
        if k in ("figarch", "fiegarch"):
            if k == "figarch":
                lam = self.weights(p)
                base = p[0] / (1 - p[2])
            else:
                w = np.ones(self.trunc)
                for i in range(1, self.trunc):  # (1 - L)^-d, then 1 / (1 - phi L)
                    w[i] = w[i - 1] * (i - 1 + p[4]) / i
                for i in range(1, self.trunc):
                    w[i] += p[3] * w[i - 1]
                g = np.zeros(n)
        for t in range(n):
            if k == "figarch":
                m = min(t, self.trunc)
                past = x[t - m : t][::-1] ** 2
                h[t] = base + lam[:m] @ past + lam[m:].sum() * s0
            elif k == "fiegarch":
                m = min(t, self.trunc)
                h[t] = math.exp(min(50.0, max(-50.0, p[0] + w[:m] @ g[t - m : t][::-1])))
                z = x[t] / math.sqrt(h[t]) if t < len(e) else draws[t - len(e)]
                g[t] = p[1] * (abs(z) - ABS_NORMAL) + p[2] * z
            elif not t:
                h[0] = s0
                hd = s0 ** (p[4] / 2) if k == "aparch" else None
            else:
                u, v = x[t - 1], h[t - 1]
                if k == "arch":
                    h[t] = p[0] + p[1] * u * u
                elif k == "garch":
                    h[t] = p[0] + p[1] * u * u + p[2] * v
                elif k == "gjr":
                    h[t] = p[0] + (p[1] + p[3] * (u < 0)) * u * u + p[2] * v
                elif k == "igarch":
                    h[t] = p[0] + p[1] * u * u + (1 - p[1]) * v
                elif k == "egarch":
                    z = u / math.sqrt(v)
                    lh = min(50.0, max(-50.0, p[0] + p[3] * lh + p[1] * (abs(z) - ABS_NORMAL) + p[2] * z))
                    h[t] = math.exp(lh)
                elif k == "cgarch":
                    last = q
                    q = p[0] + p[1] * (q - p[0]) + p[2] * (u * u - v)
                    h[t] = max(1e-12 * s0, q + p[3] * (u * u - last) + p[4] * (v - last))
                else:
                    hd = p[0] + p[1] * (abs(u) - p[2] * u) ** p[4] + p[3] * hd
                    h[t] = hd ** (2 / p[4])
            if t >= len(e):
                x[t] = math.sqrt(h[t]) * draws[t - len(e)]
        return h

    def loss(self, e: np.ndarray, p: np.ndarray, s0: float) -> float:
        if not self.allowed(p):
            return 1e300
        h = np.maximum(self.path(e, p, s0), 1e-300)
        v = 0.5 * float((np.log(2 * math.pi * h) + e * e / h).sum())
        return v if v == v else 1e300

    def fit(self, y: np.ndarray) -> dict:
        e = y - y.mean()
        s0 = float(e.var())
        f = lambda p: self.loss(e, p, s0)
        p = nelder_mead(f, self.start(s0))
        p = nelder_mead(f, p, 0.02)
        return {"params": p, "loglik": -f(p), "h": self.path(e, p, s0), "e": e, "s0": s0, "mean": float(y.mean())}

    def persistence(self, p: np.ndarray) -> float:
        return {"arch": lambda: p[1], "garch": lambda: p[1] + p[2], "gjr": lambda: p[1] + p[2] + p[3] / 2, "egarch": lambda: p[3], "igarch": lambda: 1.0, "cgarch": lambda: p[1], "aparch": lambda: p[1] * self.power_mean(p) + p[3], "figarch": lambda: float(self.weights(p).sum()), "fiegarch": lambda: p[3]}[self.kind]()

    @staticmethod
    def power_mean(p: np.ndarray) -> float:
        """E (|z| - gamma z)^delta of a standard normal z."""
        d = p[4]
        return ((1 + p[2]) ** d + (1 - p[2]) ** d) * 2 ** (d / 2 - 1) * math.gamma((d + 1) / 2) / math.sqrt(math.pi)

    def unconditional(self, p: np.ndarray) -> float:
        k, s = self.kind, self.persistence(p)
        if k in ("igarch", "figarch"):
            return float("inf")
        if k == "cgarch":
            return p[0]
        if k in ("egarch", "fiegarch"):
            log = p[0] / (1 - p[3]) if k == "egarch" else p[0]
            return math.exp(log) if log < 700 else float("inf")
        return (p[0] / (1 - s)) ** (2 / p[4]) if k == "aparch" else p[0] / (1 - s)

    def news(self, p: np.ndarray, z: np.ndarray, s: float) -> np.ndarray:
        """Next variance after a shock of z standard deviations, variances having been s."""
        out = []
        for v in z:
            u = v * math.sqrt(s)
            if self.kind in ("figarch", "fiegarch"):
                out.append(self.path(np.array([u]), p, s, 1, np.zeros(1))[1])
            else:
                out.append(self.path(np.array([u, 0.0]), p, s)[1])
        return np.array(out)


def fit_table(df: DataFrame, column: str, order: str, kind: str = "garch", by: str | None = None) -> DataFrame:
    """term, estimate: parameters, loglik, aic, bic, persistence, halflife, unconditional variance, orders."""

    def f(t, y):
        m = Model(kind)
        g = m.fit(y)
        k, p = len(m.names) + 1, m.persistence(g["params"])
        half = math.log(0.5) / math.log(p) if 0 < p < 1 else float("inf")
        own = {"arch": (1, 0)}.get(kind, (1, 1))
        return {"term": [*m.names, "mean", "loglik", "aic", "bic", "persistence", "halflife", "unconditional_variance", "arch_order", "garch_order"], "estimate": [*g["params"], g["mean"], g["loglik"], -2 * g["loglik"] + 2 * k, -2 * g["loglik"] + math.log(len(y)) * k, p, half, m.unconditional(g["params"]), *map(float, own)]}

    return run(df, column, order, f, "term string, estimate double", by)


def news_impact(df: DataFrame, column: str, order: str, kind: str = "garch", low: float = -3.0, high: float = 3.0, points: int = 13, by: str | None = None) -> DataFrame:
    """shock (in standard deviations), variance."""

    def f(t, y):
        m = Model(kind)
        g = m.fit(y)
        z = np.linspace(low, high, points)
        return {"shock": z, "variance": m.news(g["params"], z, g["s0"])}

    return run(df, column, order, f, "shock double, variance double", by)


def forecast(df: DataFrame, column: str, order: str, kind: str = "garch", steps: int = 8, paths: int = 1000, level: float = 0.95, seed: int = 1, by: str | None = None) -> DataFrame:
    """horizon, variance (mean over simulated paths), lower, upper."""

    def f(t, y):
        m = Model(kind)
        g = m.fit(y)
        rng = np.random.default_rng(seed)
        z = rng.normal(size=(paths // 2, steps))
        z = np.vstack([z, -z])
        h = np.array([m.path(g["e"], g["params"], g["s0"], steps, x)[len(y) :] for x in z]) if kind in ("figarch", "fiegarch", "cgarch", "aparch", "egarch") else _ahead(m, g, z)
        a = (1 - level) / 2
        return {"horizon": np.arange(1, steps + 1), "variance": h.mean(0), "lower": np.quantile(h, a, axis=0), "upper": np.quantile(h, 1 - a, axis=0)}

    return run(df, column, order, f, "horizon int, variance double, lower double, upper double", by)


def _ahead(m: Model, g: dict, z: np.ndarray) -> np.ndarray:
    """All paths at once for the kinds whose state is the last variance and shock."""
    p, k = g["params"], m.kind
    u, v = np.full(len(z), g["e"][-1]), np.full(len(z), g["h"][-1])
    out = []
    for s in range(z.shape[1]):
        v = {"arch": lambda: p[0] + p[1] * u * u, "garch": lambda: p[0] + p[1] * u * u + p[2] * v, "gjr": lambda: p[0] + (p[1] + p[3] * (u < 0)) * u * u + p[2] * v, "igarch": lambda: p[0] + p[1] * u * u + (1 - p[1]) * v}[k]()
        u = np.sqrt(v) * z[:, s]
        out.append(v)
    return np.array(out).T


def squared_portmanteau(df: DataFrame, column: str, order: str, lags: int = 10, standardise: bool = False, by: str | None = None) -> DataFrame:
    """Ljung-Box on squares of the demeaned series, or of GARCH-standardised residuals: statistic, df, p_value."""

    def f(t, y):
        e = y - y.mean()
        if standardise:
            g = Model("garch").fit(y)
            e = g["e"] / np.sqrt(g["h"])
        r = acf(e * e, lags)[1:]
        n, k = len(e), np.arange(1, lags + 1)
        q = n * (n + 2) * float((r * r / (n - k)).sum())
        return {"statistic": [q], "df": [lags], "p_value": [dist.chi2_sf(q, lags)]}

    return run(df, column, order, f, "statistic double, df int, p_value double", by)


def nyblom(df: DataFrame, column: str, order: str, kind: str = "garch", by: str | None = None) -> DataFrame:
    """term, statistic, of the constancy of each parameter and of all (term joint): from cumulative scores."""

    def f(t, y):
        m = Model(kind)
        g = m.fit(y)
        p = g["params"]

        def terms(q):
            h = np.maximum(m.path(g["e"], q, g["s0"]), 1e-300)
            return -0.5 * (np.log(h) + g["e"] ** 2 / h)

        s = []
        for i in range(len(p)):
            d = np.zeros(len(p))
            d[i] = 1e-5 * max(abs(p[i]), 1e-4)
            s.append((terms(p + d) - terms(p - d)) / (2 * d[i]))
        s = np.array(s).T
        s = s - s.mean(0)
        c, v = np.cumsum(s, axis=0), s.T @ s
        n = len(s)
        each = [(c[:, i] ** 2).sum() / (n * v[i, i]) for i in range(len(p))]
        return {"term": [*m.names, "joint"], "statistic": [*each, float(np.einsum("ti,ij,tj->", c, guarded_inverse(v), c) / n)]}

    return run(df, column, order, f, "term string, statistic double", by)


def components(df: DataFrame, column: str, order: str, by: str | None = None) -> DataFrame:
    """order, variance, permanent, transitory of a component model."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        m = Model("cgarch")
        g = m.fit(y)
        p, e, h = g["params"], g["e"], g["h"]
        q = np.empty(len(e))
        q[0] = g["s0"]
        for k in range(1, len(e)):
            q[k] = p[0] + p[1] * (q[k - 1] - p[0]) + p[2] * (e[k - 1] ** 2 - h[k - 1])
        return {order: t, "variance": h, "permanent": q, "transitory": h - q}

    return run(df, column, order, f, f"{order} {kind}, variance double, permanent double, transitory double", by)


# -- mixed frequency ----------------------------------------------------------------


def garch_midas(y: np.ndarray, x: np.ndarray, per: int, k: int = 12) -> dict:
    """Short-run unit GARCH times exp(m + theta sum of beta-weighted lags of the low-frequency x); x[i] goes with returns i * per .. (i + 1) * per."""
    e = y - y.mean()

    def tau(p):
        m, theta, w = p
        j = np.arange(1, k + 1) / k
        b = np.clip(1 - j, 1e-9, None) ** (max(w, 1.0) - 1)
        b /= b.sum()
        low = np.array([m + theta * (b @ x[i - k : i][::-1]) for i in range(k, len(x))])
        return np.repeat(np.exp(np.clip(low, -50, 50)), per)

    cut = k * per
    r = e[cut : cut + (len(x) - k) * per]

    def path(p):
        t = tau(p[2:])[: len(r)]
        g = np.empty(len(r))
        g[0] = 1.0
        for i in range(1, len(r)):
            g[i] = 1 - p[0] - p[1] + p[0] * r[i - 1] ** 2 / t[i - 1] + p[1] * g[i - 1]
        return t, g

    def loss(p):
        if p[0] < 0 or p[1] < 0 or p[0] + p[1] >= 0.999 or not 1 <= p[4] <= 50:
            return 1e300
        t, g = path(p)
        h = np.maximum(t * g, 1e-300)
        return 0.5 * float((np.log(2 * math.pi * h) + r * r / h).sum())

    p = nelder_mead(loss, np.array([0.1, 0.8, math.log(r.var()), 0.0, 3.0]), 0.2, 600)
    t, g = path(p)
    return {"params": dict(zip(("alpha", "beta", "m", "theta", "weight"), p.tolist(), strict=True)), "loglik": -loss(p), "tau": t, "g": g, "last": r[-1]}


def estimate_garch_midas(df: DataFrame, column: str, low: str, order: str, per: int, k: int = 12, steps: int = 4, by: str | None = None) -> DataFrame:
    """term, estimate, with variance forecasts h1.. (the long-run part held). ``low`` is the low-frequency value, repeated in the rows of its period."""

    def f(t, v):
        x = v[::per, 1]
        n = len(v) // per
        m = garch_midas(v[: n * per, 0], x[:n], per, k)
        a, b = m["params"]["alpha"], m["params"]["beta"]
        g = 1 - a - b + a * m["last"] ** 2 / m["tau"][-1] + b * m["g"][-1]
        out = []
        for _ in range(steps):
            out.append(m["tau"][-1] * g)
            g = 1 + (a + b) * (g - 1)
        return {"term": [*m["params"], "loglik", *[f"h{j + 1}" for j in range(steps)]], "estimate": [*m["params"].values(), m["loglik"], *out]}

    return per_series(df, [column, low], order, f, "term string, estimate double", by)


# -- systems --------------------------------------------------------------------------


def bekk(u: np.ndarray, diagonal: bool = False) -> dict:
    """H(t) = C + A o u u' + B o H(t - 1), C by targeting; scalar or diagonal A and B (entering as outer products)."""
    n, k = u.shape
    s = u.T @ u / n
    m = k if diagonal else 1

    def path(p):
        a, b = np.resize(p[:m], k), np.resize(p[m:], k)
        aa, bb = np.outer(a, a), np.outer(b, b)
        c = s * (1 - aa - bb)
        h = np.empty((n, k, k))
        h[0] = s
        for t in range(1, n):
            h[t] = c + aa * np.outer(u[t - 1], u[t - 1]) + bb * h[t - 1]
        return h

    def loss(p):
        if (p < 0).any() or (np.resize(p[:m], k) ** 2 + np.resize(p[m:], k) ** 2 >= 0.9999).any():
            return 1e300
        h = path(p)
        sign, ld = np.linalg.slogdet(h)
        if (sign <= 0).any():
            return 1e300
        return 0.5 * float((ld + np.einsum("ti,ti->t", u, np.linalg.solve(h, u[:, :, None])[:, :, 0])).sum()) + n * k / 2 * math.log(2 * math.pi)

    p = nelder_mead(loss, np.concatenate((np.full(m, 0.25), np.full(m, 0.9))), 0.05, 200 * m)
    return {"a": p[:m], "b": p[m:], "loglik": -loss(p), "h": path(p), "target": s}


def bekk_path(df: DataFrame, columns: list[str], order: str, diagonal: bool = False, by: str | None = None) -> DataFrame:
    """order, one, two, covariance, correlation (one = two gives variances)."""
    kind = df.schema[order].dataType.simpleString()
    k = len(columns)
    cells = [(i, j) for i in range(k) for j in range(i + 1)]

    def f(t, y):
        h = bekk(y - y.mean(0), diagonal)["h"]
        d = np.sqrt(np.array([np.diag(x) for x in h]))
        return tidy((order, "one", "two", "covariance", "correlation"), [(t[m], columns[i], columns[j], h[m, i, j], h[m, i, j] / (d[m, i] * d[m, j])) for m in range(len(h)) for i, j in cells])

    return per_series(df, columns, order, f, f"{order} {kind}, one string, two string, covariance double, correlation double", by)


def bekk_forecast(df: DataFrame, columns: list[str], order: str, steps: int = 4, diagonal: bool = False, by: str | None = None) -> DataFrame:
    """horizon, one, two, covariance."""
    k = len(columns)

    def f(t, y):
        u = y - y.mean(0)
        m = bekk(u, diagonal)
        a, b = np.resize(m["a"], k), np.resize(m["b"], k)
        aa, bb = np.outer(a, a), np.outer(b, b)
        h = m["target"] * (1 - aa - bb) + aa * np.outer(u[-1], u[-1]) + bb * m["h"][-1]
        out = []
        for s in range(1, steps + 1):
            out += [(s, columns[i], columns[j], h[i, j]) for i in range(k) for j in range(i + 1)]
            h = m["target"] * (1 - aa - bb) + (aa + bb) * h
        return tidy(("horizon", "one", "two", "covariance"), out)

    return per_series(df, columns, order, f, "horizon int, one string, two string, covariance double", by)


# -- stochastic volatility ----------------------------------------------------------

#: Seven normals that make up log chi-square(1) (Kim, Shephard and Chib, 1998): weight, mean, variance.
LOG_CHI2 = ((0.00730, -10.12999, 5.79596), (0.10556, -3.97281, 2.61369), (0.00002, -8.56686, 5.17950), (0.04395, 2.77786, 0.16735), (0.34001, 0.61942, 0.64009), (0.24566, 1.79518, 0.34023), (0.25750, -1.08819, 1.26261))


def stochastic(y: np.ndarray, draws: int = 500, burnin: int = 300, seed: int = 1, steps: int = 4) -> dict:
    """log h(t) = mu + phi (log h(t - 1) - mu) + sigma n(t): Gibbs draws of parameters, paths and forecasts."""
    rng = np.random.default_rng(seed)
    e = y - y.mean()
    x = np.log(e * e + 1e-6 * e.var())
    n = len(x)
    w, m, v = (np.array(c) for c in zip(*LOG_CHI2, strict=True))
    m = m - 1.2704
    mu, phi, sig = x.mean() + 1.27, 0.9, 0.3
    h = np.full(n, mu)
    pars, paths, ahead = [], [], []
    for it in range(burnin + draws):
        # Components given volatilities.
        d = x[:, None] - h[:, None] - m[None, :]
        lw = np.log(w) - 0.5 * np.log(v) - 0.5 * d * d / v
        lw = np.exp(lw - lw.max(1, keepdims=True))
        s = (lw.cumsum(1) < rng.random(n)[:, None] * lw.sum(1, keepdims=True)).sum(1)
        mm, vv = m[s], v[s]
        # Volatilities by filtering forwards and sampling backwards.
        a, p = np.empty(n), np.empty(n)
        am, pm = mu, sig * sig / (1 - phi * phi)
        for t in range(n):
            f = pm + vv[t]
            g = pm / f
            a[t], p[t] = am + g * (x[t] - mm[t] - am), pm * (1 - g)
            am, pm = mu + phi * (a[t] - mu), phi * phi * p[t] + sig * sig
        z = rng.normal(size=n)
        h[-1] = a[-1] + math.sqrt(p[-1]) * z[-1]
        for t in range(n - 2, -1, -1):
            f = phi * phi * p[t] + sig * sig
            g = phi * p[t] / f
            h[t] = a[t] + g * (h[t + 1] - mu - phi * (a[t] - mu)) + math.sqrt(max(1e-12, p[t] - g * phi * p[t])) * z[t]
        # Parameters.
        c = h - mu
        var = sig * sig / (c[:-1] @ c[:-1])
        new = c[:-1] @ c[1:] / (c[:-1] @ c[:-1]) + math.sqrt(var) * rng.normal()
        if abs(new) < 0.999 and math.log(rng.random() + 1e-300) < 19 * (math.log1p(new) - math.log1p(phi)) + 0.5 * (math.log1p(-new) - math.log1p(-phi)):
            phi = new
        r = c[1:] - phi * c[:-1]
        sig = math.sqrt((0.05 + (r @ r) / 2) / rng.gamma(2.5 + (n - 1) / 2))
        q = (n - 1) * (1 - phi) ** 2 + 1 - phi * phi
        mu = ((1 - phi * phi) * h[0] + (1 - phi) * (h[1:] - phi * h[:-1]).sum()) / q + sig / math.sqrt(q) * rng.normal()
        if it >= burnin:
            pars.append((mu, phi, sig))
            paths.append(np.exp(h / 2))
            last, out = h[-1], []
            for _ in range(steps):
                last = mu + phi * (last - mu) + sig * rng.normal()
                out.append(math.exp(last))
            ahead.append(out)
    return {"params": np.array(pars), "paths": np.array(paths), "ahead": np.array(ahead)}


def estimate_stochastic(df: DataFrame, column: str, order: str, draws: int = 500, burnin: int = 300, seed: int = 1, steps: int = 4, by: str | None = None) -> DataFrame:
    """term, mean, sd, lower, upper of mu, phi, sigma and variance forecasts h1.. (posterior)."""

    def f(t, y):
        m = stochastic(y, draws, burnin, seed, steps)
        a = np.column_stack([m["params"], m["ahead"]])
        return {"term": ["mu", "phi", "sigma", *[f"h{j + 1}" for j in range(steps)]], "mean": a.mean(0), "sd": a.std(0), "lower": np.quantile(a, 0.05, axis=0), "upper": np.quantile(a, 0.95, axis=0)}

    return run(df, column, order, f, "term string, mean double, sd double, lower double, upper double", by)


def volatility_path(df: DataFrame, column: str, order: str, draws: int = 500, burnin: int = 300, seed: int = 1, by: str | None = None) -> DataFrame:
    """order, volatility (posterior mean of the standard deviation), lower, upper."""
    kind = df.schema[order].dataType.simpleString()

    def f(t, y):
        p = stochastic(y, draws, burnin, seed)["paths"]
        return {order: t, "volatility": p.mean(0), "lower": np.quantile(p, 0.05, axis=0), "upper": np.quantile(p, 0.95, axis=0)}

    return run(df, column, order, f, f"{order} {kind}, volatility double, lower double, upper double", by)
