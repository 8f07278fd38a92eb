"""Structural identification beyond recursive orderings: restrictions, independent shocks, changing volatility, and tests.

Every scheme gives an impact matrix, the Cholesky factor of the residual
covariance times a rotation. Random rotations are rows seeded by their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from .kernels import per_series, tidy
from .multivariate import CUBE, Var, _cube, system
from .series import nelder_mead

# -- rotations ------------------------------------------------------------------


def haar(n: int, rng: np.random.Generator) -> np.ndarray:
    """A rotation drawn evenly."""
    q, r = np.linalg.qr(rng.normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def givens(angles: np.ndarray, n: int) -> np.ndarray:
    """A rotation from n (n - 1) / 2 angles."""
    q, k = np.eye(n), 0
    for i in range(n):
        for j in range(i + 1, n):
            c, s = math.cos(angles[k]), math.sin(angles[k])
            g = np.eye(n)
            g[i, i] = g[j, j] = c
            g[i, j], g[j, i] = -s, s
            q, k = q @ g, k + 1
    return q


def ordered(q: np.ndarray) -> np.ndarray:
    """Columns put in the order and sign that make the diagonal largest."""
    out, left = np.zeros_like(q), list(range(q.shape[1]))
    for i in range(q.shape[0]):
        k = max(left, key=lambda j: abs(q[i, j]))
        left.remove(k)
        out[:, i] = q[:, k] * (1 if q[i, k] >= 0 else -1)
    return out


def whitened(m: Var) -> tuple[np.ndarray, np.ndarray]:
    """Cholesky factor and residuals of unit covariance."""
    c = np.linalg.cholesky(m.sigma)
    return c, np.linalg.solve(c, (m.u - m.u.mean(0)).T).T


def best_rotation(loss: Callable[[np.ndarray], float], n: int, starts: int = 8, seed: int = 3) -> np.ndarray:
    """The rotation of least loss over several starts."""
    k = n * (n - 1) // 2
    rng = np.random.default_rng(seed)
    first = [np.zeros(k), *[rng.uniform(-math.pi / 2, math.pi / 2, k) for _ in range(starts - 1)]]
    got = [nelder_mead(lambda a: loss(givens(a, n)), x, 0.4, 150 * k) for x in first]
    return givens(min(got, key=lambda a: loss(givens(a, n))), n)


# -- restrictions -----------------------------------------------------------------


def zero_sign_rotation(phi: np.ndarray, chol: np.ndarray, zeros: list[tuple[int, int, int]], rng: np.random.Generator) -> np.ndarray:
    """A rotation whose responses (variable, shock, horizon) in zeros vanish, drawn column by column in the null space."""
    n = chol.shape[0]
    theta = phi @ chol
    order = sorted(range(n), key=lambda j: -sum(z[1] == j for z in zeros))
    q = np.zeros((n, n))
    done: list[np.ndarray] = []
    for j in order:
        rows = [theta[h, v] for v, s, h in zeros if s == j] + done
        x = rng.normal(size=n)
        if rows:
            a = np.array(rows)
            if np.linalg.matrix_rank(a) >= n:
                raise ValueError("too many zero restrictions on one shock")
            _, s, vt = np.linalg.svd(a)
            null = vt[(s > 1e-10).sum() :]
            x = null.T @ (null @ x)
        q[:, j] = x / np.linalg.norm(x)
        done.append(q[:, j])
    return q


def restricted_irf(df: DataFrame, columns: list[str], order: str, zeros: list[tuple[str, str, int]] = (), signs: list[tuple[str, str, int, int]] = (), narrative: list[tuple[str, object, int]] = (), p: int = 1, horizon: int = 12, draws: int = 1000, seed: int = 1) -> DataFrame:
    """horizon, variable, shock, draws, mean, median, lower, upper over rotations that meet all restrictions.

    zeros are (variable, shock, horizon), signs (variable, shock, horizon, +-1), narrative (shock, order value, +-1: sign of the shock then).
    """
    spark = df.sparkSession
    at = {c: i for i, c in enumerate(columns)}
    times = [r[0] for r in df.dropna(subset=columns).select(order).orderBy(order).collect()] if narrative else []
    m = Var(system(df, columns, order), p)
    shared = spark.sparkContext.broadcast((m.moving_average(horizon), m.impact(), m.u))
    zs = [(at[v], at[s], h) for v, s, h in zeros]
    gs = [(at[v], at[s], h, g) for v, s, h, g in signs]
    ns = [(at[s], times.index(w) - p, g) for s, w, g in narrative]

    def go(batches):
        phi, chol, u = shared.value
        e = np.linalg.solve(chol, u.T).T
        for pdf in batches:
            out = []
            for r in pdf.id:
                q = zero_sign_rotation(phi, chol, zs, np.random.default_rng([seed, int(r)]))
                a = phi @ chol @ q
                for s in range(len(columns)):  # a shock's sign is free until a restriction sets it
                    own = [a[h, v, s] * g for v, k, h, g in gs if k == s] + [(e[t] @ q[:, s]) * g for k, t, g in ns if k == s]
                    if own and all(x < 0 for x in own):
                        q[:, s] *= -1
                        a[:, :, s] *= -1
                if all(a[h, v, s] * g > 0 for v, s, h, g in gs) and all((e[t] @ q[:, s]) * g > 0 for s, t, g in ns):
                    out.append(pd.DataFrame(_cube(a, columns)))
            if out:
                yield pd.concat(out)

    kept = spark.range(draws).mapInPandas(go, CUBE)
    return kept.groupBy("horizon", "variable", "shock").agg(F.count("*").alias("draws"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.16).alias("lower"), F.percentile("value", 0.84).alias("upper"), F.min("value").alias("least"), F.max("value").alias("most"))


def penalty_rotation(phi: np.ndarray, chol: np.ndarray, signs: list[tuple[int, int, int, int]], seed: int = 3) -> np.ndarray:
    """Uhlig's penalty: responses in units of their impact's spread count once if they have the sign asked for, a hundredfold against it."""
    n = chol.shape[0]
    scale = np.sqrt((chol**2).sum(1))

    def loss(q):
        x = [-g * (phi[h, v] @ chol @ q[:, s]) / scale[v] for v, s, h, g in signs]
        return sum(v if v < 0 else 100 * v for v in x)

    return best_rotation(loss, n, 12, seed)


def penalty_irf(df: DataFrame, columns: list[str], order: str, signs: list[tuple[str, str, int, int]], p: int = 1, horizon: int = 12, by: str | None = None) -> DataFrame:
    at = {c: i for i, c in enumerate(columns)}

    def f(t, y):
        m = Var(y, p)
        phi, c = m.moving_average(horizon), m.impact()
        return _cube(phi @ c @ penalty_rotation(phi, c, [(at[v], at[s], h, g) for v, s, h, g in signs]), columns)

    return per_series(df, columns, order, f, CUBE, by)


# -- independent shocks -------------------------------------------------------------


def joint_diagonal(matrices: np.ndarray, steps: int = 100, tol: float = 1e-10) -> np.ndarray:
    """The rotation that makes all symmetric matrices as diagonal as can be, by plane rotations."""
    a = np.array(matrices, float)
    n = a.shape[1]
    v = np.eye(n)
    for _ in range(steps):
        most = 0.0
        for i in range(n):
            for j in range(i + 1, n):
                g = np.array([a[:, i, i] - a[:, j, j], a[:, i, j] + a[:, j, i]])
                g = g @ g.T
                on, off = g[0, 0] - g[1, 1], g[0, 1] + g[1, 0]
                angle = 0.5 * math.atan2(off, on + math.sqrt(on * on + off * off))
                most = max(most, abs(angle))
                r = np.eye(n)
                r[i, i] = r[j, j] = math.cos(angle)
                r[i, j], r[j, i] = -math.sin(angle), math.sin(angle)
                a = np.swapaxes(r, 0, 1) @ a @ r
                v = v @ r
        if most < tol:
            break
    return v


def jade(z: np.ndarray) -> np.ndarray:
    """By fourth cumulant matrices of white residuals."""
    t, n = z.shape
    out = []
    for i in range(n):
        for j in range(i, n):
            w = z[:, i] * z[:, j]
            q = (z * w[:, None]).T @ z / t - (i == j) * np.eye(n)
            e = np.zeros((n, n))
            e[i, j] += 1
            e[j, i] += 1
            out.append((q - (e if i != j else np.diag(np.eye(n)[i] * 2))) * (math.sqrt(2) if i != j else 1))
    return joint_diagonal(np.array(out))


def sobi(z: np.ndarray, lags: int = 12) -> np.ndarray:
    """By symmetrised autocovariances."""
    out = []
    for k in range(1, min(lags, len(z) - 2) + 1):
        c = z[k:].T @ z[:-k] / len(z)
        out.append((c + c.T) / 2)
    return joint_diagonal(np.array(out))


def distance_covariance(x: np.ndarray, y: np.ndarray) -> float:
    """Squared, of two samples."""

    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    return float((centred(x) * centred(y)).mean())


def hsic(x: np.ndarray, y: np.ndarray, width: float = 1.0) -> float:
    """Hilbert-Schmidt independence with Gaussian kernels."""

    def centred(v):
        k = np.exp(-((v[:, None] - v[None, :]) ** 2) / (2 * width * width))
        return k - k.mean(0) - k.mean(1)[:, None] + k.mean()

    return float((centred(x) * centred(y)).mean())


def _pairwise(measure) -> Callable[[np.ndarray], np.ndarray]:
    def find(z):
        n = z.shape[1]
        return best_rotation(lambda q: sum(measure((e := z @ q)[:, i], e[:, j]) for i in range(n) for j in range(i)), n, 3)

    return find


def _student(e: np.ndarray) -> float:
    """Log-likelihood of unit-variance t shocks, degrees of freedom from a grid."""

    def ll(x, d):
        s = (d - 2) / d
        return len(x) * (math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - 0.5 * math.log(math.pi * d * s)) - (d + 1) / 2 * np.log1p(x * x / (d * s)).sum()

    return sum(max(ll(x, d) for d in (2.5, 3, 4, 5, 7, 10, 15, 30, 100)) for x in e.T)


def _mixture(e: np.ndarray) -> float:
    """Of a scale mixture of two centred normals with unit variance."""

    def ll(x, w, r):
        a = 1 / (w + (1 - w) * r)  # variance of the calm part; the other's is r times that
        d = w * np.exp(-0.5 * x * x / a) / math.sqrt(a) + (1 - w) * np.exp(-0.5 * x * x / (a * r)) / math.sqrt(a * r)
        return float(np.log(d / math.sqrt(2 * math.pi)).sum())

    return sum(max(ll(x, w, r) for w in (0.5, 0.7, 0.9) for r in (1, 2, 4, 8, 16)) for x in e.T)


def _skew(e: np.ndarray) -> float:
    """Of skew-normal shocks with mean 0 and variance 1."""

    def ll(x, a):
        d = a / math.sqrt(1 + a * a)
        w = 1 / math.sqrt(1 - 2 * d * d / math.pi)
        z = x / w + d * math.sqrt(2 / math.pi)
        cdf = np.array([dist.norm_cdf(v) for v in a * z])
        return float((math.log(2 / w) - 0.5 * z * z - 0.5 * math.log(2 * math.pi) + np.log(np.maximum(cdf, 1e-300))).sum())

    return sum(max(ll(x, a) for a in (-8, -4, -2, -1, 0, 1, 2, 4, 8)) for x in e.T)


def _pseudo(e: np.ndarray) -> float:
    """Pseudo-likelihood: t shocks with a fixed 5 degrees of freedom for all."""
    d, s = 5.0, 3 / 5
    return float((math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - 0.5 * math.log(math.pi * d * s) - (d + 1) / 2 * np.log1p(e * e / (d * s))).sum())


LIKELIHOODS = {"student_t": _student, "mixture_normal": _mixture, "skew_normal": _skew, "pml": _pseudo}


def _likely(density) -> Callable[[np.ndarray], np.ndarray]:
    return lambda z: best_rotation(lambda q: -density(z @ q), z.shape[1], 3)


def _garch_path(x: np.ndarray, a: float, b: float) -> np.ndarray:
    h = np.empty(len(x))
    h[0] = 1.0
    for k in range(1, len(x)):
        h[k] = 1 - a - b + a * x[k - 1] ** 2 + b * h[k - 1]
    return h


def _garch(e: np.ndarray) -> float:
    """Log-likelihood of unit-variance GARCH(1, 1) shocks over a grid of coefficients."""

    def ll(x, a, b):
        h = _garch_path(x, a, b)
        return float(-0.5 * (np.log(2 * math.pi * h) + x * x / h).sum())

    return sum(max(ll(x, a, b) for a, b in ((0, 0), (0.05, 0.9), (0.1, 0.8), (0.2, 0.6), (0.3, 0.3))) for x in e.T)


METHODS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"jade": jade, "sobi": sobi, "dcov": _pairwise(distance_covariance), "hsic": _pairwise(hsic), "garch": _likely(_garch)} | {k: _likely(f) for k, f in LIKELIHOODS.items()}


def independent(df: DataFrame, columns: list[str], order: str, method: str, p: int = 1, by: str | None = None) -> DataFrame:
    """variable, shock, impact by jade, sobi, dcov, hsic, garch, student_t, mixture_normal, skew_normal or pml."""

    def f(t, y):
        c, z = whitened(Var(y, p))
        a = ordered(c @ METHODS[method](z))
        n = len(columns)
        return {"variable": np.repeat(columns, n), "shock": np.tile(columns, n), "impact": a.ravel()}

    return per_series(df, columns, order, f, "variable string, shock string, impact double", by)


# -- changing volatility ----------------------------------------------------------


def two_covariances(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """B and relative variances with one = B B' and two = B diag(l) B'."""
    c = np.linalg.cholesky(one)
    inv = np.linalg.inv(c)
    w, v = np.linalg.eigh(inv @ two @ inv.T)
    return c @ v, w


def regime_covariances(u: np.ndarray, regimes: int = 2, steps: int = 500, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Covariances of the regimes, smoothed probabilities and log-likelihood, by expectation-maximisation."""
    t, n = u.shape
    size = (u**2).sum(1)
    rank = np.argsort(np.argsort(size)) * regimes // t
    s = np.array([u[rank == k].T @ u[rank == k] / max(1, (rank == k).sum()) + 1e-8 * np.eye(n) for k in range(regimes)])
    p = np.full((regimes, regimes), 0.1 / max(1, regimes - 1))
    np.fill_diagonal(p, 0.9)
    start, last = np.full(regimes, 1 / regimes), -math.inf
    for _ in range(steps):
        d = np.column_stack([np.exp(-0.5 * (np.einsum("ti,ij,tj->t", u, np.linalg.inv(c), u) + np.linalg.slogdet(c)[1] + n * math.log(2 * math.pi))) for c in s]) + 1e-300
        a, k = np.zeros((t, regimes)), np.zeros(t)
        for i in range(t):
            v = (start if not i else a[i - 1] @ p) * d[i]
            k[i] = v.sum()
            a[i] = v / k[i]
        b = np.ones((t, regimes))
        for i in range(t - 2, -1, -1):
            b[i] = p @ (d[i + 1] * b[i + 1]) / k[i + 1]
        g = a * b
        g /= g.sum(1, keepdims=True)
        x = sum(np.outer(a[i], d[i + 1] * b[i + 1]) * p / k[i + 1] for i in range(t - 1))
        p, start = x / x.sum(1, keepdims=True), g[0]
        s = np.array([(u * g[:, [j]]).T @ u / g[:, j].sum() + 1e-8 * np.eye(n) for j in range(regimes)])
        ll = float(np.log(k).sum())
        if abs(ll - last) < tol:
            break
        last = ll
    o = np.argsort([np.trace(c) for c in s])
    return s[o], g[:, o], ll


def markov_switching_impact(df: DataFrame, columns: list[str], order: str, p: int = 1, by: str | None = None) -> DataFrame:
    """variable, shock, impact, variance_ratio (of the shock, second regime to first)."""

    def f(t, y):
        m = Var(y, p)
        s, _, _ = regime_covariances(m.u - m.u.mean(0))
        return _two(columns, *two_covariances(s[0], s[1]))

    return per_series(df, columns, order, f, "variable string, shock string, impact double, variance_ratio double", by)


def _two(columns: list[str], b: np.ndarray, w: np.ndarray) -> dict:
    n = len(columns)
    b = b * np.sign(np.where(b[np.abs(b).argmax(0), range(n)] == 0, 1, b[np.abs(b).argmax(0), range(n)]))
    return {"variable": np.repeat(columns, n), "shock": np.tile([f"shock{j + 1}" for j in range(n)], n), "impact": b.ravel(), "variance_ratio": np.tile(w, n)}


def smooth_transition_impact(df: DataFrame, columns: list[str], order: str, transition: str, p: int = 1, by: str | None = None) -> DataFrame:
    """variable, shock, impact, variance_ratio: covariance moves logistically with a transition variable, slope and place by likelihood over a grid."""

    def f(t, v):
        y, s = v[:, :-1], v[p:, -1]
        m = Var(y, p)
        u, n = m.u - m.u.mean(0), m.n
        z = (s - s.mean()) / s.std()
        best = None
        for gamma in (1, 2, 5, 10, 50):
            for c in np.quantile(z, (0.2, 0.35, 0.5, 0.65, 0.8)):
                g = 1 / (1 + np.exp(-gamma * (z - c)))
                # Least squares of u u' on 1 - g and g gives both covariances.
                x = np.column_stack([1 - g, g])
                k = np.linalg.lstsq(x, np.einsum("ti,tj->tij", u, u).reshape(len(u), -1), rcond=None)[0].reshape(2, n, n)
                if min(np.linalg.eigvalsh(k[0])[0], np.linalg.eigvalsh(k[1])[0]) <= 0:
                    continue
                h = (1 - g)[:, None, None] * k[0] + g[:, None, None] * k[1]
                ll = -0.5 * float((np.linalg.slogdet(h)[1] + np.einsum("ti,ti->t", u, np.linalg.solve(h, u[:, :, None])[:, :, 0])).sum())
                if best is None or ll > best[0]:
                    best = (ll, k)
        k = best[1] if best else np.array([m.sigma, m.sigma])
        return _two(columns, *two_covariances(k[0], k[1]))

    return per_series(df, [*columns, transition], order, f, "variable string, shock string, impact double, variance_ratio double", by)


# -- tests ----------------------------------------------------------------------------


def jarque_bera(x: np.ndarray) -> tuple[float, float]:
    z = (x - x.mean()) / x.std()
    s = len(x) / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4)
    return s, dist.chi2_sf(s, 2)


TESTS = "test string, statistic double, df int, p_value double"


def shock_gaussianity(df: DataFrame, columns: list[str], order: str, p: int = 1, method: str = "cholesky", by: str | None = None) -> DataFrame:
    """A Jarque-Bera row a shock and one for all: test, statistic, df, p_value."""

    def f(t, y):
        m = Var(y, p)
        e = m.shocks() if method == "cholesky" else whitened(m)[1] @ METHODS[method](whitened(m)[1])
        got = [jarque_bera(x) for x in e.T]
        total = sum(s for s, _ in got)
        return tidy(("test", "statistic", "df", "p_value"), [(c, s, 2, q) for c, (s, q) in zip(columns, got, strict=True)] + [("all", total, 2 * len(got), dist.chi2_sf(total, 2 * len(got)))])

    return per_series(df, columns, order, f, TESTS, by)


def gaussian_against(df: DataFrame, columns: list[str], order: str, p: int = 1, density: str = "student_t", by: str | None = None) -> DataFrame:
    """Likelihood ratio of independent non-Gaussian against Gaussian shocks: test, statistic, df, p_value."""

    def f(t, y):
        _, z = whitened(Var(y, p))
        n = z.shape[1]
        k = {"student_t": n, "mixture_normal": 2 * n, "skew_normal": n, "pml": 1}[density]
        s = max(0.0, 2 * (LIKELIHOODS[density](z @ METHODS[density](z)) + 0.5 * float((np.log(2 * math.pi) + z * z).sum())))
        return tidy(("test", "statistic", "df", "p_value"), [(density, s, k, dist.chi2_sf(s, k))])

    return per_series(df, columns, order, f, TESTS, by)


def shock_independence(df: DataFrame, columns: list[str], order: str, p: int = 1, method: str = "jade", lags: int = 10, permutations: int = 99, by: str | None = None) -> DataFrame:
    """Portmanteau of cross-correlations and permuted distance covariance of the shocks: test, statistic, df, p_value."""

    def f(t, y):
        _, z = whitened(Var(y, p))
        e = z @ METHODS[method](z)
        n, k = e.shape
        s, df_ = 0.0, 0
        for i in range(k):
            for j in range(k):
                if i != j:
                    for h in range(0 if i < j else 1, lags + 1):
                        r = float(e[h:, i] @ e[: n - h, j]) / n
                        s, df_ = s + n * n / (n - h) * r * r, df_ + 1
        rng = np.random.default_rng(7)
        total = lambda a: sum(distance_covariance(a[:, i], a[:, j]) for i in range(k) for j in range(i))
        own = total(e)
        above = sum(total(np.column_stack([rng.permutation(c) for c in e.T])) >= own for _ in range(permutations))
        return tidy(("test", "statistic", "df", "p_value"), [("cross_correlation", s, df_, dist.chi2_sf(s, df_)), ("distance_covariance", n * own, 0, (1 + above) / (1 + permutations))])

    return per_series(df, columns, order, f, TESTS, by)


def identification_strength(df: DataFrame, columns: list[str], order: str, p: int = 1, method: str = "jade", replicates: int = 50, seed: int = 1) -> DataFrame:
    """distance (median and 90 % of the turns between the sample's impact and bootstrap ones, 0 for the same): replicates are rows."""
    spark = df.sparkSession
    m = Var(system(df, columns, order), p)
    _, z = whitened(m)
    shared = spark.sparkContext.broadcast((z, METHODS[method](z)))

    def go(batches):
        z, base = shared.value
        for pdf in batches:
            out = []
            for r in pdf.id:
                x = z[np.random.default_rng([seed, int(r)]).integers(0, len(z), len(z))]
                c = np.linalg.cholesky(np.cov(x.T, bias=True))
                q = METHODS[method](np.linalg.solve(c, (x - x.mean(0)).T).T)
                out.append(float(np.linalg.norm(ordered(base.T @ q) - np.eye(len(q)))))
            yield pd.DataFrame({"distance": out})

    return spark.range(replicates).mapInPandas(go, "distance double").agg(F.percentile("distance", 0.5).alias("median"), F.percentile("distance", 0.9).alias("q90"), F.count("*").alias("replicates"))


def overidentification(df: DataFrame, columns: list[str], order: str, zeros: list[tuple[str, str]], p: int = 1, method: str = "jade", replicates: int = 50, seed: int = 1) -> DataFrame:
    """Bootstrap Wald test that impacts (variable, shock) of an identified model are zero: statistic, df, p_value."""
    spark = df.sparkSession
    m = Var(system(df, columns, order), p)
    at = {c: i for i, c in enumerate(columns)}
    where = [(at[v], at[s]) for v, s in zeros]
    c, z = whitened(m)
    own = ordered(c @ METHODS[method](z))
    shared = spark.sparkContext.broadcast(m.u - m.u.mean(0))

    def go(batches):
        u = shared.value
        for pdf in batches:
            out = []
            for r in pdf.id:
                x = u[np.random.default_rng([seed, int(r)]).integers(0, len(u), len(u))]
                x = x - x.mean(0)
                k = np.linalg.cholesky(x.T @ x / len(x))
                a = ordered(k @ METHODS[method](np.linalg.solve(k, x.T).T))
                out.append([float(a[i, j]) for i, j in where])
            yield pd.DataFrame({"v": out})

    got = np.array([r.v for r in spark.range(replicates).mapInPandas(go, "v array<double>").collect()])
    b = np.array([own[i, j] for i, j in where])
    s = float(b @ np.linalg.pinv(np.atleast_2d(np.cov(got.T))) @ b)
    return spark.createDataFrame([("zero_impacts", s, len(b), float(dist.chi2_sf(s, len(b))))], TESTS)
