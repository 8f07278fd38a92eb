"""More of structural models: other solvers, second-order and global solutions, sequential Monte Carlo, diagnostics of posteriors, particle methods, dynamics of heterogeneous agents, continuous time.

A model is small and lives on the driver; parameterisations, particles, draws
and replicates are rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .describe import rows
from .dynamics import solve_linear
from .series import acf as autocorrelation
from .series import nelder_mead
from .structural import Model, Solution, _sample, _value, gini, jacobian, linearize, log_prior, smoothed, steady_state

CUBE = "horizon int, variable string, shock string, value double"

# -- linear solvers -----------------------------------------------------------------


def _pencil(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots z and right vectors of A z^2 + B z + C, infinite roots as such."""
    n = len(b)
    zero, one = np.zeros((n, n)), np.eye(n)
    lead, lag = np.block([[a, zero], [zero, one]]), np.block([[-b, -c], [one, zero]])
    shift = 1.137
    mu, v = np.linalg.eig(np.linalg.solve(lag - shift * lead, lead))
    with np.errstate(all="ignore"):
        z = np.where(np.abs(mu) > 1e-11, shift + 1 / np.where(mu == 0, 1, mu), np.inf)
    return z, v[n:]


def eigen_solution(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, div: float = 1 + 1e-8) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Blanchard and Kahn by the stable roots' vectors (Klein's split of the pencil): G, H, stable roots, unique."""
    z, v = _pencil(a, b, c)
    n, at = len(b), np.argsort(np.abs(z))
    stable = int((np.abs(z) < div).sum())
    k = at[:n]
    g = (v[:, k] * z[k]) @ np.linalg.pinv(v[:, k])
    return g.real, -np.linalg.solve(a @ g.real + b, d), stable, stable == n


def doubling_solution(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By cyclic reduction."""
    return solve_linear(a, b, c, d)


def iterated_solution(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, steps: int = 10_000, tol: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """By time iteration from no dynamics."""
    g = np.zeros_like(b)
    for _ in range(steps):
        new = -np.linalg.solve(a @ g + b, c)
        done = np.abs(new - g).max() < tol
        g = new
        if done:
            break
    return g, -np.linalg.solve(a @ g + b, d)


def solver_table(spark: SparkSession, model: Model, guess: dict[str, float] | None = None) -> DataFrame:
    """method, matrix (g or h), row, column, value, residual (of the model's matrix equation), determined."""
    s = steady_state(model, guess)
    a, b, c, d = linearize(model, s)
    g1, h1, _, unique = eigen_solution(a, b, c, d)
    out = []
    for name, (g, h) in {"blanchard_kahn": (g1, h1), "cyclic_reduction": doubling_solution(a, b, c, d), "time_iteration": iterated_solution(a, b, c, d)}.items():
        gap = float(np.abs(a @ g @ g + b @ g + c).max())
        out += [{"method": name, "matrix": "g", "row": v, "column": w, "value": float(g[i, j]), "residual": gap, "determined": bool(unique)} for i, v in enumerate(model.variables) for j, w in enumerate(model.variables)]
        out += [{"method": name, "matrix": "h", "row": v, "column": w, "value": float(h[i, j]), "residual": gap, "determined": bool(unique)} for i, v in enumerate(model.variables) for j, w in enumerate(model.shocks)]
    return rows(spark, out, "method string, matrix string, row string, column string, value double, residual double, determined boolean")


def moments_table(spark: SparkSession, s: Solution, lags: int = 1) -> DataFrame:
    """lag, row, column, covariance of the stationary distribution."""
    v, out = s.covariance(), []
    for k in range(lags + 1):
        out += [{"lag": k, "row": a, "column": b, "covariance": float(v[i, j])} for i, a in enumerate(s.model.variables) for j, b in enumerate(s.model.variables)]
        v = s.g @ v
    return rows(spark, out, "lag int, row string, column string, covariance double")


# -- second order -------------------------------------------------------------------


class Second:
    """y = steady + G x + H e + (1/2) Q(s, s) + (1/2) c with s = (lagged deviations, shocks); pruned when iterated."""

    def __init__(self, model: Model, guess: dict[str, float] | None = None):
        self.first = f = Solution(model, guess)
        self.model, self.steady, g, h = model, f.steady, f.g, f.h
        n, k = h.shape
        s, none = f.steady, np.zeros(k)
        a, b, _, _ = linearize(model, s)
        whole = lambda z: model.residuals(z[:n], z[n : 2 * n], z[2 * n : 3 * n], z[3 * n :])
        z0 = np.concatenate((s, s, s, none))
        m = len(z0)
        hess = np.empty((n, m, m))
        for i in range(m):
            e = np.zeros(m)
            e[i] = 1e-5 * max(1.0, abs(z0[i]))
            hess[:, :, i] = (jacobian(whole, z0 + e) - jacobian(whole, z0 - e)) / (2 * e[i])
        hess = (hess + hess.transpose(0, 2, 1)) / 2
        gs = np.hstack([g, h])
        zs = np.vstack([g @ gs, gs, np.hstack([np.eye(n), np.zeros((n, k))]), np.hstack([np.zeros((k, n)), np.eye(k)])])
        kk = np.einsum("fab,ai,bj->fij", hess, zs, zs)
        inv = np.linalg.inv(a @ g + b)
        # Lagged by lagged block first: (A G + B) X + A X (G, G) = -K.
        x = np.zeros((n, n, n))
        for _ in range(5000):
            new = -np.einsum("vf,fij->vij", inv, kk[:, :n, :n] + np.einsum("fv,vab,ai,bj->fij", a, x, g, g))
            done = np.abs(new - x).max() < 1e-13 * max(1.0, np.abs(new).max())
            x = new
            if done:
                break
        self.q = -np.einsum("vf,fij->vij", inv, kk + np.einsum("fv,vab,ai,bj->fij", a, x, gs, gs))
        ee = np.einsum("vii->v", self.q[:, n:, n:])
        lead = np.einsum("fab,ai,bi->f", hess[:, :n, :n], h, h)
        self.c = np.linalg.solve(a @ (g + np.eye(n)) + b, -(a @ ee + lead))

    def path(self, shocks: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Levels for a row of shocks a period, by pruning."""
        g, h = self.first.g, self.first.h
        x1 = np.zeros(len(g)) if start is None else start
        x2, out = np.zeros(len(g)), []
        for e in shocks:
            s = np.concatenate((x1, e))
            x2 = g @ x2 + 0.5 * np.einsum("vij,i,j->v", self.q, s, s) + 0.5 * self.c
            x1 = g @ x1 + h @ e
            out.append(self.steady + x1 + x2)
        return np.array(out)

    def mean(self) -> np.ndarray:
        """Unconditional mean of the pruned process."""
        g, h = self.first.g, self.first.h
        v = self.first.covariance()
        s = np.block([[v, np.zeros((len(g), h.shape[1]))], [np.zeros((h.shape[1], len(g))), np.eye(h.shape[1])]])
        return self.steady + np.linalg.solve(np.eye(len(g)) - g, 0.5 * np.einsum("vij,ij->v", self.q, s) + 0.5 * self.c)


def second_order_table(spark: SparkSession, m: Second) -> DataFrame:
    """variable, steady_state, risk (the constant), mean (of the pruned process)."""
    return rows(spark, [{"variable": v, "steady_state": float(m.steady[i]), "risk": float(m.c[i] / 2), "mean": float(m.mean()[i])} for i, v in enumerate(m.model.variables)], "variable string, steady_state double, risk double, mean double")


def simulate_second(spark: SparkSession, m: Second, periods: int, replicates: int = 1, burn: int = 100, seed: int = 0) -> DataFrame:
    """replicate, t and a column per variable (levels); replicates are rows."""
    names = m.model.variables

    def go(batches):
        for pdf in batches:
            for r in pdf["id"]:
                e = np.random.default_rng([seed, int(r)]).standard_normal((burn + periods, len(m.model.shocks)))
                yield pd.DataFrame(m.path(e)[burn:], columns=names).assign(replicate=r, t=np.arange(periods, dtype=np.int32))[["replicate", "t", *names]]

    return spark.range(replicates).mapInPandas(go, "replicate long, t int, " + ", ".join(f"`{n}` double" for n in names))


def generalised_impulse(spark: SparkSession, step: Callable[[np.ndarray], np.ndarray], variables: list[str], shocks: list[str], shock: str, horizon: int = 20, size: float = 1.0, draws: int = 200, seed: int = 0) -> DataFrame:
    """horizon, variable, shock, value: mean difference of paths with and without the shock; step takes a row of shocks a period and gives levels; draws are rows."""
    j = shocks.index(shock)

    def go(batches):
        for pdf in batches:
            for r in pdf["id"]:
                e = np.random.default_rng([seed, int(r)]).standard_normal((horizon, len(shocks)))
                hit = e.copy()
                hit[0, j] += size
                d = step(hit) - step(e)
                yield pd.DataFrame({"horizon": np.repeat(np.arange(horizon, dtype=np.int32), len(variables)), "variable": np.tile(variables, horizon), "value": d.ravel()})

    got = spark.range(draws).mapInPandas(go, "horizon int, variable string, value double")
    return got.groupBy("horizon", "variable").agg(F.avg("value").alias("value")).select("horizon", "variable", F.lit(shock).alias("shock"), "value")


# -- global solutions ----------------------------------------------------------------


class Policy:
    """Chebyshev polynomials of the lagged variables that matter and the shocks, on a box of ``scale`` deviations about the steady state.

    ``method``: pfi (time iteration on the equations, the old policy standing for the future; with damping it moves less each round), collocation (Newton on all coefficients).
    """

    def __init__(self, model: Model, guess: dict[str, float] | None = None, degree: int = 3, nodes: int = 5, scale: float = 3.0, method: str = "pfi", tol: float = 1e-9, most: int = 300, damping: float | None = None):
        f = Solution(model, guess)
        self.model, self.steady, n, k = model, f.steady, len(f.g), f.h.shape[1]
        _, _, c, _ = linearize(model, f.steady)
        self.states = [i for i in range(n) if np.abs(c[:, i]).max() > 1e-12]
        sd = np.sqrt(np.maximum(np.diag(f.covariance()), 1e-12))
        self.low = np.concatenate((f.steady[self.states] - scale * sd[self.states], np.full(k, -scale)))
        self.high = np.concatenate((f.steady[self.states] + scale * sd[self.states], np.full(k, scale)))
        d = len(self.low)
        x = np.cos(math.pi * (np.arange(degree + 1) + 0.5) / (degree + 1))
        unit = np.array(list(product(x, repeat=d)))
        self.powers = [p for p in product(range(degree + 1), repeat=d) if sum(p) <= degree]
        self.grid = self.low + (unit + 1) / 2 * (self.high - self.low)
        self.fit = np.linalg.pinv(self.basis(self.grid))
        z, w = np.polynomial.hermite.hermgauss(nodes)
        quad = np.array(list(product(z * math.sqrt(2), repeat=k)))
        weight = np.array([np.prod(q) for q in product(w / math.sqrt(math.pi), repeat=k)])
        self.quad, self.weight = quad, weight
        dev = self.grid[:, : len(self.states)] - f.steady[self.states]
        y = f.steady + dev @ f.g[:, self.states].T + self.grid[:, len(self.states) :] @ f.h.T
        self.coef = self.fit @ y
        if method not in ("pfi", "collocation"):
            raise ValueError(f"method {method} is not known")
        damp = 1.0 if damping is None else damping
        self.rounds = 0
        if method == "collocation":
            self._newton(tol)
            return
        for self.rounds in range(1, most + 1):
            new = self._solve_nodes(y)
            moved = np.abs(new - y).max()
            y = (1 - damp) * y + damp * new
            self.coef = self.fit @ y
            if moved < tol:
                break

    def basis(self, s: np.ndarray) -> np.ndarray:
        u = np.clip(2 * (s - self.low) / (self.high - self.low) - 1, -1.2, 1.2)
        top = max(max(p) for p in self.powers)
        t = [np.ones_like(u), u]
        for _ in range(2, top + 1):
            t.append(2 * u * t[-1] - t[-2])
        out = np.ones((len(s), len(self.powers)))
        for j, p in enumerate(self.powers):
            for i, q in enumerate(p):
                if q:
                    out[:, j] *= t[q][:, i]
        return out

    def at(self, lagged: np.ndarray, shocks: np.ndarray) -> np.ndarray:
        """Levels of all variables; lagged has all variables' last levels."""
        return self.basis(np.hstack([np.atleast_2d(lagged)[:, self.states], np.atleast_2d(shocks)])) @ self.coef

    def expected(self, y: np.ndarray, lag: np.ndarray, shock: np.ndarray) -> np.ndarray:
        """Mean residuals of the equations over next period's shocks, a row a point."""
        out = 0.0
        for q, w in zip(self.quad, self.weight, strict=True):
            lead = self.at(y, np.repeat(q[None], len(y), 0))
            out = out + w * np.stack([np.broadcast_to(v, len(y)) for v in self.model.residuals(lead.T, y.T, lag.T, shock.T)], 1)
        return out

    def _lagged(self, s: np.ndarray) -> np.ndarray:
        lag = np.repeat(self.steady[None], len(s), 0)
        lag[:, self.states] = s[:, : len(self.states)]
        return lag

    def _solve_nodes(self, y: np.ndarray, steps: int = 20) -> np.ndarray:
        lag, shock = self._lagged(self.grid), self.grid[:, len(self.states) :]
        y = y.copy()
        n = y.shape[1]
        with np.errstate(all="ignore"):
            for _ in range(steps):
                r = self.expected(y, lag, shock)
                jac = np.empty((len(y), n, n))
                for j in range(n):
                    d = np.zeros(n)
                    d[j] = 1e-6 * max(1.0, abs(self.steady[j]))
                    jac[:, :, j] = (self.expected(y + d, lag, shock) - r) / d[j]
                move = np.linalg.solve(jac, r[:, :, None])[:, :, 0]
                y = y - np.nan_to_num(move)
                if np.abs(move).max() < 1e-11:
                    break
        return y

    def _newton(self, tol: float, steps: int = 30) -> None:
        lag, shock = self._lagged(self.grid), self.grid[:, len(self.states) :]
        shape = self.coef.shape
        # Square system: residuals are projected on the basis.
        f = lambda c: (setattr(self, "coef", c.reshape(shape)), (self.fit @ self.expected(self.basis(self.grid) @ self.coef, lag, shock)).ravel())[1]
        c = self.coef.ravel().copy()
        for self.rounds in range(1, steps + 1):
            r = f(c)
            jac = np.empty((len(c), len(c)))
            for j in range(len(c)):
                d = np.zeros(len(c))
                d[j] = 1e-6 * max(1.0, abs(c[j]))
                jac[:, j] = (f(c + d) - r) / d[j]
            move = np.linalg.lstsq(jac, r, rcond=None)[0]
            c = c - move
            if np.abs(move).max() < tol:
                break
        self.coef = c.reshape(shape)

    def error(self, points: int = 500, seed: int = 0) -> float:
        """Largest mean residual at random points of the box."""
        rng = np.random.default_rng(seed)
        s = self.low + rng.random((points, len(self.low))) * (self.high - self.low) * 0.8 + 0.1 * (self.high - self.low)
        lag, shock = self._lagged(s), s[:, len(self.states) :]
        return float(np.abs(self.expected(self.basis(s) @ self.coef, lag, shock)).max())

    def path(self, shocks: np.ndarray) -> np.ndarray:
        y, out = self.steady, []
        for e in shocks:
            y = self.at(y[None], e[None])[0]
            out.append(y)
        return np.array(out)


def policy_table(spark: SparkSession, p: Policy, points: int = 9) -> DataFrame:
    """state, at, variable, value along each state through the steady state; then a row state = euler_error with the largest mean residual."""
    out = []
    for j, i in enumerate(p.states):
        for v in np.linspace(p.low[j], p.high[j], points):
            lag = p.steady.copy()
            lag[i] = v
            y = p.at(lag[None], np.zeros((1, len(p.model.shocks))))[0]
            out += [{"state": p.model.variables[i], "at": float(v), "variable": w, "value": float(y[k])} for k, w in enumerate(p.model.variables)]
    out.append({"state": "euler_error", "at": float(p.rounds), "variable": "", "value": p.error()})
    return rows(spark, out, "state string, at double, variable string, value double")


def simulate_policy(spark: SparkSession, p: Policy, periods: int, replicates: int = 1, burn: int = 50, seed: int = 0) -> DataFrame:
    names = p.model.variables

    def go(batches):
        for pdf in batches:
            for r in pdf["id"]:
                e = np.random.default_rng([seed, int(r)]).standard_normal((burn + periods, len(p.model.shocks)))
                yield pd.DataFrame(p.path(e)[burn:], columns=names).assign(replicate=r, t=np.arange(periods, dtype=np.int32))[["replicate", "t", *names]]

    return spark.range(replicates).mapInPandas(go, "replicate long, t int, " + ", ".join(f"`{n}` double" for n in names))


# -- particles --------------------------------------------------------------------------


def particle_likelihood(step: Callable[[np.ndarray, np.ndarray], np.ndarray], state0: np.ndarray, shocks: int, measure: Callable[[np.ndarray], np.ndarray], y: np.ndarray, noise: float, particles: int = 500, seed: int = 0, smooth: bool = False):
    """Bootstrap filter: step(states, shocks) -> states, measure(states) -> observations; log-likelihood, and filtered (or backward-sampled) mean states."""
    rng = np.random.default_rng(seed)
    x = np.repeat(state0[None], particles, 0)
    ll, kept = 0.0, []
    for row in y:
        x = step(x, rng.standard_normal((particles, shocks)))
        ok = np.isfinite(row)
        w = np.zeros(particles)
        if ok.any():
            e = row[ok] - measure(x)[:, ok]
            w = -0.5 * (e * e / noise).sum(1) - 0.5 * ok.sum() * math.log(2 * math.pi * noise)
        m = w.max()
        p = np.exp(w - m)
        ll += m + math.log(p.mean())
        p /= p.sum()
        kept.append((x, p))
        if 1 / (p @ p) < particles / 2 or smooth:
            x = x[np.searchsorted(np.cumsum(p), (rng.random() + np.arange(particles)) / particles, side="right").clip(0, particles - 1)]
        else:
            x = x[rng.choice(particles, particles, p=p)]
    means = np.array([p @ s for s, p in kept])
    return ll, means, kept


def particle_filter(df: DataFrame, s: Solution, observed: list[str], time: str = "t", noise: float = 0.01, particles: int = 500, seed: int = 0) -> DataFrame:
    """t, variable, value (filtered mean, levels), loglik: bootstrap particles on a linear solution."""
    data = _sample(df, [time, *observed], time)
    at = [s.model.variables.index(v) for v in observed]
    ll, means, _ = particle_likelihood(lambda x, e: x @ s.g.T + e @ s.h.T, np.zeros(len(s.g)), s.h.shape[1], lambda x: x[:, at] + s.steady[at], data[:, 1:], noise, particles, seed)
    return rows(df.sparkSession, [{"t": int(r[0]), "variable": v, "value": float(m[i] + s.steady[i]), "loglik": ll} for r, m in zip(data, means, strict=True) for i, v in enumerate(s.model.variables)], "t long, variable string, value double, loglik double")


def particle_smoother(df: DataFrame, m: Second, observed: list[str], time: str = "t", noise: float = 0.01, particles: int = 300, back: int = 50, seed: int = 0) -> DataFrame:
    """t, variable, value: backward simulation through the particles of a pruned second-order solution."""
    data = _sample(df, [time, *observed], time)
    at = [m.model.variables.index(v) for v in observed]
    g, h, n = m.first.g, m.first.h, len(m.first.g)

    def step(x, e):
        s = np.hstack([x[:, :n], e])
        x2 = x[:, n:] @ g.T + 0.5 * np.einsum("vij,pi,pj->pv", m.q, s, s) + 0.5 * m.c
        return np.hstack([x[:, :n] @ g.T + e @ h.T, x2])

    _, _, kept = particle_likelihood(step, np.zeros(2 * n), h.shape[1], lambda x: x[:, at] + x[:, n:][:, at] + m.steady[at], data[:, 1:], noise, particles, seed)
    rng = np.random.default_rng(seed + 1)
    q = h @ h.T + 1e-6 * np.eye(n)
    inv = np.linalg.inv(q)
    paths = []
    for _ in range(back):
        x, p = kept[-1]
        k = rng.choice(len(x), p=p)
        path = [x[k]]
        for x, p in reversed(kept[:-1]):
            e = path[-1][:n] - x[:, :n] @ g.T
            w = np.log(p + 1e-300) - 0.5 * np.einsum("pi,ij,pj->p", e, inv, e)
            w = np.exp(w - w.max())
            path.append(x[rng.choice(len(x), p=w / w.sum())])
        paths.append(path[::-1])
    mean = np.array(paths).mean(0)
    level = mean[:, :n] + mean[:, n:] + m.steady
    return rows(df.sparkSession, [{"t": int(r[0]), "variable": v, "value": float(level[i, j])} for i, r in enumerate(data) for j, v in enumerate(m.model.variables)], "t long, variable string, value double")


# -- sequential Monte Carlo ------------------------------------------------------------


def prior_parameters(kind: str, mean: float, sd: float) -> dict[str, float]:
    """Of normal, beta, gamma, uniform or inv_gamma from a mean and a standard deviation."""
    if kind == "normal":
        return {"mean": mean, "sd": sd}
    if kind == "uniform":
        half = sd * math.sqrt(3)
        return {"lower": mean - half, "upper": mean + half}
    if kind == "gamma":
        return {"shape": (mean / sd) ** 2, "scale": sd**2 / mean}
    if kind == "beta":
        n = mean * (1 - mean) / sd**2 - 1
        return {"a": mean * n, "b": (1 - mean) * n}
    if kind == "inv_gamma":
        a = 2 + (mean / sd) ** 2
        return {"shape": a, "scale": mean * (a - 1)}
    raise ValueError(f"prior {kind} is not known")


def prior_draws(priors: dict[str, tuple[str, float, float]], n: int, seed: int = 0) -> np.ndarray:
    rng, out = np.random.default_rng(seed), []
    for kind, mean, sd in priors.values():
        p = prior_parameters(kind, mean, sd)
        out.append({"normal": lambda p=p: rng.normal(p["mean"], p["sd"], n), "uniform": lambda p=p: rng.uniform(p["lower"], p["upper"], n), "gamma": lambda p=p: rng.gamma(p["shape"], p["scale"], n), "beta": lambda p=p: rng.beta(p["a"], p["b"], n), "inv_gamma": lambda p=p: p["scale"] / rng.gamma(p["shape"], 1.0, n)}[kind]())
    return np.array(out).T


def sequential(df: DataFrame, model: Model, priors: dict[str, tuple[str, float, float]], observed: list[str], time: str = "t", particles: int = 128, ess: float = 0.5, moves: int = 1, noise: float = 0.0, seed: int = 0, guess: dict[str, float] | None = None, most: int = 40) -> tuple[DataFrame, float]:
    """Adaptive tempering from the prior to the posterior: draws (draw, weight, log_posterior, a column a parameter) and the log marginal likelihood. Particles are rows whose likelihoods are computed side by side; only they come to the driver."""
    spark, names = df.sparkSession, list(priors)
    rng = np.random.default_rng(seed)

    def evaluate(x):
        t = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"`{n}` double" for n in names)).repartition(min(particles, 2 * spark.sparkContext.defaultParallelism))
        got = _particle_likelihoods(df, model, t, names, observed, time, noise, guess)
        return np.array([got[i] for i in range(len(x))])

    lp = lambda x: np.array([sum(log_prior(*priors[n], float(v)) for n, v in zip(names, r, strict=True)) for r in x])
    x = prior_draws(priors, particles, seed)
    ll, pr = evaluate(x), lp(x)
    phi, log_ml, scale = 0.0, 0.0, 0.5
    for _ in range(most):
        finite = np.where(np.isfinite(ll), ll, -1e10)

        def size(step):
            w = step * (finite - finite.max())
            w = np.exp(w - w.max())
            return w.sum() ** 2 / (w @ w)

        lo, hi = 0.0, 1 - phi
        if size(hi) < ess * particles:
            for _ in range(50):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if size(mid) > ess * particles else (lo, mid)
            step = max(lo, 1e-6)
        else:
            step = hi
        w = step * finite
        top = w.max()
        log_ml += top + math.log(np.exp(w - top).mean())
        p = np.exp(w - top)
        p /= p.sum()
        phi = min(1.0, phi + step)
        k = np.searchsorted(np.cumsum(p), (rng.random() + np.arange(particles)) / particles, side="right").clip(0, particles - 1)
        x, ll, pr = x[k], ll[k], pr[k]
        chol = np.linalg.cholesky(np.cov(x.T).reshape(len(names), -1) + 1e-12 * np.eye(len(names)))
        for _ in range(moves):
            new = x + scale * rng.standard_normal(x.shape) @ chol.T
            there = lp(new)
            ok = np.isfinite(there)
            nl = np.full(particles, -math.inf)
            if ok.any():
                nl[ok] = evaluate(new[ok])
            won = np.log(rng.random(particles)) < np.where(np.isfinite(nl), phi * (nl - ll) + there - pr, -math.inf)
            x, ll, pr = np.where(won[:, None], new, x), np.where(won, nl, ll), np.where(won, there, pr)
            scale *= math.exp(won.mean() - 0.3)
        if phi >= 1:
            break
    else:
        raise RuntimeError(f"{most} rounds have not reached the posterior (tempered to {phi:.3g} of it): allow more rounds or particles")
    out = spark.createDataFrame([(int(i), 1.0 / particles, float(a + b), *map(float, r)) for i, (a, b, r) in enumerate(zip(ll, pr, x, strict=True))], "draw long, weight double, log_posterior double, " + ", ".join(f"`{n}` double" for n in names))
    return out, float(log_ml)


def _particle_likelihoods(df, model, table, names, observed, time, noise, guess) -> dict[int, float]:
    y = _sample(df, observed, time)

    def go(batches):
        for pdf in batches:
            ll = [_value(model.at(**dict(zip(names, map(float, r), strict=True))), y, observed, noise, guess) for r in pdf[names].itertuples(index=False)]
            yield pd.DataFrame({"id": pdf.id, "ll": ll})

    return {r.id: r.ll for r in table.mapInPandas(go, "id long, ll double").collect()}


def posterior_mode(df: DataFrame, model: Model, priors: dict[str, tuple[str, float, float]], observed: list[str], time: str = "t", noise: float = 0.0, guess: dict[str, float] | None = None, steps: int = 300) -> DataFrame:
    """parameter, mode, std_error (Laplace), log_posterior, laplace_log_ml."""
    y, names = _sample(df, observed, time), list(priors)

    def f(x):
        p = sum(log_prior(*priors[n], float(v)) for n, v in zip(names, x, strict=True))
        return -(p + _value(model.at(**dict(zip(names, map(float, x), strict=True))), y, observed, noise, guess)) if math.isfinite(p) else 1e300

    safe = lambda x: min(1e300, f(x)) if f(x) == f(x) else 1e300
    x = nelder_mead(safe, np.array([priors[n][1] for n in names]), 0.05, steps)
    k, h = len(x), 1e-3 * np.maximum(np.abs(x), 1e-2)
    hess = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            a, b = np.eye(k)[i] * h[i], np.eye(k)[j] * h[j]
            hess[i, j] = hess[j, i] = (safe(x + a + b) - safe(x + a - b) - safe(x - a + b) + safe(x - a - b)) / (4 * h[i] * h[j])
    cov = np.linalg.pinv(hess)
    sign, det = np.linalg.slogdet(cov)
    ml = -safe(x) + k / 2 * math.log(2 * math.pi) + 0.5 * det if sign > 0 else None
    return rows(df.sparkSession, [{"parameter": n, "mode": float(x[i]), "std_error": float(math.sqrt(max(cov[i, i], 0))), "log_posterior": float(-safe(x)), "laplace_log_ml": None if ml is None else float(ml)} for i, n in enumerate(names)], "parameter string, mode double, std_error double, log_posterior double, laplace_log_ml double")


def bridge(df: DataFrame, draws: DataFrame, model: Model, priors: dict[str, tuple[str, float, float]], observed: list[str], time: str = "t", noise: float = 0.0, proposals: int = 200, seed: int = 0, guess: dict[str, float] | None = None, most: int = 5000) -> float:
    """Log marginal likelihood by a bridge between posterior draws (columns log_posterior and the parameters; a bounded sample of them) and a normal proposal."""
    names = list(priors)
    got = draws.select("log_posterior", *names).orderBy(F.xxhash64(*names)).limit(most).toPandas()
    x, lpost = got[names].to_numpy(float), got.log_posterior.to_numpy(float)
    mean, cov = x.mean(0), np.cov(x.T).reshape(len(names), -1) + 1e-12 * np.eye(len(names))
    chol = np.linalg.cholesky(cov)
    rng = np.random.default_rng(seed)
    z = mean + rng.standard_normal((proposals, len(names))) @ chol.T
    ld = np.log(np.diag(chol)).sum()
    q = lambda v: -0.5 * (np.linalg.solve(chol, (v - mean).T) ** 2).sum(0) - ld - len(names) / 2 * math.log(2 * math.pi)
    pr = np.array([sum(log_prior(*priors[n], float(v)) for n, v in zip(names, r, strict=True)) for r in z])
    spark = df.sparkSession
    table = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(z)], "id long, " + ", ".join(f"`{n}` double" for n in names)).repartition(2 * spark.sparkContext.defaultParallelism)
    ll = _particle_likelihoods(df, model, table, names, observed, time, noise, guess)
    lz = pr + np.array([ll[i] for i in range(proposals)])
    lz = np.where(np.isfinite(lz), lz, -1e300)
    a, b = lpost - q(x), lz - q(z)
    n1, n2 = len(x), proposals
    r = float(np.median(a))
    for _ in range(1000):
        num = np.exp(b - r) / (n1 / (n1 + n2) * np.exp(b - r) + n2 / (n1 + n2))
        den = 1 / (n1 / (n1 + n2) * np.exp(a - r) + n2 / (n1 + n2))
        new = r + math.log(num.mean() / den.mean())
        if abs(new - r) < 1e-10:
            break
        r = new
    return r


# -- diagnostics --------------------------------------------------------------------------


def chain_diagnostics(draws: DataFrame, names: list[str]) -> DataFrame:
    """parameter, ess, r_hat (rank-normalised), geweke: one kernel a parameter over its chains."""
    from ..functions import dist

    long = draws.select("chain", "draw", F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(f"`{n}`").alias("v")) for n in names])).alias("e")).select("chain", "draw", "e.*")

    def f(pdf):
        m = pdf.sort_values(["chain", "draw"]).pivot(index="draw", columns="chain", values="v").to_numpy(float)
        n, c = m.shape
        r = np.argsort(np.argsort(m.ravel())).reshape(m.shape)
        z = np.array([dist.norm_ppf(v) for v in ((r + 1 - 0.375) / (m.size + 0.25)).ravel()]).reshape(m.shape)
        half = np.concatenate((z[: n // 2], z[n // 2 : 2 * (n // 2)]), axis=1)
        w, b = half.var(0, ddof=1).mean(), half.mean(0).var(ddof=1)
        rhat = math.sqrt(((n // 2 - 1) / (n // 2) * w + b) / w) if w > 0 else 1.0
        rho = np.mean([autocorrelation(col, min(n - 2, 200)) for col in m.T], axis=0) if m.std() > 0 else np.zeros(3)
        total, k = 0.0, 1
        while k + 1 < len(rho) and rho[k] + rho[k + 1] > 0:
            total += rho[k] + rho[k + 1]
            k += 2
        x = m[:, 0]
        a, e = x[: n // 10], x[n // 2 :]
        g = (a.mean() - e.mean()) / math.sqrt(a.var() / len(a) + e.var() / len(e)) if a.var() + e.var() > 0 else 0.0
        return pd.DataFrame({"parameter": [pdf.parameter.iloc[0]], "ess": [m.size / (1 + 2 * total)], "r_hat": [rhat], "geweke": [g]})

    return long.groupBy("parameter").applyInPandas(f, "parameter string, ess double, r_hat double, geweke double")


def chain_acf(draws: DataFrame, name: str, lags: int = 20) -> DataFrame:
    """lag, acf of a parameter's first chain."""
    from .series import correlogram

    return correlogram(draws.where("chain = 0"), name, "draw", lags).select("lag", "acf")


def trace(draws: DataFrame, name: str) -> DataFrame:
    return draws.select("chain", "draw", F.col(f"`{name}`").alias("value"))


def prior_posterior(draws: DataFrame, priors: dict[str, tuple[str, float, float]]) -> DataFrame:
    """parameter, prior, prior_mean, prior_sd, mean, sd, overlap (of normal approximations' densities, 0 to 1)."""
    spark = draws.sparkSession
    r = draws.agg(*[F.avg(f"`{n}`").alias(f"m_{n}") for n in priors], *[F.stddev(f"`{n}`").alias(f"s_{n}") for n in priors]).first()
    out = []
    for n, (kind, mean, sd) in priors.items():
        m, s = r[f"m_{n}"], r[f"s_{n}"] or 1e-12
        x = np.linspace(min(mean - 5 * sd, m - 5 * s), max(mean + 5 * sd, m + 5 * s), 2001)
        p = np.array([math.exp(v) if math.isfinite(v) else 0.0 for v in (log_prior(kind, mean, sd, float(q)) for q in x)])
        q = np.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi))
        out.append({"parameter": n, "prior": kind, "prior_mean": mean, "prior_sd": sd, "mean": m, "sd": s, "overlap": float(np.trapezoid(np.minimum(p, q), x))})
    return rows(spark, out, "parameter string, prior string, prior_mean double, prior_sd double, mean double, sd double, overlap double")


def identification(spark: SparkSession, model: Model, names: list[str], observed: list[str], lags: int = 2, guess: dict[str, float] | None = None) -> DataFrame:
    """parameter, strength (norm of its moment derivatives), collinear (share explained by the others), rank, parameters: derivatives of means and autocovariances."""

    def moments(x):
        s = Solution(model.at(**dict(zip(names, map(float, x), strict=True))), guess)
        at = [s.model.variables.index(v) for v in observed]
        v, out = s.covariance(), [s.steady[at]]
        for _ in range(lags + 1):
            out.append(v[np.ix_(at, at)].ravel())
            v = s.g @ v
        return np.concatenate(out)

    x = np.array([model.parameters[n] for n in names])
    j = np.empty((len(moments(x)), len(x)))
    for k in range(len(x)):
        d = np.zeros(len(x))
        d[k] = 1e-5 * max(1e-2, abs(x[k]))
        j[:, k] = (moments(x + d) - moments(x - d)) / (2 * d[k]) * max(abs(x[k]), 1e-2)
    sv = np.linalg.svd(j, compute_uv=False)
    rank = int((sv > 1e-7 * sv[0]).sum())
    out = []
    for k, n in enumerate(names):
        rest = np.delete(j, k, axis=1)
        fit = rest @ np.linalg.lstsq(rest, j[:, k], rcond=None)[0] if rest.shape[1] else np.zeros(len(j))
        nrm = float(np.linalg.norm(j[:, k]))
        out.append({"parameter": n, "strength": nrm, "collinear": float(fit @ fit / nrm**2) if nrm else None, "rank": rank, "parameters": len(names)})
    return rows(spark, out, "parameter string, strength double, collinear double, rank int, parameters int")


def predictive(spark: SparkSession, draws: DataFrame, model: Model, names: list[str], variables: list[str], periods: int = 100, seed: int = 0, guess: dict[str, float] | None = None) -> DataFrame:
    """draw, variable, mean, sd, autocorrelation of a path simulated at each row of parameters; rows without a unique stable solution give none."""

    def go(batches):
        for pdf in batches:
            out = []
            for i, r in enumerate(pdf[names].itertuples(index=False)):
                try:
                    s = Solution(model.at(**dict(zip(names, map(float, r), strict=True))), guess)
                    if not s.determined:
                        continue
                except (ValueError, np.linalg.LinAlgError, ZeroDivisionError, OverflowError):
                    continue
                k = int(pdf.draw.iloc[i])
                e = np.random.default_rng([seed, k]).standard_normal((periods + 50, s.h.shape[1]))
                y, x = np.zeros(len(s.g)), []
                for row in e:
                    y = s.g @ y + s.h @ row
                    x.append(y)
                x = np.array(x[50:]) + s.steady
                for v in variables:
                    c = x[:, model.variables.index(v)]
                    z = c - c.mean()
                    out.append((k, v, float(c.mean()), float(c.std()), float(z[1:] @ z[:-1] / (z @ z)) if z @ z > 0 else None))
            yield pd.DataFrame(out, columns=["draw", "variable", "mean", "sd", "autocorrelation"])

    return draws.select("draw", *[f"`{n}`" for n in names]).mapInPandas(go, "draw long, variable string, mean double, sd double, autocorrelation double")


def prior_predictive(spark: SparkSession, model: Model, priors: dict[str, tuple[str, float, float]], variables: list[str], draws: int = 100, periods: int = 100, seed: int = 0, guess: dict[str, float] | None = None) -> DataFrame:
    names = list(priors)
    table = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(prior_draws(priors, draws, seed))], "draw long, " + ", ".join(f"`{n}` double" for n in names)).repartition(spark.sparkContext.defaultParallelism)
    return predictive(spark, table, model, names, variables, periods, seed, guess)


def predictive_check(df: DataFrame, simulated: DataFrame, observed: list[str], time: str = "t") -> DataFrame:
    """variable, statistic, data, p_value: share of replicated statistics above the data's."""
    y = _sample(df, observed, time)
    out = None
    for i, v in enumerate(observed):
        c = y[:, i]
        z = c - c.mean()
        own = {"mean": c.mean(), "sd": c.std(), "autocorrelation": float(z[1:] @ z[:-1] / (z @ z))}
        one = simulated.where(F.col("variable") == v).agg(*[F.avg((F.col(k) > float(x)).cast("double")).alias(k) for k, x in own.items()])
        one = one.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(k).alias("statistic"), F.lit(float(x)).alias("data"), F.col(k).alias("p_value")) for k, x in own.items()])))
        out = one if out is None else out.union(one)
    return out


def posterior_impulse(draws: DataFrame, model: Model, names: list[str], horizon: int = 12, shares: bool = False, guess: dict[str, float] | None = None) -> DataFrame:
    """horizon, variable, shock, mean, lower, upper over draws of responses or of forecast variance shares."""

    def go(batches):
        for pdf in batches:
            out = []
            for r in pdf[names].itertuples(index=False):
                try:
                    s = Solution(model.at(**dict(zip(names, map(float, r), strict=True))), guess)
                except (ValueError, np.linalg.LinAlgError, ZeroDivisionError, OverflowError):
                    continue
                y = s.impulse(horizon)
                if shares:
                    q = np.cumsum(y**2, axis=0)
                    y = q / np.maximum(q.sum(2, keepdims=True), 1e-300)
                h, i, j = y.shape
                out.append(pd.DataFrame({"horizon": np.repeat(np.arange(h), i * j), "variable": np.tile(np.repeat(model.variables, j), h), "shock": np.tile(model.shocks, h * i), "value": y.ravel()}))
            if out:
                yield pd.concat(out)

    got = draws.select(*[f"`{n}`" for n in names]).mapInPandas(go, CUBE)
    return got.groupBy("horizon", "variable", "shock").agg(F.avg("value").alias("mean"), F.percentile("value", 0.05).alias("lower"), F.percentile("value", 0.95).alias("upper"))


def posterior_contributions(df: DataFrame, draws: DataFrame, model: Model, names: list[str], observed: list[str], time: str = "t", noise: float = 0.0, guess: dict[str, float] | None = None) -> DataFrame:
    """t, variable, shock, mean, lower, upper of shock contributions over draws."""
    data = _sample(df, [time, *observed], time)

    def go(batches):
        for pdf in batches:
            out = []
            for r in pdf[names].itertuples(index=False):
                try:
                    s = Solution(model.at(**dict(zip(names, map(float, r), strict=True))), guess)
                except (ValueError, np.linalg.LinAlgError, ZeroDivisionError, OverflowError):
                    continue
                _, e = smoothed(s, data[:, 1:], observed, noise)
                parts = np.zeros((len(s.g), len(model.shocks)))
                for t in range(len(data)):
                    parts = s.g @ parts + s.h * e[t]
                    out += [(int(data[t, 0]), v, k, float(parts[i, j])) for i, v in enumerate(model.variables) for j, k in enumerate(model.shocks)]
            yield pd.DataFrame(out, columns=["t", "variable", "shock", "value"])

    got = draws.select(*[f"`{n}`" for n in names]).mapInPandas(go, "t long, variable string, shock string, value double")
    return got.groupBy("t", "variable", "shock").agg(F.avg("value").alias("mean"), F.percentile("value", 0.05).alias("lower"), F.percentile("value", 0.95).alias("upper"))


def learning_rate(df: DataFrame, model: Model, priors: dict[str, tuple[str, float, float]], observed: list[str], time: str = "t", noise: float = 0.0, guess: dict[str, float] | None = None) -> DataFrame:
    """parameter, half, full (Laplace variances on half and all of the sample), rate (log2 of their ratio: about 1 when data inform)."""
    n = df.count()
    ends = df.orderBy(time).limit(n // 2)
    a = {r.parameter: r.std_error for r in posterior_mode(ends, model, priors, observed, time, noise, guess, 150).collect()}
    b = {r.parameter: r.std_error for r in posterior_mode(df, model, priors, observed, time, noise, guess, 150).collect()}
    return rows(df.sparkSession, [{"parameter": k, "half": a[k] ** 2, "full": b[k] ** 2, "rate": math.log2(max(a[k], 1e-12) ** 2 / max(b[k], 1e-12) ** 2)} for k in priors], "parameter string, half double, full double, rate double")


def match_impulses(spark: SparkSession, model: Model, target: np.ndarray, shock: str, variables: list[str], names: list[str], weights: np.ndarray | None = None, guess: dict[str, float] | None = None, steps: int = 300) -> DataFrame:
    """parameter, estimate, distance: responses (horizon by variable) closest to a target."""
    w = np.ones_like(target) if weights is None else weights

    def f(x):
        try:
            s = Solution(model.at(**dict(zip(names, map(float, x), strict=True))), guess)
        except (ValueError, np.linalg.LinAlgError, ZeroDivisionError, OverflowError):
            return 1e300
        if not s.determined:
            return 1e300
        y = s.impulse(len(target))[:, [s.model.variables.index(v) for v in variables], s.model.shocks.index(shock)]
        return float((w * (y - target) ** 2).sum())

    x = nelder_mead(f, np.array([model.parameters[n] for n in names]), 0.05, steps)
    return rows(spark, [{"parameter": n, "estimate": float(v), "distance": f(x)} for n, v in zip(names, x, strict=True)], "parameter string, estimate double, distance double")


# -- heterogeneous agents ----------------------------------------------------------


class Heterogeneous:
    """Dynamics of an incomplete-markets economy about its steady state by sequence-space Jacobians (Auclert and others, 2021): policies are perturbed once at the far end, expectations carry them to all horizons."""

    def __init__(self, eq: dict, alpha: float = 0.36, beta: float = 0.96, delta: float = 0.08, sigma: float = 2.0, horizon: int = 60):
        self.eq, self.alpha, self.delta, self.t = eq, alpha, delta, horizon
        self.grid, self.income, self.move = eq["grid"], eq["income"], eq["transitions"]
        self.beta, self.sigma, self.mass = beta, sigma, eq["mass"]
        self.jac = {k: self._jacobian(k) for k in ("r", "w")}

    def _step(self, future_c: np.ndarray, r_next: float, r: float, w: float) -> tuple[np.ndarray, np.ndarray]:
        """Savings and consumption given next period's consumption and interest."""
        want_c = (self.beta * (1 + r_next) * (future_c**-self.sigma) @ self.move.T) ** (-1 / self.sigma)
        cash = (1 + r) * self.grid[:, None] + w * self.income
        saved = np.stack([np.interp(cash[:, j], want_c[:, j] + self.grid, self.grid) for j in range(len(self.income))], 1)
        return saved, cash - saved

    def _push(self, mass: np.ndarray, saved: np.ndarray) -> np.ndarray:
        g = self.grid
        lo = np.clip(np.searchsorted(g, saved, side="right") - 1, 0, len(g) - 2)
        up = np.clip((saved - g[lo]) / (g[lo + 1] - g[lo]), 0, 1)
        return np.stack([np.bincount(lo[:, j], mass[:, j] * (1 - up[:, j]), len(g)) + np.bincount(lo[:, j] + 1, mass[:, j] * up[:, j], len(g)) for j in range(mass.shape[1])], 1) @ self.move

    def _pull(self, value: np.ndarray) -> np.ndarray:
        """Expected value next period at today's states under steady policies."""
        g, saved = self.grid, self.eq["saved"]
        v = value @ self.move.T
        return np.stack([np.interp(saved[:, j], g, v[:, j]) for j in range(v.shape[1])], 1)

    def _jacobian(self, price: str, h: float = 1e-4) -> np.ndarray:
        r, w, saved0, t = self.eq["r"], self.eq["w"], self.eq["saved"], self.t
        c0 = (1 + r) * self.grid[:, None] + w * self.income - saved0
        base_saved, base_c = self._step(c0, r, r, w)
        da, dd = [], []
        c = base_c
        push0 = self._push(self.mass, base_saved)
        for s in range(t):
            # At s = 0 the price itself moves; one period earlier only its expectation does.
            dr, dw = (h if price == "r" else 0.0, h if price == "w" else 0.0) if s == 0 else (0.0, 0.0)
            rn = r + (h if price == "r" and s == 1 else 0.0)
            saved, c = self._step(c if s else base_c, rn, r + dr, w + dw)
            da.append(float((self.mass * (saved - base_saved)).sum()) / h)
            dd.append((self._push(self.mass, saved) - push0) / h)
        # Assets carried into next period, as a function of today's state.
        e = [base_saved]
        for _ in range(t - 1):
            e.append(self._pull(e[-1]))
        fake = np.empty((t, t))
        fake[0] = da
        for k in range(1, t):
            for s in range(t):
                fake[k, s] = float((e[k - 1] * dd[s]).sum())
        j = fake.copy()
        for k in range(1, t):
            j[k, 1:] += j[k - 1, :-1]
        return j

    def impulse(self, z: np.ndarray) -> dict[str, np.ndarray]:
        """Paths of capital (end of period), r, w and output after a path of log productivity, to first order."""
        k, a, t = self.eq["capital"], self.alpha, self.t
        lag = np.eye(t, k=-1)
        r_k, r_z = a * (a - 1) * k ** (a - 2), a * k ** (a - 1)
        w_k, w_z = (1 - a) * a * k ** (a - 1), (1 - a) * k**a
        # Households' assets equal capital: J_r (r_k L K + r_z z) + J_w (w_k L K + w_z z) = K.
        left = np.eye(t) - (self.jac["r"] * r_k + self.jac["w"] * w_k) @ lag
        dk = np.linalg.solve(left, (self.jac["r"] * r_z + self.jac["w"] * w_z) @ z)
        before = lag @ dk
        return {"capital": dk, "r": r_k * before + r_z * z, "w": w_k * before + w_z * z, "output": k**a * z + a * k ** (a - 1) * before, "z": z}

    def distributions(self, z: np.ndarray) -> list[np.ndarray]:
        """Masses along the path: policies backwards with the perturbed prices, then forwards."""
        p = self.impulse(z)
        r, w = self.eq["r"] + p["r"], self.eq["w"] + p["w"]
        c = (1 + self.eq["r"]) * self.grid[:, None] + self.eq["w"] * self.income - self.eq["saved"]
        policies = []
        for s in reversed(range(self.t)):
            saved, c = self._step(c, r[s + 1] if s + 1 < self.t else self.eq["r"], r[s], w[s])
            policies.append(saved)
        mass, out = self.mass, []
        for saved in reversed(policies):
            out.append(mass)
            mass = self._push(mass, saved)
        return out


def heterogeneous_impulse(spark: SparkSession, m: Heterogeneous, rho: float = 0.9, size: float = 0.01, horizon: int = 20) -> DataFrame:
    """horizon, variable, value after a productivity shock."""
    p = m.impulse(size * rho ** np.arange(m.t))
    return rows(spark, [{"horizon": h, "variable": k, "value": float(v[h])} for k, v in p.items() for h in range(horizon)], "horizon int, variable string, value double")


def inequality_impulse(spark: SparkSession, m: Heterogeneous, rho: float = 0.9, size: float = 0.01, horizon: int = 20) -> DataFrame:
    """horizon, gini, median, top10 (share of wealth), mean wealth."""
    out = []
    for h, mass in enumerate(m.distributions(size * rho ** np.arange(m.t))[:horizon]):
        q = mass.sum(1)
        cum, wealth = np.cumsum(q) / q.sum(), np.cumsum(q * m.grid) / (q @ m.grid)
        out.append({"horizon": h, "gini": gini(m.grid, q), "median": float(np.interp(0.5, cum, m.grid)), "top10": float(1 - np.interp(0.9, cum, wealth)), "mean": float(q @ m.grid / q.sum())})
    return rows(spark, out, "horizon int, gini double, median double, top10 double, mean double")


def distribution_impulse(spark: SparkSession, m: Heterogeneous, rho: float = 0.9, size: float = 0.01, horizon: int = 5) -> DataFrame:
    """horizon, assets, change of mass against the steady state."""
    base = m.mass.sum(1)
    return rows(spark, [{"horizon": h, "assets": float(a), "change": float(v)} for h, mass in enumerate(m.distributions(size * rho ** np.arange(m.t))[:horizon]) for a, v in zip(m.grid, mass.sum(1) - base, strict=True)], "horizon int, assets double, change double")


def simulate_heterogeneous(spark: SparkSession, m: Heterogeneous, periods: int = 100, rho: float = 0.9, sigma: float = 0.007, replicates: int = 1, seed: int = 0) -> DataFrame:
    """replicate, t, z, capital, output, r, w: productivity innovations convolved with the responses; replicates are rows."""
    one = m.impulse(rho ** np.arange(m.t))
    eq, names = m.eq, ["capital", "output", "r", "w"]
    base = {"capital": eq["capital"], "output": eq["capital"] ** m.alpha, "r": eq["r"], "w": eq["w"]}

    def go(batches):
        for pdf in batches:
            for q in pdf["id"]:
                e = np.random.default_rng([seed, int(q)]).normal(0, sigma, periods + m.t)
                out = {"z": np.convolve(e, rho ** np.arange(m.t))[m.t : m.t + periods]}
                for k in names:
                    out[k] = base[k] + np.convolve(e, one[k])[m.t : m.t + periods]
                yield pd.DataFrame(out).assign(replicate=q, t=np.arange(periods, dtype=np.int32))[["replicate", "t", "z", *names]]

    return spark.range(replicates).mapInPandas(go, "replicate long, t int, z double, capital double, output double, r double, w double")


# -- continuous time --------------------------------------------------------------


class Continuous:
    """Aiyagari's economy in continuous time with two income states (Achdou and others, 2022): implicit upwind scheme for the value function, its transpose for the density, bisection on the interest rate."""

    def __init__(self, rho: float = 0.05, gamma: float = 2.0, income: tuple[float, float] = (0.2, 1.8), rates: tuple[float, float] = (0.5, 0.5), alpha: float = 0.35, delta: float = 0.1, top: float = 20.0, points: int = 100):
        self.rho, self.gamma, self.z, self.rates, self.alpha, self.delta = rho, gamma, np.array(income), rates, alpha, delta
        self.a = np.linspace(0.0, top, points)
        self.da = self.a[1] - self.a[0]
        weight = np.array([rates[1], rates[0]]) / sum(rates)
        self.labour = float(weight @ self.z)

    def hjb(self, r: float, w: float, steps: int = 100, tol: float = 1e-8, big: float = 1000.0, start: np.ndarray | None = None, dt: float | None = None):
        """Value, consumption and the generator. With dt one implicit step of that length from start is taken."""
        a, z, n, g = self.a[:, None], self.z[None], len(self.a), self.gamma
        cash = w * z + r * a
        v = start if start is not None else np.maximum(cash, 1e-4) ** (1 - g) / (1 - g) / self.rho
        for _ in range(1 if dt else steps):
            dv = np.diff(v, axis=0) / self.da
            fwd = np.vstack([dv, np.maximum(cash[-1], 1e-4)[None] ** -g])
            back = np.vstack([np.maximum(cash[0], 1e-4)[None] ** -g, dv])
            cf, cb = np.maximum(fwd, 1e-10) ** (-1 / g), np.maximum(back, 1e-10) ** (-1 / g)
            sf, sb = cash - cf, cash - cb
            up, down = sf > 0, sb < 0
            up[-1] = False
            down[0] = False
            both = up & down
            down = down & ~both
            c = np.where(up, cf, np.where(down, cb, np.maximum(cash, 1e-4)))
            x, y = np.where(down, -sb, 0.0) / self.da, np.where(up, sf, 0.0) / self.da
            m = np.zeros((2 * n, 2 * n))
            for j in range(2):
                i = np.arange(n) + j * n
                m[i, i] -= x[:, j] + y[:, j] + self.rates[j]
                m[i[1:], i[:-1]] += x[1:, j]
                m[i[:-1], i[1:]] += y[:-1, j]
                m[i, (i + n) % (2 * n)] += self.rates[j]
            u = c ** (1 - g) / (1 - g)
            step = dt or big
            new = np.linalg.solve((1 / step + self.rho) * np.eye(2 * n) - m, (u + v / step).T.ravel()).reshape(2, n).T
            done = np.abs(new - v).max() < tol
            v = new
            if done:
                break
        return v, c, m

    def kfe(self, m: np.ndarray) -> np.ndarray:
        """Stationary density."""
        q = m.T.copy()
        q[0] = 1.0
        b = np.zeros(len(q))
        b[0] = 1.0
        return np.linalg.solve(q, b).reshape(2, -1).T / self.da

    def prices(self, k: float, z: float = 1.0) -> tuple[float, float]:
        x = k / self.labour
        return self.alpha * z * x ** (self.alpha - 1) - self.delta, (1 - self.alpha) * z * x**self.alpha

    def steady(self, tol: float = 1e-6) -> dict:
        lo, hi = -self.delta + 0.02, self.rho - 1e-4
        for _ in range(60):
            r = (lo + hi) / 2
            k = self.labour * (self.alpha / (r + self.delta)) ** (1 / (1 - self.alpha))
            w = self.prices(k)[1]
            v, c, m = self.hjb(r, w)
            g = self.kfe(m)
            supply = float((g.sum(1) * self.a).sum() * self.da)
            if hi - lo < tol:
                break
            lo, hi = (lo, r) if supply > k else (r, hi)
        return {"r": r, "w": w, "capital": k, "supply": supply, "v": v, "c": c, "g": g, "m": m}

    def transition(self, ss: dict, z: np.ndarray, dt: float = 0.25, rounds: int = 60, relax: float = 0.3, tol: float = 1e-5) -> dict[str, np.ndarray]:
        """Capital, r and w after an unforeseen path of productivity, by relaxation on the path of capital."""
        n = len(z)
        k = np.full(n, ss["capital"])
        for _ in range(rounds):
            p = [self.prices(x, q) for x, q in zip(k, z, strict=True)]
            v, gens = ss["v"], []
            for t in reversed(range(n)):
                v, _, m = self.hjb(*p[t], start=v, dt=dt)
                gens.append(m)
            g, new = ss["g"].T.ravel(), []
            for m in reversed(gens):
                new.append(float((g.reshape(2, -1).sum(0) * self.a).sum() * self.da))
                g = np.linalg.solve(np.eye(len(g)) - dt * m.T, g)
            new = np.array(new)
            done = np.abs(new - k).max() < tol
            k = (1 - relax) * k + relax * new
            if done:
                break
        p = np.array([self.prices(x, q) for x, q in zip(k, z, strict=True)])
        return {"capital": k, "r": p[:, 0], "w": p[:, 1]}


def continuous_table(spark: SparkSession, m: Continuous, ss: dict) -> DataFrame:
    """assets, state, consumption, value, density, with r, w and capital on each row."""
    return rows(spark, [{"assets": float(a), "state": j, "consumption": float(ss["c"][i, j]), "value": float(ss["v"][i, j]), "density": float(ss["g"][i, j]), "r": ss["r"], "w": ss["w"], "capital": ss["capital"]} for i, a in enumerate(m.a) for j in range(2)], "assets double, state int, consumption double, value double, density double, r double, w double, capital double")


def continuous_transition(spark: SparkSession, m: Continuous, ss: dict, size: float = -0.03, decay: float = 0.2, periods: int = 40, dt: float = 0.5) -> DataFrame:
    """t, capital, r, w after productivity falls by size and recovers at a rate of decay."""
    t = dt * np.arange(periods)
    p = m.transition(ss, 1 + size * np.exp(-decay * t), dt)
    return rows(spark, [{"t": float(a), "capital": float(k), "r": float(r), "w": float(w)} for a, k, r, w in zip(t, p["capital"], p["r"], p["w"], strict=True)], "t double, capital double, r double, w double")


EXAMPLES = {"aiyagari": {"alpha": 0.36, "beta": 0.96, "delta": 0.08, "sigma": 2.0, "rho": 0.9, "risk": 0.2}, "impatient": {"alpha": 0.36, "beta": 0.94, "delta": 0.08, "sigma": 2.0, "rho": 0.9, "risk": 0.2}, "risky": {"alpha": 0.36, "beta": 0.96, "delta": 0.08, "sigma": 3.0, "rho": 0.95, "risk": 0.4}}


def example(name: str) -> dict[str, float]:
    """A calibration of an incomplete-markets economy."""
    if name not in EXAMPLES:
        raise ValueError(f"example {name} is not known; there are {', '.join(sorted(EXAMPLES))}")
    return dict(EXAMPLES[name])


# -- accessors, bounds as text -------------------------------------------------------


def solution_facts(spark: SparkSession, s: Solution) -> DataFrame:
    """variables, shocks, stable_roots, determined, stable (largest root of the law of motion under 1), largest_root."""
    top = float(np.abs(np.linalg.eigvals(s.g)).max())
    return rows(spark, [{"variables": len(s.g), "shocks": s.h.shape[1], "stable_roots": s.roots, "determined": bool(s.determined), "stable": top < 1, "largest_root": top}], "variables int, shocks int, stable_roots int, determined boolean, stable boolean, largest_root double")


def parse_bound(text: str) -> tuple[str, float | None, float | None]:
    """``i[t] >= 0`` or ``i <= 0.5`` as variable, lower, upper."""
    for mark in (">=", "<="):
        if mark in text:
            left, _, right = text.partition(mark)
            name = left.strip().removesuffix("[t]").strip()
            if not name.isidentifier():
                raise ValueError(f"{left.strip()} is not a variable")
            return (name, float(right), None) if mark == ">=" else (name, None, float(right))
    raise ValueError("a bound has >= or <=")


def particle_posterior(df: DataFrame, model: Model, priors: dict[str, tuple[str, float, float]], observed: list[str], time: str = "t", draws: int = 48, particles: int = 100, noise: float = 0.05, seed: int = 0, guess: dict[str, float] | None = None) -> DataFrame:
    """parameter, mean, sd, log_ml: prior draws weighted by particle likelihoods (one importance step of SMC squared); draws are rows."""
    spark, names = df.sparkSession, list(priors)
    y = _sample(df, observed, time)
    table = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(prior_draws(priors, draws, seed))], "draw long, " + ", ".join(f"`{n}` double" for n in names)).repartition(2 * spark.sparkContext.defaultParallelism)

    def go(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    s = Solution(model.at(**dict(zip(names, map(float, r[1:]), strict=True))), guess)
                    at = [s.model.variables.index(v) for v in observed]
                    ll = particle_likelihood(lambda x, e, s=s: x @ s.g.T + e @ s.h.T, np.zeros(len(s.g)), s.h.shape[1], lambda x, s=s, at=at: x[:, at] + s.steady[at], y, noise, particles, seed + int(r[0]))[0] if s.determined else None
                except (ValueError, np.linalg.LinAlgError, ZeroDivisionError, OverflowError):
                    ll = None
                out.append((*r, ll))
            yield pd.DataFrame(out, columns=["draw", *names, "ll"])

    got = table.mapInPandas(go, "draw long, " + ", ".join(f"`{n}` double" for n in names) + ", ll double").where("ll is not null")
    top = got.agg(F.max("ll")).first()[0]
    w = F.exp(F.col("ll") - F.lit(float(top)))
    r = got.agg(F.avg(w).alias("ml"), *[(F.sum(w * F.col(n)) / F.sum(w)).alias(f"m_{n}") for n in names], *[(F.sum(w * F.col(n) * F.col(n)) / F.sum(w)).alias(f"s_{n}") for n in names]).first()
    return rows(spark, [{"parameter": n, "mean": r[f"m_{n}"], "sd": math.sqrt(max(0.0, r[f"s_{n}"] - r[f"m_{n}"] ** 2)), "log_ml": float(top + math.log(r.ml))} for n in names], "parameter string, mean double, sd double, log_ml double")
