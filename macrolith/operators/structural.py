"""Structural models: equations as text, steady states, linear solutions, their moments and paths, likelihoods and posteriors; heterogeneous agents and perpetual youth.

A model is small and lives on the driver. What there is much of becomes rows:
parameterisations, replicates and chains, each with a seed by its number.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .describe import rows
from .dynamics import solve_linear

_FUNCTIONS = {"exp": np.exp, "log": np.log, "sqrt": np.sqrt}
_NODES = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.USub, ast.UAdd, ast.Constant, ast.Name, ast.Load, ast.Call)
#: Periods of a sample that is gathered for a likelihood.
LONGEST = 100_000


class _Times(ast.NodeTransformer):
    """x[t-1], x[t], x[t+1] become the names x__m, x__0, x__p."""

    def visit_Subscript(self, node: ast.Subscript) -> ast.Name:
        when = ast.unparse(node.slice).replace(" ", "")
        suffix = {"t-1": "__m", "t": "__0", "t+1": "__p"}.get(when)
        if suffix is None or not isinstance(node.value, ast.Name):
            raise ValueError(f"only x[t-1], x[t] and x[t+1] are known, not {ast.unparse(node)}")
        return ast.copy_location(ast.Name(node.value.id + suffix, ast.Load()), node)


class Model:
    """Equations such as ``c[t]**-s = beta * c[t+1]**-s * (1 + r[t+1])`` in as many variables; shocks are written e[t]."""

    def __init__(self, equations: list[str], variables: list[str], shocks: list[str], parameters: dict[str, float]):
        if len(equations) != len(variables):
            raise ValueError("there must be as many equations as variables")
        self.equations, self.variables, self.shocks, self.parameters = list(equations), list(variables), list(shocks), dict(parameters)
        self._code = None
        known = {v + s for v in variables for s in ("__m", "__0", "__p")} | {e + "__0" for e in shocks} | set(parameters) | set(_FUNCTIONS)
        for tree in map(self._tree, equations):
            for n in ast.walk(tree):
                if not isinstance(n, _NODES) or isinstance(n, ast.Name) and n.id not in known or isinstance(n, ast.Call) and not isinstance(n.func, ast.Name):
                    raise ValueError(f"{ast.unparse(n)} is not known in an equation")

    @staticmethod
    def _tree(equation: str) -> ast.Expression:
        left, _, right = equation.partition("=")
        return ast.fix_missing_locations(_Times().visit(ast.parse(f"({left.strip()}) - ({right.strip() or 0})", mode="eval")))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_code": None}

    def at(self, **parameters: float) -> Model:
        return Model(self.equations, self.variables, self.shocks, self.parameters | parameters)

    def residuals(self, lead, now, lag, shock) -> np.ndarray:
        if self._code is None:
            self._code = [compile(self._tree(e), "equation", "eval") for e in self.equations]
        names = self.parameters | _FUNCTIONS | {e + "__0": x for e, x in zip(self.shocks, shock, strict=True)}
        for suffix, values in (("__p", lead), ("__0", now), ("__m", lag)):
            names |= {v + suffix: x for v, x in zip(self.variables, values, strict=True)}
        return np.array([eval(c, {"__builtins__": {}}, names) for c in self._code])  # noqa: S307 - only arithmetic passes the check above


def jacobian(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    """By complex steps, exact to rounding."""
    return np.stack([np.imag(f(x + 1e-30j * e)) / 1e-30 for e in np.eye(len(x))], axis=1)


def steady_state(model: Model, guess: dict[str, float] | None = None, steps: int = 200, tol: float = 1e-11) -> np.ndarray:
    """Newton's method with halved steps from the guess (ones where there is none)."""
    x = np.array([(guess or {}).get(v, 1.0) for v in model.variables], float)
    none = np.zeros(len(model.shocks))
    f = lambda z: model.residuals(z, z, z, none)
    with np.errstate(all="ignore"):
        for _ in range(steps):
            r = f(x)
            if np.abs(r).max() < tol:
                return x
            # Least squares, as levels may be free in a model with a unit root.
            step = np.linalg.lstsq(jacobian(f, x), -r, rcond=None)[0]
            size = 1.0
            while size > 1e-10 and not (np.isfinite(new := f(x + size * step)).all() and np.linalg.norm(new) < np.linalg.norm(r)):
                size /= 2
            x = x + size * step
    if np.abs(f(x)).max() > 1e-7:
        raise ValueError("no steady state was found from this guess")
    return x


def linearize(model: Model, steady: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A, B, C, D of A E y(t+1) + B y(t) + C y(t-1) + D e(t) = 0 in deviations from the steady state."""
    s, none = steady, np.zeros(len(model.shocks))
    a = jacobian(lambda z: model.residuals(z, s, s, none), s)
    b = jacobian(lambda z: model.residuals(s, z, s, none), s)
    c = jacobian(lambda z: model.residuals(s, s, z, none), s)
    d = jacobian(lambda e: model.residuals(s, s, s, e), none) if len(none) else np.zeros((len(s), 0))
    return a, b, c, d


def stable_roots(a: np.ndarray, b: np.ndarray, c: np.ndarray, div: float = 1 + 1e-8) -> int:
    """Roots of A z^2 + B z + C within the circle of radius div; a unique stable solution needs as many as variables."""
    n = len(b)
    zero, one = np.zeros((n, n)), np.eye(n)
    lead, lag = np.block([[a, zero], [zero, one]]), np.block([[-b, -c], [one, zero]])
    # lag x = z lead x, with a shift, since lead may be singular: mu = 1 / (z - shift).
    shift = 1.0 + 0.137
    mu = np.linalg.eigvals(np.linalg.solve(lag - shift * lead, lead))
    z = shift + 1 / np.where(np.abs(mu) > 1e-11, mu, 1e-11)
    return int((np.abs(z) < div).sum())


class Solution:
    """y(t) = G y(t-1) + H e(t) in deviations from the steady state."""

    def __init__(self, model: Model, guess: dict[str, float] | None = None):
        self.model, self.steady = model, steady_state(model, guess)
        a, b, c, d = linearize(model, self.steady)
        self.roots = stable_roots(a, b, c)
        self.determined = self.roots == len(b)
        self.g, self.h = solve_linear(a, b, c, d)

    def impulse(self, horizon: int) -> np.ndarray:
        """horizon x variable x shock, to unit shocks."""
        out = [self.h]
        for _ in range(horizon - 1):
            out.append(self.g @ out[-1])
        return np.array(out)

    def covariance(self) -> np.ndarray:
        return lyapunov(self.g, self.h @ self.h.T)


def lyapunov(g: np.ndarray, q: np.ndarray, tol: float = 1e-14) -> np.ndarray:
    """V = G V G' + Q by doubling; G must be stable."""
    if len(g) and np.abs(np.linalg.eigvals(g)).max() >= 1 - 1e-10:
        raise ValueError("the solution is not stationary")
    v = q
    while True:
        more = g @ v @ g.T
        v, g = v + more, g @ g
        if np.abs(more).max(initial=0) <= tol * max(1.0, np.abs(v).max(initial=0)):
            return (v + v.T) / 2


# -- results of one model -----------------------------------------------------


def solution_table(spark: SparkSession, s: Solution) -> DataFrame:
    """variable, steady_state, std_dev, autocorrelation, stable_roots, determined."""
    v = s.covariance()
    one = s.g @ v
    return rows(spark, [{"variable": n, "steady_state": float(s.steady[i]), "std_dev": math.sqrt(max(v[i, i], 0.0)), "autocorrelation": float(one[i, i] / v[i, i]) if v[i, i] > 1e-18 else None, "stable_roots": s.roots, "determined": s.determined} for i, n in enumerate(s.model.variables)], "variable string, steady_state double, std_dev double, autocorrelation double, stable_roots int, determined boolean")


def impulse_table(spark: SparkSession, s: Solution, horizon: int = 20) -> DataFrame:
    y = s.impulse(horizon)
    return rows(spark, [{"horizon": h, "variable": v, "shock": e, "value": float(y[h, i, j])} for h in range(horizon) for i, v in enumerate(s.model.variables) for j, e in enumerate(s.model.shocks)], "horizon int, variable string, shock string, value double")


def variance_shares(spark: SparkSession, s: Solution, horizon: int = 20) -> DataFrame:
    """Shares of the forecast error variance by shock; a variable without any variance has null shares."""
    y = np.cumsum(s.impulse(horizon) ** 2, axis=0)
    total = y.sum(axis=2)
    return rows(spark, [{"horizon": h + 1, "variable": v, "shock": e, "share": float(y[h, i, j] / total[h, i]) if total[h, i] > 1e-18 else None} for h in range(horizon) for i, v in enumerate(s.model.variables) for j, e in enumerate(s.model.shocks)], "horizon int, variable string, shock string, share double")


def simulate(spark: SparkSession, s: Solution, periods: int, replicates: int = 1, burn: int = 100, seed: int = 0) -> DataFrame:
    """replicate, t, and a column per variable (levels). A replicate is one row of the input and has a seed by its number."""
    g, h, steady, names = s.g, s.h, s.steady, s.model.variables

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf["id"]:
                e = np.random.default_rng([seed, int(r)]).standard_normal((burn + periods, h.shape[1]))
                y, out = np.zeros(len(g)), np.empty((periods, len(g)))
                for t in range(-burn, periods):
                    y = g @ y + h @ e[t + burn]
                    if t >= 0:
                        out[t] = y
                yield pd.DataFrame(out + steady, columns=names).assign(replicate=r, t=np.arange(periods, dtype=np.int32))[["replicate", "t", *names]]

    return spark.range(replicates).mapInPandas(go, "replicate long, t int, " + ", ".join(f"`{n}` double" for n in names))


# -- occasionally binding bounds ----------------------------------------------


def bounded_path(s: Solution, variable: str, lower: float | None, upper: float | None, shocks: dict[str, float], periods: int = 40, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Levels (a row a period) after shocks in the first period, and when the bound binds.

    The equation ``variable[t] = ...`` gives way to the bound while its right side lies beyond it.
    Piecewise linear: guesses of the binding periods are checked until one confirms itself; past the last period none binds.
    """
    if (lower is None) == (upper is None):
        raise ValueError("give either a lower or an upper bound")
    bound, side = (lower, 1.0) if upper is None else (upper, -1.0)
    m, steady = s.model, s.steady
    own = [k for k, e in enumerate(m.equations) if e.partition("=")[0].replace(" ", "") == f"{variable}[t]"]
    if len(own) != 1:
        raise ValueError(f"there must be one equation that begins with {variable}[t] =")
    j, i = own[0], m.variables.index(variable)
    a, b, c, d = linearize(m, steady)
    a2, b2, c2, d2 = a.copy(), b.copy(), c.copy(), d.copy()
    a2[j] = c2[j] = d2[j] = 0.0
    b2[j] = np.eye(len(b))[i]
    shift = np.zeros(len(b))
    shift[j] = steady[i] - bound
    first = d @ np.array([shocks.get(e, 0.0) for e in m.shocks])
    first2 = d2 @ np.array([shocks.get(e, 0.0) for e in m.shocks])
    binds = np.zeros(periods, bool)
    for _ in range(rounds):
        p, r, rules = s.g, np.zeros(len(b)), []
        for t in reversed(range(periods)):
            at, bt, ct, ft, et = (a2, b2, c2, shift, first2) if binds[t] else (a, b, c, 0.0, first)
            inv = np.linalg.inv(at @ p + bt)
            p, r = -inv @ ct, -inv @ (at @ r + ft + (et if t == 0 else 0.0))
            rules.append((p, r))
        y, path = np.zeros(len(b)), []
        for p, r in reversed(rules):
            y = p @ y + r
            path.append(y)
        path = np.array(path)
        lead, lag = np.vstack([path[1:], s.g @ path[-1]]), np.vstack([np.zeros(len(b)), path[:-1]])
        # What the own equation leaves over: the variable less its right side.
        over = lead @ a[j] + path @ b[j] + lag @ c[j]
        over[0] += first[j]
        new = np.where(binds, side * over > 1e-12, side * (path[:, i] + steady[i] - bound) < -1e-12)
        if (new == binds).all():
            return path + steady, binds
        binds = new
    raise ValueError("no guess of the binding periods confirmed itself")


def bounded_impulses(spark: SparkSession, s: Solution, variable: str, shocks: dict[str, float], periods: int = 40, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """horizon, variable, bounded, free (levels with and without the bound), binds."""
    y, binds = bounded_path(s, variable, lower, upper, shocks, periods)
    free = s.impulse(periods) @ np.array([shocks.get(e, 0.0) for e in s.model.shocks]) + s.steady
    return rows(spark, [{"horizon": t, "variable": v, "bounded": float(y[t, k]), "free": float(free[t, k]), "binds": bool(binds[t])} for t in range(periods) for k, v in enumerate(s.model.variables)], "horizon int, variable string, bounded double, free double, binds boolean")


# -- likelihood and posterior -------------------------------------------------


def log_likelihood(s: Solution, y: np.ndarray, observed: list[str], noise: float = 0.0) -> float:
    """Of the levels y (a row a period, NaN where missing), by the Kalman filter from the stationary distribution."""
    z = np.eye(len(s.g))[[s.model.variables.index(v) for v in observed]]
    x, p, q = np.zeros(len(s.g)), s.covariance(), s.h @ s.h.T
    d, out = y - s.steady @ z.T, 0.0
    for row in d:
        k = np.isfinite(row)
        if k.any():
            zk = z[k]
            f = zk @ p @ zk.T + noise * np.eye(k.sum())
            v = row[k] - zk @ x
            sign, det = np.linalg.slogdet(f)
            if sign <= 0:
                return -math.inf
            gain = np.linalg.solve(f, zk @ p).T
            out -= 0.5 * (k.sum() * math.log(2 * math.pi) + det + v @ np.linalg.solve(f, v))
            x, p = x + gain @ v, p - gain @ zk @ p
        x, p = s.g @ x, s.g @ p @ s.g.T + q
    return float(out)


def _sample(df: DataFrame, observed: list[str], time: str) -> np.ndarray:
    """The observed series in order: one number a period and variable, of at most LONGEST periods."""
    got = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in dict.fromkeys([time, *observed])]).limit(LONGEST + 1).toPandas()
    if len(got) > LONGEST:
        raise ValueError(f"the sample has more than {LONGEST} periods; filter it")
    return got.sort_values(time)[observed].to_numpy(float)


def smoothed(s: Solution, y: np.ndarray, observed: list[str], noise: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Variables (levels) and shocks by period, given the whole sample y (NaN where missing)."""
    n, k = s.h.shape
    g = np.block([[s.g, np.zeros((n, k))], [np.zeros((k, n + k))]])
    h = np.vstack([s.h, np.eye(k)])
    z = np.eye(n + k)[[s.model.variables.index(v) for v in observed]]
    x, p, q = np.zeros(n + k), lyapunov(g, h @ h.T), h @ h.T
    ahead, spread, xs, ps = [], [], [], []
    for row in y - s.steady @ z[:, :n].T:
        ahead.append(x)
        spread.append(p)
        seen = np.isfinite(row)
        if seen.any():
            zk = z[seen]
            gain = p @ zk.T @ np.linalg.pinv(zk @ p @ zk.T + noise * np.eye(seen.sum()))
            x, p = x + gain @ (row[seen] - zk @ x), p - gain @ zk @ p
        xs.append(x)
        ps.append(p)
        x, p = g @ x, g @ p @ g.T + q
    out = np.array(xs)
    for t in reversed(range(len(out) - 1)):
        # Singular forecasts are the rule here: there are fewer shocks than states.
        out[t] = xs[t] + ps[t] @ g.T @ np.linalg.pinv(spread[t + 1], rcond=1e-11, hermitian=True) @ (out[t + 1] - ahead[t + 1])
    return out[:, :n] + s.steady, out[:, n:]


def shock_contributions(df: DataFrame, s: Solution, observed: list[str], time: str = "t", noise: float = 0.0) -> DataFrame:
    """t, variable, shock, value: what each smoothed shock, and the state before the sample (shock "initial"), adds to the deviation from the steady state."""
    y = _sample(df, [time, *observed], time)
    levels, e = smoothed(s, y[:, 1:], observed, noise)
    parts, out = np.zeros((len(s.g), len(s.model.shocks))), []
    for t in range(len(y)):
        parts = s.g @ parts + s.h * e[t]
        rest = levels[t] - s.steady - parts.sum(1)
        out += [{"t": int(y[t, 0]), "variable": v, "shock": name, "value": float(x)} for i, v in enumerate(s.model.variables) for name, x in [*zip(s.model.shocks, parts[i], strict=True), ("initial", rest[i])]]
    return rows(df.sparkSession, out, "t long, variable string, shock string, value double")


def _value(model: Model, y: np.ndarray, observed: list[str], noise: float, guess: dict | None) -> float:
    """The log-likelihood, minus infinity where the model has no unique stable solution."""
    try:
        s = Solution(model, guess)
        return log_likelihood(s, y, observed, noise) if s.determined else -math.inf
    except (ValueError, np.linalg.LinAlgError, ZeroDivisionError, OverflowError):
        return -math.inf


def likelihoods(df: DataFrame, model: Model, parameters: DataFrame, observed: list[str], time: str = "t", noise: float = 0.0, guess: dict[str, float] | None = None) -> DataFrame:
    """The rows of parameters, which need no columns but those they change, with their log-likelihood (null without a unique stable solution)."""
    y, names = _sample(df, observed, time), parameters.columns

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ll = [_value(model.at(**dict(zip(names, map(float, r), strict=True))), y, observed, noise, guess) for r in pdf[names].itertuples(index=False)]
            yield pdf.assign(log_likelihood=[v if math.isfinite(v) else None for v in ll])

    return parameters.mapInPandas(go, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parameters.schema) + ", log_likelihood double")


def log_prior(kind: str, mean: float, sd: float, x: float) -> float:
    """Log density of normal, beta, gamma or uniform with this mean and standard deviation."""
    if kind == "normal":
        return -0.5 * ((x - mean) / sd) ** 2 - math.log(sd * math.sqrt(2 * math.pi))
    if kind == "uniform":
        half = sd * math.sqrt(3)
        return -math.log(2 * half) if abs(x - mean) <= half else -math.inf
    if kind == "gamma":
        shape, rate = (mean / sd) ** 2, mean / sd**2
        return (shape - 1) * math.log(x) - rate * x + shape * math.log(rate) - math.lgamma(shape) if x > 0 else -math.inf
    if kind == "beta":
        n = mean * (1 - mean) / sd**2 - 1
        a, b = mean * n, (1 - mean) * n
        return (a - 1) * math.log(x) + (b - 1) * math.log(1 - x) + math.lgamma(n) - math.lgamma(a) - math.lgamma(b) if 0 < x < 1 else -math.inf
    raise ValueError(f"prior {kind} is not known")


def posterior(df: DataFrame, model: Model, priors: dict[str, tuple[str, float, float]], observed: list[str], time: str = "t", draws: int = 1000, burn: int = 500, chains: int = 4, scale: float = 0.3, noise: float = 0.0, seed: int = 0, guess: dict[str, float] | None = None) -> DataFrame:
    """chain, draw, log_posterior and a column per parameter: random-walk Metropolis chains, a row of the input each.

    Steps adapt to the accepted share, and to the draws' spread, during the burn-in only.
    """
    y, names, spark = _sample(df, observed, time), list(priors), df.sparkSession

    def density(x: np.ndarray) -> float:
        p = sum(log_prior(*priors[n], float(v)) for n, v in zip(names, x, strict=True))
        return p + _value(model.at(**dict(zip(names, map(float, x), strict=True))), y, observed, noise, guess) if math.isfinite(p) else -math.inf

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["id"]:
                rng = np.random.default_rng([seed, int(c)])
                sd = np.array([priors[n][2] for n in names])
                x = np.array([priors[n][1] for n in names])
                at, size, kept, out = density(x), scale, [], []
                for i in range(burn + draws):
                    new = x + size * sd * rng.standard_normal(len(x))
                    there = density(new)
                    won = math.log(rng.random()) < there - at if math.isfinite(there) else False
                    if won:
                        x, at = new, there
                    if i < burn:
                        size *= math.exp((won - 0.3) / math.sqrt(i + 1))
                        kept.append(x)
                        if i == burn // 2:
                            spread = np.std(kept[burn // 4 :], axis=0)
                            size, sd = size * float(np.mean(sd / np.maximum(spread, 1e-3 * sd))), np.maximum(spread, 1e-3 * sd)
                    else:
                        out.append([c, i - burn, at, *x])
                yield pd.DataFrame(out, columns=["chain", "draw", "log_posterior", *names]).astype({"chain": "int64", "draw": "int32"})

    return spark.range(0, chains, 1, chains).mapInPandas(go, "chain long, draw int, log_posterior double, " + ", ".join(f"`{n}` double" for n in names))


def posterior_summary(draws: DataFrame, names: list[str]) -> DataFrame:
    """parameter, mean, sd, q05, median, q95, r_hat (between against within chains)."""
    long = draws.select("chain", F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(f"`{n}`").alias("v")) for n in names])).alias("e")).select("chain", "e.*")
    per = long.groupBy("parameter", "chain").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"), F.count("*").alias("n"))
    mixed = per.groupBy("parameter").agg(F.sqrt((F.avg("n") - 1) / F.avg("n") + F.coalesce(F.var_samp("m"), F.lit(0.0)) / F.avg("s")).alias("r_hat"))
    q = lambda p: F.percentile("v", F.lit(p))
    return long.groupBy("parameter").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), q(0.05).alias("q05"), q(0.5).alias("median"), q(0.95).alias("q95")).join(mixed, "parameter")


# -- heterogeneous agents and perpetual youth ---------------------------------


def rouwenhorst(rho: float, sigma: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid and transitions of an AR(1) with innovations of this deviation."""
    p, t = (1 + rho) / 2, np.ones((1, 1))
    for k in range(2, n + 1):
        new = np.zeros((k, k))
        new[:-1, :-1] += p * t
        new[:-1, 1:] += (1 - p) * t
        new[1:, :-1] += (1 - p) * t
        new[1:, 1:] += p * t
        new[1:-1] /= 2
        t = new
    edge = sigma / math.sqrt(1 - rho * rho) * math.sqrt(n - 1)
    return np.linspace(-edge, edge, n), t


def tauchen(rho: float, sigma: float, n: int, m: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """The same by the mass between the midpoints of an even grid over m deviations."""
    edge = m * sigma / math.sqrt(1 - rho * rho)
    x = np.linspace(-edge, edge, n)
    cut = np.concatenate(([-np.inf], (x[1:] + x[:-1]) / 2, [np.inf]))
    cdf = np.array([[0.5 * math.erfc(-(c - rho * v) / sigma / math.sqrt(2)) for c in cut] for v in x])
    return x, np.diff(cdf, axis=1)


def stationary(t: np.ndarray) -> np.ndarray:
    n = len(t)
    return np.linalg.lstsq(np.vstack([t.T - np.eye(n), np.ones(n)]), np.append(np.zeros(n), 1.0), rcond=None)[0]


def savings(r: float, w: float, grid: np.ndarray, income: np.ndarray, t: np.ndarray, beta: float, sigma: float, tol: float = 1e-9, most: int = 5000) -> np.ndarray:
    """Next assets by assets and income state, by endogenous grid points; the first grid point is the borrowing limit."""
    cash = (1 + r) * grid[:, None] + w * income
    c = np.maximum(cash - grid[0], 1e-3) * 0.5
    for _ in range(most):
        want = (beta * (1 + r) * (c**-sigma) @ t.T) ** (-1 / sigma) + grid[:, None]
        saved = np.stack([np.interp(cash[:, j], want[:, j], grid) for j in range(len(income))], axis=1)
        new = cash - saved
        if np.abs(new - c).max() < tol:
            break
        c = new
    return saved


def distribution(saved: np.ndarray, grid: np.ndarray, t: np.ndarray, tol: float = 1e-12, most: int = 20_000) -> np.ndarray:
    """Stationary mass by assets and income, with savings split between the neighbouring grid points."""
    lo = np.clip(np.searchsorted(grid, saved, side="right") - 1, 0, len(grid) - 2)
    up = np.clip((saved - grid[lo]) / (grid[lo + 1] - grid[lo]), 0, 1)
    m = np.outer(np.full(len(grid), 1 / len(grid)), stationary(t))
    for _ in range(most):
        moved = np.stack([np.bincount(lo[:, j], m[:, j] * (1 - up[:, j]), len(grid)) + np.bincount(lo[:, j] + 1, m[:, j] * up[:, j], len(grid)) for j in range(len(t))], axis=1) @ t
        if np.abs(moved - m).max() < tol:
            return moved
        m = moved
    return m


def aiyagari(alpha: float = 0.36, beta: float = 0.96, delta: float = 0.08, sigma: float = 2.0, rho: float = 0.9, risk: float = 0.2, states: int = 5, points: int = 150, top: float = 150.0, tol: float = 1e-6) -> dict:
    """General equilibrium: r, w, capital, grid, saved and mass, by bisection on the interest rate. Mean labour is one."""
    x, t = rouwenhorst(rho, risk * math.sqrt(1 - rho * rho), states)
    income = np.exp(x) / (stationary(t) @ np.exp(x))
    grid = top * np.linspace(0, 1, points) ** 3
    lo, hi = -delta + 1e-3, 1 / beta - 1 - 1e-6
    while True:
        r = (lo + hi) / 2
        k = (alpha / (r + delta)) ** (1 / (1 - alpha))
        w = (1 - alpha) * k**alpha
        saved = savings(r, w, grid, income, t, beta, sigma)
        mass = distribution(saved, grid, t)
        supply = float((mass * saved).sum())
        if hi - lo < tol:
            return {"r": r, "w": w, "capital": k, "supply": supply, "grid": grid, "saved": saved, "mass": mass, "income": income, "transitions": t}
        lo, hi = (lo, r) if supply > k else (r, hi)


def gini(value: np.ndarray, mass: np.ndarray) -> float:
    order = np.argsort(value.ravel(), kind="stable")
    v, m = value.ravel()[order], mass.ravel()[order] / mass.sum()
    share = np.concatenate(([0.0], np.cumsum(v * m) / (v @ m)))
    return float(1 - (m * (share[1:] + share[:-1])).sum())


def wealth_table(spark: SparkSession, e: dict) -> DataFrame:
    """assets, mass, cumulative mass and share of wealth, with the equilibrium's r, w, capital and Gini index on each row."""
    m = e["mass"].sum(1)
    v = np.cumsum(m * e["grid"]) / (m @ e["grid"])
    g = gini(e["grid"], m)
    return rows(spark, [{"assets": float(a), "mass": float(x), "below": float(c), "share": float(s), "r": e["r"], "w": e["w"], "capital": e["capital"], "gini": g} for a, x, c, s in zip(e["grid"], m, np.cumsum(m), v, strict=True)], "assets double, mass double, below double, share double, r double, w double, capital double, gini double")


def simulate_panel(spark: SparkSession, e: dict, agents: int = 1000, periods: int = 100, seed: int = 0) -> DataFrame:
    """agent, t, income, assets: agents start from the stationary distribution and have seeds by their number."""
    grid, saved, income = e["grid"], e["saved"], e["income"]
    start, cum = np.cumsum(e["mass"].ravel()), np.cumsum(e["transitions"], axis=1)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n in pdf["id"]:
                u = np.random.default_rng([seed, int(n)]).random(periods + 1)
                i, j = divmod(min(int(np.searchsorted(start, u[0] * start[-1])), len(start) - 1), len(income))
                a, out = grid[i], []
                for k in range(periods):
                    out.append((n, k, income[j], a))
                    a = float(np.interp(a, grid, saved[:, j]))
                    j = min(int(np.searchsorted(cum[j], u[k + 1])), len(income) - 1)
                yield pd.DataFrame(out, columns=["agent", "t", "income", "assets"]).astype({"t": "int32"})

    return spark.range(agents).mapInPandas(go, "agent long, t int, income double, assets double")


def perpetual_youth(alpha: float = 0.36, beta: float = 0.96, delta: float = 0.08, gamma: float = 0.98, z: float = 1.0, debt: float = 0.0) -> tuple[Model, dict[str, float]]:
    """Blanchard's (1985) model with survival gamma, and its steady state: consumption of the budget equals that of the Euler equation."""
    turnover = (1 - beta * gamma) * (1 - gamma) / gamma
    rate = lambda k: alpha * z * k ** (alpha - 1) - delta
    least = lambda k: z * k**alpha - delta * k
    hi = (alpha * z / (1 / beta - 1 + delta)) ** (1 / (1 - alpha))
    k = hi
    if gamma < 1:
        lo = 1e-6 * hi
        for _ in range(200):
            k = (lo + hi) / 2
            gap = least(k) * (beta * (1 + rate(k)) - 1) - (1 + rate(k)) * turnover * (k + debt)
            lo, hi = (k, hi) if gap > 0 else (lo, k)
    m = Model(["c[t+1] = (1 + alpha * z * k[t]**(alpha - 1) - delta) * (beta * c[t] - turnover * (k[t] + debt))", "k[t] = z * k[t-1]**alpha + (1 - delta) * k[t-1] - c[t] + e[t]"], ["c", "k"], ["e"], {"alpha": alpha, "beta": beta, "delta": delta, "z": z, "debt": debt, "turnover": turnover})
    return m, {"c": least(k), "k": k}


def transition(spark: SparkSession, s: Solution, start: dict[str, float], periods: int = 50) -> DataFrame:
    """t and a column per variable along the linear saddle path, from lagged values of which those in start differ from the steady state."""
    y = np.array([start.get(n, v) - v for n, v in zip(s.model.variables, s.steady, strict=True)])
    out = []
    for t in range(periods):
        y = s.g @ y
        out.append({"t": t} | dict(zip(s.model.variables, (y + s.steady).tolist(), strict=True)))
    return rows(spark, out, "t int, " + ", ".join(f"{n} double" for n in s.model.variables))
