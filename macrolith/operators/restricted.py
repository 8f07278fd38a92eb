"""Zero and sign restrictions with importance weights (Arias, Rubio-Ramirez and Waggoner, 2018).

Draws come from the posterior of the reduced form and, given it, uniformly from
the rotations whose responses vanish where they must. In structural parameters
that is not the distribution wanted: drawing column by column in null spaces
favours some parts. The weight of a draw is the ratio of two volume elements,
that of the map from structural to reduced-form parameters without restrictions
(known) and that of the map onto what was drawn along the restricted set, by
central differences. Bases of null spaces are carried along smoothly, which
leaves the volume as it is.

The posterior needs cross products only, which are sums over stretches of the
order; draws are rows, seeded by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .describe import rows
from .identification import zero_sign_rotation
from .multivariate import CUBE, Summed, _cube, fitted_system

Zeros = list[tuple[int, int, int]]


def moving_average(b: np.ndarray, horizon: int) -> np.ndarray:
    """Coefficients Phi_0 .. of reduced-form coefficients (the constant first)."""
    n = b.shape[1]
    p = (b.shape[0] - 1) // n
    a = [b[1 + j * n : 1 + (j + 1) * n].T for j in range(p)]
    out = [np.eye(n)]
    for h in range(1, horizon):
        out.append(sum(out[h - 1 - j] @ a[j] for j in range(min(p, h))))
    return np.array(out)


def _basis(a: np.ndarray, near: np.ndarray | None) -> np.ndarray:
    """Orthonormal basis of what a's rows annul; the one closest to another basis if that is given."""
    _, s, vt = np.linalg.svd(a, full_matrices=True)
    null = vt[int((s > 1e-10).sum()) :].T
    if near is None:
        return null
    u, _, w = np.linalg.svd(null.T @ near)
    return null @ u @ w


def _split(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A0 and A+ of structural parameters in one vector."""
    return x[: n * n].reshape(n, n), x[n * n :].reshape(-1, n)


def _responses(x: np.ndarray, n: int, zeros: Zeros) -> np.ndarray:
    a0, ap = _split(x, n)
    inv = np.linalg.inv(a0)
    theta = moving_average(ap @ inv, max((h for *_, h in zeros), default=0) + 1) @ inv.T
    return np.array([theta[h, v, s] for v, s, h in zeros])


def _drawn(x: np.ndarray, n: int, zeros: Zeros, bases: list[np.ndarray] | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """What was drawn: coefficients, covariance, and each rotation's column in the basis it was drawn in."""
    a0, ap = _split(x, n)
    inv = np.linalg.inv(a0)
    b, sigma = ap @ inv, inv.T @ inv
    chol = np.linalg.cholesky(sigma)
    q = np.linalg.solve(chol, inv.T)
    theta = moving_average(b, max((h for *_, h in zeros), default=0) + 1) @ chol
    order = sorted(range(n), key=lambda j: -sum(z[1] == j for z in zeros))
    out, done, used = [b.ravel(), sigma[np.tril_indices(n)]], [], []
    for k, j in enumerate(order):
        above = [theta[h, v] for v, s, h in zeros if s == j] + done
        used.append(_basis(np.array(above), bases[k] if bases else None) if above else np.eye(n))
        out.append(used[-1].T @ q[:, j])
        done.append(q[:, j])
    return np.concatenate(out), used


def _jacobian(f, x: np.ndarray) -> np.ndarray:
    h = 1e-5 * np.maximum(1e-2, np.abs(x))
    return np.column_stack([(f(x + e) - f(x - e)) / (2 * s) for e, s in zip(np.diag(h), h, strict=True)])


def log_weight(b: np.ndarray, sigma: np.ndarray, q: np.ndarray, zeros: Zeros) -> float:
    """Log of a draw's weight, up to a constant that all draws of a model share."""
    n = len(sigma)
    impact = np.linalg.cholesky(sigma) @ q
    a0 = np.linalg.inv(impact).T
    x = np.concatenate([a0.ravel(), (b @ a0).ravel()])
    _, bases = _drawn(x, n, zeros, None)
    d = _jacobian(lambda v: _drawn(v, n, zeros, bases)[0], x)
    if zeros:
        d = d @ _basis(_jacobian(lambda v: _responses(v, n, zeros), x), None)
    m = b.shape[0]
    return -(2 * n + m + 1) * float(np.linalg.slogdet(a0)[1]) - 0.5 * float(np.linalg.slogdet(d.T @ d)[1])


class Flat:
    """The posterior of a system under a flat prior, from its cross products: picklable."""

    def __init__(self, m: Summed):
        self.b, self.inv, self.n = m.b, m.inv, m.n
        self.scale, self.dof = m.sigma * m.rows, m.rows - m.b.shape[0]
        self.root, self.half = np.linalg.cholesky((self.inv + self.inv.T) / 2), np.linalg.cholesky(np.linalg.inv(self.scale))

    def draw(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        w = self.half @ rng.normal(size=(self.n, self.dof))
        sigma = np.linalg.inv(w @ w.T)
        return self.b + self.root @ rng.normal(size=self.b.shape) @ np.linalg.cholesky(sigma).T, sigma


def draws(df: DataFrame, columns: list[str], order: str, zeros: list[tuple[str, str, int]] = (), signs: list[tuple[str, str, int, int]] = (), p: int = 1, horizon: int = 12, draws: int = 1000, seed: int = 1, posterior: bool = True) -> DataFrame:
    """draw, log_weight, horizon, variable, shock, value of the draws that meet all signs.

    zeros are (variable, shock, horizon), signs (variable, shock, horizon, +-1).
    posterior: reduced forms are drawn too; otherwise all have the estimate's.
    """
    spark = df.sparkSession
    at = {c: i for i, c in enumerate(columns)}
    zs = [(at[v], at[s], h) for v, s, h in zeros]
    gs = [(at[v], at[s], h, g) for v, s, h, g in signs]
    m = fitted_system(df, columns, order, p)
    shared = spark.sparkContext.broadcast((Flat(m), m.b, m.sigma))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, b0, s0 = shared.value
        for pdf in batches:
            out = []
            for r in pdf.id:
                rng = np.random.default_rng([seed, int(r)])
                b, sigma = flat.draw(rng) if posterior else (b0, s0)
                chol = np.linalg.cholesky(sigma)
                phi = moving_average(b, max(horizon, 1 + max((z[2] for z in zs), default=0)))
                q = zero_sign_rotation(phi, chol, zs, rng)
                a = phi @ chol @ q
                for s in {x[1] for x in gs}:  # a shock's sign is free until a restriction sets it
                    if all(a[h, v, s] * g < 0 for v, k, h, g in gs if k == s):
                        q[:, s] *= -1
                        a[:, :, s] *= -1
                if all(a[h, v, s] * g > 0 for v, s, h, g in gs):
                    out.append(pd.DataFrame(_cube(a[:horizon], columns)).assign(draw=int(r), log_weight=log_weight(b, sigma, q, zs)))
            if out:
                yield pd.concat(out)[["draw", "log_weight", "horizon", "variable", "shock", "value"]]

    return spark.range(draws).mapInPandas(go, f"draw long, log_weight double, {CUBE}")


def weighted(found: DataFrame) -> DataFrame:
    """The draws with weight, which adds up to one over draws."""
    top = found.agg(F.max("log_weight")).first()[0]
    w = F.exp(F.col("log_weight") - F.lit(top or 0.0))
    total = found.groupBy("draw").agg(F.first("log_weight").alias("log_weight")).agg(F.sum(w)).first()[0] or 1.0
    return found.withColumn("weight", w / F.lit(total))


def summary(found: DataFrame, quantiles: tuple = (0.16, 0.5, 0.84)) -> DataFrame:
    """horizon, variable, shock, draws, effective (draws that equal weights would be worth), mean and weighted quantiles q16, q50.."""
    keys = ["horizon", "variable", "shock"]
    d = weighted(found)
    run = F.sum("weight").over(Window.partitionBy(*keys).orderBy("value", "draw").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = d.withColumn("_run", run)
    at = lambda q: F.min(F.when(F.col("_run") >= q - 1e-12, F.col("value"))).alias(f"q{round(100 * q)}")
    return ranked.groupBy(*keys).agg(F.count("*").alias("draws"), (1 / F.sum(F.col("weight") * F.col("weight"))).alias("effective"), F.sum(F.col("weight") * F.col("value")).alias("mean"), *[at(q) for q in quantiles])


def resampled(found: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n draws with chances as their weights (systematic): draw is the new number, source the old one."""
    d = weighted(found).groupBy("draw").agg(F.first("weight").alias("w")).orderBy("draw").toPandas()  # a row a draw
    at = np.searchsorted(np.cumsum(d.w.to_numpy()), (np.random.default_rng(seed).random() + np.arange(n)) / n, side="right").clip(0, max(0, len(d) - 1))
    picked = rows(found.sparkSession, [{"new": int(k), "draw": int(d.draw.iloc[j])} for k, j in enumerate(at)] if len(d) else [], "new long, draw long")
    return picked.join(found.drop("log_weight"), "draw").select(F.col("new").alias("draw"), F.col("draw").alias("source"), "horizon", "variable", "shock", "value")


def effective_draws(found: DataFrame) -> DataFrame:
    """accepted, effective, largest_weight."""
    d = weighted(found).groupBy("draw").agg(F.first("weight").alias("w"))
    return d.agg(F.count("*").alias("accepted"), (1 / F.sum(F.col("w") * F.col("w"))).alias("effective"), F.max("w").alias("largest_weight"))
