"""Sufficient statistics: one aggregate for all cross products, then a small solve.

Products are of deviations from the means, so products of raw levels never
cancel: covariance aggregates in one pass, or a pass for the means before. Wide designs stay one pass: rows become
one array and partial Gram matrices are added up in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many columns unweighted covariances are native aggregates of one pass.
PAIRED = 8
#: Up to this many columns the products are native aggregates in generated code, after a pass for the means.
NATIVE = 12


def _moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    r = df.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    k = len(columns)
    mean = np.array([0.0 if v is None else v for v in r[1 : 1 + k]])
    sd = np.array([v or 1.0 for v in r[1 + k :]])
    return r[0], mean, sd


def centred(df: DataFrame, columns: list[str], weight: str | Column | None = None) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Rows, sum of weights, means, and sums of products of the deviations from them."""
    k = len(columns)
    if weight is None and k <= PAIRED:
        # Covariances merge stably, so one pass does without knowing the means before.
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        r = df.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
        n, mean, c = r[0], np.array([v or 0.0 for v in r[1 : 1 + k]]), np.zeros((k, k))
        for (i, j), v in zip(pairs, r[1 + k :], strict=True):
            c[i, j] = c[j, i] = n * (v or 0.0)
        return n, float(n), mean, c
    n, mean, sd = _moments(df, columns)
    k += 1
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    z = [F.lit(1.0), *[(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(columns, mean, sd, strict=True)]]
    g = np.zeros((k, k))
    if k - 1 <= NATIVE:
        named = df.select(w.alias("_w"), *[c.alias(f"_z{i}") for i, c in enumerate(z)])
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = named.agg(*[F.sum(F.col("_w") * F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in pairs]).first()
        for (i, j), v in zip(pairs, got, strict=True):
            g[i, j] = g[j, i] = v or 0.0
    else:

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((k, k))
            for b in batches:
                a = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                held += (a[:, 1:] * a[:, :1]).T @ a[:, 1:]
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(held.ravel())], ["at", "v"])

        named = df.select(w.alias("_w"), *[c.cast("double").alias(f"_z{i}") for i, c in enumerate(z)])
        for r in named.mapInArrow(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            g[r.at // k, r.at % k] = r.v
    total = float(g[0, 0])
    shift = g[0, 1:] / total if total else np.zeros(k - 1)
    return n, total, mean + sd * shift, np.outer(sd, sd) * (g[1:, 1:] - total * np.outer(shift, shift))


def gram(df: DataFrame, columns: list[str], weight: str | Column | None = None) -> tuple[int, np.ndarray]:
    """Number of rows and the matrix of sums of products of [1, columns], weighted."""
    n, total, mean, c = centred(df, columns, weight)
    one = np.concatenate(([1.0], mean))
    out = total * np.outer(one, one)
    out[1:, 1:] += c
    return n, out


def shared_products(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of columns, over the rows that have both: rows, sums of the first, sums of its squares, sums of products. Partial matrices are added up in Arrow batches."""
    k = len(columns)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, k, k))
        for b in batches:
            a = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
            ok = ~np.isnan(a)
            a, ok = np.where(ok, a, 0.0), ok.astype(float)
            held += [ok.T @ ok, a.T @ ok, (a * a).T @ ok, a.T @ a]
        yield pa.RecordBatch.from_arrays([pa.array(range(4 * k * k), pa.int32()), pa.array(held.ravel())], ["at", "v"])

    got = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(4 * k * k)
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return tuple(out.reshape(4, k, k))


class Moments:
    """Solves regressions among the columns of one aggregate; const stands for the constant.

    With a constant the slopes are solved from deviations, so that large means don't cost digits.
    """

    def __init__(self, n: int, total: float, mean: np.ndarray, c: np.ndarray, columns: list[str]):
        self.n, self.total, self.mean, self.c = n, total, mean, c
        self.names = ["const", *columns]
        one = np.concatenate(([1.0], mean))
        self.g = total * np.outer(one, one)
        self.g[1:, 1:] += c

    @classmethod
    def of(cls, df: DataFrame, columns: list[str], weight: str | None = None) -> Moments:
        return cls(*centred(df, columns, weight), columns)

    def sub(self, rows: list[str], cols: list[str] | None = None) -> np.ndarray:
        at = self.names.index
        return self.g[np.ix_([at(r) for r in rows], [at(c) for c in cols or rows])]

    def solve(self, y: str, x: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
        """Coefficients, (X'X)^-1 and residual sum of squares."""
        from ..functions.linalg import guarded_inverse

        if x[:1] != ["const"]:
            inv = guarded_inverse(self.sub(x))
            xy = self.sub(x, [y])[:, 0]
            b = inv @ xy
            return b, inv, float(max(0.0, self.sub([y])[0, 0] - b @ xy))
        at = [self.names.index(t) - 1 for t in x[1:]]
        k = self.names.index(y) - 1
        m, xy = self.mean[at], self.c[at, k]
        s = guarded_inverse(self.c[np.ix_(at, at)]) if at else np.zeros((0, 0))
        b = s @ xy
        inv = np.zeros((len(x), len(x)))
        inv[0, 0] = 1 / self.total + m @ s @ m
        inv[0, 1:] = inv[1:, 0] = -s @ m
        inv[1:, 1:] = s
        return np.concatenate(([self.mean[k] - b @ m], b)), inv, float(max(0.0, self.c[k, k] - b @ xy))
