"""Input-output analysis. Tables are coordinate rows (i, j, value); a dense table of sectors is small and solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .describe import rows

#: Sectors up to which a table is solved densely.
DENSE = 5000


class Table:
    """Z (i, j, value), final demand Y (i, value); gross output x is the row sum of both."""

    def __init__(self, z: DataFrame, y: DataFrame):
        self.z, self.y, self.spark = z, y, z.sparkSession
        names = z.select("i").union(z.select(F.col("j").alias("i"))).union(y.select("i")).distinct().limit(DENSE + 1).collect()
        if len(names) > DENSE:
            raise ValueError(f"more than {DENSE} sectors")
        self.names = sorted(r.i for r in names)
        at = {n: k for k, n in enumerate(self.names)}
        n = len(at)
        self.Z, self.Y = np.zeros((n, n)), np.zeros(n)
        place = lambda c: c.to_pandas().map(at).to_numpy()
        got = z.groupBy("i", "j").agg(F.sum("value").cast("double").alias("v")).toArrow()
        self.Z[place(got["i"]), place(got["j"])] = got["v"].to_numpy()
        got = y.groupBy("i").agg(F.sum("value").cast("double").alias("v")).toArrow()
        self.Y[place(got["i"])] = got["v"].to_numpy()
        self.x = self.Z.sum(1) + self.Y

    @property
    def A(self) -> np.ndarray:
        return np.divide(self.Z, self.x[None, :], out=np.zeros_like(self.Z), where=self.x[None, :] != 0)

    @property
    def B(self) -> np.ndarray:
        """Allocation coefficients (Ghosh)."""
        return np.divide(self.Z, self.x[:, None], out=np.zeros_like(self.Z), where=self.x[:, None] != 0)

    @property
    def L(self) -> np.ndarray:
        return np.linalg.inv(np.eye(len(self.x)) - self.A)

    @property
    def G(self) -> np.ndarray:
        return np.linalg.inv(np.eye(len(self.x)) - self.B)

    def matrix(self, m: np.ndarray) -> DataFrame:
        return rows(self.spark, [{"i": a, "j": b, "value": float(m[p, q])} for p, a in enumerate(self.names) for q, b in enumerate(self.names)], f"i {self._kind}, j {self._kind}, value double")

    @property
    def _kind(self) -> str:
        return self.z.schema["i"].dataType.simpleString()

    def vector(self, **columns: np.ndarray) -> DataFrame:
        return rows(self.spark, [{"i": n} | {k: float(v[p]) for k, v in columns.items()} for p, n in enumerate(self.names)], f"i {self._kind}, " + ", ".join(f"{k} double" for k in columns))

    def multipliers(self) -> DataFrame:
        return self.vector(output_multiplier=self.L.sum(0), input_multiplier=self.G.sum(1))

    def linkages(self) -> DataFrame:
        """Backward and forward, divided by their mean."""
        b, f = self.L.sum(0), self.G.sum(1)
        return self.vector(backward=b / b.mean(), forward=f / f.mean())

    def extraction(self) -> DataFrame:
        """Output lost when a sector's links go."""
        out = []
        for k in range(len(self.x)):
            a, y = self.A.copy(), self.Y.copy()
            a[k], a[:, k], y[k] = 0, 0, 0
            out.append(self.x.sum() - np.linalg.solve(np.eye(len(a)) - a, y).sum())
        return self.vector(loss=np.array(out), share=np.array(out) / self.x.sum())

    def extension(self, use: DataFrame) -> dict:
        """Use of a resource by sector (i, value) per unit of output: the intensities that footprint() takes."""
        got = {r.i: r.v for r in use.groupBy("i").agg(F.sum("value").alias("v")).collect()}
        return {n: got.get(n, 0.0) / x if x else 0.0 for n, x in zip(self.names, self.x, strict=True)}

    def domar_weights(self) -> DataFrame:
        """Gross output over the sum of final demand."""
        return self.vector(weight=self.x / self.Y.sum())

    def productivity(self, theta: float = 1.0, sigma: float = 1.0) -> DataFrame:
        """Effects of productivity on real income: first order (Domar weights), own second order from cost shares under substitution elasticities of sectors (theta) and demand (sigma), influence, upstreamness, downstreamness."""
        omega = self.A.T  # row: a buyer's cost shares
        psi = np.linalg.inv(np.eye(len(self.x)) - omega)
        b = self.Y / self.Y.sum()
        weight = self.x / self.Y.sum()
        cov = lambda share, v: share @ (v * v) - (share @ v) ** 2
        second = np.array([(sigma - 1) * cov(b, psi[:, k]) + (theta - 1) * sum(weight[j] * cov(omega[j] / max(omega[j].sum(), 1e-300), psi[:, k]) * omega[j].sum() for j in range(len(b))) for k in range(len(b))])
        return self.vector(first=weight, second=second, influence=b @ psi, upstream=self.G.sum(1), downstream=self.L.sum(0))

    def footprint(self, intensity: dict) -> DataFrame:
        """Satellite use by final demand of each sector, per unit output given."""
        f = np.array([intensity.get(n, 0.0) for n in self.names])
        return self.vector(production=f * self.x, consumption=(f @ self.L) * self.Y)


def technical_coefficients(z: DataFrame, y: DataFrame) -> DataFrame:
    """i, j, value: native, for tables of any size."""
    x = z.select("i", "value").union(y.select("i", "value")).groupBy("i").agg(F.sum("value").alias("x"))
    return z.groupBy("i", "j").agg(F.sum("value").alias("z")).join(x.withColumnRenamed("i", "j"), "j").select("i", "j", (F.col("z") / F.col("x")).alias("value"))


def decomposition(a: Table, b: Table) -> DataFrame:
    """i, technology, demand: the change of output from a to b, mean of both polar forms."""
    dl, dy = b.L - a.L, b.Y - a.Y
    return a.vector(technology=0.5 * (dl @ a.Y + dl @ b.Y), demand=0.5 * (a.L @ dy + b.L @ dy))


def decomposition_ratio(a: Table, b: Table) -> DataFrame:
    """i, technology, demand: factors whose product is the ratio of output in b to a, geometric mean of both polar forms."""
    mixed, other = b.L @ a.Y, a.L @ b.Y
    old, new = a.L @ a.Y, b.L @ b.Y
    with np.errstate(all="ignore"):
        return a.vector(technology=np.sqrt(mixed / old * new / other), demand=np.sqrt(other / old * new / mixed))


def balance(z: DataFrame, row: dict, column: dict, steps: int = 1000, tol: float = 1e-12) -> DataFrame:
    """RAS: rows and columns scaled in turn to given totals."""
    t = Table(z, z.select("i", F.lit(0.0).alias("value")))
    m = t.Z.copy()
    r, c = np.array([row[n] for n in t.names], float), np.array([column[n] for n in t.names], float)
    for _ in range(steps):
        m *= np.divide(r, m.sum(1), out=np.ones_like(r), where=m.sum(1) != 0)[:, None]
        m *= np.divide(c, m.sum(0), out=np.ones_like(c), where=m.sum(0) != 0)[None, :]
        if np.abs(m.sum(1) - r).max() <= tol * r.max():
            break
    return t.matrix(m)
