"""Further operators against simulated truth or plain versions."""

import math

import numpy as np
import pandas as pd
import pytest

from macrolith.operators import further

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def dynamic(spark):
    rows = []
    for u in range(200):
        a, y = RNG.normal(), 0.0
        for t in range(-10, 8):
            x = RNG.normal()
            y = 0.5 * y + 0.8 * x + a + RNG.normal() * 0.5
            if t >= 0:
                rows.append((u, t, y, x, x + RNG.normal() * 0.3))
    return spark.createDataFrame(rows, "u int, t int, y double, x double, z double")


def test_difference_gmm_finds_the_lag(dynamic):
    got = {r.term: r.estimate for r in further.difference_gmm(dynamic, "y", ["x"], "u", "t").collect()}
    assert abs(got["y_l1"] - 0.5) < 0.08 and abs(got["x"] - 0.8) < 0.08 and got["hansen_j"] < 15


def test_panel_iv_against_numpy(dynamic):
    p = dynamic.toPandas()
    w = p[["y", "x", "z"]] - p.groupby("u")[["y", "x", "z"]].transform("mean")
    r = further.panel_iv(dynamic, "y", [], ["x"], ["z"], "u").first()
    assert abs(r.estimate - (w.z @ w.y) / (w.z @ w.x)) < 1e-9
    s = (w.z * (w.y - r.estimate * w.x)).groupby(p.u).sum()
    assert abs(r.std_error - math.sqrt((s @ s) * 200 / 199) / abs(w.z @ w.x)) < 1e-9


def test_stationary_panels_are_told_from_walks(spark):
    frame = lambda f: spark.createDataFrame([(u, t, float(v)) for u in range(20) for t, v in enumerate(f(RNG.normal(size=80)))], "u int, t int, y double")
    noise, walk = frame(lambda e: e), frame(np.cumsum)
    t = lambda d: {r.statistic: r.value for r in further.levin_lin_chu(d, "y", "u", "t").collect()}["t"]
    assert t(noise) < -20 < t(walk)
    assert further.hadri(noise, "y", "u", "t").first().z < 4 < further.hadri(walk, "y", "u", "t").first().z
    assert further.cips(noise, "y", "u", "t").first().cips < -4 < further.cips(walk, "y", "u", "t").first().cips


def test_cointegrated_system(spark):
    x = RNG.normal(size=400).cumsum()
    e = np.zeros(400)
    for k in range(1, 400):
        e[k] = 0.4 * e[k - 1] + RNG.normal()
    d = spark.createDataFrame(pd.DataFrame({"t": range(400), "y": 2 * x + e, "x": x}))
    got = {(r.matrix, r.row): r.value for r in further.vecm(d, ["y", "x"], "t", 2, 1).collect()}
    assert abs(got["beta", "x"] + 2) < 0.1 and got["alpha", "y"] < -0.2
    assert further.phillips_ouliaris(d, "y", ["x"], "t").first().z_t < -6


def test_midas_finds_the_total_effect(spark):
    x = RNG.normal(size=900)
    w = further.midas_weights(np.array([0.3, -0.15]), 6)
    low = [(t, float(1 + 2 * w @ x[3 * t + 2 - np.arange(6)] + RNG.normal() * 0.05)) for t in range(2, 300)]
    h = spark.createDataFrame(pd.DataFrame({"t": range(900), "x": x}))
    got = {r.term: r.estimate for r in further.midas(spark.createDataFrame(low, "t int, y double"), h, "y", "x", "t", 3).collect()}
    assert abs(got["slope"] - 2) < 0.05 and abs(got["const"] - 1) < 0.05
    free = {r.term: r.estimate for r in further.midas(spark.createDataFrame(low, "t int, y double"), h, "y", "x", "t", 3, 6, "unrestricted").collect()}
    assert abs(sum(v for k, v in free.items() if k != "const") - 2) < 0.1


def test_smoothers(spark):
    x = np.sort(RNG.uniform(0, 1, 300))
    d = spark.createDataFrame(pd.DataFrame({"x": x, "y": 3 * x - 1}))
    for got in (further.lowess(d, "y", "x"), further.kernel_regression(d, "y", "x")):
        p = got.toPandas()
        assert np.allclose(p.fitted, 3 * p.x - 1, atol=1e-6)


def test_factors_fill_a_rank_one_table():
    x = np.outer(np.arange(1, 30), [1.0, 2, -1]) + 5
    hole = x.copy()
    hole[-2:, 0] = np.nan
    assert np.abs(further.factor_fill(hole, 1)[0] - x)[-2:, 0].max() < 6


def test_volatility_identification_recovers_the_impact(spark):
    b = np.array([[1.0, 0.4], [-0.5, 1.0]])
    s = np.repeat([0, 1], 3000)
    e = RNG.normal(size=(6000, 2)) * np.where(s[:, None] == 1, [3.0, 1.0], [1.0, 1.0])
    y = np.zeros((6000, 2))
    for k in range(1, 6000):
        y[k] = 0.3 * y[k - 1] + b @ e[k]
    d = spark.createDataFrame(pd.DataFrame({"t": range(6000), "a": y[:, 0], "b": y[:, 1], "s": s.astype(float)}))
    got = {(r.variable, r.shock): r.value for r in further.identify_by_volatility(d, ["a", "b"], "t", "s").where("horizon = 1").collect()}
    assert abs(got["a", "a"] - 1) < 0.1 and abs(got["b", "a"] + 0.5) < 0.1


def test_independent_components_recover_the_impact(spark):
    b = np.array([[1.0, 0.4], [-0.5, 1.0]])
    e = RNG.laplace(size=(6000, 2)) / math.sqrt(2)
    d = spark.createDataFrame(pd.DataFrame(e @ b.T, columns=["a", "b"]).assign(t=range(6000)))
    got = {(r.variable, r.shock): r.value for r in further.identify_by_independence(d, ["a", "b"], "t").where("horizon = 1").collect()}
    assert abs(got["a", "a"] - 1) < 0.12 and abs(got["b", "a"] + 0.5) < 0.12


def test_perfect_foresight_growth_path():
    alpha, beta = 0.33, 0.95
    k1 = (alpha * beta) ** (1 / (1 - alpha))

    def f(a, b, c, x):
        c0, c1 = a[0] ** alpha - b[0], b[0] ** alpha - c[0]
        return np.array([c1 - beta * alpha * b[0] ** (alpha - 1) * c0])

    path = further.perfect_foresight(f, np.array([0.5 * k1]), np.array([k1]), np.zeros((40, 1)))
    want = [0.5 * k1]
    for _ in range(5):
        want.append(alpha * beta * want[-1] ** alpha)
    assert np.allclose(path[:6, 0], want, atol=1e-6)


def test_doubly_robust_effect(spark):
    n = 4000
    x = RNG.normal(size=n)
    w = (RNG.uniform(size=n) < 1 / (1 + np.exp(-x))).astype(float)
    d = spark.createDataFrame(pd.DataFrame({"x": x, "w": w, "y": 1.5 * w + 2 * x + RNG.normal(size=n)}))
    r = further.propensity_projection(d, "y", "w", ["x"]).first()
    assert abs(r.ate_aipw - 1.5) < 0.15 and abs(r.ate_ipw - 1.5) < 0.3
