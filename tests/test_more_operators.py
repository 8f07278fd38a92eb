"""Likelihood models, dynamics and expectations against simulated truth or plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from macrolith.operators import choice, describe, dynamics, limited, panels

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def data(spark):
    n = 3000
    x = RNG.normal(size=n)
    e = RNG.normal(size=n)
    star = 0.5 + x + e
    u = RNG.logistic(size=n)
    g = np.searchsorted([-1, 0.5, 1.5], 0.8 * x + u)
    noise = RNG.gumbel(size=(n, 3)) + np.column_stack([np.zeros(n), 0.5 + x, -0.5 * x])
    p = pd.DataFrame({"x": x, "c": np.maximum(star, 0), "s": star, "g": g, "m": noise.argmax(1), "y": 1 + 2 * x + RNG.standard_t(2, size=n)})
    p["w"] = RNG.normal(size=n)
    p["d"] = (0.3 + p.w + RNG.normal(size=n) > 0).astype(float)
    return spark.createDataFrame(p)


def table(df):
    return {r.term: r.estimate for r in df.collect()}


def test_ordered_logit_and_multinomial(data):
    t = table(limited.ordered(data, "g", ["x"]))
    assert abs(t["x"] - 0.8) < 0.15 and abs(t["cut1"] + 1) < 0.2 and abs(t["cut3"] - 1.5) < 0.2
    m = table(limited.multinomial(data, "m", ["x"]))
    assert abs(m["1:x"] - 1) < 0.2 and abs(m["2:x"] + 0.5) < 0.2 and abs(m["1:const"] - 0.5) < 0.2


def test_tobit_and_truncated(data):
    t = table(limited.tobit(data, "c", ["x"]))
    assert abs(t["const"] - 0.5) < 0.1 and abs(t["x"] - 1) < 0.1 and abs(t["sigma"] - 1) < 0.1
    t = table(limited.truncated(data, "s", ["x"], 0.0))
    assert abs(t["const"] - 0.5) < 0.2 and abs(t["x"] - 1) < 0.15 and abs(t["sigma"] - 1) < 0.15


def test_robust_regression_and_selection(data):
    f = limited.robust_regression(data, "y", ["x"], "bisquare")
    assert abs(f.b[1] - 2) < 0.1 and 0.01 < math.sqrt(f.v[1, 1]) < 0.1
    assert set(table(limited.select_variables(data, "s", ["x", "w"], "best"))) == {"const", "x"}
    assert table(limited.select_variables(data, "s", ["x", "w"], "forward")) == table(limited.select_variables(data, "s", ["x", "w"], "backward"))


def test_heckman_without_selection_effect_finds_the_slope(data):
    t = table(limited.heckman(data, "s", ["x"], "d", ["w"]))
    assert abs(t["x"] - 1) < 0.1 and abs(t["lambda"]) < 0.25


def test_gmm_with_equal_numbers_is_iv(data):
    t = table(limited.gmm(data, "s", ["x"], ["x"]))
    assert abs(t["x"] - 1) < 0.1 and t["j_stat"] < 1e-8


def test_recursive_residuals_add_up():
    x = np.column_stack([np.ones(60), RNG.normal(size=60)])
    y = x @ [1, 2] + RNG.normal(size=60)
    w = dynamics.recursive_residuals(y, x)
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert abs(w @ w - e @ e) < 1e-8


def test_kalman_with_a_known_level_is_the_running_mean():
    y = RNG.normal(size=50)
    _, a, _ = dynamics.kalman(y, np.eye(1), np.ones(1), np.zeros((1, 1)), 1.0, np.zeros(1), np.eye(1) * 1e9)
    assert np.allclose(a[:, 0], np.cumsum(y) / np.arange(1, 51), atol=1e-6)


def test_markov_switching_tells_two_regimes():
    s = np.repeat([0, 1, 0, 1], 150)
    m = dynamics.markov_switching(np.where(s == 1, 3.0, -1.0) + RNG.normal(size=600))
    assert abs(m["mu"][0] + 1) < 0.3 and abs(m["mu"][1] - 3) < 0.3 and ((m["smoothed"][:, 1] > 0.5) == s).mean() > 0.97


def test_breaks_are_found(spark):
    y = np.concatenate((RNG.normal(size=60), 4 + RNG.normal(size=60)))
    d = spark.createDataFrame(pd.DataFrame({"t": range(120), "y": y}))
    assert abs(dynamics.sup_f(d, "y", [], "t").first()["at"] - 60) <= 2
    rows = dynamics.bai_perron(d, "y", "t", 2).collect()
    assert min(rows, key=lambda r: r.bic).breaks == 1 and abs(int(rows[1].dates) - 60) <= 2
    assert abs(dynamics.zivot_andrews(d, "y", "t").first()["at"] - 60) <= 3


def test_explosive_series_is_told_from_a_walk(spark):
    walk = RNG.normal(size=100).cumsum()
    bubble = walk.copy()
    for k in range(60, 80):
        bubble[k] = bubble[k - 1] * 1.1 + 1
    d = spark.createDataFrame(pd.DataFrame({"s": ["w"] * 100 + ["b"] * 100, "t": list(range(100)) * 2, "y": np.concatenate((walk, bubble))}))
    got = {(r.s, r.test): r.statistic for r in dynamics.explosive(d, "y", "t", 20, "s").collect()}
    assert got["b", "gsadf"] > 2.5 and got["b", "gsadf"] > got["w", "gsadf"]


def test_linear_expectations():
    for b, r in ((0.5, 0.8), (0.95, 0.9)):
        g, h = dynamics.solve_linear(np.array([[b, 0], [0, 0.0]]), np.array([[-1.0, 1], [0, -1]]), np.array([[0, 0], [0, r]]), np.array([[0.0], [1]]))
        assert np.allclose(h[0, 0], 1 / (1 - b * r)) and np.allclose(g, [[0, r / (1 - b * r)], [0, r]])


def test_long_memory_of_noise_is_none(spark):
    d = spark.createDataFrame(pd.DataFrame({"t": range(2000), "y": RNG.normal(size=2000)}))
    r = dynamics.gph(d, "y", "t").first()
    assert abs(r.d) < 3 * r.std_error


@pytest.mark.parametrize("n", [11, 120_001])
def test_siegel_tukey_of_many_rows_equals_ranks_dealt_one_by_one(spark, n):
    """Squares of half the rows of the longer table are beyond an integer."""
    y = np.arange(n) * 7919 % (n // 2)
    g = np.where(np.sin(np.arange(n)) > 0.2 - 1e-6 * y, "b", "a")
    place = np.arange(1, n + 1)
    top = n + 1 - place
    rank = np.where(place <= (n + 1) // 2, np.where(place % 2 == 1, 2 * place - 1, 2 * place), np.where(top % 2 == 1, 2 * top, 2 * top - 1)).astype(float)
    at = np.argsort(y, kind="stable")
    s = pd.DataFrame({"y": y[at], "s": rank}).groupby("y").s.transform("mean").to_numpy()
    own = g[at] == "a"
    want = (s[own].sum() - own.sum() * s.mean()) / np.sqrt(s.var() * own.sum() * (~own).sum() / (n - 1))
    got = choice.siegel_tukey(spark.createDataFrame(pd.DataFrame({"y": y.astype(float), "g": g})), "y", "g").first()
    assert got.statistic == pytest.approx(want, abs=1e-9)


def jittered(spark, v):
    """Rows whose values differ in a late digit whenever they are computed again, as sums of doubles do whose parts arrive in another order."""
    noise = F.udf(lambda x: x + float(np.random.default_rng().uniform(-1, 1)) * 1e-9, "double").asNondeterministic()
    return spark.createDataFrame([(int(k), float(x)) for k, x in enumerate(v)], "k long, v double").withColumn("a", noise("v"))


def test_ranks_keep_rows_whose_values_differ_from_run_to_run(spark):
    v = np.array([3.0, -1.5, 4.25, -2.0, 6.0, 0.5, -7.5, 8.0, 9.5, -0.25])
    d = jittered(spark, v).withColumn("zero", F.lit(0.0))
    r = pd.Series(np.abs(v)).rank().to_numpy()
    want = (r[v > 0].sum() - len(v) * (len(v) + 1) / 4) / np.sqrt((r * r).sum() / 4)
    assert choice.signed_rank(d, "a", "zero").first().statistic == pytest.approx(want, abs=1e-9)
    ranks = describe.rank_average(d, "a", "r").select("k", "r").toPandas().set_index("k").r
    assert np.allclose(ranks.reindex(range(len(v))), pd.Series(v).rank())


@pytest.mark.parametrize("link", ["logit", "probit"])
def test_unit_means_models_compute_their_panel_once(spark, link):
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v

    r = np.random.default_rng(8)
    cells = [(u, t, float(r.normal() + u % 3), float(r.normal())) for u in range(12) for t in range(8)]
    d = spark.createDataFrame(cells, "u int, t int, x double, e double").withColumn("x", F.udf(count, "double").asNondeterministic()("x")).withColumn("y", (F.col("x") - 1 + F.col("e") > 0).cast("double"))
    got = {c.term: c.estimate for c in panels.panel_binary(d, "y", ["x"], "u", "t", link, "cre", 4).collect()}
    assert seen.value == len(cells)
    assert list(got) == ["const", "x", "mean_x", "sigma_u"] and got["x"] > 0.5


@pytest.mark.parametrize("model", ["tobit", "heckman"])
def test_own_derivatives_equal_differences_and_replace_them(spark, model, monkeypatch):
    """No pass takes differences, whose cost a row grows with the square of the parameters."""
    from macrolith.plans import likelihood

    held, numeric = {}, likelihood._derivatives

    def keep(df, columns, log, theta, *args, derivatives=None, **more):
        held.update(log=log, derivatives=derivatives, columns=columns)
        monkeypatch.setattr(likelihood, "_derivatives", None)
        return likelihood.maximise(df, columns, log, theta, *args, derivatives=derivatives, **more)

    r = np.random.default_rng(12)
    n = 2000
    x, z, e = r.normal(size=(3, n))
    s = (0.3 + 0.5 * x + z + 0.6 * e + 0.8 * r.normal(size=n) > 0).astype(float)
    y = 1 + 2 * x + 1.5 * e
    d = spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "s": s, "y": y, "c": np.clip(y, 0, 3)}))
    if model == "tobit":
        monkeypatch.setattr(limited, "maximise", keep)
        got = limited.tobit(d, "c", ["x"], 0.0, 3.0)
        v, points = np.column_stack([np.clip(y, 0, 3), x]), ([1.0, 2.0, 0.4], [0.2, -0.5, -0.3])
        truth = {"const": 1, "x": 2, "sigma": 1.5}
    else:
        monkeypatch.setattr(choice, "maximise", keep)
        got = choice.heckman_ml(d.withColumn("y", F.when(F.col("s") > 0, F.col("y"))), "y", ["x"], "s", ["x", "z"])
        v, points = np.column_stack([np.where(s > 0, y, 0), s, x, z]), ([1.0, 2.0, 0.3, 0.5, 1.0, 0.4, 0.6], [0.5, 1.0, -0.3, 0.2, 0.4, 0.1, -0.9])
        truth = {"const": 1, "x": 2, "s:z": 1, "sigma": 1.5, "rho": 0.6}
    assert held["columns"][:2] == (["c", "x"] if model == "tobit" else ["_y", "s"])
    for p in points:
        a, b = held["derivatives"](np.array(p), v), numeric(held["log"], np.array(p), v)
        assert np.allclose(a, b, rtol=1e-5, atol=2e-3)
    found = {c.term: c.estimate for c in got.collect()}
    assert all(abs(found[k] - t) < 0.15 for k, t in truth.items())
