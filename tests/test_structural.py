"""Structural models against closed forms and plain versions."""

import math

import numpy as np
import pytest

from macrolith.operators import structural as st

#: Log utility and full depreciation: k(t) = alpha beta z k(t-1)^alpha exactly.
GROWTH = st.Model(["1 / c[t] = beta * alpha * exp(a[t+1]) * k[t]**(alpha - 1) / c[t+1]", "c[t] + k[t] = exp(a[t]) * k[t-1]**alpha", "a[t] = rho * a[t-1] + s * e[t]"], ["c", "k", "a"], ["e"], {"alpha": 0.3, "beta": 0.95, "rho": 0.8, "s": 0.01})
GUESS = {"c": 0.5, "k": 0.2, "a": 0.0}


def test_growth_model_has_its_closed_form():
    s = st.Solution(GROWTH, GUESS)
    k = (0.3 * 0.95) ** (1 / 0.7)
    assert s.determined and abs(s.steady[1] - k) < 1e-9
    assert np.allclose(s.g[1], [0, 0.3, 0.8 * k], atol=1e-9) and abs(s.h[1, 0] - 0.01 * k) < 1e-10
    v = s.covariance()
    assert np.allclose(v, s.g @ v @ s.g.T + s.h @ s.h.T) and abs(v[2, 2] - 1e-4 / (1 - 0.64)) < 1e-12


def test_indeterminate_model_is_told():
    weak = st.Model(["i[t] = phi * p[t]", "i[t] = p[t+1] + e[t]"], ["p", "i"], ["e"], {"phi": 1.5})
    assert st.Solution(weak, {"p": 0, "i": 0}).determined
    a, b, c, _ = st.linearize(weak.at(phi=0.9), np.zeros(2))
    assert st.stable_roots(a, b, c) == 3


@pytest.mark.parametrize("bad", ["y[t] = __import__('os')", "y[t] = y[t-2]", "y[t] = unknown", "y[t] = (1).real"])
def test_equations_take_arithmetic_only(bad):
    with pytest.raises(ValueError):
        st.Model([bad], ["y"], [], {})


def test_tables_and_simulation(spark):
    s = st.Solution(GROWTH, GUESS)
    assert st.solution_table(spark, s).count() == 3 and st.impulse_table(spark, s, 5).count() == 15
    assert {round(r.share, 9) for r in st.variance_shares(spark, s, 4).collect()} == {1.0}
    got = st.simulate(spark, s, 400, 20, seed=3).toPandas()
    assert abs(got.a.std() / math.sqrt(s.covariance()[2, 2]) - 1) < 0.1
    again = st.simulate(spark, s, 400, 20, seed=3).repartition(3).toPandas().sort_values(["replicate", "t"], ignore_index=True)
    assert got.sort_values(["replicate", "t"], ignore_index=True).equals(again)


def test_likelihood_of_an_autoregression(spark):
    m = st.Model(["y[t] = rho * y[t-1] + s * e[t]"], ["y"], ["e"], {"rho": 0.5, "s": 1.0})
    rng, y = np.random.default_rng(1), [0.0]
    for _ in range(299):
        y.append(0.7 * y[-1] + rng.normal())
    y = np.array(y)
    plain = lambda r: -0.5 * (math.log(2 * math.pi / (1 - r * r)) + y[0] ** 2 * (1 - r * r)) - 0.5 * sum(math.log(2 * math.pi) + (b - r * a) ** 2 for a, b in zip(y, y[1:]))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t int, y double")
    got = {r.rho: r.log_likelihood for r in st.likelihoods(df, m, spark.createDataFrame([(0.5,), (0.7,), (1.2,)], "rho double"), ["y"], guess={"y": 0}).collect()}
    assert abs(got[0.5] - plain(0.5)) < 1e-8 and abs(got[0.7] - plain(0.7)) < 1e-8 and got[1.2] is None
    grid = np.linspace(0.2, 0.9, 141)
    p = np.array([plain(r) + st.log_prior("beta", 0.5, 0.2, r) for r in grid])
    p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
    mean = p @ grid
    draws = st.posterior(df, m, {"rho": ("beta", 0.5, 0.2)}, ["y"], draws=400, burn=150, chains=2, guess={"y": 0})
    r = st.posterior_summary(draws, ["rho"]).first()
    assert abs(r["mean"] - mean) < 0.02 and abs(r["sd"] / math.sqrt(p @ grid**2 - mean**2) - 1) < 0.35 and r.r_hat < 1.1


def test_priors_integrate_to_one():
    x = np.linspace(-8, 12, 400_001)
    for kind, mean, sd in (("normal", 1, 0.5), ("gamma", 2, 0.8), ("beta", 0.4, 0.1), ("uniform", 1, 0.5)):
        p = np.exp([st.log_prior(kind, mean, sd, v) for v in x[::20]])
        step = x[20] - x[0]
        assert abs(p.sum() * step - 1) < 2e-3 and abs((p * x[::20]).sum() * step - mean) < 5e-3


@pytest.mark.parametrize("chain", [st.rouwenhorst, st.tauchen])
def test_chains_keep_the_moments(chain):
    x, t = chain(0.8, 0.1, 15)
    p = st.stationary(t)
    assert np.allclose(t.sum(1), 1) and abs(p @ x) < 1e-9
    assert abs(math.sqrt(p @ x**2) / (0.1 / 0.6) - 1) < 0.05 and abs((p * x) @ t @ x / (p @ x**2) - 0.8) < 0.02


def test_aiyagari_clears_and_saves_for_caution(spark):
    e = st.aiyagari(states=3, points=80, top=60, tol=1e-4)
    assert e["r"] < 1 / 0.96 - 1 and abs(e["supply"] / e["capital"] - 1) < 0.05 and abs(e["mass"].sum() - 1) < 1e-6
    assert 0 < st.gini(e["grid"], e["mass"].sum(1)) < 1 and st.wealth_table(spark, e).count() == 80
    p = st.simulate_panel(spark, e, 300, 40).toPandas()
    assert len(p) == 12_000 and abs(p.assets.mean() / e["capital"] - 1) < 0.2


def test_perpetual_youth(spark):
    m, at = st.perpetual_youth()
    s = st.Solution(m, at)
    r = 0.36 * at["k"] ** -0.64 - 0.08
    assert s.determined and abs(s.steady[1] - at["k"]) < 1e-6 and r > 1 / 0.96 - 1
    assert st.perpetual_youth(debt=0.5)[1]["k"] < at["k"]
    assert abs(0.36 * st.perpetual_youth(gamma=1.0)[1]["k"] ** -0.64 - 0.08 - (1 / 0.96 - 1)) < 1e-12
    path = st.transition(spark, s, {"k": 0.8 * at["k"]}, 60).orderBy("t").toPandas().k
    assert path.is_monotonic_increasing and abs(path.iloc[-1] / at["k"] - 1) < 0.05


def test_bound_binds_as_long_as_the_rule_lies_beyond_it():
    m = st.Model(["y[t] = y[t+1] - 0.5 * (i[t] - p[t+1]) + g[t]", "p[t] = 0.95 * p[t+1] + 0.1 * y[t]", "i[t] = 1.5 * p[t] + 0.3 * y[t]", "g[t] = 0.8 * g[t-1] + e[t]"], ["y", "p", "i", "g"], ["e"], {})
    s = st.Solution(m, dict.fromkeys(m.variables, 0.0))
    free, none = st.bounded_path(s, "i", -9.0, None, {"e": -1.0}, 40)
    assert not none.any() and np.allclose(free, s.impulse(40)[:, :, 0] * -1, atol=1e-9)
    y, binds = st.bounded_path(s, "i", -0.2, None, {"e": -1.0}, 40)
    rule = 1.5 * y[:, 1] + 0.3 * y[:, 0]
    assert binds[0] and not binds[-1] and np.allclose(y[:, 2], np.maximum(rule, -0.2), atol=1e-9)
    assert np.allclose(y[:-1, 0], y[1:, 0] - 0.5 * (y[:-1, 2] - y[1:, 1]) + y[:-1, 3], atol=1e-9) and y[0, 0] < free[0, 0]
    top, _ = st.bounded_path(s, "i", None, 0.2, {"e": 1.0}, 40)
    assert np.allclose(top, -y, atol=1e-9)


def test_smoother_against_one_large_regression(spark):
    m = st.Model(["y[t] = 0.6 * y[t-1] + u[t] + e[t]", "u[t] = 0.9 * u[t-1] + 0.3 * v[t]"], ["y", "u"], ["e", "v"], {})
    s = st.Solution(m, {"y": 0, "u": 0})
    y = np.random.default_rng(5).normal(size=(12, 1))
    y[4] = np.nan
    levels, e = st.smoothed(s, y, ["y"], 0.1)
    # Joint covariance of all states, then the conditional mean.
    v, n = s.covariance(), len(y)
    power = [np.linalg.matrix_power(s.g, k) for k in range(n)]
    joint = np.block([[power[a - b] @ v if a >= b else v @ power[b - a].T for b in range(n)] for a in range(n)])
    seen = [2 * t for t in range(n) if t != 4]
    want = joint[:, seen] @ np.linalg.solve(joint[np.ix_(seen, seen)] + 0.1 * np.eye(n - 1), y[np.isfinite(y)])
    assert np.allclose(levels.ravel(), want, atol=1e-8)
    assert np.allclose(levels[1:], levels[:-1] @ s.g.T + e[1:] @ s.h.T, atol=1e-7)
    df = spark.createDataFrame([(t, None if t == 4 else float(y[t, 0])) for t in range(n)], "t int, y double")
    got = st.shock_contributions(df, s, ["y"], noise=0.1).groupBy("t", "variable").sum("value").toPandas().pivot(index="t", columns="variable", values="sum(value)")
    assert np.allclose(got[["y", "u"]], levels, atol=1e-9)
