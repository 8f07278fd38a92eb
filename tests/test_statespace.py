"""The parallel scan gives what the serial filter and smoother give, with nulls, several observations and any number of stretches."""

import numpy as np
import pytest

from macrolith.operators import dynamics, statespace

PARTS = [1, 8]


@pytest.fixture(scope="module")
def walk(spark):
    r = np.random.default_rng(4)
    level = np.cumsum(r.normal(0, 0.5, 400))
    y = level + r.normal(0, 1.0, 400)
    y[[0, 5, 6, 7, 100, 399]] = np.nan
    y[200:230] = np.nan
    return y, spark.createDataFrame([(int(3 * k), None if np.isnan(v) else float(v)) for k, v in enumerate(y)], "t long, y double").repartition(5)


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("trend", [False, True])
def test_scan_equals_the_serial_filter_and_smoother(walk, parts, trend):
    y, df = walk
    m = statespace.local_trend(1.0, 0.25, 0.01, 0.3, 100.0) if trend else statespace.local_level(1.0, 0.25, 0.3, 100.0)
    for smooth, f in ((False, statespace.filtered), (True, statespace.smoothed)):
        _, mean, cov = dynamics.kalman(y, m.move, m.see[0], m.shock, m.error[0, 0], m.mean, m.cov, smooth)
        got = f(df, ["y"], "t", m, parts).orderBy("t", "state").toPandas()
        d = m.states
        assert np.allclose(got["mean"].to_numpy().reshape(-1, d), mean, atol=1e-8)
        assert np.allclose(got["variance"].to_numpy().reshape(-1, d), np.diagonal(cov, axis1=1, axis2=2), atol=1e-8)
    line = statespace.Line(df, ["y"], "t", parts)
    assert (len(line.sizes) > 1) == (parts > 1)
    ll = statespace.forward(m, y[:, None], None)[2]
    other = statespace.local_level(2.0, 0.1, 0.0, 50.0)
    assert np.allclose(line.log_likelihoods([m, other]), [ll, statespace.forward(other, y[:, None], None)[2]], atol=1e-8)


def test_likelihood_is_the_density_of_the_whole(spark):
    """Of all observations at once, by the covariance that the model implies."""
    r = np.random.default_rng(1)
    y = r.normal(size=(12, 2))
    y[3, 1] = y[7, 0] = y[7, 1] = np.nan
    move, see = np.array([[0.8, 0.1], [0.0, 0.5]]), np.array([[1.0, 0.0], [0.5, 1.0]])
    m = statespace.Model(move, see, np.diag([0.3, 0.2]), [[0.4, 0.1], [0.1, 0.5]], [0.5, -0.5], np.eye(2))
    mean, cov = [m.mean], [m.cov]
    for _ in range(11):
        mean.append(move @ mean[-1])
        cov.append(move @ cov[-1] @ move.T + m.shock)
    big = np.zeros((24, 24))
    for i in range(12):
        for j in range(i, 12):
            c = cov[i] @ np.linalg.matrix_power(move, j - i).T
            big[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = see @ c @ see.T + (m.error if i == j else 0)
            big[2 * j : 2 * j + 2, 2 * i : 2 * i + 2] = big[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].T
    ok = ~np.isnan(y.ravel())
    v = (y.ravel() - np.concatenate([see @ x for x in mean]))[ok]
    s = big[np.ix_(ok, ok)]
    want = -0.5 * (ok.sum() * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + v @ np.linalg.solve(s, v))
    df = spark.createDataFrame([(k, *[None if np.isnan(x) else float(x) for x in r_]) for k, r_ in enumerate(y)], "t int, a double, b double")
    for parts in (1, 3):
        assert abs(statespace.Line(df, ["a", "b"], "t", parts).log_likelihoods([m])[0] - want) < 1e-9
    mean, cov = statespace.Line(df, ["a", "b"], "t", 3).end(m)
    f = statespace.forward(m, y, None)
    assert np.allclose(mean, f[0][-1]) and np.allclose(cov, f[1][-1])
    got = statespace.forecast(df, ["a", "b"], "t", m, 2).collect()
    assert got[0].forecast == pytest.approx(float((see @ move @ mean)[0])) and len(got) == 4


def test_elements_combine_associatively():
    r = np.random.default_rng(2)
    m = statespace.local_trend(1.0, 0.5, 0.1)
    e = statespace.elements(m, r.normal(size=(3, 1)), False)
    one = [tuple(x[k] for x in e) for k in range(3)]
    a, b = statespace.combine(statespace.combine(one[0], one[1]), one[2]), statespace.combine(one[0], statespace.combine(one[1], one[2]))
    assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))


def test_estimates_are_at_the_top(spark, walk):
    y, df = walk
    build = lambda p: statespace.local_level(float(np.exp(p[0])), float(np.exp(p[1])), 0.0, 1e4)
    table, m = statespace.estimate(df, ["y"], "t", build, [0.0, 0.0], ["log_error", "log_level"], parts=4)
    best = statespace.forward(m, y[:, None], None)[2]
    p = [np.log(m.error[0, 0]), np.log(m.shock[0, 0])]
    for d in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)):
        assert statespace.forward(build(np.add(p, d)), y[:, None], None)[2] < best
    got = {r.term: r for r in table.collect()}
    assert abs(got["log_error"].estimate) < 4 * got["log_error"].std_error and abs(got["log_level"].estimate - np.log(0.25)) < 4 * got["log_level"].std_error


@pytest.mark.parametrize("parts", PARTS)
def test_estimation_from_variances_thousands_of_times_too_large(spark, parts):
    """The first steps lead to variances of zero, where there is no density; the likelihood flattens out as the level's variance vanishes."""
    y = 5 + 0.004 * np.random.default_rng(1).standard_normal(84)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "t int, y double")
    table, m = statespace.estimate(df, ["y"], "t", lambda p: statespace.local_level(float(np.exp(p[0])), float(np.exp(p[1])), 5.0, 1.0), [-3.0, -4.0], ["error", "level"], parts)
    got = {r.term: r.estimate for r in table.collect()}
    # The mean is estimated by the first state, which has a spread of its own.
    assert got["error"] == pytest.approx(np.log(y.var(ddof=1)), abs=2e-3) and got["level"] < -20
    assert m.error[0, 0] == pytest.approx(np.exp(got["error"]))


def test_observations_without_a_density_are_not_likely():
    for see in ([[1.0]], [[1.0], [1.0]]):
        m = statespace.Model([[1.0]], see, [[0.0]], np.zeros((len(see), len(see))), [0.0], [[0.0]])
        assert statespace.forward(m, np.ones((3, len(see))), None)[2] == -np.inf
