"""Distributions and kernels against closed forms, dense solves and published values."""

import math

import numpy as np
import pytest

from macrolith.functions import dist
from macrolith.functions.linalg import guarded_inverse
from macrolith.operators import multivariate, series

RNG = np.random.default_rng(5)


@pytest.mark.parametrize(("got", "want"), [(dist.norm_ppf(0.975), 1.959963984540054), (dist.t_ppf(0.975, 10), 2.228138851986274), (dist.chi2_ppf(0.95, 5), 11.070497693516351), (dist.f_sf(4.964602743730711, 1, 10), 0.05), (dist.chi2_sf(2 * math.log(20), 2), 0.05), (dist.t_two_sided(1.0, 1), 0.5)])
def test_distributions(got, want):
    assert abs(got - want) < 1e-9


def test_guarded_inverse_of_a_singular_matrix():
    a = np.array([[1.0, 2], [2, 4]])
    assert np.allclose(a @ guarded_inverse(a) @ a, a)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 50])
def test_hp_against_dense_solve(n):
    y = RNG.normal(size=n).cumsum()
    d = np.diff(np.eye(n), 2, axis=0)
    assert np.allclose(series.hp(y, 1600.0), np.linalg.solve(np.eye(n) + 1600 * d.T @ d, y))
    assert (series.hp(y, 0) == y).all()


def test_pacf_against_regression():
    y = RNG.normal(size=500).cumsum() * 0.1 + RNG.normal(size=500)
    r = series.acf(y, 5)
    for k in range(1, 6):
        m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert abs(np.linalg.solve(m, r[1 : k + 1])[-1] - series.pacf(y, 5)[k - 1]) < 1e-10


def test_baxter_king_weights_sum_to_zero_and_pass_the_band():
    w = series.baxter_king_weights(6, 32, 40)
    full = np.concatenate((w[:0:-1], w))
    gain = lambda period: (full * np.cos(2 * np.pi * np.arange(-40, 41) / period)).sum()
    assert abs(full.sum()) < 1e-12 and abs(gain(12) - 1) < 0.1 and abs(gain(3)) < 0.1


def test_unit_root_tests_tell_a_walk_from_noise():
    e = RNG.normal(size=600)
    walk = e.cumsum()
    assert series.adf(e, 1)[0] < -10 < series.adf(walk, 1)[0]
    assert series.kpss(e)[0] < 0.463 < series.kpss(walk)[0]
    assert series.phillips_perron(e)[0] < -10


def test_critical_values_of_the_limit():
    assert np.allclose(series.critical_values("constant", 10**9), [-3.43035, -2.86154, -2.56677], atol=1e-5)


def test_garch_finds_its_process():
    h, e = 1.0, []
    for z in RNG.normal(size=3000):
        e.append(z * math.sqrt(h))
        h = 0.1 + 0.1 * e[-1] ** 2 + 0.8 * h
    p = series.garch(np.array(e))["params"]
    assert abs(p["alpha"] - 0.1) < 0.06 and abs(p["beta"] - 0.8) < 0.12


def test_arma_finds_its_process():
    e = RNG.normal(size=2000)
    y = np.zeros(2000)
    for k in range(1, 2000):
        y[k] = 0.6 * y[k - 1] + e[k] + 0.3 * e[k - 1]
    m = series.arma(y, 1, 1)
    assert abs(m["ar"][0] - 0.6) < 0.08 and abs(m["ma"][0] - 0.3) < 0.08


def test_var_recovers_coefficients_and_identities():
    a = np.array([[0.5, 0.1], [-0.2, 0.4]])
    y = np.zeros((3000, 2))
    for k in range(1, 3000):
        y[k] = a @ y[k - 1] + RNG.normal(size=2)
    m = multivariate.Var(y, 1)
    assert np.allclose(m.b[1:].T, a, atol=0.06) and m.roots[0] < 1
    assert np.allclose(m.impact() @ m.impact().T, m.sigma) and np.allclose(m.impact("long_run") @ m.impact("long_run").T, m.sigma)
    assert np.allclose(m.fevd(5).sum(2), 1)
    short = multivariate.Var(y[:60], 1)
    c, base = short.historical()
    assert np.allclose(c.sum(2) + base, y[1:60])
    long = np.linalg.inv(np.eye(2) - m.b[1:].T) @ m.impact("long_run")
    assert abs(long[0, 1]) < 1e-10


def test_beveridge_nelson_of_a_walk_is_the_walk():
    y = RNG.normal(size=3000).cumsum()
    t = series.beveridge_nelson(y, 1)
    assert np.nanmax(np.abs(t - y)) < 0.4


def test_quadratic_spectral_and_bartlett_agree_on_noise():
    x = RNG.normal(size=4000)
    assert abs(series.long_run_covariance(x, 3, "bartlett")[0, 0] - 1) < 0.15 and abs(series.long_run_covariance(x, 3, "quadratic_spectral")[0, 0] - 1) < 0.15


def test_vectorised_normal_quantile():
    from macrolith.functions.columns import norm_ppf_array

    p = np.array([1e-12, 1e-6, 0.01, 0.3, 0.5, 0.7, 0.999, 1 - 1e-9, 0.0, 1.0])
    z = norm_ppf_array(p)
    assert np.allclose([dist.norm_cdf(v) for v in z[:8]], p[:8], rtol=1e-9) and np.isnan(z[8:]).all()
