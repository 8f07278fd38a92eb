"""Kernels of the further operators against closed forms, simulated truth, or a plain version."""

import math

import numpy as np
import pytest

from macrolith.operators import arima, factors, identification, moments, panels, projections, seasonal, structural, structural_more, systems, trends, unitroots, vectors, volatility
from macrolith.operators.multivariate import Var

RNG = np.random.default_rng(5)


def cointegrated(n=300):
    w = np.cumsum(RNG.normal(size=n))
    return np.column_stack([w + RNG.normal(size=n) * 0.4, 0.5 * w + RNG.normal(size=n) * 0.4, np.cumsum(RNG.normal(size=n))])


def test_error_correction_and_its_level_form():
    y = cointegrated()
    m = vectors.Vecm(y, 2, 1)
    v = m.to_var()
    assert np.abs(v.u - m.u).max() < 1e-10 and abs(m.beta[1, 0] + 2) < 0.2 and m.select_rank() == 1
    none = np.eye(3)
    assert abs(m.joint_restriction(none, none)[1]) < 1e-6
    cut = np.eye(3)[:, :2]
    joint = m.joint_restriction(cut, cut)
    assert joint[2] == 2 and joint[1] >= max(m.beta_restriction(cut)[1], m.alpha_restriction(cut)[1]) - 1e-6
    assert m.known_beta(m.beta)[1] < 1e-8
    c, base = v.historical()
    assert np.abs(c.sum(2) + base - y[2:]).max() < 1e-8


def test_posterior_centres_on_least_squares_without_a_prior():
    y = np.diff(cointegrated(), axis=0)
    p = vectors.Posterior(y, 1, None)
    assert np.abs(p.b - Var(y, 1).b).max() < 1e-10
    mean = np.mean([p.draw(np.random.default_rng(k))[0] for k in range(400)], axis=0)
    assert np.abs(mean - p.b).max() < 0.05


@pytest.mark.parametrize("method", ["jade", "dcov", "student_t", "mixture_normal", "pml"])
def test_independent_shocks_are_found(method):
    rng = np.random.default_rng(1)
    e = rng.standard_t(3, size=(3000 if method in ("jade", "student_t", "pml", "mixture_normal") else 500, 2)) / math.sqrt(3)
    a = np.array([[1.0, 0.5], [-0.4, 1.0]])
    u = e @ a.T
    c = np.linalg.cholesky(np.cov(u.T, bias=True))
    z = np.linalg.solve(c, (u - u.mean(0)).T).T
    got = identification.ordered(c @ identification.METHODS[method](z))
    got = got / np.abs(got).max(0) * np.abs(a).max(0)
    assert np.abs(got - a).max() < 0.25


def test_zero_restrictions_hold_and_rotations_are_rotations():
    m = Var(np.diff(cointegrated(), axis=0), 1)
    phi, c = m.moving_average(4), m.impact()
    q = identification.zero_sign_rotation(phi, c, [(0, 1, 0), (1, 2, 1)], np.random.default_rng(0))
    assert np.abs(q.T @ q - np.eye(3)).max() < 1e-10 and abs((phi[0] @ c @ q)[0, 1]) < 1e-10 and abs((phi[1] @ c @ q)[1, 2]) < 1e-10
    b, w = identification.two_covariances(np.array([[2, 0.3], [0.3, 1]]), np.array([[3, 0.1], [0.1, 4]]))
    assert np.allclose(b @ b.T, [[2, 0.3], [0.3, 1]]) and np.allclose(b @ np.diag(w) @ b.T, [[3, 0.1], [0.1, 4]])


def test_splines_add_up_to_one_and_smoothing_keeps_lines():
    b = projections.bspline(np.arange(13), 3, 4)
    assert np.abs(b.sum(1) - 1).max() < 1e-12
    line = 0.3 + 0.1 * np.arange(13)
    assert np.abs(projections.smooth(line, np.ones(13), 0.0) @ line - line).max() < 1e-6


def test_arma_likelihood_and_forecasts():
    e = np.random.default_rng(3).normal(size=1500)
    y = np.zeros(1500)
    for t in range(1, 1500):
        y[t] = 1 + 0.7 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    m = arima.maximum_likelihood(y, 1, 1)
    assert abs(m["ar"][0] - 0.7) < 0.06 and abs(m["ma"][0] - 0.4) < 0.08 and abs(m["sigma2"] - 1) < 0.1
    # The exact likelihood of an AR(1) in closed form.
    z, r = y[:50] - y.mean(), 0.5
    s = (z[0] ** 2 * (1 - r * r) + ((z[1:] - r * z[:-1]) ** 2).sum()) / 50
    want = -25 * (math.log(2 * math.pi * s) + 1) + 0.5 * math.log(1 - r * r)
    assert abs(arima.exact(z, np.array([r]), np.zeros(0))[0] - want) < 1e-8
    f, se = arima.path(y, {"ar": np.array([0.5]), "ma": np.zeros(0), "const": 0.0, "sigma2": 1.0}, 0, 3)
    assert np.allclose(f, y[-1] * 0.5 ** np.arange(1, 4)) and np.allclose(se**2, [1, 1.25, 1.3125])
    x = arima.fractional_difference(arima.fractional_difference(e, -0.3, 2000), 0.3, 2000)
    assert np.abs(x - e).max() < 1e-8


@pytest.mark.parametrize("kind", list(volatility.Model.NAMES))
def test_volatility_kinds(kind):
    rng = np.random.default_rng(2)
    y, h = np.zeros(400), 1.0
    for t in range(400):
        h = 0.1 + 0.15 * (y[t - 1] ** 2 if t else 1) + 0.75 * h
        y[t] = math.sqrt(h) * rng.normal()
    m = volatility.Model(kind, 60)
    g = m.fit(y)
    start = m.start(g["s0"])
    assert g["loglik"] >= -m.loss(g["e"], start, g["s0"]) and (g["h"] > 0).all() and 0 <= m.persistence(g["params"]) <= 1.01
    assert m.news(g["params"], np.array([-3.0, 0.0, 3.0]), g["s0"]).argmin() == 1 or kind in ("fiegarch", "cgarch")


def test_filtered_factors_find_the_common_part_and_fill_gaps():
    rng = np.random.default_rng(0)
    f = np.zeros(150)
    for t in range(1, 150):
        f[t] = 0.8 * f[t - 1] + rng.normal()
    x = np.outer(f, [1, 0.8, -0.6, 0.5, 0.9]) + rng.normal(size=(150, 5)) * 0.5
    gap = x.copy()
    gap[rng.random(x.shape) < 0.1] = np.nan
    m = factors.Filtered(gap)
    assert abs(np.corrcoef(m.smooth()[1][:, 0], f)[0, 1]) > 0.95
    fit = m.fitted()[0]
    hole = np.isnan(gap)
    assert np.sqrt(((fit - x)[hole] ** 2).mean()) < 0.8
    g = factors.Generalised(x, 1)
    assert abs(np.corrcoef(g.common[:, 0], f)[0, 1]) > 0.9 and abs(g.share.sum() - 1) < 1e-9


def test_normality_and_unit_root_statistics_have_their_size():
    rng = np.random.default_rng(4)
    p = [unitroots.henze_zirkler(rng.normal(size=(80, 2)))[1] for _ in range(60)]
    assert 0.2 < np.mean(p) < 0.8 and unitroots.henze_zirkler(rng.standard_t(2, size=(200, 2)))[1] < 0.01
    assert abs(unitroots.adf_p_value(-2.86, 250) - 0.05) < 0.02 and abs(unitroots.adf_p_value(-1.95, 250, "none") - 0.05) < 0.02


def test_moments_bounds_and_transforms():
    x = RNG.normal(size=400)
    d = np.column_stack([1 + 2 * x + RNG.normal(size=400), x])
    f = lambda th, v: (lambda e: np.column_stack([e, e * v[:, 1], e * v[:, 1] ** 2]))(v[:, 0] - th[0] - th[1] * v[:, 1])
    m = moments.gmm(f, np.zeros(2), d)
    assert np.abs(m["theta"] - [1, 2]).max() < 0.25 and m["df"] == 1 and 0 <= m["j_p"] <= 1
    b = moments.Bounds([0, None, -1, None], [None, 2, 1, None])
    th = np.array([0.5, 1.0, 0.3, -7.0])
    assert np.allclose(b.bound(b.free(th)), th) and np.allclose(moments.numerical_gradient(b.bound, b.free(th)).diagonal(), b.slopes(b.free(th)), rtol=1e-5)
    z = moments.simulate_autoregression(np.array([1.0, 0.6, 0.5]), 400, np.random.default_rng(8))
    s = moments.smm(moments.simulate_autoregression, np.array([0.0, 0.2, 1.0]), z, bounds=moments.Bounds([None, -1, 0], [None, 1, None]))
    assert np.abs(s["theta"] - [1.0, 0.6, 0.5]).max() < 0.3


def test_conditional_logit_denominator_by_enumeration():
    from itertools import combinations

    s = RNG.normal(size=7)
    for k in range(8):
        want = math.log(sum(math.exp(sum(c)) for c in combinations(s, k)))
        assert abs(panels.conditional_logsum(s, k) - want) < 1e-10


def test_honest_intervals_widen_with_the_limit():
    b, v = np.array([0.1, -0.05, 1.0, 1.2]), np.eye(4) * 0.01
    width = [np.diff(trends.honest(b, v, 2, "rm", m))[0] for m in (0.0, 1.0, 2.0)]
    assert width == sorted(width) and abs(width[0] - 2 * 1.96 * 0.1) < 1e-3


def test_long_run_estimates_and_spectra():
    e = np.random.default_rng(6).normal(size=4000)
    x = np.zeros(4000)
    for t in range(1, 4000):
        x[t] = 0.5 * x[t - 1] + e[t]
    assert abs(systems.var_prewhitened(x)[0][0, 0] - 4) < 0.7
    a, s = systems.burg(x, 2)
    assert abs(a[0] - 0.5) < 0.05 and abs(s - 1) < 0.1
    w, sx, _, c, _ = systems.welch(x, x)
    assert np.allclose(sx, c.real) and abs(2 * np.trapezoid(sx, w) - x.var()) < 0.3 * x.var()
    u = RNG.normal(size=(500, 2))
    assert np.allclose(systems.one_sided(u, 5) + systems.one_sided(u, 5).T - (u - u.mean(0)).T @ (u - u.mean(0)) / 500, systems.long_run_covariance(u, 5))


def test_seasonal_adjustment_recovers_a_season():
    rng, n = np.random.default_rng(0), 96
    t = np.arange(n)
    season = np.tile(0.2 * np.sin(2 * math.pi * np.arange(12) / 12), 8)
    y = np.exp(5 + 0.005 * t + season + rng.normal(size=n) * 0.01)
    y[50] *= 1.4
    m = seasonal.adjust(y, transform="log")
    assert ("ao", 50) in m["outliers"] and np.abs(np.log(m["seasonal"]) - season).max() < 0.05
    w = seasonal.henderson(13)
    assert abs(w.sum() - 1) < 1e-12 and abs((w * np.arange(-6, 7) ** 3).sum()) < 1e-9 and abs((w * np.arange(-6, 7) ** 2).sum()) < 1e-9


def growth(full=1.0):
    return structural.Model(["c[t]**(-1) = beta*c[t+1]**(-1)*alpha*exp(z[t+1])*k[t]**(alpha-1)", "k[t] = exp(z[t])*k[t-1]**alpha - c[t]", "z[t] = rho*z[t-1]+s*e[t]"], ["c", "k", "z"], ["e"], {"alpha": 0.36, "beta": 0.95, "rho": 0.9, "s": 0.02})


def test_second_order_and_global_solutions_of_a_model_in_closed_form():
    guess, a, b = {"c": 0.3, "k": 0.2, "z": 0.0}, 0.36, 0.95
    m = structural_more.Second(growth(), guess)
    k = m.steady[1]
    assert abs(m.q[1, 1, 1] - a * b * a * (a - 1) * k ** (a - 2)) < 1e-6 and np.abs(m.c).max() < 1e-8
    for method in ("pfi", "collocation"):
        p = structural_more.Policy(growth(), guess, degree=3, method=method)
        got = p.at(np.array([[0.3, 0.19, 0.02]]), np.array([[0.5]]))[0, 1]
        assert abs(got - a * b * math.exp(0.9 * 0.02 + 0.02 * 0.5) * 0.19**a) < 2e-4
    s = structural.Solution(growth(), guess)
    g, h, stable, unique = structural_more.eigen_solution(*structural.linearize(s.model, s.steady))
    assert unique and stable == 3 and np.abs(g - s.g).max() < 1e-9 and np.abs(h - s.h).max() < 1e-9


def test_particles_come_near_the_exact_likelihood():
    m = structural.Model(["y[t] = rho * y[t-1] + s * e[t]"], ["y"], ["e"], {"rho": 0.5, "s": 1.0})
    s = structural.Solution(m, {"y": 0.0})
    y = np.random.default_rng(0).normal(size=(60, 1))
    exact = structural.log_likelihood(s, y, ["y"], 0.3)
    got = structural_more.particle_likelihood(lambda x, e: x @ s.g.T + e @ s.h.T, np.zeros(1), 1, lambda x: x, y, 0.3, 4000)[0]
    assert abs(got - exact) < 1.5


def test_sequence_space_jacobians_against_the_distribution():
    e = structural.aiyagari(states=3, points=80, top=60.0, tol=1e-6)
    m = structural_more.Heterogeneous(e, horizon=40)
    z = 1e-3 * 0.9 ** np.arange(40)
    k = m.impulse(z)["capital"]
    wealth = [float((x.sum(1) * m.grid).sum()) for x in m.distributions(z)]
    steady = float((m.mass.sum(1) * m.grid).sum())
    assert np.abs(np.array(wealth[1:6]) - steady - k[:5]).max() < 0.06 * np.abs(k[:5]).max()


def test_continuous_time_economy_clears():
    m = structural_more.Continuous(points=60)
    s = m.steady()
    assert abs(s["supply"] - s["capital"]) < 1e-2 and abs(s["g"].sum() * m.da - 1) < 1e-8 and np.abs(s["m"].sum(1)).max() < 1e-8
    flat = m.transition(s, np.ones(5), 0.5)
    assert np.abs(flat["capital"] - s["capital"]).max() < 1e-2
