"""Weights of draws under zero and sign restrictions against known volumes, and what they do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from macrolith.operators import multivariate, restricted
from macrolith.operators.identification import haar, zero_sign_rotation


def reduced(r, n, p):
    b = r.normal(0, 0.2, size=(1 + n * p, n))
    x = r.normal(size=(n, n + 3))
    return b, x @ x.T / 3


@pytest.mark.parametrize(("n", "p"), [(2, 1), (3, 1), (2, 2)])
def test_without_zeros_all_weigh_the_same(n, p):
    r = np.random.default_rng(n + p)
    got = []
    for _ in range(6):
        b, s = reduced(r, n, p)
        got.append(restricted.log_weight(b, s, haar(n, r), []))
    assert np.ptp(got) < 1e-4


def test_a_recursive_pair_weighs_by_the_known_volume():
    """Two variables, one zero on impact: parameters are triangular, whose map to the covariance has the volume of a Cholesky factor."""
    r = np.random.default_rng(3)
    got, want = [], []
    for _ in range(12):
        b, s = reduced(r, 2, 1)
        zeros = [(0, 1, 0)]
        q = zero_sign_rotation(restricted.moving_average(b, 1), np.linalg.cholesky(s), zeros, r)
        impact = np.linalg.cholesky(s) @ q
        assert abs(impact[0, 1]) < 1e-10
        a0 = np.linalg.inv(impact).T  # upper triangular
        got.append(restricted.log_weight(b, s, q, zeros))
        # |a11 a22| over the volume of a0 -> a0 a0': a11 once, a22 twice.
        want.append(-np.log(abs(a0[1, 1])))
    assert np.ptp(np.subtract(got, want)) < 1e-4 and np.ptp(want) > 0.5


def test_weights_do_not_depend_on_signs_or_bases():
    r = np.random.default_rng(5)
    b, s = reduced(r, 3, 1)
    zeros = [(1, 0, 0), (2, 0, 1)]
    q = zero_sign_rotation(restricted.moving_average(b, 2), np.linalg.cholesky(s), zeros, r)
    w = restricted.log_weight(b, s, q, zeros)
    for flip in ([1, -1, 1], [-1, 1, -1]):
        assert abs(restricted.log_weight(b, s, q * flip, zeros) - w) < 1e-5
    theta = restricted.moving_average(b, 2) @ np.linalg.cholesky(s) @ q
    assert abs(theta[0, 1, 0]) < 1e-10 and abs(theta[1, 2, 0]) < 1e-10


@pytest.fixture(scope="module")
def system(spark):
    r = np.random.default_rng(8)
    y = np.zeros((200, 3))
    for t in range(1, 200):
        y[t] = 0.5 * y[t - 1] + np.array([[1, 0.3, 0], [0.5, 1, 0.2], [0.2, 0.4, 1]]) @ r.normal(size=3)
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(y)], "t int, a double, b double, c double")


def test_draws_meet_restrictions_and_summaries_follow_weights(spark, system):
    found = restricted.draws(system, ["a", "b", "c"], "t", zeros=[("a", "c", 0)], signs=[("a", "a", 0, 1), ("b", "a", 0, 1)], horizon=4, draws=60).cache()
    assert found.where("horizon = 1 and variable = 'a' and shock = 'c' and abs(value) > 1e-9").count() == 0
    assert found.where("horizon = 1 and variable in ('a', 'b') and shock = 'a' and value <= 0").count() == 0
    w = restricted.weighted(found).select("draw", "weight").distinct().toPandas()
    e = restricted.effective_draws(found).first()
    assert abs(w.weight.sum() - 1) < 1e-9 and e.accepted == len(w) and 1 <= e.effective <= e.accepted and e.effective == pytest.approx(1 / (w.weight**2).sum())
    got = restricted.summary(found).where("horizon = 2 and variable = 'b' and shock = 'a'").first()
    one = restricted.weighted(found).where("horizon = 2 and variable = 'b' and shock = 'a'").toPandas().sort_values("value")
    assert got["mean"] == pytest.approx((one.weight * one.value).sum()) and got.q50 == pytest.approx(one.value[one.weight.cumsum() >= 0.5].iloc[0])
    again = restricted.resampled(found, 500)
    counts = again.select("draw", "source").distinct().groupBy("source").count().toPandas().set_index("source")["count"]
    expect = 500 * w.set_index("draw").weight
    assert (counts.reindex(expect.index).fillna(0) - expect).abs().max() <= 1 and again.select(F.count_distinct("draw")).first()[0] == 500
    # The same draws on other partitions.
    other = restricted.draws(system.repartition(7), ["a", "b", "c"], "t", zeros=[("a", "c", 0)], signs=[("a", "a", 0, 1), ("b", "a", 0, 1)], horizon=4, draws=60)
    assert abs(other.agg(F.sum("value")).first()[0] - found.agg(F.sum("value")).first()[0]) < 1e-6


def test_posterior_of_sums_is_centred_at_the_estimate(system):
    m = multivariate.fitted_system(system, ["a", "b", "c"], "t", 1)
    flat = restricted.Flat(m)
    got = [flat.draw(np.random.default_rng([1, k])) for k in range(800)]
    assert np.allclose(np.mean([g[0] for g in got], axis=0), m.b, atol=0.02)
    assert np.allclose(np.mean([g[1] for g in got], axis=0), m.sigma, atol=0.06)
