"""Effects of units and times on panels with gaps, sensitivity of event studies, sizes of panel tests, covariances of terms."""

import math

import numpy as np
import pytest

from macrolith.operators import limited, panel, regression, results, transforms, trends, unitroots


def gappy(seed=1, units=12, times=15):
    r = np.random.default_rng(seed)
    out = []
    for u in range(units):
        for t in range(times):
            for _ in range(int(r.integers(0, 3)) if u % 4 else int(t < 5)):
                x = r.normal() + 0.3 * u + 0.2 * t * (u % 3)
                out.append((u, t, 2 * x + u - 0.5 * t + r.normal(), x))
    return out


def dummies(rows):
    a = np.array(rows)
    return np.column_stack([*[(a[:, 0] == k) for k in np.unique(a[:, 0])], *[(a[:, 1] == k) for k in np.unique(a[:, 1])[1:]]]).astype(float), a


def test_two_way_effects_of_a_panel_with_gaps_equal_dummies(spark):
    rows = gappy()
    d = spark.createDataFrame([*rows, (3, None, 1.0, 1.0), (3, 1, None, 1.0)], "u int, t int, y double, x double")
    f = panel.fixed_effects(d, "y", ["x"], "u", "t", True)
    z, a = dummies(rows)
    assert abs(f.b[0] - np.linalg.lstsq(np.column_stack([a[:, 3], z]), a[:, 2], rcond=None)[0][0]) < 1e-8
    got = sorted((r.u, r.t, r.x) for r in f.df.collect())
    left = a[:, 3] - z @ np.linalg.lstsq(z, a[:, 3], rcond=None)[0]
    want = sorted(zip(a[:, 0].astype(int), a[:, 1].astype(int), left, strict=True))
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-8)


def test_two_way_effects_of_spanned_columns_and_hard_panels(spark):
    # A chain: each unit is seen at two neighbouring times only, the slowest case for steps in turn.
    rows = [(u, u + k, float(u + k * k), float((u * 7 + k) % 5)) for u in range(40) for k in (0, 1)]
    d = spark.createDataFrame(rows, "u int, t int, y double, x double").withColumn("one", transforms.F.lit(1.0)).withColumn("s", transforms.F.col("u") + transforms.F.col("t") * 0.1)
    z, a = dummies(rows)
    got = sorted((r.u, r.t, r.x, r.one, r.s) for r in transforms.two_way_demean(d, ["x", "one", "s"], "u", "t").collect())
    left = a[:, 3] - z @ np.linalg.lstsq(z, a[:, 3], rcond=None)[0]
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(zip(a[:, 0], a[:, 1], left, strict=True))], atol=1e-7)
    assert max(abs(g[3]) + abs(g[4]) for g in got) < 1e-8


#: Three estimates before and three after, and the ends of intervals of fixed length that the published program gives (its critical values are simulated).
B, V = np.array([0.05, -0.10, 0.08, 0.15, 0.25, 0.30]), np.array([[0.01 * 0.5 ** abs(i - j) for i in range(6)] for j in range(6)])
PUBLISHED = [(0, 0.0, -0.0746475725, 0.3160442338), (0, 0.02, -0.1018395313, 0.3270227396), (0, 0.05, -0.1778374773, 0.3638093457), (1, 0.0, 0.0073599200, 0.4847787921), (1, 0.02, -0.0655127233, 0.5344024372)]


@pytest.mark.parametrize(("which", "limit", "lower", "upper"), PUBLISHED)
def test_smooth_intervals_equal_published_ones(which, limit, lower, upper):
    got = trends.honest(B, V, 3, "sd", limit, np.eye(3)[which])
    assert abs(got[0] - lower) < 3e-3 and abs(got[1] - upper) < 3e-3


def test_smooth_intervals_are_the_shortest_of_a_grid():
    best = np.diff(trends.honest(B, V, 3, "sd", 0.05))[0] / 2
    for a in np.linspace(-2, 2, 81):
        for c in np.linspace(-2, 2, 81):
            # Weights on the periods before, counted back 1, 2, 3, must cancel the slope of the first effect: w1 + 2 w2 + 3 w3 = 1.
            w = np.array([c, a, 1 - 2 * a - 3 * c, 1, 0, 0])
            se = math.sqrt(w @ V @ w)
            back = w[2::-1]
            bias = 0.05 * sum(abs(sum((m - k) * back[m - 1] for m in range(k + 1, 4))) for k in range(3))
            assert trends.folded_normal(bias / se, 0.95) * se >= best - 1e-6


def test_errors_of_earlier_estimates_widen_relative_intervals():
    b = np.array([0.0, 0.0, 1.0, 1.0, 1.0])
    wide = trends.honest(b, np.diag([1.0, 1.0, 0.01, 0.01, 0.01]), 2)
    slim = trends.honest(b, np.diag([1e-12, 1e-12, 0.01, 0.01, 0.01]), 2)
    assert wide[1] - wide[0] > 3 and abs(slim[1] - slim[0] - 2 * 1.96 * 0.1) < 1e-3
    one, all_ = trends.honest(B, V, 3), trends.honest(B, V, 3, uniform=True)
    assert all_[0] <= one[0] and all_[1] >= one[1]


@pytest.mark.parametrize("restriction", ["rm", "sd"])
def test_breakdown_is_where_zero_enters(restriction):
    m = trends.breakdown(4 * B, V, 3, restriction)
    lo, hi = trends.honest(4 * B, V, 3, restriction, m * 1.001)
    assert lo <= 0 <= hi and trends.honest(4 * B, V, 3, restriction, m * 0.99)[0] > 0
    assert trends.breakdown(0 * B, V, 3, restriction) == 0
    with pytest.raises(ValueError):
        trends.honest(B, V, 0, restriction)


def test_event_study_covariance_reaches_the_intervals(spark):
    r = np.random.default_rng(2)
    rows = [(u, t, float(r.normal() + u + (t >= 5) * (u % 2)), 5 if u % 2 else 0) for u in range(40) for t in range(1, 9)]
    d = spark.createDataFrame(rows, "u int, t int, y double, first int")
    e = panel.event_effects(d, "y", "u", "t", "first", 3, 2)
    assert e.v.shape == (5, 5) and abs(e.v[0, 1]) > 1e-6
    assert [x.std_error for x in e.table(spark).collect()] == pytest.approx(np.sqrt(np.diag(e.v)).tolist())
    assert e.covariance(spark).count() == 25
    got = {x.limit: (x.lower, x.upper) for x in trends.honest_bounds(e, spark, "sd", (0.0, 0.1)).collect()}
    assert got[0.1][0] < got[0.0][0] and got[0.1][1] > got[0.0][1]


@pytest.mark.parametrize(("n", "t"), [(20, 100), (10, 200)])
def test_size_of_common_factor_tests(n, t):
    rejected, runs = {}, 200
    for k in range(runs):
        r = np.random.default_rng(k)
        f = np.cumsum(r.normal(size=t))
        x = 5 * r.normal(size=n) + np.outer(f, r.normal(1, 1, n)) + np.cumsum(r.normal(size=(t, n)), axis=0)
        for name, _, p in unitroots.common_factor_kernel(x):
            rejected[name] = rejected.get(name, 0) + (p < 0.05)
    assert all(0.02 <= v / runs <= 0.085 for v in rejected.values())
    # And they have power: units about a common walk.
    r = np.random.default_rng(0)
    x = np.outer(np.cumsum(r.normal(size=t)), np.ones(n)) + r.normal(size=(t, n))
    assert all(p < 0.01 for name, _, p in unitroots.common_factor_kernel(x) if name != "factor_1")


def test_covariances_travel_with_tables(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 2))
    y = 1 + x @ [0.5, -0.25] + r.normal(size=300)
    d = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(y, x, strict=True)], "y double, a double, b double")
    f = regression.ols(d, "y", ["a", "b"])
    for table in (f.table(), f.table().where("term <> ''")):
        assert np.allclose(results.Result(table).vcov(), f.v)
    f.table().write.parquet(str(tmp_path / "t"))
    again = results.Result(spark.read.parquet(str(tmp_path / "t")))
    order = [f.terms.index(k) for k in again.coef()]
    assert np.allclose(again.vcov(), f.v[np.ix_(order, order)])
    got = results.Result(f.table())
    c = got.combination({"a": 1.0, "b": 2.0}, 0.1)
    g = np.array([0, 1.0, 2.0])
    assert abs(c["std_error"] - math.sqrt(g @ f.v @ g)) < 1e-10 and abs(c["estimate"] - g @ f.b) < 1e-10
    w = got.wald([{"a": 1.0}, {"b": 1.0}], [0.5, -0.25])
    dev = f.b[1:] - [0.5, -0.25]
    assert abs(w["statistic"] - dev @ np.linalg.solve(f.v[1:, 1:], dev)) < 1e-8 and w["df"] == 2 and w["p_value"] > 0.001
    ratio = got.delta(lambda b: b["a"] / b["b"])
    g = np.array([0, 1 / f.b[2], -f.b[1] / f.b[2] ** 2])
    assert abs(ratio["std_error"] - math.sqrt(g @ f.v @ g)) < 1e-6
    rows = {(x.term, x.other_term): x.value for x in results.covariance(f.table()).collect()}
    assert rows["a", "b"] == pytest.approx(f.v[1, 2]) and len(rows) == 9
    given = results.Result(f.table().select("term", transforms.F.col("estimate") + 0, "std_error").toDF("term", "estimate", "std_error"), covariance=results.covariance(f.table()))
    assert np.allclose(given.vcov(), f.v)


def test_unknown_covariances_are_not_made_up(spark):
    t = spark.createDataFrame([("a", 1.0, 0.1), ("b", 2.0, 0.5)], "term string, estimate double, std_error double")
    r = results.Result(t)
    assert np.isnan(r.vcov()[0, 1]) and r.combination({"a": 1.0})["std_error"] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        r.wald([{"a": 1.0}, {"b": 1.0}])
    with pytest.raises(ValueError):
        r.combination({"c": 1.0})
    with pytest.raises(ValueError):
        results.covariance(t.select("term"))


def test_likelihood_tables_have_covariances(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=400)
    y = (0.3 + 0.8 * x + r.logistic(size=400) > 0).astype(float)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x, strict=True)], "y double, x double")
    table = limited.tobit(d.selectExpr("greatest(y + x, 0) AS y", "x"), "y", ["x"])
    v = results.Result(table).vcov()
    assert np.isfinite(v).all() and np.allclose(v, v.T) and abs(v[0, 1]) > 0


def panel_of(spark, seed=3):
    r = np.random.default_rng(seed)
    out = [(u, t, float(r.normal() + 0.5 * u * np.sin(t)), float(r.normal())) for u in range(5) for t in range(20) if (u + t) % 6 or u == 0]
    return out, spark.createDataFrame(out, "u int, t int, y double, x double")


def test_pesaran_cd_of_an_unbalanced_panel(spark):
    _, d = panel_of(spark)
    f = panel.fixed_effects(d, "y", ["x"], "u", "t")
    e = {(x.u, x.t): x.y - f.b[0] * x.x for x in f.df.collect()}
    total = 0.0
    for i in range(5):
        for j in range(i + 1, 5):
            shared = [t for t in range(20) if (i, t) in e and (j, t) in e]
            total += math.sqrt(len(shared)) * np.corrcoef([e[i, t] for t in shared], [e[j, t] for t in shared])[0, 1]
    assert panel.pesaran_cd(f).first().statistic == pytest.approx(math.sqrt(2 / 20) * total, abs=1e-10)


@pytest.mark.parametrize("pairwise", [False, True])
def test_panel_corrected_errors_against_plain_matrices(spark, pairwise):
    from macrolith.operators import panels

    rows, d = panel_of(spark)
    f = panels.pcse(d, "y", ["x"], "u", "t", pairwise)
    a = np.array(rows)
    x = np.column_stack([np.ones(len(a)), a[:, 3]])
    e = a[:, 2] - x @ f.b
    wide = np.full((20, 5), np.nan)
    wide[a[:, 1].astype(int), a[:, 0].astype(int)] = e
    full = wide[~np.isnan(wide).any(1)]
    s = full.T @ full / len(full)
    if pairwise:
        ok = ~np.isnan(wide)
        z = np.where(ok, wide, 0)
        s = z.T @ z / (ok.T.astype(float) @ ok)
    meat = sum(np.outer(x[i], x[j]) * s[int(a[i, 0]), int(a[j, 0])] for i in range(len(a)) for j in range(len(a)) if a[i, 1] == a[j, 1])
    inv = np.linalg.inv(x.T @ x)
    assert np.allclose(f.v, inv @ meat @ inv)


def test_rows_by_place_in_an_order_of_several_columns(spark):
    from macrolith.operators import cleaning

    d = spark.range(500).selectExpr("id % 7 AS a", "500 - id AS b", "id")
    want = [r.id for r in d.orderBy("a", "b").collect()]
    got = cleaning.keep_rows(d, ["a", "b"], [1, 72, 73, 500, 900])
    assert sorted(r.id for r in got.collect()) == sorted(want[k - 1] for k in (1, 72, 73, 500)) and got.columns == d.columns
    assert cleaning.keep_rows(d.limit(0), ["a", "b"], [1]).count() == 0


def test_groups_of_equality_tests_are_bounded(spark):
    from macrolith.operators import describe

    with pytest.raises(ValueError):
        describe.equality_tests(spark.range(describe.GROUPS + 1).selectExpr("cast(id as double) AS y", "id AS g"), "y", "g")


def test_memory_is_the_exact_optimum(spark):
    from macrolith.operators import further

    y = np.cumsum(np.random.default_rng(5).normal(size=300)) * 0.3 + np.random.default_rng(6).normal(size=300)
    d = further.local_whittle(spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "t int, y double"), "y", "t").first().d
    m = int(300**0.65)
    w = 2 * math.pi * np.arange(1, m + 1) / 300
    p = np.abs(np.fft.fft(y - y.mean())[1 : m + 1]) ** 2
    loss = lambda q: math.log((p * w ** (2 * q)).mean()) - 2 * q * np.log(w).mean()
    assert loss(d) <= min(loss(q) for q in np.linspace(d - 1e-3, d + 1e-3, 101)) + 1e-13


def test_ratios_of_output_multiply(spark):
    from macrolith.operators import inputoutput

    flows = lambda k: spark.createDataFrame([(i, j, float(1 + i + j * k)) for i in range(3) for j in range(3)], "i int, j int, value double")
    demand = lambda k: spark.createDataFrame([(i, float(20 + i * k)) for i in range(3)], "i int, value double")
    a, b = inputoutput.Table(flows(1), demand(1)), inputoutput.Table(flows(2), demand(3))
    got = sorted(tuple(r) for r in inputoutput.decomposition_ratio(a, b).select("i", "technology", "demand").collect())
    assert np.allclose([g[1] * g[2] for g in got], b.x / a.x)
