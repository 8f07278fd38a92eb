"""DataFrame operators on small frames against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from macrolith.operators import cleaning, containers, describe, forecasting, inputoutput, multivariate, panel, regression, transforms
from macrolith.plans.gram import gram
from macrolith.plans.ordered import running_sum
from macrolith.sources import files
from macrolith.streaming import running

RNG = np.random.default_rng(1)


@pytest.fixture(scope="module")
def xy(spark):
    n = 300
    z = RNG.normal(size=(n, 2))
    x = z[:, 0] + 0.5 * RNG.normal(size=n)
    w = RNG.normal(size=n)
    y = 1 + 2 * x - w + RNG.normal(size=n) * (1 + abs(x))
    return spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "w": w, "z1": z[:, 0], "z2": z[:, 1], "g": np.arange(n) % 7, "b": (y > 1).astype(float), "t": np.arange(n)}))


def arrays(df, *cols):
    p = df.toPandas()
    return p[cols[0]].to_numpy(), np.column_stack([np.ones(len(p)), *[p[c] for c in cols[1:]]])


def test_gram_is_the_same_both_ways(spark):
    wide = pd.DataFrame(RNG.normal(size=(50, 15)) + 1e6, columns=[f"c{k}" for k in range(15)])
    d = spark.createDataFrame(wide)
    for cols in (list(wide)[:3], list(wide)):
        x = np.column_stack([np.ones(50), wide[cols]])
        n, g = gram(d, cols)
        assert n == 50 and np.allclose(g, x.T @ x, rtol=1e-12)


def test_large_means_cost_no_digits(spark):
    x = RNG.normal(size=(200, 2))
    p = pd.DataFrame({"y": 3 + x @ [1.0, -2.0], "a": x[:, 0] + 1e7, "b": x[:, 1] - 1e7})
    for weight in (None, "w"):
        f = regression.ols(spark.createDataFrame(p.assign(w=2.0)), "y", ["a", "b"], "ols", weight=weight)
        assert np.allclose(f.b[1:], [1, -2], atol=1e-6) and f.rss < 1e-10


@pytest.mark.parametrize("cov", ["ols", "hc0", "hc1", "hc2", "hc3", "cluster"])
def test_ols_covariances(xy, cov):
    y, x = arrays(xy, "y", "x", "w")
    f = regression.ols(xy, "y", ["x", "w"], cov, "g")
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    n, k = x.shape
    if cov == "cluster":
        g = np.arange(n) % 7
        s = np.array([(x[g == c] * e[g == c, None]).sum(0) for c in range(7)])
        v = inv @ s.T @ s @ inv * 7 / 6 * (n - 1) / (n - k)
    elif cov == "ols":
        v = inv * (e @ e) / (n - k)
    else:
        u = {"hc0": e, "hc1": e * math.sqrt(n / (n - k)), "hc2": e / np.sqrt(1 - h), "hc3": e / (1 - h)}[cov]
        v = inv @ ((x * u[:, None]).T @ (x * u[:, None])) @ inv
    assert np.allclose(f.b, b) and np.allclose(f.v, v)


def test_iv_estimators(xy):
    p = xy.toPandas()
    x, z = np.column_stack([np.ones(300), p.w, p.x]), np.column_stack([np.ones(300), p.w, p.z1, p.z2])
    hat = z @ np.linalg.lstsq(z, x, rcond=None)[0]
    assert np.allclose(regression.iv(xy, "y", ["w"], ["x"], ["z1", "z2"]).b, np.linalg.solve(hat.T @ x, hat.T @ p.y))
    assert abs(regression.iv(xy, "y", ["w"], ["x"], ["z1"], "liml").extra["kappa"] - 1) < 1e-8
    assert regression.iv(xy, "y", ["w"], ["x"], ["z1", "z2"], "liml").extra["kappa"] >= 1


def test_logit_and_probit_solve_their_scores(xy):
    y, x = arrays(xy, "b", "x", "w")
    f = regression.binary(xy, "b", ["x", "w"])
    assert np.allclose(x.T @ (y - 1 / (1 + np.exp(-x @ f.b))), 0, atol=1e-6)
    g = regression.binary(xy, "b", ["x", "w"], "probit")
    assert 0.5 < g.b[1] / f.b[1] < 0.7 and f.extra["pseudo_r2"] > 0


def test_lasso_meets_its_conditions(xy):
    p = xy.toPandas()
    got = {r.term: r.estimate for r in regression.elastic_net(xy, "y", ["x", "w", "z2"], 0.3).collect()}
    e = p.y - got["const"] - sum(got[c] * p[c] for c in ("x", "w", "z2"))
    for c in ("x", "w", "z2"):
        s = p[c].std(ddof=0)
        score = ((p[c] - p[c].mean()) / s * e).mean()
        assert abs(score) <= 0.3 + 1e-8 and (got[c] == 0 or abs(score - math.copysign(0.3, got[c])) < 1e-8)


def test_running_sum_and_ranks(spark):
    v = RNG.integers(0, 50, 500)
    d = spark.createDataFrame(pd.DataFrame({"v": v}))
    counts = d.groupBy("v").count()
    got = {r.v: r.s for r in running_sum(counts, "v", "count", "s", 8).collect()}
    assert all(got[k] == (v <= k).sum() for k in set(v))
    ranks = describe.rank_average(d, "v", "r").toPandas().drop_duplicates().set_index("v").r
    assert np.allclose(pd.Series(v).rank().to_numpy(), [ranks[k] for k in v])


def test_exact_quantiles(spark, monkeypatch):
    from macrolith.plans import ordered

    p = pd.DataFrame({"a": RNG.normal(size=20_000), "b": RNG.integers(0, 3, 20_000).astype(float), "c": np.where(RNG.uniform(size=20_000) < 0.7, 1.0, RNG.normal(size=20_000))})
    d = spark.createDataFrame(p).union(spark.createDataFrame([(None, None, None)], "a double, b double, c double"))
    want = {c: [0.0, 0.1, 0.25, 0.5, 0.501, 0.9, 1.0] for c in "abc"}
    for most in (100_000, 3):
        monkeypatch.setattr(ordered, "BRACKET", most)
        got = ordered.exact_quantiles(d, want)
        assert all(np.allclose(got[c], np.quantile(p[c], want[c])) for c in want)
    assert ordered.exact_quantiles(d.where("a is null"), {"a": [0.5]}) == {"a": [None]}


def test_kendall_with_ties(spark):
    p = pd.DataFrame({"a": RNG.integers(0, 6, 80), "b": RNG.integers(0, 6, 80)})
    got = describe.kendall(spark.createDataFrame(p), "a", "b").first()
    a, b = np.sign(np.subtract.outer(p.a.to_numpy(), p.a.to_numpy())), np.sign(np.subtract.outer(p.b.to_numpy(), p.b.to_numpy()))
    assert abs(got.tau - (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())) < 1e-12


def test_cleaning(spark):
    d = spark.createDataFrame([(1, None, 1.0), (2, 2.0, 1.0), (3, float("inf"), 1.0), (4, 8.0, 1.0), (5, float("nan"), 1.0)], "t int, v double, c double")
    assert [r.v for r in cleaning.fix(d, ["v", "c"], "interpolate", "t").orderBy("t").collect()] == [2, 2, 5, 8, 8]
    assert cleaning.fix(d, ["v", "c"]).columns == ["t", "v"] and cleaning.dropna(d, ["v"]).count() == 2
    r = cleaning.diagnose(d, ["v", "c"]).collect()
    assert (r[0].n_missing, r[0].n_inf, r[1].is_constant, r[0].is_short) == (2, 1, True, True)


def test_transforms_with_low_values_fall_back(spark):
    d = spark.createDataFrame([(k, float(k - 1)) for k in range(5)], "t int, v double")
    assert [r.v for r in transforms.apply_tcodes(d, {"v": 5}, "t").orderBy("t").collect()] == [1, 1, 1, 1]


def test_panel_shift_goes_by_time_value(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 4, 4.0)], "u string, t int, v double")
    got = [(r.t, r.lag1_v, r.lag2_v) for r in transforms.panel_lag(transforms.panel_lag(d, "v", "u", "t"), "v", "u", "t", 2).orderBy("t").collect()]
    assert got == [(1, None, None), (2, 1.0, None), (4, None, 2.0)]


def test_containers(spark):
    d = spark.createDataFrame([("a", 1, 1.0, "x"), ("a", 2, 2.0, "x"), ("b", 1, float("nan"), "y")], "u string, t int, v double, s string")
    p = containers.xtset(d, "u", "t")
    assert p.variables == ("v",) and not p.is_balanced() and p.ngroups() == 2 and p.df.where("v is null").count() == 1
    assert p.rename({"v": "w"}).set_vardesc("w", "text").vardesc == {"w": "text"}
    with pytest.raises(ValueError):
        containers.xtset(d.union(d), "u", "t")
    with pytest.raises(ValueError):
        p.validate_for("var")
    with pytest.raises(KeyError):
        p.select("none")


@pytest.fixture(scope="module")
def did(spark):
    rows = []
    for u in range(30):
        first = (0, 4, 6)[u % 3]
        for t in range(1, 9):
            rows.append((u, t, u * 0.3 + t * 0.2 + (2.0 if first and t >= first else 0.0), first, float(RNG.normal())))
    return spark.createDataFrame(rows, "u int, t int, y double, first int, x double")


def test_effects_of_a_known_treatment(did):
    att = panel.group_time_att(did, "y", "u", "t", "first")
    assert all(abs(r.att - (2 if r.t >= r.cohort else 0)) < 1e-9 for r in att.collect())
    assert all(abs(r.att - 2) < 1e-9 for r in panel.imputation(did, "y", "u", "t", "first").collect())
    assert all(abs(r.estimate - (2 if r.event_time >= 0 else 0)) < 1e-6 for r in panel.event_study(did, "y", "u", "t", "first", 5, 4).collect())
    b = panel.bacon(did, "y", "u", "t", "first").collect()
    assert abs(sum(r.weight for r in b) - 1) < 1e-12 and all(abs(r.estimate - 2) < 1e-9 for r in b)


def test_bacon_weights_give_the_two_way_estimate(spark):
    rows = [(u, t, float(RNG.normal() + (t if u % 3 else 0)), (0, 4, 6)[u % 3]) for u in range(12) for t in range(1, 9)]
    d = spark.createDataFrame(rows, "u int, t int, y double, first int")
    b = panel.bacon(d, "y", "u", "t", "first").collect()
    f = panel.fixed_effects(d.withColumn("d", ((F.col("first") > 0) & (F.col("t") >= F.col("first"))).cast("double")), "y", ["d"], "u", "t", True)
    assert abs(sum(r.weight * r.estimate for r in b) - f.b[0]) < 1e-9


def test_unbalanced_two_way_demeaning_converges(did):
    d = did.where("not (u = 3 and t = 2) and not (u = 5 and t > 6)")
    got = transforms.two_way_demean(d.select("u", "t", "x"), ["x"], "u", "t")
    assert got.groupBy("u").agg(F.abs(F.avg("x")).alias("m")).agg(F.max("m")).first()[0] < 1e-9


def test_random_effects_lie_between(did):
    d = did.withColumn("y2", F.col("x") * 0.5 + F.col("u") % 5 + F.rand(3))
    fe, re = panel.fixed_effects(d, "y2", ["x"], "u", "t", cov="ols"), panel.random_effects(d, "y2", ["x"], "u", "t")
    assert abs(fe.b[0] - re.b[1]) < 0.05 and panel.hausman(fe, re).first().p_value > 0.001


def test_input_output(spark):
    z = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (2, 1, 30.0), (2, 2, 5.0)], "i int, j int, value double")
    t = inputoutput.Table(z, spark.createDataFrame([(1, 70.0), (2, 65.0)], "i int, value double"))
    assert np.allclose(t.L @ t.Y, t.x) and np.allclose(t.x, [100, 100])
    got = {(r.i, r.j): r.value for r in inputoutput.technical_coefficients(z, spark.createDataFrame([(1, 70.0), (2, 65.0)], "i int, value double")).collect()}
    assert np.allclose([got[1, 1], got[2, 1]], [0.1, 0.3])
    u = inputoutput.Table(z, spark.createDataFrame([(1, 80.0), (2, 60.0)], "i int, value double"))
    d = inputoutput.decomposition(t, u).toPandas()
    assert np.allclose(d.technology + d.demand, u.x - t.x)
    r = inputoutput.balance(z, {1: 40.0, 2: 30.0}, {1: 35.0, 2: 35.0}).toPandas()
    assert np.allclose(r.groupby("i").value.sum(), [40, 30]) and np.allclose(r.groupby("j").value.sum(), [35, 35])


def test_bootstrap_and_draws_do_not_depend_on_partitions(spark, xy):
    a = multivariate.bootstrap_irf(xy, ["y", "x"], "t", 1, 3, 20).orderBy("horizon", "variable", "shock").toPandas()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    b = multivariate.bootstrap_irf(xy, ["y", "x"], "t", 1, 3, 20).orderBy("horizon", "variable", "shock").toPandas()
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert np.allclose(a[["value", "lower", "upper"]], b[["value", "lower", "upper"]])


def test_sur_with_equal_regressors_is_ols(xy):
    got = {(r.equation, r.term): r.estimate for r in multivariate.seemingly_unrelated(xy, {"a": ("y", ["x"]), "b": ("w", ["x"])}).collect()}
    assert abs(got["a", "x"] - regression.ols(xy, "y", ["x"], "ols").b[1]) < 1e-8


def test_combination_weights(spark):
    p = pd.DataFrame({"y": RNG.normal(size=200)})
    p["a"], p["b"] = p.y + RNG.normal(size=200) * 0.1, p.y + RNG.normal(size=200)
    d = forecasting.combine(spark.createDataFrame(p), "y", ["a", "b"], "inverse_mse")
    acc = {r.forecast: r.rmse for r in forecasting.accuracy(d, "y", ["a", "b", "combined"]).collect()}
    assert acc["combined"] < acc["b"]


def test_files(spark, tmp_path):
    import zipfile

    text = "10,20,70\n30,5,65\n"
    (tmp_path / "t.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("inner.csv", text)
    for z, y in (files.read_table(spark, str(tmp_path / "t.csv"), 2), files.read_archive(spark, str(tmp_path / "t.zip"), 2)):
        assert sorted(map(tuple, z.select("i", "j", "value").collect())) == [(0, 0, 10), (0, 1, 20), (1, 0, 30), (1, 1, 5)] and sorted(r.value for r in y.collect()) == [65, 70]
    d = spark.createDataFrame([("a", 1.0)], "term string, estimate double")
    files.save_model(d, str(tmp_path / "m"), "ols", {"n": 3})
    back, meta = files.load_model(spark, str(tmp_path / "m"), "ols")
    assert back.collect() == d.collect() and meta == {"n": 3}
    with pytest.raises(ValueError):
        files.load_model(spark, str(tmp_path / "m"), "var")
    files.write_csv(d, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    assert len(files.digest(spark, str(tmp_path / "t.csv")).first().sha256) == 64


def test_stream_gives_the_batch_result(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = running.windowed_moments(stream, "ts", "value", "1 day", "40 days").writeStream.format("memory").queryName("moments").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = running.windowed_moments(src, "ts", "value", "1 day")
    assert sorted((r.start, r.n) for r in spark.table("moments").collect()) == sorted((r.start, r.n) for r in want.collect())
