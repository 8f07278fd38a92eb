"""Windows over a whole order in stretches give what one window gives; results as text and accessors; stored loops."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from macrolith.operators import cleaning, results, series, transforms
from macrolith.plans import ordered, store
from macrolith.sources import examples


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=500).cumsum()
    return spark.createDataFrame([(int(k) * 3, float(x), None if k % 7 == 0 or 100 < k < 160 else float(x)) for k, x in enumerate(v)], "t long, v double, h double").repartition(5)


def test_blocks_cover_the_order(spark, line):
    for before, after in ((0, 0), (3, 0), (12, 12), (400, 0)):
        d, sizes = ordered.blocked(line, "t", before, after, 16)
        own = d.where("not _halo").orderBy("_place").collect()
        assert [r.t for r in own] == [3 * k for k in range(500)] and [r._place for r in own] == list(range(1, 501)) and sum(sizes) == 500 and min(sizes) >= max(before, after)
    assert ordered.blocked(line.limit(0), "t")[0].count() == 0
    one = spark.createDataFrame([(1, 2.0)], "t long, v double")
    assert ordered.ordered_lags(one, "v", "t", 2).collect()[0].v_l1 is None


def test_lags_codes_interpolation_and_filters_as_one_window(spark, line):
    w = Window.orderBy("t")
    same = lambda a, b: [tuple(r) for r in a.orderBy("t").collect()] == [tuple(r) for r in b.orderBy("t").collect()]
    assert same(ordered.ordered_lags(line.select("t", "v"), "v", "t", 3), line.select("t", "v", *[F.lag("v", j).over(w).alias(f"v_l{j}") for j in (1, 2, 3)]))
    assert same(transforms.apply_tcodes(line.select("t", "v"), {"v": 3}, "t"), line.select("t", (F.col("v") - 2 * F.lag("v").over(w) + F.lag("v", 2).over(w)).alias("v")).where("v is not null"))
    assert transforms.lag_design(line.select("t", "v"), ["v"], 4, "t").count() == 496
    got = [r.h for r in cleaning.interpolate(line, "h", "t").orderBy("t").collect()]
    x = np.array([np.nan if r.h is None else r.h for r in line.orderBy("t").collect()])
    ok = ~np.isnan(x)
    assert np.allclose(got, np.interp(np.arange(500), np.flatnonzero(ok), x[ok]))
    assert [r.t for r in cleaning.keep_rows(line, ["t"], [1, 77, 500]).orderBy("t").collect()] == [0, 228, 1497]
    b = series.baxter_king_weights(6, 32, 12)
    v = np.array([r.v for r in line.orderBy("t").collect()])
    want = [sum(b[abs(j)] * v[k + j] for j in range(-12, 13)) for k in range(12, 488)]
    assert np.allclose([r.cycle for r in series.baxter_king(line, "v", "t").orderBy("t").collect()], want)


def test_no_window_without_partitions(line):
    for d in (transforms.apply_tcodes(line.select("t", "v"), {"v": 2}, "t"), transforms.lag_design(line.select("t", "v"), ["v"], 2, "t"), cleaning.interpolate(line, "h", "t"), series.baxter_king(line, "v", "t")):
        assert "SinglePartition" not in d._jdf.queryExecution().executedPlan().toString()


def test_results_as_text_and_accessors(spark):
    t = spark.createDataFrame([("const", 1.0, 0.1, 0.0), ("x_1", 2.0, 0.5, 0.2)], "term string, estimate double, std_error double, p_value double")
    assert "***" in results.report(t, "T", {"n": 5}) and results.report(t).count("\n") == 5
    with results.display_backend("latex"):
        assert "x\\_1" in results.print_table(t) and results.get_display_backend() == "latex"
    assert results.get_display_backend() == "text" and "<td>" in results.print_table(t, backend="html")
    r = results.Result(t, nobs=10)
    assert r.coef() == {"const": 1.0, "x_1": 2.0} and r.dof_residual() == 8 and np.allclose(np.diag(r.vcov()), [0.01, 0.25]) and abs(r.confint()["x_1"][0] - 1.02) < 1e-3
    assert r.residuals(spark.createDataFrame([(3.0, 1.0)], "y double, x_1 double"), "y").first().residual == 0
    assert results.has_uncertainty(t) and results.uncertainty_bounds(t).columns[-2:] == ["lower", "upper"]
    page = results.plot(spark.createDataFrame([(1, 0.5, 0.1, 0.9), (2, 0.7, 0.2, 1.0)], "h int, v double, lo double, hi double"), "h", "v", lower="lo", upper="hi", title="a<b")
    assert page.count("<polyline") == 1 and "a&lt;b" in page
    c, add = results.safe_cholesky(np.array([[1.0, 1.0], [1.0, 1.0]]))
    assert add > 0 and np.allclose(c @ c.T, 1, atol=1e-6)
    assert "Jorda" in results.refs(["jorda"]) and results.refs(["jorda"], "bibtex").startswith("@article")
    with pytest.raises(ValueError):
        results.set_display_backend("braille")


def test_example_files(spark, tmp_path):
    p = tmp_path / "p.toml"
    p.write_text('[metadata]\nyears = [2000, 2001]\n[countries]\nnames = ["A", "B"]\n[variables]\nnames = ["y"]\n[descriptions]\ny = "output"\n[data]\ny = [1.0, 2.0, nan, 4.0]\n')
    got = examples.read_file(spark, str(p)).orderBy("unit", "t").collect()
    assert [(r.unit, r.t) for r in got] == [("A", 2000), ("A", 2001), ("B", 2000), ("B", 2001)] and np.isnan(got[2].y)
    p.write_text('[metadata]\nname = "s"\n[variables]\nnames = ["a", "b"]\n[data]\na = [1.0, 2.0]\nb = [3.0, nan]\n')
    d = examples.read_file(spark, str(p))
    assert d.columns == ["t", "a", "b"] and d.count() == 2
    p.write_text('[metadata]\nname = "io"\n[data]\nZ = [[1.0, 2.0], [3.0, 4.0]]\nY = [[5.0], [6.0]]\n')
    assert examples.read_file(spark, str(p)).where("part = 'Z'").count() == 4
    with pytest.raises(ValueError):
        examples.load_example(spark, "none")


def test_stored_rows_can_be_dropped(spark):
    import os

    k = store.Kept(spark.range(5).toDF("a"))
    path = k.path.removeprefix("file://")
    assert k.rows.count() == 5 and os.path.isdir(path)
    k.drop()
    assert not os.path.exists(path)
