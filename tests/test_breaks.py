"""Breaks in slopes against brute force, sizes of the tests, bubbles against refits, dated episodes."""

from itertools import combinations

import numpy as np
import pytest

from macrolith.operators import breaks
from macrolith.operators.series import adf


def rss(y, x):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(((y - x @ b) ** 2).sum())


def test_partitions_equal_brute_force():
    r = np.random.default_rng(1)
    for trial in range(5):
        n = 26
        x = np.column_stack([np.ones(n), r.normal(size=n)])
        y = x @ [1000, 0.5] + r.normal(size=n) + 2 * (np.arange(n) > 12) * x[:, 1]
        least = 5
        got = breaks.partitions(breaks.segment_squares(y, x, least), 3)
        for m in range(4):
            best = min((sum(rss(y[a:b], x[a:b]) for a, b in zip([0, *c], [*c, n], strict=True)), list(c)) for c in combinations(range(least, n - least + 1), m) if all(b - a >= least for a, b in zip([0, *c], [*c, n], strict=True)))
            assert got[m][1] == best[1] and abs(got[m][0] - best[0]) < 1e-6 * (1 + best[0]), trial


def test_breaks_in_slopes_are_found(spark):
    r = np.random.default_rng(3)
    rows = []
    for g in range(3):
        for t in range(150):
            x = r.normal()
            slope = [(1.0, 1.0, 1.0), (1.0, -1.0, -1.0), (1.0, -1.0, 2.0)][g][t // 50]
            rows.append((g, 2000 + t, slope * x + 0.5 * r.normal(), x))
    d = spark.createDataFrame(rows, "g int, t int, y double, x double")
    got = breaks.break_tests(d, "y", ["x"], "t", 3, by="g").where("chosen").orderBy("g").collect()
    assert [x.breaks for x in got] == [0, 1, 2]
    assert abs(int(got[1].dates) - 2050) <= 3 and all(abs(int(a) - b) <= 3 for a, b in zip(got[2].dates.split(","), (2050, 2100), strict=True))
    c = breaks.break_coefficients(d, "y", ["x"], "t", by="g").where("g = 2 and term = 'x'").orderBy("segment").collect()
    assert [round(x.estimate) for x in c] == [1, -1, 2] and c[0]["first"] == 2000 and c[-1]["last"] == 2149 and sum(x.n for x in c) == 150
    fixed = breaks.break_coefficients(d, "y", ["x"], "t", breaks=1, by="g").where("g = 0").select("segment").distinct().count()
    assert fixed == 2


def test_size_of_one_break_against_none():
    rejected = 0
    for k in range(200):
        r = np.random.default_rng(k)
        x = np.column_stack([np.ones(120), r.normal(size=120)])
        rejected += breaks.find_breaks(x @ [1, 1] + r.normal(size=120), x, 1)["chosen"] > 0
    assert 0.02 <= rejected / 200 <= 0.09


def test_simulated_suprema_match_published_values():
    # Bai and Perron (2003), one break, trimming 0.15, 5 and 10 % for 1, 2 and 3 coefficients.
    for q, ten, five in ((1, 7.04, 8.58), (2, 9.81, 11.47), (3, 12.08, 13.98)):
        null = breaks.bridge_suprema(q, 0.15)
        assert abs(np.quantile(null, 0.95) - five) < 0.6 and abs(np.quantile(null, 0.9) - ten) < 0.5


@pytest.mark.parametrize("lags", [0, 1, 2])
def test_recursive_statistics_equal_refits(lags):
    r = np.random.default_rng(lags)
    y = 100 + np.cumsum(r.normal(size=60))
    w = 15
    first, most = breaks.recursive_roots(y, w, lags)
    for i, b in enumerate(range(w, 61)):
        assert abs(first[i] - adf(y[:b], lags)[0]) < 1e-6
        assert abs(most[i] - max(adf(y[a:b], lags)[0] for a in range(b - w + 1))) < 1e-6


def test_bubbles_are_dated(spark):
    r = np.random.default_rng(6)
    rows = []
    for g in range(2):
        y = [100.0]
        for t in range(1, 120):
            y.append((1.06 * (y[-1] - 100) + 100 + 1 if g and 60 <= t < 85 else y[-1] if not (g and t == 85) else 100.0) + r.normal())
        rows += [(g, t, v) for t, v in enumerate(y)]
    d = spark.createDataFrame(rows, "g int, t int, y double")
    tests = {(x.g, x.test): x for x in breaks.bubble_tests(d, "y", "t", replicates=200, by="g").collect()}
    assert tests[1, "gsadf"].p_value < 0.02 and tests[1, "gsadf"].statistic > tests[1, "gsadf"].cv_99 and tests[0, "gsadf"].p_value > 0.05
    assert tests[0, "sadf"].cv_90 < tests[0, "sadf"].cv_95 < tests[0, "sadf"].cv_99
    found = breaks.bubble_episodes(d, "y", "t", replicates=200, least=5, by="g").where("g = 1").collect()
    assert len(found) == 1 and 60 <= found[0].begin <= 75 and 83 <= found[0].end <= 88 and found[0].rows == found[0].end - found[0].begin + 1
    alone = breaks.bubble_episodes(d.where("g = 1"), "y", "t", replicates=200, least=5).collect()
    assert [tuple(x) for x in alone] == [tuple(x)[1:] for x in found]


def test_long_series_are_an_error():
    with pytest.raises(ValueError):
        breaks.recursive_roots(np.zeros(breaks.ROWS + 10), 20)
