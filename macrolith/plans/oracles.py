"""SQL for queries of the catalogue that needs more than a line: regressions, chances and inverses written out by ``sqlkit``."""

from __future__ import annotations

from . import catalog_more  # noqa: F401 - its queries are registered first
from . import sqlkit as k
from .base import sql
from .catalog import _FC, _QUERIES, _RHO, _SQL
from .sqlkit import r


def oracle(name: str, text: str) -> None:
    if name not in _QUERIES:
        raise KeyError(name)
    _SQL[name] = sql(text)


def _table(terms: list[str], fit: str, se: list[str], dof: str | None) -> str:
    """Coefficient rows with p values and bands."""
    parts = []
    for i, (t, s) in enumerate(zip(terms, se, strict=True)):
        p = k.t_two_sided(f"b{i} / ({s})", dof) if dof else k.normal_two_sided(f"b{i} / ({s})")
        crit = k.t_975(dof) if dof else "1.959963984540054e0"
        parts.append(f"SELECT '{t}' AS term, {r(f'b{i}')} AS estimate, {r(s)} AS std_error, {r(f'b{i} / ({s})')} AS stat, {r(p)} AS p_value, {r(f'b{i} - {crit} * {s}')} AS ci_lower, {r(f'b{i} + {crit} * {s}')} AS ci_upper FROM {fit}")
    return " UNION ALL ".join(parts)


# -- cross-sections -------------------------------------------------------------------

_X = ["1.0e0", "q", "d", "tax"]
_OLS3 = k.regression("SELECT y, q, d, tax FROM {xs}", "y", _X, "f")
_U = "SELECT " + ", ".join(f"x{i}" for i in range(4)) + ", y - b0 * x0 - b1 * x1 - b2 * x2 - b3 * x3 AS u, " + ", ".join(f"b{i}" for i in range(4)) + ", " + ", ".join(f"v{i}_{j}" for i in range(4) for j in range(4)) + ", n FROM f_x CROSS JOIN f"
# Row i of the inverse times x, squared with the residual, summed: the sandwich's diagonal.
_HC1 = f"{_OLS3}, u AS ({_U}), h AS (SELECT " + ", ".join(f"sqrt(any_value(n) / (any_value(n) - 4) * sum(power(u * (v{i}_0 * x0 + v{i}_1 * x1 + v{i}_2 * x2 + v{i}_3 * x3), 2))) AS s{i}" for i in range(4)) + ", " + ", ".join(f"any_value(b{i}) AS b{i}" for i in range(4)) + ", any_value(n) - 4 AS dof FROM u)"
oracle("ols_hc1_three_regressors", f"WITH {_HC1} " + _table(["const", "q", "d", "tax"], "h", [f"s{i}" for i in range(4)], "dof"))
oracle("uncertainty_bounds", "WITH " + k.regression("SELECT y, q FROM {xs}", "y", ["1.0e0", "q"], "f") + ", h AS (SELECT *, n - 2 AS dof, sqrt(rss / (n - 2) * v0_0) AS s0, sqrt(rss / (n - 2) * v1_1) AS s1 FROM f) " + _table(["const", "q"], "h", ["s0", "s1"], "dof").replace("AS ci_lower", "AS lower").replace("AS ci_upper", "AS upper").replace(", 6)", ", 5)"))

_RESET = k.regression("SELECT y, q, d FROM {xs}", "y", ["1.0e0", "q", "d"], "f") + ", m AS (SELECT y, x1 AS q, x2 AS d, b0 + b1 * x1 + b2 * x2 AS p FROM (SELECT * FROM f_x CROSS JOIN (SELECT b0, b1, b2 FROM f))), z AS (SELECT y, q, d, (p - avg(p) OVER ()) / stddev_pop(p) OVER () AS p FROM m), " + k.regression("SELECT * FROM z", "y", ["1.0e0", "q", "d", "p * p", "p * p * p", "p * p * p * p"], "g")
oracle("reset_test", f"WITH {_RESET}, s AS (SELECT ((SELECT rss FROM f) - rss) / 3 / (rss / (n - 6)) AS s, n - 6 AS d FROM g) SELECT 'reset' AS test, {r('s')} AS statistic, 3.0e0 AS df1, d AS df2, {r(k.f_sf('s', '3', 'd'))} AS p_value FROM s")

# Logit by eight Newton steps from zero, each a weighted regression of the working response.
_STEPS = ["i0 AS (SELECT 0.0e0 AS b0, 0.0e0 AS b1, 0.0e0 AS b2)"]
for _i in range(8):
    _src = f"SELECT x, en, e + (y - 1 / (1 + exp(-e))) / (1 / (1 + exp(-e)) * (1 - 1 / (1 + exp(-e)))) AS z, 1 / (1 + exp(-e)) * (1 - 1 / (1 + exp(-e))) AS wt FROM (SELECT y, x, en, b0 + b1 * x + b2 * en AS e FROM {{bin}} CROSS JOIN i{_i})"
    _STEPS.append(k.regression(_src, "z", ["1.0e0", "x", "en"], f"n{_i}", "wt") + f", i{_i + 1} AS (SELECT b0, b1, b2 FROM n{_i})")
_LOGIT = ", ".join(_STEPS) + ", h AS (SELECT b0, b1, b2, sqrt(v0_0) AS s0, sqrt(v1_1) AS s1, sqrt(v2_2) AS s2, n - 3 AS dof FROM n7)"
_TERMS = ["const", "x", "en"]
oracle("logit_table", f"WITH {_LOGIT} " + _table(_TERMS, "h", ["s0", "s1", "s2"], "dof"))
oracle("logit_marginal_effects", f"WITH {_LOGIT}, p AS (SELECT avg(1 / (1 + exp(-b0 - b1 * x - b2 * en)) * (1 - 1 / (1 + exp(-b0 - b1 * x - b2 * en)))) AS m, any_value(b1) AS b1, any_value(b2) AS b2 FROM {{bin}} CROSS JOIN h) SELECT 'x' AS term, {r('m * b1')} AS effect FROM p UNION ALL SELECT 'en', {r('m * b2')} FROM p")
oracle("logit_odds_ratios", f"WITH {_LOGIT} " + " UNION ALL ".join(f"SELECT '{t}' AS term, {r(f'exp(b{i})')} AS odds_ratio, {r(f'exp(b{i}) * s{i}')} AS std_error, {r(f'exp(b{i}) * (1 - 1.959963984540054e0 * s{i})')} AS ci_lower, {r(f'exp(b{i}) * (1 + 1.959963984540054e0 * s{i})')} AS ci_upper FROM h" for i, t in enumerate(_TERMS)))
oracle("classification_table", f"WITH {_LOGIT}, p AS (SELECT 1 / (1 + exp(-b0 - b1 * x - b2 * en)) >= 0.8 AS hat, y > 0.5 AS y FROM {{bin}} CROSS JOIN h), c AS (SELECT count(*) FILTER (hat AND y) AS tp, count(*) FILTER (hat AND NOT y) AS fp, count(*) FILTER (NOT hat AND NOT y) AS tn, count(*) FILTER (NOT hat AND y) AS fn FROM p) SELECT tp, fp, tn, fn, {r('(tp + tn) / (tp + fp + tn + fn)')} AS accuracy, {r('tp / (tp + fn)')} AS sensitivity, {r('tn / (tn + fp)')} AS specificity FROM c")

# -- autoregressions -------------------------------------------------------------------


def _lagged(p: int, drop: int) -> str:
    cols = ", ".join(f"lag(revenue, {j}) OVER (ORDER BY t) AS p{j}, lag(disc, {j}) OVER (ORDER BY t) AS q{j}" for j in range(1, p + 1))
    return f"SELECT revenue AS p, disc AS q, {cols} FROM {{tsm}} QUALIFY row_number() OVER (ORDER BY t) > {drop}"


def _var(p: int, name: str = "v", drop: int | None = None) -> str:
    """CTEs {name}a, {name}b and {name} with residual covariances."""
    src = _lagged(p, p if drop is None else drop)
    x = ["1.0e0", *[f"{c}{j}" for j in range(1, p + 1) for c in "pq"]]
    line = lambda f: " - ".join([f"{f}.b{i} * {e}" for i, e in enumerate(x)])
    u1, u2 = f"(p - {line(name + 'a')})", f"(q - {line(name + 'b')})"
    cov = f"{name} AS (SELECT avg(power({u1}, 2)) AS s11, avg({u1} * {u2}) AS s12, avg(power({u2}, 2)) AS s22, CAST(count(*) AS DOUBLE) AS n FROM ({src}) CROSS JOIN {name}a CROSS JOIN {name}b)"
    return ", ".join([k.regression(src, "p", x, name + "a"), k.regression(src, "q", x, name + "b"), cov])


oracle("lag_order", "WITH " + ", ".join(_var(p, f"v{p}") for p in range(1, 5)) + " " + " UNION ALL ".join(f"SELECT CAST({p} AS INT) AS p, {r(f'l + 2 * {1 + 2 * p} / n')} AS aic, {r(f'l + ln(n) * {1 + 2 * p} / n')} AS bic, {r(f'l + 2 * ln(ln(n)) * {1 + 2 * p} / n')} AS hqic FROM (SELECT ln(s11 * s22 - s12 * s12) AS l, n FROM v{p})" for p in range(1, 5)))

_A = "c AS (SELECT va.b0 AS c1, vb.b0 AS c2, va.b1 AS a11, va.b2 AS a12, vb.b1 AS a21, vb.b2 AS a22, va.b3 AS e11, va.b4 AS e12, vb.b3 AS e21, vb.b4 AS e22, s11, s12, s22 FROM va CROSS JOIN vb CROSS JOIN v)"
_PSI = ", i AS (SELECT 1 AS h, 1.0e0 AS t11, 0.0e0 AS t12, 0.0e0 AS t21, 1.0e0 AS t22, 0.0e0 AS o11, 0.0e0 AS o12, 0.0e0 AS o21, 0.0e0 AS o22 UNION ALL SELECT h + 1, a11 * t11 + a12 * t21 + e11 * o11 + e12 * o21, a11 * t12 + a12 * t22 + e11 * o12 + e12 * o22, a21 * t11 + a22 * t21 + e21 * o11 + e22 * o21, a21 * t12 + a22 * t22 + e21 * o12 + e22 * o22, t11, t12, t21, t22 FROM i CROSS JOIN c WHERE h < 10)"


def _cells(matrix: str) -> str:
    """variable, shock, x of psi times an impact (columns m11.. of a CTE)."""
    return f"(SELECT h, unnest(['revenue','revenue','disc','disc']) AS variable, unnest(['revenue','disc','revenue','disc']) AS shock, unnest([t11 * m11 + t12 * m21, t11 * m12 + t12 * m22, t21 * m11 + t22 * m21, t21 * m12 + t22 * m22]) AS x FROM i CROSS JOIN {matrix})"


_V2 = f"WITH RECURSIVE {_var(2)}, {_A}{_PSI}, g AS (SELECT sqrt(s11) AS m11, 0.0e0 AS m12, s12 / sqrt(s11) AS m21, sqrt(s22 - s12 * s12 / s11) AS m22 FROM c)"
# Long run: M = I - A1 - A2, D = chol(M^-1 S M^-1'), impact M D.
_LONG = ", n AS (SELECT *, 1 - a11 - e11 AS m1, -a12 - e12 AS m2, -a21 - e21 AS m3, 1 - a22 - e22 AS m4 FROM c), w AS (SELECT *, m4 / (m1 * m4 - m2 * m3) AS i1, -m2 / (m1 * m4 - m2 * m3) AS i2, -m3 / (m1 * m4 - m2 * m3) AS i3, m1 / (m1 * m4 - m2 * m3) AS i4 FROM n), z AS (SELECT *, i1 * i1 * s11 + 2 * i1 * i2 * s12 + i2 * i2 * s22 AS k11, i1 * i3 * s11 + (i1 * i4 + i2 * i3) * s12 + i2 * i4 * s22 AS k12, i3 * i3 * s11 + 2 * i3 * i4 * s12 + i4 * i4 * s22 AS k22 FROM w), l AS (SELECT *, sqrt(k11) AS d11, k12 / sqrt(k11) AS d21, sqrt(k22 - k12 * k12 / k11) AS d22 FROM z), lr AS (SELECT m1 * d11 + m2 * d21 AS m11, m2 * d22 AS m12, m3 * d11 + m4 * d21 AS m21, m4 * d22 AS m22 FROM l)"
oracle("irf_cholesky", f"{_V2} SELECT CAST(h AS INT) AS horizon, variable, shock, {r('x')} AS value FROM {_cells('g')}")
oracle("irf_long_run_cumulative", f"{_V2}{_LONG} SELECT CAST(h AS INT) AS horizon, variable, shock, {r('sum(x) OVER (PARTITION BY variable, shock ORDER BY h)')} AS value FROM {_cells('lr')}")
oracle("var_forecast", f"WITH RECURSIVE {_var(2)}, {_A}{_PSI}, y AS (SELECT *, row_number() OVER (ORDER BY t DESC) AS k FROM {{tsm}}), f AS (SELECT 0 AS h, (SELECT revenue FROM y WHERE k = 1) AS p, (SELECT disc FROM y WHERE k = 1) AS q, (SELECT revenue FROM y WHERE k = 2) AS po, (SELECT disc FROM y WHERE k = 2) AS qo UNION ALL SELECT h + 1, c1 + a11 * p + a12 * q + e11 * po + e12 * qo, c2 + a21 * p + a22 * q + e21 * po + e22 * qo, p, q FROM f CROSS JOIN c WHERE h < 6), s AS (SELECT h, sum(t11 * t11 * s11 + 2 * t11 * t12 * s12 + t12 * t12 * s22) OVER (ORDER BY h) AS w1, sum(t21 * t21 * s11 + 2 * t21 * t22 * s12 + t22 * t22 * s22) OVER (ORDER BY h) AS w2 FROM i CROSS JOIN c) SELECT CAST(f.h AS INT) AS horizon, 'revenue' AS variable, {r('p')} AS forecast, {r('p - 1.959963984540054e0 * sqrt(w1)')} AS lower, {r('p + 1.959963984540054e0 * sqrt(w1)')} AS upper FROM f JOIN s ON s.h = f.h UNION ALL SELECT CAST(f.h AS INT), 'disc', {r('q')}, {r('q - 1.959963984540054e0 * sqrt(w2)')}, {r('q + 1.959963984540054e0 * sqrt(w2)')} FROM f JOIN s ON s.h = f.h")

_SMALL, _BIG = _var(1, "a", 2), _var(2, "b", 2)
_EVEN = "exp(-({0}) / 2) * (1 + ({0}) / 2)"  # chi-square with four degrees of freedom
oracle("lag_tests", f"WITH {_SMALL}, {_BIG}, s AS (SELECT a.n AS n, a.n * (ln(a.s11 * a.s22 - a.s12 * a.s12) - ln(b.s11 * b.s22 - b.s12 * b.s12)) AS lr, a.n * (2 - (a.s22 * b.s11 - 2 * a.s12 * b.s12 + a.s11 * b.s22) / (a.s11 * a.s22 - a.s12 * a.s12)) AS lm FROM a CROSS JOIN b) SELECT 'lr' AS test, {r('lr')} AS statistic, CAST(4 AS INT) AS df, {r(_EVEN.format('lr'))} AS p_value FROM s UNION ALL SELECT 'lm', {r('lm')}, 4, {r(_EVEN.format('lm'))} FROM s")

_L4 = "SELECT " + ", ".join(f"{c}, lag({c}) OVER w AS {c}1, lag({c}, 2) OVER w AS {c}2" for c in ("revenue", "qty", "disc", "tax")) + " FROM {tsm} WINDOW w AS (ORDER BY t) QUALIFY row_number() OVER w > 2"
_ALL4 = ["1.0e0", *[f"{c}{j}" for j in (1, 2) for c in ("revenue", "qty", "disc", "tax")]]
_no = lambda *out: [x for x in _ALL4 if x[:-1] not in out]
oracle("granger_blocks", "WITH " + ", ".join([k.regression(_L4, "revenue", _ALL4, "u"), k.regression(_L4, "revenue", _no("disc", "tax"), "p"), k.regression(_L4, "revenue", _no("qty"), "q")]) + f", s AS (SELECT ((SELECT rss FROM p) - rss) / (rss / (n - 9)) AS a, ((SELECT rss FROM q) - rss) / (rss / (n - 9)) AS b FROM u) SELECT 'prices' AS test, {r('a')} AS statistic, CAST(4 AS INT) AS df, {r(_EVEN.format('a'))} AS p_value FROM s UNION ALL SELECT 'qty', {r('b')}, 2, {r('exp(-b / 2)')} FROM s")

_AR2 = k.regression("SELECT t, z, lag(z) OVER (ORDER BY t) AS z1, lag(z, 2) OVER (ORDER BY t) AS z2 FROM (SELECT t, revenue - avg(revenue) OVER () AS z FROM {tsm}) QUALIFY row_number() OVER (ORDER BY t) > 2", "z", ["1.0e0", "z1", "z2"], "f")
oracle("ar_forecast", f"WITH RECURSIVE {_AR2}, c AS (SELECT (SELECT avg(revenue) FROM {{tsm}}) * (1 - b1 - b2) + b0 AS c0, b1, b2, rss / n AS s2 FROM f), y AS (SELECT revenue, row_number() OVER (ORDER BY t DESC) AS k FROM {{tsm}}), g AS (SELECT 0 AS h, (SELECT revenue FROM y WHERE k = 1) AS p, (SELECT revenue FROM y WHERE k = 2) AS o, 0.0e0 AS w, 1.0e0 AS psi, 0.0e0 AS psi_o UNION ALL SELECT h + 1, c0 + b1 * p + b2 * o, p, w + psi * psi, b1 * psi + b2 * psi_o, psi FROM g CROSS JOIN c WHERE h < 6) SELECT CAST(h AS INT) AS horizon, {r('p')} AS forecast, {r('sqrt(s2 * w)')} AS std_error, {r('p - 1.959963984540054e0 * sqrt(s2 * w)')} AS lower, {r('p + 1.959963984540054e0 * sqrt(s2 * w)')} AS upper FROM g CROSS JOIN c WHERE h > 0")

_SHOCKS = _SQL["var_structural_shocks"]
_JB = "power(avg(power(value - m, 3)) / power(avg(power(value - m, 2)), 1.5), 2) + power(avg(power(value - m, 4)) / power(avg(power(value - m, 2)), 2) - 3, 2) / 4"
_SQL["test_shock_gaussianity"] = f"WITH e AS ({_SHOCKS.replace('round(', '(').replace(', 6) + 0.0', ') + 0.0')}), z AS (SELECT shock, value, avg(value) OVER (PARTITION BY shock) AS m FROM e), j AS (SELECT shock, count(*) / 6.0e0 * ({_JB}) AS s FROM z GROUP BY shock), a AS (SELECT sum(s) AS s FROM j) SELECT shock AS test, {r('s')} AS statistic, CAST(2 AS INT) AS df, {r('exp(-s / 2)')} AS p_value FROM j UNION ALL SELECT 'all', {r('s')}, 4, {r(_EVEN.format('s'))} FROM a"

oracle("shock_totals", f"WITH RECURSIVE {k.var1('SELECT * FROM {tsm}', 'revenue', 'disc')}, y AS (SELECT t, revenue, disc, row_number() OVER (ORDER BY t) AS k FROM {{tsm}}), g AS (SELECT 1 AS k, (SELECT revenue FROM y WHERE k = 1) AS p, (SELECT disc FROM y WHERE k = 1) AS q UNION ALL SELECT k + 1, c1 + a11 * p + a12 * q, c2 + a21 * p + a22 * q FROM g CROSS JOIN v1 WHERE k < (SELECT max(k) FROM y)) SELECT t, 'revenue' AS variable, {r('revenue - p')} AS total FROM y JOIN g USING (k) WHERE k > 1 UNION ALL SELECT t, 'disc', {r('disc - q')} FROM y JOIN g USING (k) WHERE k > 1")

_NARDL = "SELECT revenue AS y, lag(revenue) OVER w AS y1, sum(greatest(d, 0)) OVER w AS u, sum(least(d, 0)) OVER w AS v, sum(greatest(d, 0)) OVER w - greatest(d, 0) AS u1, sum(least(d, 0)) OVER w - least(d, 0) AS v1 FROM (SELECT t, revenue, disc - lag(disc) OVER (ORDER BY t) AS d FROM {tsm}) WHERE d IS NOT NULL WINDOW w AS (ORDER BY t) QUALIFY row_number() OVER w > 1"
oracle("nardl", "WITH " + k.regression(_NARDL, "y", ["1.0e0", "y1", "u", "u1", "v", "v1"], "f") + " SELECT unnest(['const', 'revenue_l1', 'plus_l0', 'plus_l1', 'minus_l0', 'minus_l1', 'lr_plus', 'lr_minus']) AS term, round(unnest([b0, b1, b2, b3, b4, b5, (b2 + b3) / (1 - b1), (b4 + b5) / (1 - b1)]), 6) + 0.0 AS estimate FROM f")

_S = "(SELECT t, revenue, disc, 1 / (1 + exp(-3 * (qty - avg(qty) OVER ()) / stddev_pop(qty) OVER ())) AS g FROM {tsm})"


def _state(h: int, y: str) -> str:
    src = f"SELECT lead({y}, {h}) OVER w AS z, lag(g) OVER w AS f, revenue AS s, lag(revenue) OVER w AS p1, lag(disc) OVER w AS q1 FROM {_S} WINDOW w AS (ORDER BY t) QUALIFY lag(g) OVER w IS NOT NULL AND lead({y}, {h}) OVER w IS NOT NULL"
    x = ["s", "1.0e0", "p1", "q1"]
    return k.regression(src, "z", [f"f * {e}" for e in x] + [f"(1 - f) * {e}" for e in x], f"{y}_{h}")


oracle("state_local_projection", "WITH " + ", ".join(_state(h, y) for y in ("revenue", "disc") for h in range(5)) + " " + " UNION ALL ".join(f"SELECT CAST({h} AS INT) AS horizon, '{y}' AS variable, {r('b0')} AS high, {r('b4')} AS low FROM {y}_{h}" for y in ("revenue", "disc") for h in range(5)))

# -- panels ---------------------------------------------------------------------------

_PL = "SELECT unit, t, y, x, lag(y) OVER w AS y1, lag(x) OVER w AS x1, lag(y, 2) OVER w AS y2, row_number() OVER w AS k FROM {panel} WINDOW w AS (PARTITION BY unit ORDER BY t)"
_CIPS = "SELECT unit, y - y1 AS d, y1, m1, m - m1 AS dm FROM (SELECT unit, t, y, lag(y) OVER w AS y1, m, lag(m) OVER w AS m1 FROM (SELECT unit, t, y, avg(y) OVER (PARTITION BY t) AS m FROM {panel}) WINDOW w AS (PARTITION BY unit ORDER BY t)) WHERE y1 IS NOT NULL"
oracle("cips", "WITH " + k.regression(_CIPS, "d", ["y1", "1.0e0", "m1", "dm"], "f", by="unit") + f" SELECT {r('avg(b0 / sqrt(rss / (n - 4) * v0_0))')} AS cips, count(*) AS units FROM f")
oracle("panel_unit_roots", "WITH " + k.regression(f"SELECT unit, y - y1 AS d, y1 FROM ({_PL}) WHERE k > 1", "d", ["y1", "1.0e0"], "f", by="unit") + f", s AS (SELECT avg(b0 / sqrt(rss / (n - 2) * v0_0)) AS t, count(*) AS k FROM f) SELECT 'ips_tbar' AS test, {r('t')} AS statistic, CAST(NULL AS DOUBLE) AS p_value FROM s UNION ALL SELECT 'ips_w', {r('sqrt(k) * (t + 1.533e0) / sqrt(0.706e0)')}, {r(k.normal_cdf('sqrt(k) * (t + 1.533e0) / sqrt(0.706e0)'))} FROM s")
_DH = f"SELECT * FROM ({_PL}) WHERE k > 1"
_ZB, _ZT = "sqrt(k / 2.0e0) * (w - 1)", "sqrt(k / 2.0e0 * (n - 7) / (n - 4)) * ((n - 5) / (n - 3) * w - 1)"
oracle("dumitrescu_hurlin", "WITH " + k.regression(_DH, "y", ["1.0e0", "y1"], "a", by="unit") + ", " + k.regression(_DH, "y", ["1.0e0", "y1", "x1"], "b", by="unit") + f", s AS (SELECT avg((a.rss - b.rss) / (b.rss / (b.n - 3))) AS w, CAST(count(*) AS DOUBLE) AS k, avg(b.n) AS n FROM a JOIN b USING (unit)) SELECT 'w_bar' AS test, {r('w')} AS statistic, CAST(NULL AS DOUBLE) AS p_value FROM s UNION ALL SELECT 'z_bar', {r(_ZB)}, {r(k.normal_two_sided(_ZB))} FROM s UNION ALL SELECT 'z_tilde', {r(_ZT)}, {r(k.normal_two_sided(_ZT))} FROM s")
_LLC = f"SELECT unit, y - y1 AS d, y1, y1 - y2 AS d1 FROM ({_PL}) WHERE k > 2"
oracle("levin_lin_chu", "WITH " + k.regression(_LLC, "d", ["1.0e0", "d1"], "a", by="unit") + ", " + k.regression(_LLC, "y1", ["1.0e0", "d1"], "b", by="unit") + ", r AS (SELECT q.unit, d - a.b0 - a.b1 * d1 AS e, y1 - b.b0 - b.b1 * d1 AS u FROM (" + _LLC + f") q JOIN a USING (unit) JOIN b USING (unit)), o AS (SELECT unit, sum(u * e) AS ue, sum(u * u) AS uu, sum(e * e) AS ee, count(*) AS n FROM r GROUP BY unit), z AS (SELECT ue / v AS ue, uu / v AS uu, ee / v AS ee, n FROM (SELECT *, (ee - ue * ue / uu) / n AS v FROM o)), s AS (SELECT sum(ue) / sum(uu) AS rho, sum(uu) AS uu, (sum(ee) - sum(ue) / sum(uu) * sum(ue)) / sum(n) AS s2, CAST(count(*) AS DOUBLE) AS k FROM z) SELECT 'rho' AS statistic, {r('rho')} AS value FROM s UNION ALL SELECT 't', {r('rho / sqrt(s2 / uu)')} FROM s UNION ALL SELECT 'units', k FROM s")
_KAO = "WITH w AS (SELECT unit, t, y - avg(y) OVER (PARTITION BY unit) AS y, x - avg(x) OVER (PARTITION BY unit) AS x FROM {panel}), b AS (SELECT sum(x * y) / sum(x * x) AS b FROM w), e AS (SELECT unit, y - b * x AS e, lag(y - b * x) OVER (PARTITION BY unit ORDER BY t) AS l FROM w CROSS JOIN b), s AS (SELECT sum(e * l) / sum(l * l) AS rho, (sum(e * e) - sum(e * l) / sum(l * l) * sum(e * l)) / count(*) AS s2, sum(l * l) AS ll FROM e WHERE l IS NOT NULL)"
oracle("kao", f"{_KAO} SELECT 'rho' AS statistic, {r('rho')} AS value FROM s UNION ALL SELECT 't', {r('(rho - 1) / sqrt(s2 / ll)')} FROM s")
for _name, _d, _dig in (("clark_west", "power(y - f1, 2) - (power(y - f12, 2) - power(f1 - f12, 2))", 6), ("forecast_encompassing", "(y - f1) * (f12 - f1)", 6)):
    _s = "avg(d) / sqrt(var_pop(d) / count(*))"
    if _name == "clark_west":
        oracle(_name, f"WITH d AS (SELECT unit, {_d} AS d FROM {_FC}), s AS (SELECT unit, {_s} AS s FROM d GROUP BY unit) SELECT unit, {r('s')} AS statistic, {r('1 - ' + k.normal_cdf('s'))} AS p_value FROM s")
    else:
        oracle(_name, f"WITH d AS (SELECT unit, {_d} AS d FROM {_FC}), s AS (SELECT unit, {_s} * sqrt((count(*) - 1.0e0) / count(*)) AS s, count(*) - 1.0e0 AS n FROM d GROUP BY unit) SELECT unit, {r('s')} AS statistic, {r(k.t_two_sided('s', 'n'))} AS p_value FROM s")

_PVW = "SELECT " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY unit) AS {c}" for c in ("y", "x", "y1", "x1")) + " FROM (SELECT a.unit, a.t, a.y, a.x, b.y AS y1, b.x AS x1 FROM {panel} a JOIN {panel} b ON a.unit = b.unit AND b.t = a.t - 1)"
oracle("pvar_within", "WITH " + k.regression(_PVW, "y", ["y1", "x1"], "a") + ", " + k.regression(_PVW, "x", ["y1", "x1"], "b") + " SELECT 'y' AS equation, unnest(['y_l1', 'x_l1']) AS term, round(unnest([b0, b1]), 5) + 0.0 AS estimate FROM a UNION ALL SELECT 'x', unnest(['y_l1', 'x_l1']), round(unnest([b0, b1]), 5) + 0.0 FROM b")

# -- input-output ------------------------------------------------------------------------

_N = 5
_GROSS = "x AS (SELECT i, sum(value) AS x FROM (SELECT i, value FROM {flows} UNION ALL SELECT i, value * 0.5 FROM {sales}) GROUP BY i)"
_LEON = f"{_GROSS}, " + k.inverse("SELECT f.i, f.j, CASE WHEN f.i = f.j THEN 1 ELSE 0 END - value / x AS a FROM {flows} f JOIN x ON x.i = f.j", _N, "l")
_GHOSH = k.inverse("SELECT f.i, f.j, CASE WHEN f.i = f.j THEN 1 ELSE 0 END - value / x AS a FROM {flows} f JOIN x ON x.i = f.i", _N, "g")
_col = lambda j: "(" + " + ".join(f"l.m{i}_{j}" for i in range(_N)) + ")"
_row = lambda i: "(" + " + ".join(f"g.m{i}_{j}" for j in range(_N)) + ")"
oracle("io_leontief_inverse", f"WITH {_LEON} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, {r(f'm{i}_{j}')} AS value FROM l" for i in range(_N) for j in range(_N)))
oracle("io_multipliers", f"WITH {_LEON}, {_GHOSH} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS i, {r(_col(i))} AS output_multiplier, {r(_row(i))} AS input_multiplier FROM l CROSS JOIN g" for i in range(_N)))
_mean = lambda f: "((" + " + ".join(f(i) for i in range(_N)) + f") / {_N})"
oracle("io_linkages", f"WITH {_LEON}, {_GHOSH} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS i, {r(f'{_col(i)} / {_mean(_col)}')} AS backward, {r(f'{_row(i)} / {_mean(_row)}')} AS forward FROM l CROSS JOIN g" for i in range(_N)))
# Without a sector the others' output solves the smaller system; its inverse comes from the whole one by taking the sector's row and column out.
_gone = lambda s: " + ".join(f"(m{i}_{j} - m{i}_{s} * m{s}_{j} / m{s}_{s}) * y{j}" for i in range(_N) for j in range(_N) if s not in (i, j))
_YS = "d AS (SELECT " + ", ".join(f"sum(CASE WHEN i = {j} THEN value * 0.5 END) AS y{j}" for j in range(_N)) + " FROM {sales}), tot AS (SELECT sum(x) AS x FROM x)"
oracle("io_extraction", f"WITH {_LEON}, {_YS} " + " UNION ALL ".join(f"SELECT CAST({s} AS INT) AS i, {r(f'x - ({_gone(s)})')} AS loss, {r(f'1 - ({_gone(s)}) / x')} AS share FROM l CROSS JOIN d CROSS JOIN tot" for s in range(_N)))
_SECOND = "SELECT i, j, value * (1 + 0.1e0 * i) AS value FROM {flows}"
_TWO = f"x2 AS (SELECT i, sum(value) AS x FROM (SELECT i, value FROM ({_SECOND}) UNION ALL SELECT i, value FROM {{sales}}) GROUP BY i), " + k.inverse(f"SELECT f.i, f.j, CASE WHEN f.i = f.j THEN 1 ELSE 0 END - value / x AS a FROM ({_SECOND}) f JOIN x2 ON x2.i = f.j", _N, "h")
# Demand doubles (the first table has half the sales), so the change of demand is the first table's demand.
_TECH = lambda i: " + ".join(f"1.5 * (h.m{i}_{j} - l.m{i}_{j}) * y{j}" for j in range(_N))
_DEM = lambda i: " + ".join(f"0.5 * (h.m{i}_{j} + l.m{i}_{j}) * y{j}" for j in range(_N))
oracle("io_structural_decomposition", f"WITH {_LEON}, {_TWO}, {_YS} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS i, {r(_TECH(i))} AS technology, {r(_DEM(i))} AS demand FROM l CROSS JOIN h CROSS JOIN d" for i in range(_N)))

# Demand is the same mix twice over, so each ratio of it is two and technology's is that of the inverses.
_OVER = lambda m, i: "(" + " + ".join(f"{m}.m{i}_{j} * y{j}" for j in range(_N)) + ")"
oracle("io_structural_decomposition_ratio", f"WITH {_LEON}, {_TWO}, {_YS} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS i, {r(_OVER('h', i) + ' / ' + _OVER('l', i))} AS technology, 2.0e0 AS demand FROM l CROSS JOIN h CROSS JOIN d" for i in range(_N)))

# -- structural models: log utility, full depreciation, known in closed form --------------------

_G = "WITH p AS (SELECT 0.3e0 AS al, " + _RHO + " AS rho, 0.01e0 AS s, power(0.285e0, 1 / 0.7e0) AS kb, power(0.285e0, 1 / 0.7e0) * 0.715e0 / 0.285e0 AS cb)"
_LAW = {("c", "k"): "al * cb / kb", ("c", "a"): "cb * rho", ("k", "k"): "al", ("k", "a"): "kb * rho", ("a", "a"): "rho"}
_HIT = {"c": "cb * s", "k": "kb * s", "a": "s"}
oracle("structural_solvers", f"{_G} " + " UNION ALL ".join([f"SELECT '{m}' AS method, 'g' AS matrix, '{a}' AS row, '{b}' AS column, {r(_LAW.get((a, b), '0.0e0'))} AS value, true AS determined FROM p" for m in ("blanchard_kahn", "cyclic_reduction", "time_iteration") for a in "cka" for b in "cka"] + [f"SELECT '{m}', 'h', '{a}', 'e', {r(_HIT[a])}, true FROM p" for m in ("blanchard_kahn", "cyclic_reduction", "time_iteration") for a in "cka"]))
# Capital over its mean follows k = al k(-1) + a, consumption the same; a is an AR(1).
_VA, _VK = "s * s / (1 - rho * rho)", "(s * s / (1 - rho * rho) * (1 + al * rho) / ((1 - al * rho) * (1 - al * al)))"
oracle("structural_solution", f"{_G}, v AS (SELECT *, {_VA} AS va, {_VK} AS vk FROM p), w AS (SELECT *, va / (1 - al * rho) AS cka FROM v) SELECT 'a' AS variable, 0.0e0 AS steady_state, {r('sqrt(va)')} AS std_dev, {r('rho')} AS autocorrelation, CAST(3 AS INT) AS stable_roots, true AS determined FROM w UNION ALL SELECT 'k', {r('kb')}, {r('kb * sqrt(vk)')}, {r('al + rho * cka / vk')}, 3, true FROM w UNION ALL SELECT 'c', {r('cb')}, {r('cb * sqrt(vk)')}, {r('al + rho * cka / vk')}, 3, true FROM w")
oracle("structural_variance_shares", "SELECT CAST(h AS INT) AS horizon, v AS variable, 'e' AS shock, 1.0e0 AS share FROM range(1, 21) q(h), (VALUES ('c'), ('k'), ('a')) x(v)")
oracle("transfer_function_baxter_king", "WITH c AS (SELECT 2 * pi() / 32 AS a, 2 * pi() / 6 AS b), w0 AS (SELECT j, CASE WHEN j = 0 THEN (b - a) / pi() ELSE (sin(b * j) - sin(a * j)) / (pi() * greatest(j, 1)) END AS w FROM c CROSS JOIN range(0, 13) q(j)), w1 AS (SELECT j, w - (SELECT sum(CASE WHEN j = 0 THEN w ELSE 2 * w END) FROM w0) / 25 AS w FROM w0), z AS (SELECT revenue - avg(revenue) OVER () AS z, row_number() OVER (ORDER BY t) - 1 AS r, count(*) OVER () AS n FROM {tsm}), s AS (SELECT 2 * pi() * k / any_value(n) AS x, (power(sum(z * cos(2 * pi() * k * r / n)), 2) + power(sum(z * sin(2 * pi() * k * r / n)), 2)) / (2 * pi() * any_value(n)) AS p FROM z CROSS JOIN range(1, (SELECT count(*) // 2 + 1 FROM z)) g(k) GROUP BY k), g AS (SELECT x, any_value(p) AS p, abs(sum(CASE WHEN j = 0 THEN w ELSE 2 * w * cos(j * x) END)) AS g FROM s CROSS JOIN w1 GROUP BY x) SELECT " + f"{r('x', 5)} AS frequency, {r('p', 5)} AS power, {r('g', 5)} AS gain, {r('p * g * g', 5)} AS passed FROM g")


# -- stretches of a series by running sums ---------------------------------------------------

_SEG = "WITH o AS (SELECT t, revenue AS y, row_number() OVER (ORDER BY t) AS i FROM {tsm}), p AS (SELECT 0 AS i, 0.0e0 AS s, 0.0e0 AS q UNION ALL SELECT i, sum(y) OVER (ORDER BY t), sum(y * y) OVER (ORDER BY t) FROM o), n AS (SELECT max(i) AS n, CAST(greatest(2, floor(0.15e0 * max(i))) AS INT) AS h FROM p), r AS (SELECT a.i AS a, b.i AS b, b.q - a.q - power(b.s - a.s, 2) / (b.i - a.i) AS c FROM p a JOIN p b ON b.i > a.i CROSS JOIN n WHERE b.i - a.i >= h)"
_BIC = lambda m: r(f"n * ln(s / n) + {2 * m + 1} * ln(n)")
oracle(
    "bai_perron_breaks",
    f"{_SEG}, m0 AS (SELECT c AS s, n FROM r CROSS JOIN n WHERE a = 0 AND b = n), m1 AS (SELECT x.c + z.c AS s, n, x.b AS k FROM r x JOIN r z ON z.a = x.b CROSS JOIN n WHERE x.a = 0 AND z.b = n ORDER BY s LIMIT 1), "
    f"m2 AS (SELECT x.c + w.c + z.c AS s, n, x.b AS k, w.b AS j FROM r x JOIN r w ON w.a = x.b JOIN r z ON z.a = w.b CROSS JOIN n WHERE x.a = 0 AND z.b = n ORDER BY s LIMIT 1) "
    f"SELECT CAST(0 AS INT) AS breaks, {r('s')} AS rss, {_BIC(0)} AS bic, '' AS dates FROM m0 UNION ALL SELECT 1, {r('s')}, {_BIC(1)}, CAST((SELECT t FROM o WHERE i = k + 1) AS VARCHAR) FROM m1 UNION ALL SELECT 2, {r('s')}, {_BIC(2)}, (SELECT CAST(t AS VARCHAR) FROM o WHERE i = k + 1) || ',' || (SELECT CAST(t AS VARCHAR) FROM o WHERE i = j + 1) FROM m2",
)
oracle(
    "explosive_roots",
    "WITH o AS (SELECT t, revenue - avg(revenue) OVER () AS y, row_number() OVER (ORDER BY t) AS i FROM {tsm}), d AS (SELECT i, y - lag(y) OVER (ORDER BY i) AS d, lag(y) OVER (ORDER BY i) AS x FROM o), p AS (SELECT 1 AS i, 0.0e0 AS sx, 0.0e0 AS sd, 0.0e0 AS xx, 0.0e0 AS xd, 0.0e0 AS dd UNION ALL SELECT i, sum(x) OVER w, sum(d) OVER w, sum(x * x) OVER w, sum(x * d) OVER w, sum(d * d) OVER w FROM d WHERE i > 1 WINDOW w AS (ORDER BY i)), "
    "s AS (SELECT a.i AS a, b.i AS b, b.i - a.i AS m, b.sx - a.sx AS sx, b.sd - a.sd AS sd, b.xx - a.xx AS xx, b.xd - a.xd AS xd, b.dd - a.dd AS dd FROM p a JOIN p b ON b.i - a.i >= 29), "
    "c AS (SELECT a, b, m, xx - sx * sx / m AS vx, xd - sx * sd / m AS vxd, dd - sd * sd / m AS vd FROM s), "
    f"q AS (SELECT a, b, vxd / vx / sqrt((vd - vxd * vxd / vx) / (m - 2) / vx) AS t FROM c) SELECT 'sadf' AS test, {r('max(t)')} AS statistic FROM q WHERE a = 1 UNION ALL SELECT 'gsadf', {r('max(t)')} FROM q",
)


# -- lagged systems: the regressions of each horizon, reduced ranks of a pair, long-run multipliers -----

_ROWS = "SELECT t, revenue AS p, disc AS q, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS n FROM {tsm}"
_LEADS = f"SELECT a.i, h, b.p AS yp, b.q AS yq, a.p AS s, x.p AS p1, x.q AS q1, z.p AS p2, z.q AS q2, a.n FROM o a JOIN o b ON b.i >= a.i AND b.i <= a.i + 6 CROSS JOIN LATERAL (SELECT b.i - a.i AS h) JOIN o x ON x.i = a.i - 1 JOIN o z ON z.i = a.i - 2"
_LP_X = ["s", "1.0e0", "p1", "q1", "p2", "q2"]


def _projection_part(v: str, name: str) -> str:
    fit = f"fit_{v}"
    e = f"(y{v} - " + " - ".join(f"b{i} * ({x})" for i, x in enumerate(_LP_X)) + ")"
    score = "(" + " + ".join(f"v0_{i} * ({x})" for i, x in enumerate(_LP_X)) + ")"
    return (
        f"{k.regression('SELECT * FROM w', f'y{v}', _LP_X, fit, by='h')},\n"
        f"sc_{v} AS (SELECT w.h, w.i, {score} * {e} AS a FROM w JOIN {fit} f ON f.h = w.h),\n"
        f"hac_{v} AS (SELECT x.h, sum(CASE WHEN z.i = x.i THEN 1.0e0 ELSE 2 * (1 - (x.i - z.i) / (bw + 1.0e0)) END * x.a * z.a) AS s FROM sc_{v} x JOIN bws ON bws.h = x.h JOIN sc_{v} z ON z.h = x.h AND z.i BETWEEN x.i - bw AND x.i GROUP BY x.h)"
    )


_LP_OUT = lambda v, name: f"SELECT CAST(f.h AS INT) AS horizon, '{name}' AS variable, {r('b0')} AS value, {r('sqrt(s)')} AS std_error, {r('b0 - 1.959963984540054e0 * sqrt(s)')} AS lower, {r('b0 + 1.959963984540054e0 * sqrt(s)')} AS upper FROM fit_{v} f JOIN hac_{v} g ON g.h = f.h"
oracle(
    "local_projection",
    f"WITH o AS ({_ROWS}), w AS ({_LEADS}), bws AS (SELECT h, CAST(greatest(h + 1, floor(4 * power(count(*) / 100.0e0, 2.0e0 / 9))) AS INT) AS bw FROM w GROUP BY h),\n{_projection_part('p', 'revenue')},\n{_projection_part('q', 'disc')}\n{_LP_OUT('p', 'revenue')} UNION ALL {_LP_OUT('q', 'disc')}",
)

_JO = "SELECT p - lag(p) OVER w AS dp, q - lag(q) OVER w AS dq, lag(p) OVER w AS lp, lag(q) OVER w AS lq, lag(p) OVER w - lag(p, 2) OVER w AS dp1, lag(q) OVER w - lag(q, 2) OVER w AS dq1, row_number() OVER w AS i FROM (SELECT t, revenue AS p, disc AS q FROM {tsm}) WINDOW w AS (ORDER BY t)"
_JX = ["1.0e0", "dp1", "dq1"]
_RES = lambda y: f"({y} - " + " - ".join(f"f{y}.b{i} * ({x})" for i, x in enumerate(_JX)) + ")"
_EIG = "(tr + {} * sqrt(greatest(tr * tr - 4 * dt, 0))) / 2"
oracle(
    "johansen",
    f"WITH w AS (SELECT * FROM ({_JO}) WHERE i > 2), "
    + ", ".join(k.regression("SELECT * FROM w", y, _JX, f"f{y}") for y in ("dp", "dq", "lp", "lq"))
    + f", u AS (SELECT {_RES('dp')} AS a, {_RES('dq')} AS b, {_RES('lp')} AS c, {_RES('lq')} AS d FROM w CROSS JOIN fdp CROSS JOIN fdq CROSS JOIN flp CROSS JOIN flq), "
    "s AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(c * c) AS cc, sum(c * d) AS cd, sum(d * d) AS dd, sum(a * c) AS ac, sum(a * d) AS ad, sum(b * c) AS bc, sum(b * d) AS bd FROM u), "
    # S10 S00^-1 S01 = [[m, o], [o, r]]; then S11^-1 times it.
    "g AS (SELECT *, (bb * ac * ac - 2 * ab * ac * bc + aa * bc * bc) / (aa * bb - ab * ab) AS m, (bb * ac * ad - ab * (ac * bd + bc * ad) + aa * bc * bd) / (aa * bb - ab * ab) AS o, (bb * ad * ad - 2 * ab * ad * bd + aa * bd * bd) / (aa * bb - ab * ab) AS r FROM s), "
    "e AS (SELECT n, (dd * m - 2 * cd * o + cc * r) / (cc * dd - cd * cd) AS tr, (m * r - o * o) / (cc * dd - cd * cd) AS dt FROM g), "
    f"z AS (SELECT n, {_EIG.format('1')} AS l1, {_EIG.format('-1')} AS l2 FROM e) "
    f"SELECT CAST(0 AS INT) AS rank, {r('l1')} AS eigenvalue, {r('-n * (ln(1 - l1) + ln(1 - l2))')} AS trace, {r('-n * ln(1 - l1)')} AS max_eigen, 15.41e0 AS trace_cv_5 FROM z UNION ALL SELECT 1, {r('l2')}, {r('-n * ln(1 - l2)')}, {r('-n * ln(1 - l2)')}, 3.76e0 FROM z",
)

_AR = "SELECT revenue AS y, disc AS x, lag(revenue) OVER w AS y1, lag(disc) OVER w AS x1, row_number() OVER w AS i FROM {tsm} WINDOW w AS (ORDER BY t)"
_S2, _GAP = "(rss / (n - 4))", "(1 - b1)"
_LR = f"((b2 + b3) / {_GAP})"
_G = ("0.0e0", f"({_LR} / {_GAP})", f"(1 / {_GAP})", f"(1 / {_GAP})")
_LRV = " + ".join(f"{_G[i]} * {_G[j]} * v{i}_{j}" for i in range(4) for j in range(4))
oracle(
    "ardl",
    f"WITH w AS (SELECT * FROM ({_AR}) WHERE i > 1), {k.regression('SELECT * FROM w', 'y', ['1.0e0', 'y1', 'x', 'x1'])}, {k.regression('SELECT * FROM w', 'y - y1', ['1.0e0', 'x - x1'], 'short')} "
    + " UNION ALL ".join(f"SELECT '{n}' AS term, {r(f'b{i}')} AS estimate, {r(f'sqrt({_S2} * v{i}_{i})')} AS std_error FROM fit" for i, n in enumerate(("const", "revenue_l1", "disc_l0", "disc_l1")))
    + f" UNION ALL SELECT 'lr_disc', {r(_LR)}, {r(f'sqrt({_S2} * ({_LRV}))')} FROM fit UNION ALL SELECT 'bounds_f', {r('(short.rss - fit.rss) / 2 / (fit.rss / (fit.n - 4))')}, NULL FROM fit CROSS JOIN short",
)

_DF = "SELECT y - lag(y) OVER w AS d, lag(y) OVER w AS l, lag(y) OVER w - lag(y, 2) OVER w AS d1, row_number() OVER w AS i FROM (SELECT t, revenue AS y FROM {tsm}) WINDOW w AS (ORDER BY t)"
oracle("unit_root_one_series", f"WITH {k.regression(f'SELECT * FROM ({_DF}) WHERE i > 2', 'd', ['l', 'd1', '1.0e0'])} SELECT {r('b0 / sqrt(rss / (n - 3) * v0_0)')} AS statistic, CAST(1 AS INT) AS lags, CAST(n AS INT) AS n, {r('-2.86154e0 - 2.8903e0 / n - 4.234e0 / (n * n) - 40.040e0 / (n * n * n)')} AS cv_5 FROM fit")

_PQ = "SELECT revenue AS p, disc AS q, lag(revenue) OVER w AS p1, lag(disc) OVER w AS q1, lag(revenue, 2) OVER w AS p2, lag(disc, 2) OVER w AS q2, row_number() OVER w AS i FROM {tsm} WINDOW w AS (ORDER BY t)"
_TERMS = ("const", "revenue_l1", "disc_l1")
_UV = "u AS (SELECT p - va.b0 - va.b1 * p1 - va.b2 * q1 AS a, q - vb.b0 - vb.b1 * p1 - vb.b2 * q1 AS b FROM w CROSS JOIN va CROSS JOIN vb), s AS (SELECT sum(a * a) / (count(*) - 3) AS s11, sum(a * b) / (count(*) - 3) AS s12, sum(b * b) / (count(*) - 3) AS s22 FROM u)"
oracle(
    "var_coefficient_covariance",
    f"WITH w AS (SELECT * FROM ({_PQ}) WHERE i > 1), {k.regression('SELECT * FROM w', 'p', ['1.0e0', 'p1', 'q1'], 'va')}, {k.regression('SELECT * FROM w', 'q', ['1.0e0', 'p1', 'q1'], 'vb')}, {_UV} "
    + " UNION ALL ".join(f"SELECT '{e}' AS equation, '{a}' AS term, '{f}' AS equation2, '{b}' AS term2, {r(f's{1 + min(m, o)}{1 + max(m, o)} * v{i}_{j}', 8)} AS value FROM va CROSS JOIN s" for m, e in enumerate(("revenue", "disc")) for i, a in enumerate(_TERMS) for o, f in enumerate(("revenue", "disc")) for j, b in enumerate(_TERMS)),
)

_E = "f AS (SELECT unit, t, y - avg(y) OVER (PARTITION BY unit) AS y, x - avg(x) OVER (PARTITION BY unit) AS x FROM {panel}), b AS (SELECT sum(x * y) / sum(x * x) AS b FROM f), e AS (SELECT unit, t, y - b * x AS e FROM f CROSS JOIN b)"
_CD = "sqrt(2.0e0 / (n * (n - 1))) * s"
oracle(
    "panel_pesaran_cd",
    f"WITH {_E}, p AS (SELECT corr(a.e, c.e) AS r, count(*) AS k FROM e a JOIN e c ON c.t = a.t AND c.unit > a.unit GROUP BY a.unit, c.unit HAVING count(*) > 2), s AS (SELECT sum(sqrt(k) * r) AS s FROM p), n AS (SELECT CAST(count(DISTINCT unit) AS DOUBLE) AS n FROM e), c AS (SELECT {_CD} AS cd FROM s CROSS JOIN n) SELECT 'pesaran_cd' AS test, {r('cd')} AS statistic, 1.0e0 AS df1, CAST(NULL AS DOUBLE) AS df2, {r(k.normal_two_sided('cd'))} AS p_value FROM c",
)
