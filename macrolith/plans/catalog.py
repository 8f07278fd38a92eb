"""All registered queries of the library's own operators, with the SQL that each is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, containers, describe, dynamics, forecasting, further, inputoutput, limited, multivariate, panel, regression, series, structural, transforms
from ..streaming import running
from .base import base, rounded, sql, table

FLAGSHIP = "ols_hc1_three_regressors"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _all() -> None:
    """The further queries and their SQL register themselves on import, once this module is whole."""
    from . import catalog_more, oracles  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def register(name: str, oracle: str | None = None, digits: int = 6):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: rounded(f(lambda n: base(spark, sf_dir, n) if n in _BASES else table(spark, sf_dir, n)), digits)
        if oracle:
            _SQL[name] = sql(oracle)
        return f

    return add


_BASES = ("xs", "tsm", "panel", "gaps", "did", "hours", "flows", "sales", "bin")
R = "round({}, 6) + 0.0"

# -- containers, cleaning, transforms --------------------------------------


_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 6) + 0.0 AS sd, round(min({c}), 6) + 0.0 AS min, round(quantile_cont({c}, 0.25), 6) + 0.0 AS q25, round(median({c}), 6) + 0.0 AS median, round(quantile_cont({c}, 0.75), 6) + 0.0 AS q75, round(max({c}), 6) + 0.0 AS max, "
    f"round(avg(power({c} - m_{c}, 3)) / power(stddev_pop({c}), 3), 6) + 0.0 AS skewness, round(avg(power({c} - m_{c}, 4)) / power(var_pop({c}), 2) - 3, 6) + 0.0 AS kurtosis FROM (SELECT *, avg({c}) OVER () AS m_{c} FROM {{xs}})"
    for c in ("y", "q", "d", "tax")
)


@register("describe_data", _DESCRIBE)
def _(t):
    return describe.describe(t("xs"), ["y", "q", "d", "tax"])


def _holes(t):
    return t("tsm").select("t", F.when(F.col("t") % 5 == 0, float("nan")).when(F.col("t") % 7 == 0, float("inf")).otherwise(F.col("revenue")).alias("v"), F.lit(1.0).alias("flat"))


_HOLES = "(SELECT t, CASE WHEN t % 5 = 0 OR t % 7 = 0 THEN NULL ELSE revenue END AS v FROM {tsm})"


@register("diagnose", "SELECT 'v' AS variable, count(*) AS n, count(*) FILTER (t % 5 = 0) AS n_missing, count(*) FILTER (t % 7 = 0 AND t % 5 <> 0) AS n_inf, false AS is_constant, count(*) < 10 AS is_short FROM {tsm} UNION ALL SELECT 'flat', count(*), 0, 0, true, count(*) < 10 FROM {tsm}")
def _(t):
    return cleaning.diagnose(_holes(t), ["v", "flat"])


@register("dropna", f"SELECT t, round(v, 6) + 0.0 AS v FROM {_HOLES} WHERE v IS NOT NULL")
def _(t):
    return cleaning.dropna(_holes(t), ["v"]).select("t", "v")


@register("fix_listwise", f"SELECT t, round(v, 6) + 0.0 AS v FROM {_HOLES} WHERE v IS NOT NULL")
def _(t):
    return cleaning.fix(_holes(t), ["v", "flat"])


@register("fix_mean", f"SELECT t, round(coalesce(v, avg(v) OVER ()), 6) + 0.0 AS v FROM {_HOLES}")
def _(t):
    return cleaning.fix(_holes(t), ["v"], "mean").select("t", "v")


@register(
    "fix_interpolate",
    f"""WITH k AS (SELECT t, v, row_number() OVER (ORDER BY t) AS r FROM {_HOLES}),
e AS (SELECT a.t, a.v, a.r, (SELECT max(r) FROM k b WHERE b.r <= a.r AND b.v IS NOT NULL) AS r0, (SELECT min(r) FROM k b WHERE b.r >= a.r AND b.v IS NOT NULL) AS r1 FROM k a)
SELECT e.t, round(CASE WHEN e.v IS NOT NULL THEN e.v WHEN r0 IS NULL THEN y.v WHEN r1 IS NULL THEN x.v ELSE x.v + (y.v - x.v) * (e.r - r0) / (r1 - r0) END, 6) + 0.0 AS v
FROM e LEFT JOIN k x ON x.r = r0 LEFT JOIN k y ON y.r = r1""",
)
def _(t):
    return cleaning.fix(_holes(t), ["v"], "interpolate", "t").select("t", "v")


@register("keep_rows", "SELECT t, round(revenue, 6) + 0.0 AS revenue FROM (SELECT *, row_number() OVER (ORDER BY t) AS r FROM {tsm}) WHERE r IN (1, 3, 10)")
def _(t):
    return cleaning.keep_rows(t("tsm").select("t", "revenue"), ["t"], [1, 3, 10])


_D = "v - lag(v) OVER w"
for _code, _expr in {1: "v", 2: _D, 3: "v - 2 * lag(v) OVER w + lag(v, 2) OVER w", 4: "ln(v)", 5: "ln(v) - lag(ln(v)) OVER w", 6: "ln(v) - 2 * lag(ln(v)) OVER w + lag(ln(v), 2) OVER w", 7: "v / lag(v) OVER w - lag(v) OVER w / lag(v, 2) OVER w"}.items():
    _lost = {1: 0, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 2}[_code]

    @register(f"apply_tcode_{_code}", f"SELECT t, round({_expr}, 6) + 0.0 AS v FROM (SELECT t, revenue AS v FROM {{tsm}}) WINDOW w AS (ORDER BY t) QUALIFY row_number() OVER w > {_lost}")
    def _(t, code=_code):
        return transforms.apply_tcodes(t("tsm").select("t", F.col("revenue").alias("v")), {"v": code}, "t")

    @register(f"inverse_tcode_{_code}", f"SELECT t, round(revenue, 5) + 0.0 AS v FROM (SELECT t, revenue, row_number() OVER (ORDER BY t) AS r FROM {{tsm}}) WHERE r > {_lost}", digits=5)
    def _(t, code=_code, lost=_lost):
        d = t("tsm").select("t", F.col("revenue").alias("v"))
        first = [r.v for r in d.orderBy("t").limit(2).collect()]
        return transforms.inverse_tcode(transforms.apply_tcodes(d, {"v": code}, "t"), "v", code, "t", first[:lost] if code != 4 else [])


for _name, _f, _k in (("panel_lag", transforms.panel_lag, 1), ("panel_lead", transforms.panel_lead, -1)):

    @register(_name, f"SELECT a.unit, a.t, round(b.y, 6) + 0.0 AS v FROM {{gaps}} a LEFT JOIN {{gaps}} b ON a.unit = b.unit AND b.t = a.t - ({_k})")
    def _(t, f=_f):
        return f(t("gaps"), "y", "unit", "t", name="v").select("unit", "t", "v")


@register("panel_lag_3", "SELECT a.unit, a.t, round(b.y, 6) + 0.0 AS v FROM {gaps} a LEFT JOIN {gaps} b ON a.unit = b.unit AND b.t = a.t - 3")
def _(t):
    return transforms.panel_lag(t("gaps"), "y", "unit", "t", 3, "v").select("unit", "t", "v")


@register("panel_diff", "SELECT a.unit, a.t, round(a.y - b.y, 6) + 0.0 AS v FROM {gaps} a LEFT JOIN {gaps} b ON a.unit = b.unit AND b.t = a.t - 1")
def _(t):
    return transforms.panel_diff(t("gaps"), "y", "unit", "t", "v").select("unit", "t", "v")


@register("xtset_summary", "SELECT count(*) AS groups, min(n) AS min_obs, round(avg(n), 6) + 0.0 AS mean_obs, max(n) AS max_obs, min(a) AS first_t, max(b) AS last_t, min(n) = max(n) AS balanced FROM (SELECT unit, count(*) AS n, min(t) AS a, max(t) AS b FROM {gaps} GROUP BY unit)")
def _(t):
    return containers.xtset(t("gaps"), "unit", "t").summary()


@register("panel_counts", "SELECT unit, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM {gaps} GROUP BY unit")
def _(t):
    return containers.xtset(t("gaps"), "unit", "t").counts()


@register("group_data", "SELECT t, round(y, 6) + 0.0 AS y FROM {panel} WHERE unit = 3")
def _(t):
    return containers.xtset(t("panel"), "unit", "t").select("y").group_data(3).df


# Of logarithms: sums of cents make exact ties at the last digit kept, which any order of summation decides its own way.
@register("within_demean", "SELECT unit, t, round(ln(y) - avg(ln(y)) OVER (PARTITION BY unit), 6) + 0.0 AS y FROM {panel}")
def _(t):
    return transforms.demean(t("panel").select("unit", "t", F.log("y").alias("y")), ["y"], ["unit"])


#: Residuals of y and x on unit and time effects, by projections in turn: the panel has gaps. A step takes unit means out, then gives the time means left.
_TWO_WAY = """WITH RECURSIVE p AS MATERIALIZED (SELECT unit, t, y, x FROM {panel}),
it AS (SELECT 0 AS k, t, 0.0e0 AS ty, 0.0e0 AS tx FROM p GROUP BY t UNION ALL
SELECT k + 1, t, avg(y - ay), avg(x - ax) FROM (SELECT it.k, p.t, p.y, p.x, avg(p.y - it.ty) OVER (PARTITION BY p.unit) AS ay, avg(p.x - it.tx) OVER (PARTITION BY p.unit) AS ax FROM p JOIN it ON it.t = p.t WHERE it.k < 150) GROUP BY k, t),
w AS (SELECT unit, t, y - avg(y) OVER (PARTITION BY unit) AS y, x - avg(x) OVER (PARTITION BY unit) AS x FROM (SELECT p.unit, p.t, p.y - ty AS y, p.x - tx AS x FROM p JOIN it ON it.t = p.t AND it.k = 150)) """


@register("two_way_demean", _TWO_WAY + "SELECT unit, t, round(y, 6) + 0.0 AS y FROM w")
def _(t):
    return transforms.two_way_demean(t("panel").select("unit", "t", "y"), ["y"], "unit", "t")


@register("var_design", "SELECT t, round(revenue, 6) + 0.0 AS revenue, round(lag(revenue) OVER w, 6) + 0.0 AS revenue_l1, round(lag(revenue, 2) OVER w, 6) + 0.0 AS revenue_l2 FROM {tsm} WINDOW w AS (ORDER BY t) QUALIFY row_number() OVER w > 2")
def _(t):
    return transforms.lag_design(t("tsm").select("t", "revenue"), ["revenue"], 2, "t")


# -- association and equality ----------------------------------------------


@register("correlation_pearson", "SELECT 'pearson' AS method, count(*) AS n, round(corr(y, q), 6) + 0.0 AS estimate FROM {xs}")
def _(t):
    return describe.correlation_test(t("xs"), "y", "q").select("method", "n", "estimate")


_RANK = "(SELECT *, rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS r FROM {{{1}}})"


@register("correlation_spearman", "SELECT 'spearman' AS method, count(*) AS n, round(corr(a, b), 6) + 0.0 AS estimate FROM (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS b FROM {xs})")
def _(t):
    return describe.correlation_test(t("xs"), "y", "q", "spearman").select("method", "n", "estimate")


@register("correlation_kendall", "WITH p AS (SELECT sign(a.revenue - b.revenue) AS x, sign(a.disc - b.disc) AS y FROM {tsm} a JOIN {tsm} b ON a.t < b.t) SELECT (SELECT count(*) FROM {tsm}) AS n, round(sum(x * y) / sqrt(sum(x * x) * CAST(sum(y * y) AS DOUBLE)), 6) + 0.0 AS tau FROM p")
def _(t):
    return describe.kendall(t("tsm"), "revenue", "disc")


@register("t_test_one_sample", "SELECT 'one-sample' AS kind, round(avg(d), 6) + 0.0 AS estimate, round((avg(d) - 0.5) / sqrt(var_samp(d) / count(*)), 6) + 0.0 AS statistic, round(count(*) - 1, 6) + 0.0e0 AS df FROM {xs}")
def _(t):
    return describe.t_test(t("xs"), "d", mu=0.5).drop("p_value")


@register("t_test_welch", "WITH g AS (SELECT status, count(*) AS n, avg(y) AS m, var_samp(y) / count(*) AS v FROM {xs} GROUP BY status), w AS (SELECT a.m - b.m AS e, a.v + b.v AS v, a.v * a.v / (a.n - 1) + b.v * b.v / (b.n - 1) AS q FROM g a JOIN g b ON a.status < b.status) SELECT 'welch' AS kind, round(e, 6) + 0.0 AS estimate, round(e / sqrt(v), 6) + 0.0 AS statistic, round(v * v / q, 3) + 0.0 AS df FROM w")
def _(t):
    return describe.t_test(t("xs"), "y", "status").drop("p_value").withColumn("df", F.round("df", 3))


@register("t_test_paired", "SELECT 'paired' AS kind, round(avg(d - tax), 6) + 0.0 AS estimate, round(avg(d - tax) / sqrt(var_samp(d - tax) / count(*)), 6) + 0.0 AS statistic FROM {xs}")
def _(t):
    return describe.t_test(t("xs"), "d", pair="tax").select("kind", "estimate", "statistic")


_F = "SELECT '{name}' AS test, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) + 0.0 AS statistic FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g FROM (SELECT flag, count(*) AS n, avg({c}) AS m, var_samp({c}) AS v FROM {src} GROUP BY flag))"
_SPREAD = "(SELECT flag, abs(y - avg(y) OVER (PARTITION BY flag)) AS a, abs(y - median(y) OVER (PARTITION BY flag)) AS b FROM {xs})"
_EQUAL = " UNION ALL ".join(
    [
        _F.replace("{name}", "anova").replace("{c}", "y").replace("{src}", "{xs}"),
        _F.replace("{name}", "levene").replace("{c}", "a").replace("{src}", _SPREAD),
        _F.replace("{name}", "brown_forsythe").replace("{c}", "b").replace("{src}", _SPREAD),
        "SELECT 'kruskal_wallis', round(sum(n * power(m - (t + 1) / 2.0, 2)) / any_value(s), 6) + 0.0 FROM (SELECT flag, count(*) AS n, avg(r) AS m, any_value(t) AS t, any_value(s) AS s FROM (SELECT *, var_samp(r) OVER () AS s, count(*) OVER () AS t FROM (SELECT flag, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS r FROM {xs})) GROUP BY flag)",
        "SELECT 'bartlett', round(((sum(n) - count(*)) * ln(sum((n - 1) * v) / (sum(n) - count(*))) - sum((n - 1) * ln(v))) / (1 + (sum(1.0 / (n - 1)) - 1.0 / (sum(n) - count(*))) / (3 * (count(*) - 1))), 6) + 0.0 FROM (SELECT flag, count(*) AS n, var_samp(y) AS v FROM {xs} GROUP BY flag)",
    ]
)


@register("equality_tests", _EQUAL)
def _(t):
    return describe.equality_tests(t("xs"), "y", "flag").where(F.col("test").isin("anova", "levene", "brown_forsythe", "kruskal_wallis", "bartlett")).select("test", "statistic")


@register("equality_tests_two_groups")
def _(t):
    return describe.equality_tests(t("xs"), "y", "status")


@register("edf_tests_normal")
def _(t):
    return describe.edf_statistics(t("xs"), "y")


# -- regression ------------------------------------------------------------


@register("ols_hc1_three_regressors")
def _(t):
    return regression.ols(t("xs"), "y", ["q", "d", "tax"]).table()


@register("ols_simple", "SELECT 'const' AS term, round(regr_intercept(y, q), 6) + 0.0 AS estimate FROM {xs} UNION ALL SELECT 'q', round(regr_slope(y, q), 6) + 0.0 FROM {xs}")
def _(t):
    return regression.ols(t("xs"), "y", ["q"], "ols").table().select("term", "estimate")


_TWO = "(SELECT count(*) AS n, var_pop({a}) AS saa, var_pop({b}) AS sbb, covar_pop({a}, {b}) AS sab, covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby, var_pop({y}) AS syy, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my FROM {src})"


def _two(y: str, a: str, b: str, src: str) -> str:
    """Coefficients and classical errors of y on a constant, a and b, in closed form."""
    s = _TWO
    for k, v in (("{a}", a), ("{b}", b), ("{y}", y), ("{src}", src)):
        s = s.replace(k, v)
    return f"(SELECT *, (syy - ba * say - bb * sby) * n / (n - 3) AS s2, my - ba * ma - bb * mb AS c FROM (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM {s}))"


_XS2 = _two("y", "q", "d", "{xs}")


@register("ols_two_regressors", f"SELECT 'const' AS term, round(c, 6) + 0.0 AS estimate FROM {_XS2} UNION ALL SELECT 'q', round(ba, 6) + 0.0 FROM {_XS2} UNION ALL SELECT 'd', round(bb, 6) + 0.0 FROM {_XS2}")
def _(t):
    return regression.ols(t("xs"), "y", ["q", "d"], "ols").table().select("term", "estimate")


@register("ols_two_regressors_errors", f"SELECT 'q' AS term, round(sqrt(s2 * sbb / (saa * sbb - sab * sab) / n), 8) + 0.0 AS std_error FROM {_XS2} UNION ALL SELECT 'd', round(sqrt(s2 * saa / (saa * sbb - sab * sab) / n), 8) + 0.0 FROM {_XS2}", digits=8)
def _(t):
    return regression.ols(t("xs"), "y", ["q", "d"], "ols").table().where("term <> 'const'").select("term", "std_error")


@register("ols_summary", f"SELECT 'n' AS statistic, round(n, 6) + 0.0e0 AS value FROM {_XS2} UNION ALL SELECT 'r2', round((ba * say + bb * sby) / syy, 6) + 0.0 FROM {_XS2} UNION ALL SELECT 'sigma', round(sqrt(s2), 6) + 0.0 FROM {_XS2} UNION ALL SELECT 'f_stat', round((ba * say + bb * sby) * n / 2 / s2, 3) + 0.0 FROM {_XS2}")
def _(t):
    return regression.ols(t("xs"), "y", ["q", "d"], "ols").summary().where(F.col("statistic").isin("n", "r2", "sigma", "f_stat")).withColumn("value", F.when(F.col("statistic") == "f_stat", F.round("value", 3)).otherwise(F.col("value")))


_E1 = "(SELECT *, y - a - b * q AS e, q - m AS z FROM (SELECT *, regr_intercept(y, q) OVER () AS a, regr_slope(y, q) OVER () AS b, avg(q) OVER () AS m, count(*) OVER () AS n, regr_sxx(y, q) OVER () AS sxx FROM {xs}))"

for _cov, _num in {"hc0": "e * e", "hc1": "e * e * n / (n - 2.0)", "hc2": "e * e / (1 - 1.0 / n - z * z / sxx)", "hc3": "e * e / power(1 - 1.0 / n - z * z / sxx, 2)"}.items():

    @register(f"ols_{_cov}", f"SELECT 'q' AS term, round(sqrt(sum(z * z * {_num})) / any_value(sxx), 8) + 0.0 AS std_error FROM {_E1}", digits=8)
    def _(t, cov=_cov):
        return regression.ols(t("xs"), "y", ["q"], cov).table().where("term = 'q'").select("term", "std_error")


@register("ols_cluster", f"WITH g AS (SELECT id, sum(z * e) AS s, any_value(sxx) AS sxx, any_value(n) AS n FROM {_E1} GROUP BY id) SELECT 'q' AS term, round(sqrt(sum(s * s) * count(*) / (count(*) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - 2.0)) / any_value(sxx), 8) + 0.0 AS std_error FROM g", digits=8)
def _(t):
    return regression.ols(t("xs"), "y", ["q"], "cluster", "id").table().where("term = 'q'").select("term", "std_error")


@register("wls", "SELECT 'q' AS term, round((sum(w) * sum(w * q * y) - sum(w * q) * sum(w * y)) / (sum(w) * sum(w * q * q) - sum(w * q) * sum(w * q)), 6) + 0.0 AS estimate FROM (SELECT *, 1 + tax AS w FROM {xs})")
def _(t):
    return regression.ols(t("xs").withColumn("w", 1 + F.col("tax")), "y", ["q"], "ols", weight="w").table().where("term = 'q'").select("term", "estimate")


@register("predict", f"SELECT round(sum(c + ba * q + bb * d), 4) + 0.0 AS total, round(max(c + ba * q + bb * d), 6) + 0.0 AS most FROM {{xs}}, (SELECT c, ba, bb FROM {_XS2})".replace("FROM {xs}, (", "FROM {xs} CROSS JOIN ("))
def _(t):
    return regression.ols(t("xs"), "y", ["q", "d"], "ols").predict(t("xs")).agg(F.round(F.sum("fitted"), 4).alias("total"), F.max("fitted").alias("most"))


@register("vif", f"SELECT 'q' AS term, round(1 / (1 - sab * sab / (saa * sbb)), 6) + 0.0 AS vif FROM {_XS2} UNION ALL SELECT 'd', round(1 / (1 - sab * sab / (saa * sbb)), 6) + 0.0 FROM {_XS2}")
def _(t):
    return regression.vif(t("xs"), ["q", "d"])


@register("iv_just_identified", "SELECT 'revenue' AS term, round(covar_pop(z, disc) / covar_pop(z, revenue), 6) + 0.0 AS estimate FROM (SELECT disc, revenue, qty AS z FROM {tsm})")
def _(t):
    return regression.iv(t("tsm"), "disc", [], ["revenue"], ["qty"]).table().where("term = 'revenue'").select("term", "estimate")


for _m in ("tsls", "liml", "fuller"):

    @register(f"iv_{_m}")
    def _(t, m=_m):
        return regression.iv(t("tsm"), "disc", ["tax"], ["revenue"], ["qty", "t"], m).table()


@register("ridge", "SELECT 'q' AS term, round((1.1 * ry - r12 * r2y) / (1.21 - r12 * r12) / sq, 6) + 0.0 AS estimate FROM (SELECT corr(q, d) AS r12, covar_pop(q, y) / stddev_pop(q) AS ry, covar_pop(d, y) / stddev_pop(d) AS r2y, stddev_pop(q) AS sq FROM {xs})")
def _(t):
    return regression.elastic_net(t("xs"), "y", ["q", "d"], 0.1, 0.0).where("term = 'q'")


@register("lasso", "SELECT 'q' AS term, round(sign(covar_pop(q, y)) * greatest(abs(covar_pop(q, y) / stddev_pop(q)) - 0.1, 0) / stddev_pop(q), 6) + 0.0 AS estimate FROM {xs}")
def _(t):
    return regression.elastic_net(t("xs"), "y", ["q"], 0.1, 1.0).where("term = 'q'")


@register("elastic_net")
def _(t):
    return regression.elastic_net(t("xs"), "y", ["q", "d", "tax"], 0.05, 0.5)


for _link in ("logit", "probit"):

    @register(f"{_link}_table")
    def _(t, link=_link):
        return regression.binary(t("bin"), "y", ["x", "en"], link).table()


@register("logit_score_identity", "SELECT term, 0.0e0 AS score FROM (VALUES ('const'), ('x'), ('en')) v(term)")
def _(t):
    f = regression.binary(t("bin"), "y", ["x", "en"])
    e = F.col("y") - 1 / (1 + F.exp(-regression.linear(f.b, f.terms)))
    parts = [F.struct(F.lit(c).alias("term"), F.avg(e * (F.lit(1.0) if c == "const" else F.col(c))).alias("score")) for c in f.terms]
    return f.df.agg(F.array(*parts).alias("v")).select(F.inline("v"))


@register("logit_marginal_effects")
def _(t):
    return regression.marginal_effects(regression.binary(t("bin"), "y", ["x", "en"]))


@register("logit_odds_ratios")
def _(t):
    return regression.odds_ratios(regression.binary(t("bin"), "y", ["x", "en"]))


@register("classification_table")
def _(t):
    return regression.classification_table(regression.binary(t("bin"), "y", ["x", "en"]), 0.8)


for _kind, _u in {"breusch_pagan": "e * e", "glejser": "abs(e)", "harvey": "ln(e * e)"}.items():

    @register(f"het_{_kind}", f"SELECT '{_kind}' AS test, round(count(*) * regr_r2({_u}, q), 5) + 0.0 AS statistic, 1.0e0 AS df1 FROM {_E1}", digits=5)
    def _(t, kind=_kind):
        return regression.heteroskedasticity(regression.ols(t("xs"), "y", ["q"], "ols"), kind).select("test", "statistic", "df1")


_W = _two("u", "q", "q2", f"(SELECT e * e AS u, q, q * q AS q2 FROM {_E1})")


@register("het_white", f"SELECT 'white' AS test, round(n * (ba * say + bb * sby) / syy, 4) + 0.0 AS statistic FROM {_W}", digits=4)
def _(t):
    return regression.heteroskedasticity(regression.ols(t("xs"), "y", ["q"], "ols"), "white").select("test", "statistic")


@register("reset_test")
def _(t):
    return regression.reset(regression.ols(t("xs"), "y", ["q", "d"], "ols"))


@register("chow_test", "WITH r AS (SELECT regr_syy(y, q) - power(regr_sxy(y, q), 2) / regr_sxx(y, q) AS s, count(*) AS n, status FROM {xs} GROUP BY GROUPING SETS ((), (status))), p AS (SELECT sum(s) FILTER (status IS NULL) AS s0, sum(s) FILTER (status IS NOT NULL) AS s1, max(n) AS n FROM r) SELECT 'chow' AS test, round((s0 - s1) / 2 / (s1 / (n - 4)), 5) + 0.0 AS statistic, round(n - 4, 6) + 0.0e0 AS df2 FROM p", digits=5)
def _(t):
    return regression.chow(t("xs"), "y", ["q"], F.col("status") == "F").select("test", "statistic", "df2")


@register("influence", f"SELECT round(max(1.0 / n + z * z / sxx), 8) + 0.0 AS leverage, round(max(abs(e) / sqrt(s2 * (1 - 1.0 / n - z * z / sxx))), 8) + 0.0 AS student FROM (SELECT *, sum(e * e) OVER () / (n - 2) AS s2 FROM {_E1})", digits=8)
def _(t):
    d = regression.influence(regression.ols(t("xs"), "y", ["q"], "ols"))
    return d.agg(F.max("leverage").alias("leverage"), F.max(F.abs("student")).alias("student"))


# -- series ----------------------------------------------------------------

_Z = "(SELECT t, {0} - avg({0}) OVER () AS z, count(*) OVER () AS n FROM {{tsm}})"
_ZR = "(SELECT t, revenue - avg(revenue) OVER () AS z, count(*) OVER () AS n, row_number() OVER (ORDER BY t) AS r FROM {tsm})"
_ACF = f"(SELECT k AS lag, (SELECT sum(a.z * b.z) FROM {_ZR} a JOIN {_ZR} b ON a.r = b.r + k) / (SELECT sum(z * z) FROM {_ZR}) AS acf FROM range(1, 6) g(k))"


@register("acf", f"SELECT CAST(lag AS INT) AS lag, round(acf, 6) + 0.0 AS acf FROM {_ACF}")
def _(t):
    return series.correlogram(t("tsm"), "revenue", "t", 5).select("lag", "acf")


@register("acf_native", f"SELECT CAST(lag AS INT) AS lag, round(acf, 6) + 0.0 AS acf FROM {_ACF}")
def _(t):
    return series.acf_native(t("tsm"), "revenue", "t", 5)


@register("acf_by_group", "WITH z AS (SELECT unit, t, y - avg(y) OVER (PARTITION BY unit) AS z, row_number() OVER (PARTITION BY unit ORDER BY t) AS r FROM {panel}) SELECT unit, CAST(k AS INT) AS lag, round((SELECT sum(a.z * b.z) FROM z a JOIN z b ON a.unit = b.unit AND a.r = b.r + k WHERE a.unit = u.unit) / (SELECT sum(z * z) FROM z WHERE z.unit = u.unit), 6) + 0.0 AS acf FROM (SELECT DISTINCT unit FROM z) u, range(1, 4) g(k)")
def _(t):
    return series.acf_native(t("panel"), "y", "t", 3, ["unit"])


@register("pacf_first_two", f"WITH a AS (SELECT max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2 FROM {_ACF}) SELECT 1 AS lag, round(r1, 6) + 0.0 AS pacf FROM a UNION ALL SELECT 2, round((r2 - r1 * r1) / (1 - r1 * r1), 6) + 0.0 FROM a")
def _(t):
    return series.correlogram(t("tsm"), "revenue", "t", 5).where("lag <= 2").select("lag", "pacf")


@register("ccf", "WITH z AS (SELECT row_number() OVER (ORDER BY t) AS r, revenue - avg(revenue) OVER () AS a, disc - avg(disc) OVER () AS b, stddev_pop(revenue) OVER () * stddev_pop(disc) OVER () * count(*) OVER () AS s FROM {tsm}) SELECT CAST(k AS INT) AS lag, round((SELECT sum(x.a * y.b) / any_value(x.s) FROM z x JOIN z y ON x.r = y.r + k), 6) + 0.0 AS ccf FROM range(-3, 4) g(k)")
def _(t):
    return series.ccf(t("tsm"), "revenue", "disc", "t", 3)


@register("portmanteau_tests", f"WITH a AS (SELECT a.*, (SELECT count(*) FROM {{tsm}}) AS n FROM {_ACF} a) SELECT 'ljung_box' AS test, round(sum(n * (n + 2) * acf * acf / (n - lag)), 5) + 0.0 AS statistic, 5 AS df FROM a UNION ALL SELECT 'box_pierce', round(sum(n * acf * acf), 5) + 0.0, 5 FROM a", digits=5)
def _(t):
    return series.portmanteau(t("tsm"), "revenue", "t", 5).where("df > 0").select("test", "statistic", "df")


@register("durbin_watson", f"SELECT 'durbin_watson' AS test, round(sum(d * d) / sum(z * z), 6) + 0.0 AS statistic FROM (SELECT z, z - lag(z) OVER (ORDER BY r) AS d FROM {_ZR})")
def _(t):
    d = t("tsm")
    m = d.agg(F.avg("revenue")).first()[0]
    return series.portmanteau(d.withColumn("z", F.col("revenue") - m), "z", "t", 5).where("test = 'durbin_watson'").select("test", "statistic")


@register("variance_ratio", "WITH l AS (SELECT row_number() OVER (ORDER BY t) AS r, revenue AS y FROM {tsm}), d AS (SELECT r, y, y - lag(y) OVER (ORDER BY r) AS d, y - lag(y, 2) OVER (ORDER BY r) AS d2 FROM l), m AS (SELECT avg(d) AS mu, var_samp(d) AS s, count(d) AS n FROM d) SELECT 2 AS q, round(sum(power(d2 - 2 * mu, 2)) / (2 * (any_value(n) - 1) * (1 - 2.0 / any_value(n))) / any_value(s), 6) + 0.0 AS vr FROM d CROSS JOIN m WHERE d2 IS NOT NULL")
def _(t):
    return series.variance_ratio(t("tsm"), "revenue", "t", (2,)).select("q", "vr")


@register("periodogram", f"WITH z AS (SELECT z, r - 1 AS r, n FROM {_ZR}) SELECT round(2 * pi() * k / any_value(n), 6) + 0.0 AS frequency, round((power(sum(z * cos(2 * pi() * k * r / n)), 2) + power(sum(z * sin(2 * pi() * k * r / n)), 2)) / (2 * pi() * any_value(n)), 5) + 0.0 AS power FROM z CROSS JOIN range(1, (SELECT count(*) // 2 + 1 FROM z)) g(k) GROUP BY k")
def _(t):
    return series.periodogram(t("tsm"), "revenue", "t").withColumn("power", F.round("power", 5))


@register("white_noise_tests")
def _(t):
    return series.white_noise(t("hours"), "v", "t", "kind")


@register("long_run_variance", f"WITH g AS (SELECT k, (SELECT sum(a.z * b.z) / any_value(a.n) FROM {_ZR} a JOIN {_ZR} b ON a.r = b.r + k) AS c FROM range(0, 3) g(k)) SELECT (SELECT CAST(count(*) AS INT) FROM {{tsm}}) AS n, round(sum(CASE WHEN k = 0 THEN c ELSE 2 * (1 - k / 3.0) * c END), 5) + 0.0 AS lrv FROM g", digits=5)
def _(t):
    return series.long_run_variance(t("tsm"), "revenue", "t", 2)


for _f in ("hp", "boosted_hp", "hamilton", "beveridge_nelson"):

    @register(f"filter_{_f}")
    def _(t, f=_f):
        return series.trend_cycle(t("tsm"), "revenue", "t", f)


@register("filter_hp_by_group")
def _(t):
    return series.trend_cycle(t("panel"), "y", "t", "hp", "unit", lam=129600.0)


@register("filter_hamilton_one_lag", "WITH l AS (SELECT t, revenue AS y, lag(revenue, 8) OVER (ORDER BY t) AS x FROM {tsm}), c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l) SELECT t, round(a + b * x, 6) + 0.0 AS trend, round(y - a - b * x, 6) + 0.0 AS cycle FROM l CROSS JOIN c WHERE x IS NOT NULL")
def _(t):
    return series.trend_cycle(t("tsm"), "revenue", "t", "hamilton", h=8, p=1).select("t", "trend", "cycle")


_BK = "WITH w AS (SELECT k, CASE WHEN k = 0 THEN 2 * (1.0 / 6 - 1.0 / 32) ELSE (sin(2 * pi() * k / 6) - sin(2 * pi() * k / 32)) / (pi() * k) END AS b FROM range(0, 13) g(k)), s AS (SELECT k, b - (SELECT sum(CASE WHEN k = 0 THEN b ELSE 2 * b END) / 25 FROM w) AS b FROM w), l AS (SELECT t, revenue AS y, row_number() OVER (ORDER BY t) AS r FROM {tsm}) SELECT a.t, round(sum(s.b * c.y), 6) + 0.0 AS cycle FROM l a JOIN l c ON abs(a.r - c.r) <= 12 JOIN s ON s.k = abs(a.r - c.r) GROUP BY a.t HAVING count(*) = 25"


@register("filter_baxter_king", _BK)
def _(t):
    return series.baxter_king(t("tsm"), "revenue", "t").select("t", "cycle")


@register("filter_ideal_bandpass")
def _(t):
    return series.trend_cycle(t("tsm"), "revenue", "t", "ideal_bandpass", low=1 / 32, high=1 / 6)


@register("adf_no_lags", "WITH l AS (SELECT lag(revenue) OVER (ORDER BY t) AS x, revenue - lag(revenue) OVER (ORDER BY t) AS d FROM {tsm}), s AS (SELECT regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy, regr_sxy(d, x) AS sxy, count(x) AS n FROM l) SELECT round(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) + 0.0 AS statistic, CAST(n AS INT) AS n FROM s")
def _(t):
    return series.unit_root(t("tsm"), "revenue", "t", lags=0).where("test = 'adf'").select("statistic", "n")


@register("kpss_level", f"WITH z AS (SELECT z, r, n, sum(z) OVER (ORDER BY r) AS s, CAST(floor(4 * power(n / 100.0, 0.25)) AS INT) AS bw FROM {_ZR}), g AS (SELECT k, (SELECT sum(a.z * b.z) / any_value(a.n) FROM z a JOIN z b ON a.r = b.r + k) AS c, (SELECT any_value(bw) FROM z) AS bw FROM range(0, 30) g(k)), v AS (SELECT sum(CASE WHEN k = 0 THEN c ELSE 2 * (1 - k / (bw + 1.0)) * c END) AS v FROM g WHERE k <= bw) SELECT round(sum(s * s) / power(any_value(n), 2) / (SELECT v FROM v), 6) + 0.0 AS statistic FROM z")
def _(t):
    return series.unit_root(t("tsm"), "revenue", "t").where("test = 'kpss'").select("statistic")


@register("unit_root_one_series")
def _(t):
    return series.unit_root(t("tsm"), "revenue", "t", "constant", 1).where("test = 'adf'").select("statistic", "lags", "n", "cv_5")


@register("unit_root_chosen_lags")
def _(t):
    return series.unit_root(t("tsm"), "disc", "t", "trend")


@register("unit_root_battery")
def _(t):
    return series.unit_root(t("panel"), "y", "t", "constant", 1, "unit")


@register("arch_lm_one_lag", f"WITH u AS (SELECT z * z AS u, lag(z * z) OVER (ORDER BY r) AS l FROM {_ZR}) SELECT round(count(l) * regr_r2(u, l), 6) + 0.0 AS statistic, 1 AS df FROM u WHERE l IS NOT NULL")
def _(t):
    return series.arch_lm(t("tsm"), "revenue", "t", 1).select("statistic", "df")


for _g in ("garch", "gjr", "egarch"):

    @register(f"estimate_{_g}", digits=3)
    def _(t, g=_g):
        return series.estimate_garch(t("hours"), "v", "t", g, "kind")


@register("ar1", "WITH z AS (SELECT revenue - avg(revenue) OVER () AS z, avg(revenue) OVER () AS m, t FROM {tsm}), l AS (SELECT z, lag(z) OVER (ORDER BY t) AS x, m FROM z) SELECT 'ar1' AS term, round(regr_slope(z, x), 6) + 0.0 AS estimate FROM l UNION ALL SELECT 'const', round(any_value(m) * (1 - regr_slope(z, x)) + regr_intercept(z, x), 5) + 0.0 FROM l")
def _(t):
    return series.estimate_arma(t("tsm"), "revenue", "t", 1).where(F.col("term").isin("ar1", "const")).withColumn("estimate", F.when(F.col("term") == "const", F.round("estimate", 5)).otherwise(F.col("estimate")))


@register("arma_1_1", digits=3)
def _(t):
    return series.estimate_arma(t("tsm"), "revenue", "t", 1, 1)


@register("ar_forecast")
def _(t):
    return series.forecast_ar(t("tsm"), "revenue", "t", 2, 6)


@register("threshold_autoregression")
def _(t):
    return series.estimate_threshold(t("tsm"), "revenue", "t")


@register("kernel_density", "WITH h AS (SELECT count(*) AS n, min(y) AS lo, max(y) AS hi, 0.9 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.349) * power(count(*), -0.2) AS h FROM {xs}), g AS (SELECT lo + (hi - lo) * k / 10.0 AS x, n, h FROM h CROSS JOIN range(0, 11) g(k)) SELECT round(x, 6) + 0.0 AS x, round(sum(exp(-power((y - x) / h, 2) / 2)) / any_value(n * h) / sqrt(2 * pi()), 6) + 0.0 AS density FROM g CROSS JOIN {xs} GROUP BY x")
def _(t):
    return series.kde(t("xs"), "y", 11)


# -- systems ---------------------------------------------------------------

_PAIR = ["revenue", "disc"]
_LAGGED = "(SELECT revenue, disc, lag(revenue) OVER (ORDER BY t) AS r1, lag(disc) OVER (ORDER BY t) AS d1 FROM {tsm} QUALIFY row_number() OVER (ORDER BY t) > 1)"
_V1, _V2 = _two("revenue", "r1", "d1", _LAGGED), _two("disc", "r1", "d1", _LAGGED)


@register("var_coefficients", " UNION ALL ".join(f"SELECT '{e}' AS equation, '{n}' AS term, round({c}, 5) + 0.0 AS estimate FROM {v}" for e, v in (("revenue", _V1), ("disc", _V2)) for n, c in (("const", "c"), ("revenue_l1", "ba"), ("disc_l1", "bb"))), digits=5)
def _(t):
    return multivariate.var_coefficients(t("tsm"), _PAIR, "t", 1).drop("std_error")


@register("granger_causality", f"WITH v AS (SELECT 'disc' AS cause, 'revenue' AS effect, bb * bb / (s2 * saa / (saa * sbb - sab * sab) / n) AS f, n FROM {_V1} UNION ALL SELECT 'revenue', 'disc', ba * ba / (s2 * sbb / (saa * sbb - sab * sab) / n), n FROM {_V2}) SELECT cause, effect, round(f, 5) + 0.0 AS statistic, CAST(n - 3 AS INT) AS df2 FROM v", digits=5)
def _(t):
    return multivariate.granger(t("tsm"), _PAIR, "t", 1).select("cause", "effect", "statistic", "df2")


@register("lag_order")
def _(t):
    return multivariate.lag_order(t("tsm"), _PAIR, "t", 4)


@register("irf_cholesky")
def _(t):
    return multivariate.irf(t("tsm"), _PAIR, "t", 2, 10)


@register("irf_long_run_cumulative")
def _(t):
    return multivariate.irf(t("tsm"), _PAIR, "t", 2, 10, "long_run", True)


@register("irf_bootstrap")
def _(t):
    return multivariate.bootstrap_irf(t("tsm"), _PAIR, "t", 1, 6, 100)


@register("irf_sign_restrictions")
def _(t):
    return multivariate.sign_restricted_irf(t("tsm"), _PAIR, "t", {("revenue", "revenue"): 1, ("disc", "revenue"): 1}, 1, 6, 400)


@register("fevd", "SELECT CAST(k AS INT) AS horizon, v AS variable, 1.0e0 AS total FROM range(1, 11) g(k), (VALUES ('revenue'), ('disc')) x(v)")
def _(t):
    return multivariate.fevd(t("tsm"), _PAIR, "t", 2, 10).groupBy("horizon", "variable").agg(F.sum("value").alias("total"))


@register("historical_decomposition", "SELECT t, 'revenue' AS variable, round(revenue, 6) + 0.0 AS value FROM {tsm} QUALIFY row_number() OVER (ORDER BY t) > 1 UNION ALL SELECT t, 'disc', round(disc, 6) + 0.0 FROM {tsm} QUALIFY row_number() OVER (ORDER BY t) > 1")
def _(t):
    return multivariate.historical_decomposition(t("tsm"), _PAIR, "t", 1).groupBy("t", "variable").agg(F.sum("value").alias("value"))


@register("var_forecast")
def _(t):
    return multivariate.var_forecast(t("tsm"), _PAIR, "t", 2, 6)


@register("var_stability")
def _(t):
    return multivariate.stability(t("tsm"), _PAIR, "t", 2)


@register("bayesian_var_thousand_draws", digits=2)
def _(t):
    return multivariate.bvar(t("tsm"), ["revenue", "qty", "disc"], "t", 2, 1000)


@register("bayesian_var")
def _(t):
    return multivariate.bvar(t("tsm"), _PAIR, "t", 1, 300)


@register("local_projection")
def _(t):
    return multivariate.local_projection(t("tsm"), _PAIR, "revenue", "t", 6, 2)


@register("local_projection_iv")
def _(t):
    return multivariate.local_projection_iv(t("tsm"), _PAIR, "revenue", "qty", "t", 4, 1)


@register("johansen")
def _(t):
    return multivariate.johansen(t("tsm"), _PAIR, "t", 2)


@register("engle_granger", "SELECT 'const' AS term, round(regr_intercept(revenue, qty), 6) + 0.0 AS estimate FROM {tsm} UNION ALL SELECT 'qty', round(regr_slope(revenue, qty), 6) + 0.0 FROM {tsm}")
def _(t):
    return multivariate.engle_granger(t("tsm"), "revenue", ["qty"], "t").where("term <> 'adf_t'")


for _m in ("fmols", "dols"):

    @register(f"cointegration_{_m}")
    def _(t, m=_m):
        return multivariate.cointegrating_regression(t("tsm"), "revenue", ["qty"], "t", m)


@register("ardl")
def _(t):
    return multivariate.ardl(t("tsm"), "revenue", ["disc"], "t", 1, 1)


@register("factor_shares", "SELECT CAST(1 AS INT) AS factors, round((1 + abs(corr(revenue, qty))) / 2, 6) + 0.0 AS share FROM {tsm} UNION ALL SELECT 2, round((1 - abs(corr(revenue, qty))) / 2, 6) + 0.0 FROM {tsm}")
def _(t):
    d = t("tsm")
    _, share, _ = multivariate.principal_factors(d, ["revenue", "qty"])
    return describe.rows(d.sparkSession, [{"factors": k + 1, "share": float(s)} for k, s in enumerate(share)], "factors int, share double")


@register("factor_criteria")
def _(t):
    return multivariate.factor_summary(t("tsm"), ["revenue", "qty", "disc", "tax"], 3)


@register("factors")
def _(t):
    return multivariate.principal_factors(t("tsm"), ["revenue", "qty", "disc", "tax"], 2)[2].select("t", "f1", "f2")


@register("seemingly_unrelated")
def _(t):
    return multivariate.seemingly_unrelated(t("tsm"), {"a": ("revenue", ["disc"]), "b": ("qty", ["tax"])})


# -- panels ----------------------------------------------------------------

_FE = "(SELECT unit, t, y - avg(y) OVER (PARTITION BY unit) AS y, x - avg(x) OVER (PARTITION BY unit) AS x FROM {panel})"


@register("panel_fe", f"SELECT 'x' AS term, round(sum(x * y) / sum(x * x), 6) + 0.0 AS estimate FROM {_FE}")
def _(t):
    return panel.panel_table(panel.fixed_effects(t("panel"), "y", ["x"], "unit", "t")).select("term", "estimate")


@register("panel_fe_cluster_error", f"WITH b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS s, count(*) AS n FROM {_FE}), g AS (SELECT unit, sum(x * (y - b.b * x)) AS s FROM {_FE} CROSS JOIN b GROUP BY unit) SELECT 'x' AS term, round(sqrt(sum(g.s * g.s) * count(*) / (count(*) - 1.0) * any_value(n - 1) / any_value(n - 1)) / any_value(b.s), 7) + 0.0 AS std_error FROM g CROSS JOIN b", digits=7)
def _(t):
    return panel.panel_table(panel.fixed_effects(t("panel"), "y", ["x"], "unit", "t")).select("term", "std_error")


@register("panel_fe_two_way", _TWO_WAY + "SELECT 'x' AS term, round(sum(x * y) / sum(x * x), 6) + 0.0 AS estimate FROM w")
def _(t):
    return panel.panel_table(panel.fixed_effects(t("panel"), "y", ["x"], "unit", "t", True)).select("term", "estimate")


@register("panel_fe_driscoll_kraay")
def _(t):
    return panel.panel_table(panel.fixed_effects(t("panel"), "y", ["x"], "unit", "t", cov="driscoll_kraay"))


@register("panel_between", "WITH g AS (SELECT avg(y) AS y, avg(x) AS x FROM {panel} GROUP BY unit) SELECT 'const' AS term, round(regr_intercept(y, x), 6) + 0.0 AS estimate FROM g UNION ALL SELECT 'x', round(regr_slope(y, x), 6) + 0.0 FROM g")
def _(t):
    return panel.panel_table(panel.between(t("panel"), "y", ["x"], "unit")).select("term", "estimate")


@register("panel_first_differences", "SELECT 'x' AS term, round(sum((a.x - b.x) * (a.y - b.y)) / sum(power(a.x - b.x, 2)), 6) + 0.0 AS estimate FROM {panel} a JOIN {panel} b ON a.unit = b.unit AND b.t = a.t - 1")
def _(t):
    return panel.panel_table(panel.first_differences(t("panel"), "y", ["x"], "unit", "t")).select("term", "estimate")


_CRE = _two("y", "x", "xm", "(SELECT y, x, avg(x) OVER (PARTITION BY unit) AS xm FROM {panel})")


@register("panel_cre", f"SELECT 'x' AS term, round(ba, 6) + 0.0 AS estimate FROM {_CRE} UNION ALL SELECT 'x_mean', round(bb, 5) + 0.0 FROM {_CRE}")
def _(t):
    return panel.panel_table(panel.correlated_random_effects(t("panel"), "y", ["x"], "unit", "t")).where("term <> 'const'").select("term", F.when(F.col("term") == "x_mean", F.round("estimate", 5)).otherwise(F.col("estimate")).alias("estimate"))


@register("panel_random_effects")
def _(t):
    return panel.panel_table(panel.random_effects(t("panel"), "y", ["x"], "unit", "t"))


@register("panel_hausman")
def _(t):
    return panel.hausman(panel.fixed_effects(t("panel"), "y", ["x"], "unit", "t", cov="ols"), panel.random_effects(t("panel"), "y", ["x"], "unit", "t"))


@register("panel_breusch_pagan_lm", "WITH c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {panel}), e AS (SELECT unit, y - a - b * x AS e FROM {panel} CROSS JOIN c), g AS (SELECT unit, sum(e) AS s, count(*) AS t, sum(e * e) AS q FROM e GROUP BY unit) SELECT 'breusch_pagan_lm' AS test, round(sum(t) / (2 * (avg(t) - 1)) * power(sum(s * s) / sum(q) - 1, 2), 5) + 0.0 AS statistic FROM g", digits=5)
def _(t):
    return panel.breusch_pagan_lm(t("panel"), "y", ["x"], "unit").select("test", "statistic")


@register("panel_unit_effects_f", f"WITH w AS (SELECT sum(y * y) - power(sum(x * y), 2) / sum(x * x) AS r1 FROM {_FE}), p AS (SELECT regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x) AS r0, count(*) AS n, count(DISTINCT unit) AS g FROM {{panel}}) SELECT 'unit_effects_f' AS test, round((r0 - r1) / (g - 1) / (r1 / (n - g - 1)), 5) + 0.0 AS statistic FROM w CROSS JOIN p", digits=5)
def _(t):
    return panel.unit_effects_f(panel.fixed_effects(t("panel"), "y", ["x"], "unit", "t")).select("test", "statistic")


@register("panel_modified_wald", f"WITH b AS (SELECT sum(x * y) / sum(x * x) AS b FROM {_FE}), e AS (SELECT unit, power(y - b * x, 2) AS q FROM {_FE} CROSS JOIN b), s AS (SELECT avg(q) AS s FROM e), g AS (SELECT unit, avg(q) AS v, count(*) AS t FROM e GROUP BY unit) SELECT 'modified_wald' AS test, round(sum(power(v - s, 2) / (2 * v * v / t)), 4) + 0.0 AS statistic FROM g CROSS JOIN s", digits=4)
def _(t):
    return panel.modified_wald(panel.fixed_effects(t("panel"), "y", ["x"], "unit", "t")).select("test", "statistic")


@register("panel_pesaran_cd")
def _(t):
    return panel.pesaran_cd(panel.fixed_effects(t("panel"), "y", ["x"], "unit", "t"))


@register("panel_wooldridge_ar")
def _(t):
    return panel.wooldridge_ar(t("panel"), "y", ["x"], "unit", "t")


@register("panel_unit_roots")
def _(t):
    return panel.panel_unit_roots(t("panel"), "y", "unit", "t")


@register("dumitrescu_hurlin")
def _(t):
    return panel.dumitrescu_hurlin(t("panel"), "y", "x", "unit", "t")


_GT = "(SELECT c.first AS cohort, d.t, avg(d.y - b.y) FILTER (d.first = c.first) - avg(d.y - b.y) FILTER (d.first = 0) AS att, count(*) FILTER (d.first = c.first) AS n_treated, count(*) FILTER (d.first = 0) AS n_control FROM (SELECT DISTINCT first FROM {did} WHERE first > 0) c JOIN {did} d ON d.first IN (0, c.first) JOIN {did} b ON b.unit = d.unit AND b.t = c.first - 1 GROUP BY c.first, d.t HAVING n_treated > 0 AND n_control > 0)"


@register("did_group_time_att", f"SELECT cohort, t, round(att, 6) + 0.0 AS att, n_treated, n_control FROM {_GT}")
def _(t):
    return panel.group_time_att(t("did"), "y", "unit", "t", "first")


@register("did_event_time_att", f"SELECT CAST(t - cohort AS INT) AS event_time, round(sum(att * n_treated) / sum(n_treated), 6) + 0.0 AS att FROM {_GT} GROUP BY 1")
def _(t):
    return panel.aggregate_att(panel.group_time_att(t("did"), "y", "unit", "t", "first"))


@register("did_event_study")
def _(t):
    return panel.event_study(t("did"), "y", "unit", "t", "first", 2, 3)


@register("did_imputation")
def _(t):
    return panel.imputation(t("did"), "y", "unit", "t", "first")


@register("did_bacon")
def _(t):
    return panel.bacon(t("did"), "y", "unit", "t", "first")


# -- input-output, forecasts, streams ----------------------------------------


def _io(t) -> inputoutput.Table:
    return inputoutput.Table(t("flows"), t("sales").select("i", (F.col("value") * 0.5).alias("value")))


_X = "(SELECT i, sum(value) AS x FROM (SELECT i, value FROM {flows} UNION ALL SELECT i, value * 0.5 FROM {sales}) GROUP BY i)"


@register("io_technical_coefficients", f"SELECT f.i, f.j, round(value / x, 6) + 0.0 AS value FROM {{flows}} f JOIN {_X} x ON x.i = f.j")
def _(t):
    return inputoutput.technical_coefficients(t("flows"), t("sales").select("i", (F.col("value") * 0.5).alias("value")))


@register("io_output_identity", f"SELECT i, round(x, 5) + 0.0 AS x FROM {_X}", digits=5)
def _(t):
    a = _io(t)
    return a.vector(x=a.L @ a.Y)


@register("io_multipliers")
def _(t):
    return _io(t).multipliers()


@register("io_linkages")
def _(t):
    return _io(t).linkages()


@register("io_leontief_inverse")
def _(t):
    a = _io(t)
    return a.matrix(a.L)


@register("io_extraction")
def _(t):
    return _io(t).extraction()


@register("io_footprint", f"SELECT i, round(0.1 * (i + 1) * x, 5) + 0.0 AS production FROM {_X}", digits=5)
def _(t):
    return _io(t).footprint({k: 0.1 * (k + 1) for k in range(5)}).select("i", "production")


@register("io_structural_decomposition_ratio")
def _(t):
    a = _io(t)
    b = inputoutput.Table(t("flows").withColumn("value", F.col("value") * (1 + 0.1 * F.col("i"))), t("sales"))
    return inputoutput.decomposition_ratio(a, b)


@register("io_structural_decomposition")
def _(t):
    a = _io(t)
    b = inputoutput.Table(t("flows").withColumn("value", F.col("value") * (1 + 0.1 * F.col("i"))), t("sales"))
    return inputoutput.decomposition(a, b)


@register("io_ras")
def _(t):
    return inputoutput.balance(t("flows"), {k: 100.0 for k in range(5)}, {k: 100.0 for k in range(5)})


def _forecasts(t):
    return forecasting.naive_forecasts(t("panel"), "y", "t", {"f1": 1, "f12": 12}, ["unit"])


_FC = "(SELECT * FROM (SELECT unit, t, y, lag(y) OVER w AS f1, lag(y, 12) OVER w AS f12 FROM {panel} WINDOW w AS (PARTITION BY unit ORDER BY t)) WHERE f12 IS NOT NULL)"


@register("forecast_accuracy", " UNION ALL ".join(f"SELECT '{c}' AS forecast, count(*) AS n, round(avg(y - {c}), 6) + 0.0 AS me, round(avg(abs(y - {c})), 6) + 0.0 AS mae, round(sqrt(avg(power(y - {c}, 2))), 6) + 0.0 AS rmse, round(100 * avg(abs((y - {c}) / y)), 6) + 0.0 AS mape, round(sqrt(avg(power(y - {c}, 2))) / (sqrt(avg(y * y)) + sqrt(avg({c} * {c}))), 6) + 0.0 AS theil_u1 FROM {_FC}" for c in ("f1", "f12")))
def _(t):
    return forecasting.accuracy(_forecasts(t), "y", ["f1", "f12"])


@register("diebold_mariano", f"WITH d AS (SELECT unit, power(y - f1, 2) - power(y - f12, 2) AS d FROM {_FC}) SELECT unit, round(avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1.0) / count(*)), 5) + 0.0 AS statistic, CAST(count(*) - 1 AS INT) AS df FROM d GROUP BY unit", digits=5)
def _(t):
    return forecasting.diebold_mariano(_forecasts(t), "y", "f1", "f12", "t", by="unit").drop("p_value")


@register("clark_west")
def _(t):
    return forecasting.clark_west(_forecasts(t), "y", "f1", "f12", "t", "unit")


@register("mincer_zarnowitz", f"SELECT round(regr_intercept(y, f1), 6) + 0.0 AS const, round(regr_slope(y, f1), 6) + 0.0 AS slope FROM {_FC}")
def _(t):
    return forecasting.mincer_zarnowitz(_forecasts(t).where("f12 is not null"), "y", "f1").select("const", "slope")


for _m, _e in {"mean": "(f1 + f12) / 2", "median": "(f1 + f12) / 2"}.items():

    @register(f"combine_{_m}", f"SELECT unit, t, round({_e}, 6) + 0.0 AS combined FROM {_FC}")
    def _(t, m=_m):
        return forecasting.combine(_forecasts(t).where("f12 is not null"), "y", ["f1", "f12"], m).select("unit", "t", "combined")


@register("combine_inverse_mse", f"WITH w AS (SELECT 1 / avg(power(y - f1, 2)) AS a, 1 / avg(power(y - f12, 2)) AS b FROM {_FC}) SELECT unit, t, round((a * f1 + b * f12) / (a + b), 6) + 0.0 AS combined FROM {_FC} CROSS JOIN w")
def _(t):
    return forecasting.combine(_forecasts(t).where("f12 is not null"), "y", ["f1", "f12"], "inverse_mse").select("unit", "t", "combined")


_LS = _two("y", "f1", "f12", _FC)


@register("combine_least_squares", f"SELECT unit, t, round(c + ba * f1 + bb * f12, 6) + 0.0 AS combined FROM {_FC} CROSS JOIN (SELECT c, ba, bb FROM {_LS})")
def _(t):
    return forecasting.combine(_forecasts(t).where("f12 is not null"), "y", ["f1", "f12"], "least_squares").select("unit", "t", "combined")


@register("stream_windowed_moments", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd FROM {events} GROUP BY 1, 2")
def _(t):
    return running.windowed_moments(t("events"), "ts", "value", by=["event_type"]).withColumn("start", F.col("start").cast("timestamp").cast("long"))


@register("stream_windowed_regression", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(*) AS n, round(regr_slope(value, user_id), 6) + 0.0 AS slope, round(regr_intercept(value, user_id), 6) + 0.0 AS intercept FROM {events} GROUP BY 1")
def _(t):
    return running.windowed_regression(t("events"), "ts", "value", "user_id").withColumn("start", F.col("start").cast("timestamp").cast("long"))


# -- limited dependent variables, robust estimation --------------------------


@register("ordered_logit")
def _(t):
    return limited.ordered(t("bin").withColumn("g", F.col("y") + F.col("en")), "g", ["x"])


@register("ordered_probit")
def _(t):
    return limited.ordered(t("bin").withColumn("g", F.col("y") + F.col("en")), "g", ["x"], "probit")


@register("multinomial_logit")
def _(t):
    return limited.multinomial(t("xs"), "flag", ["q", "d"])


@register("tobit")
def _(t):
    return limited.tobit(t("xs").withColumn("c", F.greatest(F.col("y") - 3, F.lit(0.0))), "c", ["q", "d"])


@register("truncated_regression")
def _(t):
    return limited.truncated(t("xs"), "y", ["q", "d"], 1.0)


@register("heckman_two_step")
def _(t):
    return limited.heckman(t("bin").withColumn("w", F.col("x") * 2 + F.col("en")), "w", ["en"], "y", ["x", "en"])


for _psi in ("huber", "bisquare"):

    @register(f"robust_{_psi}")
    def _(t, psi=_psi):
        return limited.robust_regression(t("xs"), "y", ["q", "d"], psi).table()


for _m in ("forward", "backward", "best"):

    @register(f"select_variables_{_m}")
    def _(t, m=_m):
        return limited.select_variables(t("xs"), "y", ["q", "d", "tax"], m)


@register("gmm_linear")
def _(t):
    return limited.gmm(t("tsm"), "disc", ["revenue"], ["qty", "tax"])


_JB = " UNION ALL ".join(f"SELECT '{c}' AS variable, round(n / 6.0 * (power(k3, 2) + power(k4 - 3, 2) / 4), 4) + 0.0 AS statistic FROM (SELECT any_value(n) AS n, avg(power(({c} - m) / s, 3)) AS k3, avg(power(({c} - m) / s, 4)) AS k4 FROM (SELECT {c}, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s, count(*) OVER () AS n FROM {{xs}}))" for c in ("y", "q"))


@register("jarque_bera", _JB, digits=4)
def _(t):
    return limited.jarque_bera(t("xs"), ["y", "q"]).drop("p_value")


_D2 = "(SELECT (power(q - mq, 2) * vd - 2 * (q - mq) * (d - md) * c + power(d - md, 2) * vq) / (vq * vd - c * c) AS m FROM {xs} CROSS JOIN (SELECT avg(q) AS mq, avg(d) AS md, var_pop(q) AS vq, var_pop(d) AS vd, covar_pop(q, d) AS c FROM {xs}))"


@register("mardia_kurtosis", f"SELECT count(*) AS n, round(avg(m * m), 6) + 0.0 AS kurtosis, round((avg(m * m) - 8) / sqrt(64.0 / count(*)), 4) + 0.0 AS statistic FROM {_D2}")
def _(t):
    return limited.mardia(t("xs"), ["q", "d"]).drop("p_value").withColumn("statistic", F.round("statistic", 4))


@register("mean_group", "WITH g AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {panel} GROUP BY unit) SELECT 'const' AS term, round(avg(a), 6) + 0.0 AS estimate, round(stddev_samp(a) / sqrt(count(a)), 6) + 0.0 AS std_error FROM g UNION ALL SELECT 'x', round(avg(b), 6) + 0.0, round(stddev_samp(b) / sqrt(count(b)), 6) + 0.0 FROM g")
def _(t):
    return limited.mean_group(t("panel"), "y", ["x"], "unit")


_LPD = " UNION ALL ".join(
    f"SELECT CAST({h} AS INT) AS horizon, round(sum((s - ms) * (dy - md)) / sum(power(s - ms, 2)), 6) + 0.0 AS estimate, count(*) AS n FROM (SELECT *, avg(s) OVER (PARTITION BY t) AS ms, avg(dy) OVER (PARTITION BY t) AS md FROM (SELECT a.t, CASE WHEN a.first = a.t THEN 1.0 ELSE 0.0 END AS s, c.y - b.y AS dy FROM {{did}} a JOIN {{did}} b ON b.unit = a.unit AND b.t = a.t - 1 JOIN {{did}} c ON c.unit = a.unit AND c.t = a.t + ({h}) WHERE a.first = a.t OR a.first = 0 OR a.first > a.t + {max(h, 0)}))" for h in (-2, 0, 1, 2)
)


@register("did_local_projections", _LPD)
def _(t):
    return limited.lp_did(t("did"), "y", "unit", "t", "first", 2, 2)


# -- state space, breaks, regimes, expectations --------------------------------


@register("local_level", digits=2)
def _(t):
    return dynamics.local_level(t("tsm"), "revenue", "t").select("t", "value", "level")


@register("local_linear_trend", digits=2)
def _(t):
    return dynamics.local_level(t("tsm"), "revenue", "t", True).select("t", "value", "level")


@register("arma_order_selection", digits=2)
def _(t):
    return dynamics.order_selection(t("tsm"), "revenue", "t", 2, 1)


@register("long_memory_gph")
def _(t):
    return dynamics.gph(t("hours"), "v", "t", by="kind")


@register("cusum", "SELECT count(*) - 2 AS n, 1.0e0 AS last_cusumsq FROM {tsm}")
def _(t):
    return dynamics.cusum(t("tsm"), "revenue", ["qty"], "t").agg(F.count("*").alias("n"), F.max("cusumsq").alias("last_cusumsq"))


_S = "(SELECT row_number() OVER (ORDER BY t) AS r, revenue AS y, count(*) OVER () AS n FROM {tsm})"


@register("sup_f_break", f"WITH s AS {_S}, k AS (SELECT b FROM range(2, (SELECT count(*) FROM s)) g(b), (SELECT any_value(n) AS n FROM s) WHERE b >= greatest(2, CAST(floor(0.15 * n) AS INT)) AND b < least(n - 2, CAST(floor(0.85 * n) AS INT))), f AS (SELECT b, var_pop(y) * count(*) AS total, var_pop(y) FILTER (r <= b) * count(*) FILTER (r <= b) + var_pop(y) FILTER (r > b) * count(*) FILTER (r > b) AS rss, count(*) AS n FROM s CROSS JOIN k GROUP BY b) SELECT round(max((total - rss) / (rss / (n - 2))), 5) + 0.0 AS sup_f FROM f", digits=5)
def _(t):
    return dynamics.sup_f(t("tsm"), "revenue", [], "t").select("sup_f")


@register("bai_perron_breaks")
def _(t):
    return dynamics.bai_perron(t("tsm"), "revenue", "t", 2)


@register("zivot_andrews")
def _(t):
    return dynamics.zivot_andrews(t("tsm"), "revenue", "t")


@register("explosive_roots")
def _(t):
    return dynamics.explosive(t("tsm"), "revenue", "t", 30)


@register("markov_switching", digits=3)
def _(t):
    return dynamics.estimate_markov_switching(t("tsm"), "revenue", "t")


@register("state_local_projection")
def _(t):
    return dynamics.state_local_projection(t("tsm"), _PAIR, "revenue", "qty", "t", horizon=4, lags=1)


@register("nardl")
def _(t):
    return dynamics.nardl(t("tsm"), "revenue", "disc", "t")


@register("constant_correlation", digits=3)
def _(t):
    return dynamics.dynamic_correlation(t("tsm"), _PAIR, "t", True)


@register("dynamic_correlation", digits=2)
def _(t):
    return dynamics.dynamic_correlation(t("tsm"), _PAIR, "t")


@register("sign_bias", digits=2)
def _(t):
    return dynamics.sign_bias(t("hours"), "v", "t", "kind")


@register("rational_expectations_irf", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS id, CAST(k AS INT) AS horizon, 'y' AS variable, 'e' AS shock, round(power({r}, k) / (1 - {b} * {r}), 6) + 0.0 AS value FROM range(0, 6) g(k)" for i, (b, r) in enumerate(((0.5, 0.8), (0.9, 0.5)))))
def _(t):
    # y = beta E y(+1) + z, z = rho z(-1) + e: the response of y is rho^k / (1 - beta rho).
    models = [(i, [[b, 0], [0, 0]], [[-1, 1], [0, -1]], [[0, 0], [0, r]], [[0], [1]]) for i, (b, r) in enumerate(((0.5, 0.8), (0.9, 0.5)))]
    spark = t("region").sparkSession
    return dynamics.linear_irf(spark, models, ["y", "z"], ["e"], 6).where("variable = 'y'")


# -- further -------------------------------------------------------------------


@register("panel_iv_just_identified", "SELECT 'x' AS term, round(sum(z * y) / sum(z * x), 6) + 0.0 AS estimate FROM (SELECT y - avg(y) OVER w AS y, x - avg(x) OVER w AS x, t - avg(t) OVER w AS z FROM {panel} WINDOW w AS (PARTITION BY unit))")
def _(t):
    return further.panel_iv(t("panel").withColumn("z", F.col("t")), "y", [], ["x"], ["z"], "unit").select("term", "estimate")


@register("panel_difference_gmm")
def _(t):
    return further.difference_gmm(t("panel"), "y", ["x"], "unit", "t")


@register("panel_var", "WITH l AS (SELECT a.unit, a.y, b.y AS z FROM {panel} a JOIN {panel} b ON a.unit = b.unit AND b.t = a.t - 1), d AS (SELECT y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM l WINDOW w AS (PARTITION BY unit)) SELECT 'y' AS equation, 'y_l1' AS term, round(sum(y * z) / sum(z * z), 6) + 0.0 AS estimate FROM d")
def _(t):
    return further.panel_var(t("panel"), ["y"], "unit", "t")


@register("panel_var_two_variables")
def _(t):
    return further.panel_var(t("panel"), ["y", "x"], "unit", "t", 2)


@register("levin_lin_chu")
def _(t):
    return further.levin_lin_chu(t("panel"), "y", "unit", "t", 1)


_KP = "(SELECT unit, sum(s * s) / power(any_value(n), 2) / (any_value(q) / any_value(n)) AS k FROM (SELECT *, sum(z) OVER (PARTITION BY unit ORDER BY t) AS s, sum(z * z) OVER (PARTITION BY unit) AS q FROM (SELECT unit, t, y - avg(y) OVER (PARTITION BY unit) AS z, count(*) OVER (PARTITION BY unit) AS n FROM {panel})) GROUP BY unit)"


@register("hadri", f"SELECT round(avg(k), 6) + 0.0 AS lm, round(sqrt(count(*)) * (avg(k) - 1.0 / 6) / sqrt(1.0 / 45), 5) + 0.0 AS z FROM {_KP}")
def _(t):
    return further.hadri(t("panel"), "y", "unit", "t").select("lm", F.round("z", 5).alias("z"))


@register("cips")
def _(t):
    return further.cips(t("panel"), "y", "unit", "t")


@register("kao")
def _(t):
    return further.kao(t("panel"), "y", ["x"], "unit", "t")


@register("pedroni")
def _(t):
    return further.pedroni(t("panel"), "y", ["x"], "unit", "t")


@register("vecm")
def _(t):
    return further.vecm(t("tsm"), _PAIR, "t", 2, 1)


@register("phillips_ouliaris")
def _(t):
    return further.phillips_ouliaris(t("tsm"), "revenue", ["qty"], "t")


@register("gregory_hansen")
def _(t):
    return further.gregory_hansen(t("tsm"), "revenue", ["qty"], "t")


for _m in ("expalmon", "beta", "unrestricted"):

    @register(f"midas_{_m}", digits=3)
    def _(t, m=_m):
        d = t("tsm").withColumn("t", F.col("t") - 1)
        low = d.groupBy((F.col("t") / 3).cast("int").alias("t")).agg(F.sum("revenue").alias("y"), F.count("*").alias("n")).where("n = 3")
        return further.midas(low, d, "y", "qty", "t", 3, 4, m)


@register("kernel_regression", "WITH h AS (SELECT min(q) AS lo, max(q) AS hi, 1.06 * stddev_samp(q) * power(count(*), -0.2) AS h FROM {xs}), g AS (SELECT lo + (hi - lo) * k / 10.0 AS x, h FROM h CROSS JOIN range(0, 11) r(k)), w AS (SELECT x, (q - x) / h AS u, exp(-power((q - x) / h, 2) / 2) AS w, y FROM g CROSS JOIN {xs}) SELECT round(x, 6) + 0.0 AS x, round((sum(w * u * u) * sum(w * y) - sum(w * u) * sum(w * u * y)) / (sum(w) * sum(w * u * u) - power(sum(w * u), 2)), 5) + 0.0 AS fitted FROM w GROUP BY x")
def _(t):
    return further.kernel_regression(t("xs"), "y", "q").select("x", F.round("fitted", 5).alias("fitted"))


@register("lowess")
def _(t):
    return further.lowess(t("tsm"), "revenue", "qty")


@register("smooth_transition", digits=3)
def _(t):
    return further.smooth_transition(t("tsm"), "revenue", "t")


@register("local_whittle", digits=3)
def _(t):
    return further.local_whittle(t("hours"), "v", "t", by="kind")


@register("nowcast", digits=3)
def _(t):
    d = t("tsm")
    last = d.agg(F.max("t")).first()[0]
    return further.nowcast(d.withColumn("revenue", F.when(F.col("t") < last - 1, F.col("revenue"))), ["revenue", "qty", "disc"], "t", "revenue")


@register("identify_external_volatility")
def _(t):
    return further.identify_by_volatility(t("tsm").withColumn("regime", (F.col("t") % 24 >= 12).cast("double")), _PAIR, "t", "regime")


@register("identify_independent_components", digits=4)
def _(t):
    return further.identify_by_independence(t("tsm"), _PAIR, "t")


@register("propensity_effect")
def _(t):
    return further.propensity_projection(t("bin"), "x", "en", ["y"])


@register("forecast_encompassing")
def _(t):
    return further.forecast_encompassing(_forecasts(t), "y", "f1", "f12", "t", "unit")


# -- structural models ------------------------------------------------------


#: Persistence of monthly revenue, kept where the models have a solution of their own kind.
_RHO = "(SELECT least(0.9e0, greatest(0.4e0, sum(y * b) / sum(b * b))) FROM (SELECT y, lag(y) OVER (ORDER BY t) AS b FROM (SELECT t, (revenue - avg(revenue) OVER ()) / stddev_samp(revenue) OVER () AS y FROM {tsm})) WHERE b IS NOT NULL)"


def _persistence(t) -> float:
    """What the models below take from the tables: the first autoregressive coefficient of monthly revenue."""
    d = transforms.lag_design(_scaled(t), ["y"], 1, "t")
    return min(0.9, max(0.4, d.agg(F.sum(F.col("y") * F.col("y_l1")) / F.sum(F.col("y_l1") * F.col("y_l1"))).first()[0]))


def _risk(t) -> float:
    """Spread of monthly growth of revenue, as income risk, within bounds."""
    d = transforms.lag_design(t("tsm").select("t", "revenue"), ["revenue"], 1, "t")
    return min(0.4, max(0.05, d.agg(F.stddev_samp(F.log("revenue") - F.log("revenue_l1"))).first()[0]))


def _growth(t) -> structural.Model:
    return structural.Model(["1 / c[t] = beta * alpha * exp(a[t+1]) * k[t]**(alpha - 1) / c[t+1]", "c[t] + k[t] = exp(a[t]) * k[t-1]**alpha", "a[t] = rho * a[t-1] + s * e[t]"], ["c", "k", "a"], ["e"], {"alpha": 0.3, "beta": 0.95, "rho": _persistence(t), "s": 0.01})


_GUESS = {"c": 0.5, "k": 0.2, "a": 0.0}
_AR = structural.Model(["y[t] = rho * y[t-1] + s * e[t]"], ["y"], ["e"], {"rho": 0.5, "s": 1.0})


def _scaled(t):
    d = t("tsm").crossJoin(F.broadcast(t("tsm").agg(F.avg("revenue").alias("m"), F.stddev_samp("revenue").alias("sd"))))  # one row
    return d.select("t", ((F.col("revenue") - F.col("m")) / F.col("sd")).alias("y"))


@register("structural_solution")
def _(t):
    return structural.solution_table(t("tsm").sparkSession, structural.Solution(_growth(t), _GUESS))


@register("structural_irf", "WITH p AS (SELECT 0.3e0 AS al, " + _RHO + " AS rho, 0.01e0 AS s, power(0.285e0, 1 / 0.7e0) AS kbar), r AS (SELECT CAST(h AS INT) AS horizon, s * power(rho, h) AS a, kbar * s * (power(rho, h + 1) - power(al, h + 1)) / (rho - al) AS k FROM p CROSS JOIN range(0, 20) q(h)) SELECT horizon, 'a' AS variable, 'e' AS shock, round(a, 6) + 0.0 AS value FROM r UNION ALL SELECT horizon, 'k', 'e', round(k, 6) + 0.0 FROM r UNION ALL SELECT horizon, 'c', 'e', round(k * 0.715e0 / 0.285e0, 6) + 0.0 FROM r")
def _(t):
    return structural.impulse_table(t("tsm").sparkSession, structural.Solution(_growth(t), _GUESS))


@register("structural_variance_shares")
def _(t):
    return structural.variance_shares(t("tsm").sparkSession, structural.Solution(_growth(t), _GUESS))


@register("structural_simulation")
def _(t):
    return structural.simulate(t("tsm").sparkSession, structural.Solution(_growth(t), _GUESS), 100, 50, seed=1)


@register("structural_likelihoods", "WITH z AS (SELECT t, (revenue - avg(revenue) OVER ()) / stddev_samp(revenue) OVER () AS y FROM {tsm}), l AS (SELECT t, y, lag(y) OVER (ORDER BY t) AS b FROM z), g AS (SELECT k / 10.0e0 AS rho FROM range(0, 10) q(k)) SELECT round(rho, 6) + 0.0 AS rho, round(sum(CASE WHEN b IS NULL THEN -0.5 * (ln(2 * pi() / (1 - rho * rho)) + y * y * (1 - rho * rho)) ELSE -0.5 * (ln(2 * pi()) + power(y - rho * b, 2)) END), 6) + 0.0 AS log_likelihood FROM g CROSS JOIN l GROUP BY rho")
def _(t):
    d = _scaled(t)
    return structural.likelihoods(d, _AR, d.sparkSession.range(10).select((F.col("id") / 10).alias("rho")), ["y"], guess={"y": 0.0})


@register("structural_posterior", digits=4)
def _(t):
    draws = structural.posterior(_scaled(t), _AR, {"rho": ("beta", 0.5, 0.2), "s": ("gamma", 1.0, 0.5)}, ["y"], draws=300, burn=200, chains=4, guess={"y": 0.0})
    return structural.posterior_summary(draws, ["rho", "s"])


@register("incomplete_markets_wealth", digits=4)
def _(t):
    return structural.wealth_table(t("tsm").sparkSession, structural.aiyagari(rho=_persistence(t), risk=_risk(t), states=3, points=80, top=60.0, tol=1e-4))


@register("incomplete_markets_households", digits=4)
def _(t):
    return structural.simulate_panel(t("tsm").sparkSession, structural.aiyagari(rho=_persistence(t), risk=_risk(t), states=3, points=80, top=60.0, tol=1e-4), 500, 40)


@register("perpetual_youth_transition")
def _(t):
    m, at = structural.perpetual_youth(beta=1 - 0.2 * (1 - _persistence(t)))
    return structural.transition(t("tsm").sparkSession, structural.Solution(m, at), {"k": 0.8 * at["k"]})


def _floor(t) -> structural.Model:
    return structural.Model(["y[t] = rho * y[t-1] + e[t]", "i[t] = 1.5 * y[t]", "c[t] = 0.9 * c[t+1] - i[t]"], ["y", "i", "c"], ["e"], {"rho": _persistence(t)})


@register("bounded_rate_impulses", "WITH z AS (SELECT " + _RHO + " AS rho), p AS (SELECT CAST(h AS INT) AS h, -power(rho, h) AS y, greatest(-0.5e0, -1.5e0 * power(rho, h)) AS i, -1.5e0 * power(rho, h) AS f FROM z CROSS JOIN range(0, 600) q(h)), c AS (SELECT a.h, -sum(power(0.9e0, b.h - a.h) * b.i) AS c, -sum(power(0.9e0, b.h - a.h) * b.f) AS f FROM p a JOIN p b ON b.h >= a.h WHERE a.h < 30 GROUP BY a.h), l AS (SELECT h, 'y' AS variable, y AS bounded, y AS free FROM p UNION ALL SELECT h, 'i', i, f FROM p UNION ALL SELECT h, 'c', c, f FROM c) SELECT h AS horizon, variable, round(bounded, 6) + 0.0 AS bounded, round(free, 6) + 0.0 AS free, -1.5e0 * power(rho, h) < -0.5e0 AS binds FROM l CROSS JOIN z WHERE h < 30")
def _(t):
    return structural.bounded_impulses(t("tsm").sparkSession, structural.Solution(_floor(t), {"y": 0.0, "i": 0.0, "c": 0.0}), "i", {"e": -1.0}, 30, lower=-0.5)


@register("structural_shock_contributions")
def _(t):
    m = structural.Model(["y[t] = 0.6 * y[t-1] + u[t] + e[t]", "u[t] = 0.9 * u[t-1] + 0.3 * v[t]"], ["y", "u"], ["e", "v"], {})
    return structural.shock_contributions(_scaled(t), structural.Solution(m, {"y": 0.0, "u": 0.0}), ["y"])
