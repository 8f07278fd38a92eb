"""Queries of the further operators, with the SQL that each is compared with where SQL can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import arima, breaks, choice, describe, factors, identification, limited, moments, multivariate, nonlinear, panel, panels, projections, regression, restricted, results, seasonal, statespace, structural, structural_more, systems, transforms, trends, unitroots, vectors, volatility
from . import sqlkit
from .catalog import _AR, _GUESS, _RHO, _X, _growth, _io, _persistence, _risk, _scaled, register
from .sqlkit import r

_PAIR, _FOUR = ["revenue", "disc"], ["revenue", "qty", "disc", "tax"]
_T = "SELECT * FROM {tsm}"


def _changes(t):
    """Log differences of revenue, in percent."""
    return transforms.apply_tcodes(t("tsm").select("t", "revenue"), {"revenue": 5}, "t").select("t", (F.col("revenue") * 100).alias("v"))


# -- vector autoregressions ---------------------------------------------------------

_V1 = sqlkit.var1(_T, "revenue", "disc")


@register("var_coefficient_covariance", digits=8)
def _(t):
    return vectors.coefficient_covariance(t("tsm"), _PAIR, "t", 1)


@register("var_lag_coefficients", f"WITH {_V1} SELECT CAST(1 AS INT) AS lag, e AS equation, v AS variable, {r('x')} AS value FROM (SELECT unnest(['revenue','revenue','disc','disc']) AS e, unnest(['revenue','disc','revenue','disc']) AS v, unnest([a11, a12, a21, a22]) AS x FROM v1)")
def _(t):
    return vectors.lag_coefficients(t("tsm"), _PAIR, "t", 1)


@register("var_dimensions", f"WITH {_V1} SELECT CAST(2 AS INT) AS variables, CAST(1 AS INT) AS lags, CAST(3 AS INT) AS coefficients, CAST(n AS INT) AS rows_used, {r('-n * (ln(2 * pi()) + 1) - n / 2 * ln(s11 * s22 - s12 * s12)')} AS loglik, greatest(abs((a11 + a22 + sqrt(greatest(0, power(a11 - a22, 2) + 4 * a12 * a21))) / 2), abs((a11 + a22 - sqrt(greatest(0, power(a11 - a22, 2) + 4 * a12 * a21))) / 2), CASE WHEN power(a11 - a22, 2) + 4 * a12 * a21 < 0 THEN sqrt(a11 * a22 - a12 * a21) ELSE 0 END) < 1 AS stationary FROM v1")
def _(t):
    return vectors.dimensions(t("tsm"), _PAIR, "t", 1)


@register("var_fitted", f"WITH {_V1}, l AS (SELECT t, revenue, disc, lag(revenue) OVER (ORDER BY t) AS p1, lag(disc) OVER (ORDER BY t) AS q1 FROM {{tsm}} QUALIFY row_number() OVER (ORDER BY t) > 1) SELECT t, 'revenue' AS variable, {r('c1 + a11 * p1 + a12 * q1')} AS fitted, {r('revenue - c1 - a11 * p1 - a12 * q1')} AS residual FROM l CROSS JOIN v1 UNION ALL SELECT t, 'disc', {r('c2 + a21 * p1 + a22 * q1')}, {r('disc - c2 - a21 * p1 - a22 * q1')} FROM l CROSS JOIN v1")
def _(t):
    return vectors.fitted(t("tsm"), _PAIR, "t", 1)


_PATH = f"WITH RECURSIVE {_V1}, f AS (SELECT 0 AS h, (SELECT revenue FROM {{tsm}} ORDER BY t DESC LIMIT 1) AS p, (SELECT disc FROM {{tsm}} ORDER BY t DESC LIMIT 1) AS q UNION ALL SELECT h + 1, c1 + a11 * p + a12 * q, c2 + a21 * p + a22 * q FROM f CROSS JOIN v1 WHERE h < 6)"


@register("var_point_forecast", f"{_PATH} SELECT CAST(h AS INT) AS horizon, 'revenue' AS variable, {r('p')} AS forecast FROM f WHERE h > 0 UNION ALL SELECT CAST(h AS INT), 'disc', {r('q')} FROM f WHERE h > 0")
def _(t):
    return vectors.point_forecast(t("tsm"), _PAIR, "t", 1, 6)


_IRF = f"WITH RECURSIVE {_V1}, c AS (SELECT *, sqrt(s11) AS l11, s12 / sqrt(s11) AS l21, sqrt(s22 - s12 * s12 / s11) AS l22 FROM v1), i AS (SELECT 1 AS h, l11 AS t11, 0.0e0 AS t12, l21 AS t21, l22 AS t22 FROM c UNION ALL SELECT h + 1, a11 * t11 + a12 * t21, a11 * t12 + a12 * t22, a21 * t11 + a22 * t21, a21 * t12 + a22 * t22 FROM i CROSS JOIN c WHERE h < 8)"
_CELLS = "(SELECT h, unnest(['revenue','revenue','disc','disc']) AS variable, unnest(['revenue','disc','revenue','disc']) AS shock, unnest([t11, t12, t21, t22]) AS x FROM i)"


@register("irf_one_lag", f"{_IRF} SELECT CAST(h AS INT) AS horizon, variable, shock, {r('x')} AS value FROM {_CELLS}")
def _(t):
    from ..operators import multivariate

    return multivariate.irf(t("tsm"), _PAIR, "t", 1, 8)


@register("irf_one_lag_cumulative", f"{_IRF} SELECT CAST(h AS INT) AS horizon, variable, shock, {r('sum(x) OVER (PARTITION BY variable, shock ORDER BY h)')} AS value FROM {_CELLS}")
def _(t):
    from ..operators import multivariate

    return multivariate.irf(t("tsm"), _PAIR, "t", 1, 8, cumulative=True)


@register("fevd_one_lag", f"{_IRF}, q AS (SELECT h, variable, shock, sum(x * x) OVER (PARTITION BY variable, shock ORDER BY h) AS s FROM {_CELLS}) SELECT CAST(h AS INT) AS horizon, variable, shock, {r('s / sum(s) OVER (PARTITION BY variable, h)')} AS value FROM q")
def _(t):
    from ..operators import multivariate

    return multivariate.fevd(t("tsm"), _PAIR, "t", 1, 8)


@register("var_structural_shocks", f"WITH {_V1}, l AS (SELECT t, revenue, disc, lag(revenue) OVER (ORDER BY t) AS p1, lag(disc) OVER (ORDER BY t) AS q1 FROM {{tsm}} QUALIFY row_number() OVER (ORDER BY t) > 1), u AS (SELECT t, (revenue - c1 - a11 * p1 - a12 * q1) / sqrt(s11) AS e1, disc - c2 - a21 * p1 - a22 * q1 AS u2, s11, s12, s22 FROM l CROSS JOIN v1) SELECT t, 'revenue' AS shock, {r('e1')} AS value FROM u UNION ALL SELECT t, 'disc', {r('(u2 - s12 / sqrt(s11) * e1) / sqrt(s22 - s12 * s12 / s11)')} FROM u")
def _(t):
    return vectors.structural_shocks(t("tsm"), _PAIR, "t", 1)


@register("decomposition_gap", "SELECT v AS variable, true AS holds FROM (VALUES ('revenue'), ('disc')) x(v)")
def _(t):
    return vectors.decomposition_gap(t("tsm"), _PAIR, "t", 1).drop("gap")


@register("shock_totals")
def _(t):
    return vectors.shock_totals(t("tsm"), _PAIR, "t", 1)


@register("granger_blocks")
def _(t):
    return vectors.granger_blocks(t("tsm"), _FOUR, "t", {"prices": ["disc", "tax"], "qty": ["qty"]}, "revenue", 2)


@register("lag_tests")
def _(t):
    return vectors.lag_tests(t("tsm"), _PAIR, "t", 1, 2)


_COINT = ["revenue", "qty"]


@register("vecm_rank")
def _(t):
    return vectors.vecm_rank(t("tsm"), _COINT, "t", 2)


@register("vecm_to_var")
def _(t):
    return vectors.vecm_to_var(t("tsm"), _COINT, "t", 2)


@register("vecm_fitted")
def _(t):
    return vectors.vecm_fitted(t("tsm"), _COINT, "t", 2)


@register("vecm_forecast")
def _(t):
    return vectors.vecm_forecast(t("tsm"), _COINT, "t", 2, 1, 6)


@register("vecm_irf")
def _(t):
    return vectors.vecm_irf(t("tsm"), _COINT, "t", 2, 1, 8)


@register("vecm_fevd")
def _(t):
    return vectors.vecm_irf(t("tsm"), _COINT, "t", 2, 1, 8, True)


@register("vecm_historical_decomposition", f"SELECT t, 'revenue' AS variable, {r('revenue')} AS value FROM {{tsm}} QUALIFY row_number() OVER (ORDER BY t) > 2 UNION ALL SELECT t, 'qty', {r('qty')} FROM {{tsm}} QUALIFY row_number() OVER (ORDER BY t) > 2")
def _(t):
    return vectors.vecm_historical(t("tsm"), _COINT, "t", 2).groupBy("t", "variable").agg(F.sum("value").alias("value"))


@register("vecm_granger")
def _(t):
    return vectors.vecm_granger(t("tsm"), _COINT, "t", "qty", "revenue", 2)


@register("vecm_restrictions")
def _(t):
    return vectors.vecm_restrictions(t("tsm"), ["revenue", "qty", "disc"], "t", 2, 1, beta=[[1, 0], [0, 1], [0, 0]], alpha=[[1, 0], [0, 1], [0, 0]], exogenous=["disc"], known=[1, -4, 0])


@register("bvar_irf", digits=4)
def _(t):
    return vectors.posterior_irf(t("tsm"), _PAIR, "t", 1, 6, 100)


@register("bvar_fevd", digits=4)
def _(t):
    return vectors.posterior_irf(t("tsm"), _PAIR, "t", 1, 6, 100, shares=True)


@register("bvar_historical_decomposition", digits=4)
def _(t):
    return vectors.posterior_historical(t("tsm"), _PAIR, "t", 1, 20)


@register("bvar_forecast", digits=4)
def _(t):
    return vectors.posterior_forecast(t("tsm"), _PAIR, "t", 1, 6, 200)


@register("bvar_models", digits=4)
def _(t):
    return vectors.posterior_model(t("tsm"), _PAIR, "t", 1, 200)


@register("bvar_gibbs", digits=4)
def _(t):
    return vectors.gibbs(t("tsm"), _PAIR, "t", 1, 2, 100, 100)


@register("bvar_hyperparameters", digits=4)
def _(t):
    return vectors.hyperparameters(t("tsm"), _PAIR, "t", 1, (0.05, 0.2, 1.0, 5.0), (1.0, 2.0), (0.0, 0.5))


# -- identification -----------------------------------------------------------------


for _m in identification.METHODS:

    @register(f"identify_{_m}", digits=4)
    def _(t, m=_m):
        return identification.independent(t("tsm"), _PAIR, "t", m)


@register("identify_zero_and_sign", digits=4)
def _(t):
    return identification.restricted_irf(t("tsm"), _PAIR, "t", zeros=[("disc", "revenue", 0)], signs=[("revenue", "revenue", 0, 1)], horizon=6, draws=200)


@register("identify_narrative", digits=4)
def _(t):
    first = t("tsm").agg(F.min("t")).first()[0]
    return identification.restricted_irf(t("tsm"), _PAIR, "t", signs=[("revenue", "revenue", 0, 1), ("disc", "disc", 0, 1)], narrative=[("revenue", first + 10, 1)], horizon=6, draws=200)


@register("identify_penalty", digits=3)
def _(t):
    return identification.penalty_irf(t("tsm"), _PAIR, "t", [("revenue", "revenue", 0, 1), ("disc", "revenue", 0, -1)], horizon=6)


@register("identify_markov_switching", digits=4)
def _(t):
    return identification.markov_switching_impact(t("tsm"), _PAIR, "t")


@register("identify_smooth_transition", digits=4)
def _(t):
    return identification.smooth_transition_impact(t("tsm"), _PAIR, "t", "tax")


@register("test_shock_gaussianity")
def _(t):
    return identification.shock_gaussianity(t("tsm"), _PAIR, "t")


@register("test_gaussian_vs_nongaussian", digits=3)
def _(t):
    return identification.gaussian_against(t("tsm"), _PAIR, "t")


@register("test_shock_independence", digits=4)
def _(t):
    return identification.shock_independence(t("tsm"), _PAIR, "t", permutations=19)


@register("test_identification_strength", digits=4)
def _(t):
    return identification.identification_strength(t("tsm"), _PAIR, "t", replicates=20)


@register("test_overidentification", digits=3)
def _(t):
    return identification.overidentification(t("tsm"), _PAIR, "t", [("disc", "revenue")], replicates=20)


# -- local projections -----------------------------------------------------------------


def _lp_sql(h: int, y: str) -> str:
    src = f"SELECT lead({y}, {h}) OVER w AS z, revenue AS s, lag(revenue) OVER w AS p1, lag(disc) OVER w AS q1 FROM {{tsm}} WINDOW w AS (ORDER BY t) QUALIFY lag(revenue) OVER w IS NOT NULL AND lead({y}, {h}) OVER w IS NOT NULL"
    return sqlkit.regression(src, "z", ["s", "1.0e0", "p1", "q1"], f"{y}_{h}")


_LP = ",\n".join(_lp_sql(h, y) for y in _PAIR for h in range(5))


@register("local_projection_values", f"WITH {_LP} " + " UNION ALL ".join(f"SELECT CAST({h} AS INT) AS horizon, '{y}' AS variable, {r('b0')} AS value FROM {y}_{h}" for y in _PAIR for h in range(5)))
def _(t):
    from ..operators import multivariate

    return multivariate.local_projection(t("tsm"), _PAIR, "revenue", "t", 4, 1).select("horizon", "variable", "value")


@register("projection_several_shocks")
def _(t):
    return projections.several_shocks(t("tsm"), _PAIR, _PAIR, "t", 4, 2)


@register("projection_structural")
def _(t):
    return projections.structural(t("tsm"), _PAIR, "t", 4, 2)


@register("projection_against_var")
def _(t):
    return projections.against_var(t("tsm"), _PAIR, "t", 4, 2)


@register("projection_instrument_tests")
def _(t):
    return projections.instrument_tests(t("tsm"), _PAIR, "revenue", ["qty", "tax"], "t", "disc", 3, 1)


@register("projection_smooth")
def _(t):
    return projections.smoothed(t("tsm"), _PAIR, "revenue", "t", 10, 2)


@register("projection_smoothing_choice", digits=4)
def _(t):
    return projections.choose_smoothing(t("tsm"), _PAIR, "revenue", "disc", "t", 10, 2)


@register("transitions", f"SELECT t, {r('1 / (1 + exp(-3 * (disc - 5)))')} AS logistic, {r('1 - exp(-3 * power(disc - 5, 2))')} AS exponential, CASE WHEN disc >= 5 THEN 1.0e0 ELSE 0.0e0 END AS indicator FROM {{tsm}}")
def _(t):
    return projections.transitions(t("tsm"), "disc", "t", 3.0, 5.0)


@register("projection_state_test", digits=3)
def _(t):
    return projections.state_test(t("tsm"), _PAIR, "revenue", "tax", "disc", "t", 3, 1)


def _treated(t):
    return t("tsm").withColumn("d", (F.col("t") % 3 == 0).cast("double"))


@register("treatment_projection")
def _(t):
    return projections.treatment_projection(_treated(t), _PAIR, "d", ["tax"], "revenue", "t", 3, 1)


@register("treatment_doubly_robust")
def _(t):
    return projections.treatment_projection(_treated(t), _PAIR, "d", ["tax"], "revenue", "t", 3, 1, True)


@register("propensity_overlap")
def _(t):
    return projections.overlap(_treated(t), "d", ["tax", "disc"], "t")


@register("projection_forecast")
def _(t):
    return projections.forecast(t("tsm"), _PAIR, "revenue", "t", [0.5, 0.0, 0.0], 2)


@register("projection_variance_shares")
def _(t):
    return projections.variance_shares(t("tsm"), _PAIR, "t", "disc", 4, 2)


@register("projection_historical")
def _(t):
    return projections.historical(t("tsm"), _PAIR, "t", "disc", 4, 2)


@register("projection_gmm")
def _(t):
    return projections.gmm(t("tsm"), _PAIR, "revenue", "t", "disc", 3, 2).drop("j_stat")


# -- factors and nowcasts ---------------------------------------------------------------


@register("dynamic_factors")
def _(t):
    return factors.dynamic_factors(t("tsm"), _FOUR, "t", 2, 1)


@register("dynamic_factor_summary")
def _(t):
    return factors.dynamic_summary(t("tsm"), _FOUR, "t", 1, 2)


@register("dynamic_factor_criteria")
def _(t):
    return factors.dynamic_criteria(t("tsm"), _FOUR, "t", 2, 2)


@register("factor_forecast")
def _(t):
    return factors.factor_forecast(t("tsm"), _FOUR, "t", 1, 1, 4)


def _ragged(t, back: int = 2):
    last = t("tsm").agg(F.max("t")).first()[0]
    nan = F.lit(float("nan"))
    return t("tsm").withColumns({"revenue": F.when(F.col("t") > last - back, nan).otherwise(F.col("revenue")), "qty": F.when(F.col("t") > last - 1, nan).otherwise(F.col("qty"))})


@register("balance_panel", digits=4)
def _(t):
    return factors.fill_panel(_ragged(t), _FOUR, "t")


@register("nowcast_dfm", digits=4)
def _(t):
    return factors.nowcast(_ragged(t), _FOUR, "t", "revenue")


@register("nowcast_news", digits=4)
def _(t):
    return factors.news(_ragged(t, 1), _ragged(t, 3), _FOUR, "t", "revenue")


@register("nowcast_bridge")
def _(t):
    first = t("tsm").agg(F.min("t")).first()[0]
    d = _ragged(t, 1).withColumn("t", F.col("t") - first)
    return factors.bridge(d.withColumn("target", F.when(F.col("t") % 3 == 2, F.col("tax")).otherwise(float("nan"))), ["revenue", "qty", "disc"], "target", "t")


@register("nowcast_bvar", digits=4)
def _(t):
    return factors.nowcast_bvar(_ragged(t), _FOUR, "t", "revenue")


@register("generalised_factors")
def _(t):
    return factors.generalised_factors(t("tsm"), _FOUR, "t", 1)


@register("generalised_factor_summary")
def _(t):
    return factors.generalised_summary(t("tsm"), _FOUR, "t")


@register("generalised_factor_forecast")
def _(t):
    return factors.generalised_forecast(t("tsm"), _FOUR, "t")


for _w in ("irf", "fevd", "panel_irf", "forecast", "panel_forecast", "historical"):

    @register(f"favar_{_w}")
    def _(t, w=_w):
        return factors.augmented(t("tsm"), ["revenue", "qty", "tax"], ["disc"], "t", w, 1, 1, 6)


@register("favar_to_var")
def _(t):
    return factors.augmented_to_var(t("tsm"), ["revenue", "qty", "tax"], ["disc"], "t")


@register("favar_bayesian", digits=4)
def _(t):
    return factors.augmented_bayesian(t("tsm"), ["revenue", "qty", "tax"], ["disc"], "t", horizon=4, draws=40)


@register("structural_factor_irf")
def _(t):
    return factors.structural_factors(t("tsm"), _FOUR, "t", 2, 1, 6)


@register("factor_break_tests")
def _(t):
    return factors.loading_breaks(t("tsm"), _FOUR, "t")


# -- ARIMA, state space --------------------------------------------------------------


@register("arma_exact", digits=3)
def _(t):
    return arima.estimate(t("tsm"), "disc", "t", 1, 1)


@register("ar1_exact", digits=3)
def _(t):
    return arima.estimate(t("tsm"), "disc", "t", 1, 0)


for _n, (_p, _d, _q) in {"ar": (1, 0, 0), "ma": (0, 0, 1), "arma": (1, 0, 1), "arima": (1, 1, 1)}.items():

    @register(f"forecast_{_n}", digits=3)
    def _(t, p=_p, d=_d, q=_q):
        return arima.forecast(t("tsm"), "disc", "t", p, q, d, 4)


@register("auto_arima")
def _(t):
    return arima.orders(t("tsm"), "disc", "t", 2, 1)


@register("arfima", digits=3)
def _(t):
    return arima.estimate_arfima(t("tsm"), "disc", "t", 1, 0)


@register("forecast_arfima", digits=3)
def _(t):
    return arima.forecast_arfima(t("tsm"), "disc", "t", 0, 0, 4)


@register("state_space", digits=3)
def _(t):
    return arima.estimate_state_space(t("tsm"), "disc", "t", arima.level_model, [-3.0, -3.0], ["log_obs", "log_level"])


@register("forecast_state_space", digits=3)
def _(t):
    return arima.forecast_state_space(t("tsm"), "disc", "t", arima.level_model, [-3.0, -3.0], 4)


@register("varying_coefficients", digits=3)
def _(t):
    return arima.varying_coefficients(t("tsm"), "revenue", ["qty"], "t")


# -- volatility ------------------------------------------------------------------------


for _k in volatility.Model.NAMES:

    @register(f"volatility_{_k}", digits=3)
    def _(t, k=_k):
        return volatility.fit_table(_changes(t), "v", "t", k)

    @register(f"volatility_forecast_{_k}", digits=3)
    def _(t, k=_k):
        return volatility.forecast(_changes(t), "v", "t", k, 4, 100)


@register("news_impact_curve", digits=3)
def _(t):
    return volatility.news_impact(_changes(t), "v", "t", "gjr")


_SQUARES = "SELECT t, power(v - avg(v) OVER (), 2) AS z FROM (SELECT t, 100 * (ln(revenue) - lag(ln(revenue)) OVER (ORDER BY t)) AS v FROM {tsm} QUALIFY row_number() OVER (ORDER BY t) > 1)"


@register("ljung_box_squared", f"WITH q AS (SELECT t, z - avg(z) OVER () AS c FROM ({_SQUARES})), l AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) AS i, c, lag(c, CAST(k AS INT)) OVER (PARTITION BY k ORDER BY t) AS d FROM q CROSS JOIN range(1, 6) g(k)), a AS (SELECT k, sum(c * d) / (SELECT sum(c * c) FROM q) AS rho, (SELECT count(*) FROM q) AS n FROM l GROUP BY k) SELECT {r('any_value(n) * (any_value(n) + 2) * sum(rho * rho / (n - k))', 4)} AS statistic, CAST(5 AS INT) AS df FROM a", digits=4)
def _(t):
    return volatility.squared_portmanteau(_changes(t), "v", "t", 5).drop("p_value")


@register("nyblom_stability", digits=2)
def _(t):
    return volatility.nyblom(_changes(t), "v", "t")


@register("volatility_components", digits=3)
def _(t):
    return volatility.components(_changes(t), "v", "t")


@register("garch_midas", digits=3)
def _(t):
    d = _changes(t).join(t("tsm").select("t", "tax"), "t")
    return volatility.estimate_garch_midas(d, "v", "tax", "t", 6, 2)


@register("bekk_path", digits=3)
def _(t):
    return volatility.bekk_path(t("tsm"), ["disc", "tax"], "t")


@register("bekk_forecast", digits=3)
def _(t):
    return volatility.bekk_forecast(t("tsm"), ["disc", "tax"], "t")


@register("stochastic_volatility", digits=3)
def _(t):
    return volatility.estimate_stochastic(_changes(t), "v", "t", 100, 100)


@register("stochastic_volatility_path", digits=3)
def _(t):
    return volatility.volatility_path(_changes(t), "v", "t", 60, 60)


# -- tests ----------------------------------------------------------------------------


@register("ng_perron", digits=4)
def _(t):
    return unitroots.ng_perron(t("tsm"), "disc", "t")


@register("point_optimal", digits=4)
def _(t):
    return unitroots.point_optimal(t("tsm"), "disc", "t")


@register("fourier_tests")
def _(t):
    return unitroots.fourier_tests(t("tsm"), "disc", "t")


@register("lm_unit_root")
def _(t):
    return unitroots.lm_tests(t("tsm"), "disc", "t", 2)


@register("adf_two_breaks")
def _(t):
    return unitroots.adf_two_breaks(t("tsm"), "disc", "t")


@register("hegy_quarterly")
def _(t):
    return unitroots.seasonal_roots(t("tsm"), "disc", "t", 4)


@register("hegy_monthly")
def _(t):
    return unitroots.seasonal_roots(t("tsm"), "disc", "t", 12)


@register("bds")
def _(t):
    return unitroots.bds(t("tsm"), "disc", "t")


for _k in ("adf", "kpss", "pp", "df_gls"):

    @register(f"all_variables_{_k}")
    def _(t, k=_k):
        return unitroots.all_variables(t("tsm"), _FOUR, "t", k)


@register("cointegration_instability")
def _(t):
    return unitroots.instability(t("tsm"), "revenue", ["qty"], "t")


@register("panel_fisher")
def _(t):
    return unitroots.fisher_panel(t("panel"), "y", "unit", "t")


@register("panel_breitung")
def _(t):
    return unitroots.breitung(t("panel"), "y", "unit", "t")


@register("panel_common_factors")
def _(t):
    return unitroots.common_factor_tests(t("tsm"), _FOUR, "t")


@register("panel_unit_root_summary")
def _(t):
    return unitroots.panel_summary(t("panel"), "y", "unit", "t")


@register("panel_westerlund")
def _(t):
    return unitroots.westerlund(t("panel"), "y", ["x"], "unit", "t")


@register("panel_johansen")
def _(t):
    return unitroots.johansen_panel(t("panel"), ["y", "x"], "unit", "t", replicates=200)


@register("normality_suite")
def _(t):
    return unitroots.normality(t("tsm"), _PAIR, "t")


# -- moments, panel autoregressions -----------------------------------------------------


def _line(theta, d):
    e = d[:, 0] - theta[0] - theta[1] * d[:, 1]
    return np.column_stack([e, e * d[:, 1], e * d[:, 2]])


@register("gmm_nonlinear", digits=4)
def _(t):
    return moments.estimate(t("tsm"), ["revenue", "qty", "tax"], "t", _line, ["const", "qty"], [0.0, 1.0], hac=False)


@register("gmm_exactly_identified", f"SELECT 'const' AS term, {r('regr_intercept(revenue, qty)', 4)} AS estimate FROM {{tsm}} UNION ALL SELECT 'qty', {r('regr_slope(revenue, qty)', 4)} FROM {{tsm}}", digits=4)
def _(t):
    return moments.estimate(t("tsm"), ["revenue", "qty"], "t", lambda th, d: (lambda e: np.column_stack([e, e * d[:, 1]]))(d[:, 0] - th[0] - th[1] * d[:, 1]), ["const", "qty"], [0.0, 1.0], "identity").where("term in ('const', 'qty')").select("term", "estimate")


@register("simulated_moments", digits=2)
def _(t):
    return moments.estimate_simulated(_scaled(t), ["y"], "t", moments.simulate_autoregression, ["mean", "rho", "sd"], [0.0, 0.3, 1.0], moments.Bounds([None, -0.99, 0.0], [None, 0.99, None]))


@register("autocovariance_moments")
def _(t):
    from ..operators.kernels import per_series

    return per_series(t("tsm"), ["disc"], "t", lambda _, v: {"moment": [0, 1, 2], "value": moments.autocovariance_moments(v, 1)}, "moment int, value double")


_PV = ["y", "x"]


@register("pvar_within", digits=5)
def _(t):
    return moments.panel_coefficients(moments.PanelVar(t("panel"), _PV, "unit", "t", 1)).drop("std_error")


@register("pvar_difference_gmm", digits=4)
def _(t):
    return moments.panel_coefficients(moments.PanelVar(t("panel"), _PV, "unit", "t", 1, "fd"))


@register("pvar_forward_gmm", digits=4)
def _(t):
    return moments.panel_coefficients(moments.PanelVar(t("panel"), _PV, "unit", "t", 1, "fod"))


@register("pvar_system_gmm", digits=4)
def _(t):
    return moments.panel_coefficients(moments.PanelVar(t("panel"), _PV, "unit", "t", 1, "fd", system=True))


for _w in ("oirf", "girf", "fevd"):

    @register(f"pvar_{_w}", digits=5)
    def _(t, w=_w):
        return moments.panel_cube(moments.PanelVar(t("panel"), _PV, "unit", "t", 1), w, 6)


@register("pvar_stability", digits=5)
def _(t):
    return moments.panel_stability(moments.PanelVar(t("panel"), _PV, "unit", "t", 1))


@register("pvar_hansen_and_mmsc", digits=4)
def _(t):
    return moments.panel_tests(moments.PanelVar(t("panel"), _PV, "unit", "t", 1, "fd"))


@register("pvar_lag_selection", digits=4)
def _(t):
    return moments.panel_lag_selection(t("panel"), _PV, "unit", "t", 2)


@register("pvar_bootstrap", digits=3)
def _(t):
    return moments.panel_bootstrap(t("panel"), _PV, "unit", "t", 1, 4, 20)


@register("pvar_serial_correlation", digits=4)
def _(t):
    return moments.serial_correlation(t("panel"), _PV, "unit", "t")


# -- panels, difference-in-differences ------------------------------------------------------


@register("panel_pcse", digits=5)
def _(t):
    return panels.pcse(t("panel"), "y", ["x"], "unit", "t").table()


@register("panel_pcse_pairwise", digits=5)
def _(t):
    return panels.pcse(t("panel"), "y", ["x"], "unit", "t", True).table()


@register("panel_prais_winsten", digits=5)
def _(t):
    return panels.prais_winsten(t("panel"), "y", ["x"], "unit", "t").table()


@register("panel_hausman_taylor", digits=4)
def _(t):
    d = t("panel").withColumns({"x2": F.col("x") * F.sin(F.col("t")), "z1": (F.col("unit") % 3).cast("double"), "z2": (F.col("unit") % 5).cast("double")})
    return panels.hausman_taylor(d, "y", ["x2"], ["x"], ["z1"], ["z2"], "unit", "t")


def _binary_panel(t):
    m = t("panel").groupBy("t").agg(F.avg("y").alias("m"))
    return t("panel").join(m, "t").select("unit", "t", (F.col("y") > F.col("m")).cast("double").alias("d"), "x")


for _k in ("pooled", "fe", "re", "cre"):

    @register(f"panel_logit_{_k}", digits=4)
    def _(t, k=_k):
        return panels.panel_binary(_binary_panel(t), "d", ["x"], "unit", "t", "logit", k)


for _k in ("pooled", "re", "cre"):

    @register(f"panel_probit_{_k}", digits=4)
    def _(t, k=_k):
        return panels.panel_binary(_binary_panel(t), "d", ["x"], "unit", "t", "probit", k)


@register("panel_logit_margins", digits=4)
def _(t):
    d = _binary_panel(t)
    return panels.panel_margins(d, panels.panel_binary(d, "d", ["x"], "unit", "t", "logit", "re"), ["x"])


@register("did_sun_abraham", digits=5)
def _(t):
    return panels.sun_abraham(t("did"), "y", "unit", "t", "first", 2, 2)


@register("did_long_differences", digits=4)
def _(t):
    return panels.long_differences(t("did"), "y", "unit", "t", "first", draws=20).drop("std_error")


@register("did_pooled_projection", digits=5)
def _(t):
    return panels.pooled_projection(t("did"), "y", "unit", "t", "first", 1, 1)


@register("did_pretrend", digits=4)
def _(t):
    return panels.pretrend(panels.sun_abraham_effects(t("did"), "y", "unit", "t", "first", 3, 2), t("did").sparkSession)


@register("did_weights", f"WITH u AS (SELECT DISTINCT unit, first FROM {{did}}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM u), d AS (SELECT t, (SELECT count(*) FROM u WHERE first > 0 AND first <= t) / (SELECT n FROM n) AS d FROM (SELECT DISTINCT t FROM {{did}})), s AS (SELECT first AS g, count(*) / (SELECT n FROM n) AS s FROM u WHERE first > 0 GROUP BY first) SELECT g AS cohort, t, {r('s * (1 - d) / (d * (1 - d))')} AS weight FROM s CROSS JOIN d WHERE t >= g AND d > 0 AND d < 1")
def _(t):
    return panels.weights(t("did"), "unit", "t", "first")


@register("did_honest", digits=5)
def _(t):
    return trends.honest_bounds(panels.sun_abraham_effects(t("did"), "y", "unit", "t", "first", 3, 2), t("did").sparkSession)


@register("did_honest_smooth", digits=5)
def _(t):
    return trends.honest_bounds(panels.sun_abraham_effects(t("did"), "y", "unit", "t", "first", 3, 2), t("did").sparkSession, "sd", (0.0, 0.1, 0.5))


@register("did_event_covariance", digits=5)
def _(t):
    return panel.event_effects(t("did"), "y", "unit", "t", "first", 2, 2).covariance(t("did").sparkSession)


# -- limited dependent variables, robust and selected regressions ---------------------------------


def _grades(t):
    return t("xs").select("y", "q", "d", F.when(F.col("q") < 1.7, 0).when(F.col("q") < 3.4, 1).otherwise(2).alias("g")).where("y is not null")


@register("ordered_chances", digits=4)
def _(t):
    d = _grades(t)
    return choice.ordered_chances(d, limited.ordered(d, "g", ["d", "y"]), ["d", "y"], [0, 1, 2]).agg(*[F.avg(f"p_{k}").alias(f"p_{k}") for k in range(3)])


@register("ordered_effects", digits=4)
def _(t):
    d = _grades(t)
    return choice.ordered_effects(d, limited.ordered(d, "g", ["d", "y"]), ["d", "y"], [0, 1, 2])


@register("multinomial_chances", "SELECT " + ", ".join(f"round(avg(CASE WHEN g = {k} THEN 1.0e0 ELSE 0.0e0 END), 3) + 0.0 AS p_{k}" for k in range(3)) + " FROM (SELECT CASE WHEN q < 1.7 THEN 0 WHEN q < 3.4 THEN 1 ELSE 2 END AS g FROM {xs})", digits=3)
def _(t):
    d = _grades(t)
    return choice.multinomial_chances(d, limited.multinomial(d, "g", ["d"]), ["d"], [0, 1, 2]).agg(*[F.avg(f"p_{k}").alias(f"p_{k}") for k in range(3)])


@register("multinomial_effects", digits=4)
def _(t):
    d = _grades(t)
    return choice.multinomial_effects(d, limited.multinomial(d, "g", ["d"]), ["d"], [0, 1, 2])


@register("tobit_effects", digits=4)
def _(t):
    d = t("xs").withColumn("c", F.greatest(F.col("y") - 2, F.lit(0.0)))
    return choice.tobit_effects(d, limited.tobit(d, "c", ["q", "d"]), ["q", "d"])


@register("brant", digits=3)
def _(t):
    return choice.brant(_grades(t), "g", ["d", "y"], [0, 1, 2])


@register("hausman_iia", digits=3)
def _(t):
    d = _grades(t)
    both = (limited.multinomial(d, "g", ["d"]), limited.multinomial(d.where("g <> 2"), "g", ["d"]))
    return choice.independence_of_alternatives(d, "g", ["d"], 2, both)


@register("heckman_ml", digits=3)
def _(t):
    d = t("xs").withColumn("s", (F.col("tax") + F.col("d") + F.sin(F.col("id").cast("double")) > 0.7).cast("double"))  # the sine stands for noise
    return choice.heckman_ml(d, "y", ["q"], "s", ["tax", "d"])


@register("robust_mm", digits=4)
def _(t):
    return choice.mm_regression(t("xs"), "y", ["q", "d"], 20)


@register("select_general_to_specific", digits=5)
def _(t):
    return choice.general_to_specific(t("xs"), "y", ["q", "d", "tax"])


@register("penalised_path", digits=5)
def _(t):
    return choice.penalised_path(t("xs"), "y", ["q", "d", "tax"], 0.5, 6)


@register("weak_instruments", digits=3)
def _(t):
    d = t("xs").withColumn("z", F.col("q") + F.col("d"))
    return choice.weak_instruments(d, ["tax"], ["y"], ["z", "d"])


_BG = sqlkit.regression("SELECT t, revenue, qty FROM {tsm}", "revenue", ["1.0e0", "qty"], "m") + ", u AS (SELECT t, qty, revenue - b0 - b1 * qty AS u FROM {tsm} CROSS JOIN m), l AS (SELECT qty, u, coalesce(lag(u) OVER (ORDER BY t), 0) AS u1, coalesce(lag(u, 2) OVER (ORDER BY t), 0) AS u2 FROM u), " + sqlkit.regression("SELECT * FROM l", "u", ["1.0e0", "qty", "u1", "u2"], "g")


@register("breusch_godfrey", f"WITH {_BG} SELECT 'breusch_godfrey' AS test, {r('n * (1 - rss / tss)')} AS statistic, 2.0e0 AS df1, CAST(NULL AS DOUBLE) AS df2 FROM g UNION ALL SELECT 'breusch_godfrey_f', {r('(tss - rss) / 2 / (rss / (n - 4))')}, 2.0e0, n - 4 FROM g")
def _(t):
    return choice.breusch_godfrey(regression.ols(t("tsm"), "revenue", ["qty"], "ols"), "t", 2).drop("p_value")


@register("siegel_tukey", "WITH d AS (SELECT y, status AS g, row_number() OVER (ORDER BY y) AS i, count(*) OVER () AS n FROM {xs}), k AS (SELECT y, g, n, CASE WHEN i <= (n + 1) // 2 THEN CASE WHEN i % 2 = 1 THEN 2 * i - 1 ELSE 2 * i END ELSE CASE WHEN (n + 1 - i) % 2 = 1 THEN 2 * (n + 1 - i) ELSE 2 * (n + 1 - i) - 1 END END AS s FROM d), m AS (SELECT g, n, avg(s) OVER (PARTITION BY y) AS s FROM k), a AS (SELECT avg(s) AS m, var_pop(s) AS v, any_value(n) AS n FROM m), c AS (SELECT count(*) AS n1, sum(s) AS w FROM m WHERE g = (SELECT min(g) FROM m)) SELECT 'siegel_tukey' AS test, round((w - n1 * m) / sqrt(v * n1 * (n - n1) / (n - 1)), 4) + 0.0 AS statistic, 1.0e0 AS df1, CAST(NULL AS DOUBLE) AS df2 FROM a CROSS JOIN c", digits=4)
def _(t):
    return choice.siegel_tukey(t("xs"), "y", "status").drop("p_value")


@register("signed_rank", "WITH d AS (SELECT revenue / 10 - qty AS d FROM {tsm} WHERE revenue / 10 - qty <> 0), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0e0 AS r FROM d) SELECT 'signed_rank' AS test, round((sum(CASE WHEN d > 0 THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4.0e0) / sqrt(sum(r * r) / 4), 6) + 0.0 AS statistic, 1.0e0 AS df1, CAST(NULL AS DOUBLE) AS df2 FROM k")
def _(t):
    return choice.signed_rank(t("tsm").withColumn("a", F.col("revenue") / 10), "a", "qty").drop("p_value")


_EDF = {
    "exponential": ("1 - exp(-y / m)", "m", "0.0e0"),
    "logistic": ("1 / (1 + exp(-(y - m) / (s * sqrt(3) / pi())))", "m", "s * sqrt(3) / pi()"),
    "gumbel": ("exp(-exp(-(y - (m - 0.5772156649015329e0 * s * sqrt(6) / pi())) / (s * sqrt(6) / pi())))", "m - 0.5772156649015329e0 * s * sqrt(6) / pi()", "s * sqrt(6) / pi()"),
    "weibull": ("1 - exp(-power(y / exp(lm + 0.5772156649015329e0 * ls * sqrt(6) / pi()), pi() / (ls * sqrt(6))))", "pi() / (ls * sqrt(6))", "exp(lm + 0.5772156649015329e0 * ls * sqrt(6) / pi())"),
}
for _k, (_p, _a, _b) in _EDF.items():

    @register(f"edf_{_k}", f"WITH a AS (SELECT avg(y) AS m, stddev_samp(y) AS s, avg(ln(y)) AS lm, stddev_samp(ln(y)) AS ls, CAST(count(*) AS DOUBLE) AS n FROM {{xs}}), p AS (SELECT greatest(1e-300, least(1 - 1e-16, {_p})) AS p, row_number() OVER (ORDER BY y) AS i, n, {_a} AS first, {_b} AS second FROM {{xs}} CROSS JOIN a), g AS (SELECT max(greatest(i / n - p, p - (i - 1) / n)) AS ks, sum(power(p - (2 * i - 1) / (2 * n), 2)) + 1 / (12 * any_value(n)) AS w, -any_value(n) - sum((2 * i - 1) * ln(p) + (2 * n + 1 - 2 * i) * ln(1 - p)) / any_value(n) AS a, avg(p) AS pm, any_value(n) AS n, any_value(first) AS first, any_value(second) AS second FROM p) SELECT unnest(['ks', 'cramer_von_mises', 'anderson_darling', 'watson']) AS test, round(unnest([ks, w, a, w - n * power(pm - 0.5, 2)]), 4) + 0.0 AS statistic, round(first, 4) + 0.0 AS first, round(second, 4) + 0.0 AS second FROM g", digits=4)
    def _(t, k=_k):
        return choice.edf_tests(t("xs"), "y", k)


# -- systems, long-run covariance, spectra ---------------------------------------------------


@register("three_stage_least_squares", digits=5)
def _(t):
    return systems.three_stage(t("tsm"), {"one": ("revenue", ["qty"]), "two": ("disc", ["tax"])}, ["qty", "tax"])


for _e in ("parzen", "newey_west", "one_sided", "varhac"):

    @register(f"long_run_covariance_{_e}")
    def _(t, e=_e):
        return systems.long_run(t("tsm"), _PAIR, "t", [e])


@register("short_run_covariance", f"SELECT 'short_run' AS estimator, a AS row, b AS column, {r('x')} AS value FROM (SELECT unnest(['revenue','revenue','disc','disc']) AS a, unnest(['revenue','disc','revenue','disc']) AS b, unnest([var_pop(revenue), covar_pop(revenue, disc), covar_pop(revenue, disc), var_pop(disc)]) AS x FROM {{tsm}})")
def _(t):
    return systems.long_run(t("tsm"), _PAIR, "t", ["short_run"])


@register("bandwidths")
def _(t):
    return systems.bandwidths(t("tsm"), "disc", "t")


@register("cointegration_ccr")
def _(t):
    return systems.canonical(t("tsm"), "revenue", ["qty"], "t")


@register("panel_fmols", digits=5)
def _(t):
    return systems.panel_cointegration(t("panel"), "y", ["x"], "unit", "t")


@register("panel_fmols_pooled", digits=5)
def _(t):
    return systems.panel_cointegration(t("panel"), "y", ["x"], "unit", "t", True)


@register("pooled_mean_group", digits=5)
def _(t):
    return systems.pooled_mean_group(t("panel"), "y", ["x"], "unit", "t")


@register("asymmetric_multipliers", digits=5)
def _(t):
    return systems.asymmetric_multipliers(t("tsm"), "revenue", "disc", "t")


@register("midas_forecast", digits=4)
def _(t):
    first = t("tsm").agg(F.min("t")).first()[0]
    d = t("tsm").withColumn("k", F.col("t") - first)
    return systems.forecast_mixed(d.withColumn("y", F.when(F.col("k") % 3 == 2, F.col("tax")).otherwise(float("nan"))), "y", "disc", "k", 3)


for _m in ("welch", "smoothed", "ar"):

    @register(f"spectral_density_{_m}")
    def _(t, m=_m):
        return systems.spectral_density(t("tsm"), "disc", "t", m)


@register("cross_spectrum")
def _(t):
    return systems.cross_spectrum(t("tsm"), "revenue", "disc", "t")


@register("band_power")
def _(t):
    return systems.band_power(systems.spectral_density(t("tsm"), "disc", "t", "ar"), 0.2, 1.0)


_PASSED = "WITH z AS (SELECT revenue - avg(revenue) OVER () AS z, row_number() OVER (ORDER BY t) - 1 AS r, count(*) OVER () AS n FROM {tsm}), s AS (SELECT 2 * pi() * k / any_value(n) AS w, (power(sum(z * cos(2 * pi() * k * r / n)), 2) + power(sum(z * sin(2 * pi() * k * r / n)), 2)) / (2 * pi() * any_value(n)) AS p FROM z CROSS JOIN range(1, (SELECT count(*) // 2 + 1 FROM z)) g(k) GROUP BY k), g AS (SELECT w, p, GAIN AS g FROM s) SELECT " + f"{r('w', 5)} AS frequency, {r('p', 5)} AS power, {r('g', 5)} AS gain, {r('p * g * g', 5)} AS passed FROM g"


@register("transfer_function_hp", _PASSED.replace("GAIN", "4 * 1600 * power(1 - cos(w), 2) / (1 + 4 * 1600 * power(1 - cos(w), 2))"), digits=5)
def _(t):
    return systems.filtered_spectrum(t("tsm"), "revenue", "t", "hp")


@register("transfer_function_hamilton", _PASSED.replace("GAIN", "sqrt(power(1 - cos(8 * w), 2) + power(sin(8 * w), 2))"), digits=5)
def _(t):
    return systems.filtered_spectrum(t("tsm"), "revenue", "t", "hamilton")


@register("transfer_function_baxter_king", digits=5)
def _(t):
    return systems.filtered_spectrum(t("tsm"), "revenue", "t", "baxter_king")


@register("filter_beveridge_nelson_arma", digits=3)
def _(t):
    return systems.beveridge_nelson_arma(t("tsm"), "revenue", "t")


@register("seasonal_adjustment", digits=3)
def _(t):
    return seasonal.x11(t("tsm"), "revenue", "t")


@register("seasonal_adjustment_summary", digits=2)
def _(t):
    return seasonal.x11_summary(t("tsm"), "revenue", "t")


# -- breaks and episodes ---------------------------------------------------------------


def _one_break_sql() -> str:
    """Least squares on a constant and x before and after each possible break, by running sums."""
    run = lambda e: f"sum({e}) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)"
    sums = {"n": "1.0e0", "x": "x", "y": "y", "xx": "x * x", "xy": "x * y", "yy": "y * y"}
    p = ", ".join(f"{run(e)} - ({e}) AS b_{k}, sum({e}) OVER () AS a_{k}" for k, e in sums.items())
    rss = lambda n, x, y, xx, xy, yy: f"({yy} - power({y}, 2) / {n} - power({xy} - {x} * {y} / {n}, 2) / ({xx} - power({x}, 2) / {n}))"
    before = rss(*[f"b_{k}" for k in sums])
    after = rss(*[f"(a_{k} - b_{k})" for k in sums])
    whole = rss(*[f"a_{k}" for k in sums])
    return (
        f"WITH o AS (SELECT t, disc AS x, revenue AS y FROM {{tsm}}), p AS (SELECT t, count(*) OVER () AS m, row_number() OVER (ORDER BY t) - 1 AS i, {p} FROM o), h AS (SELECT CAST(greatest(3, floor(0.15e0 * max(m))) AS INT) AS h FROM p), "
        f"c AS (SELECT t, {before} + {after} AS s FROM p CROSS JOIN h WHERE i >= h AND m - i >= h) "
        f"SELECT CAST(0 AS INT) AS breaks, {r(f'any_value({whole})', 4)} AS rss, '' AS dates FROM p UNION ALL SELECT CAST(1 AS INT), {r('s', 4)}, CAST(t AS VARCHAR) FROM (SELECT * FROM c ORDER BY s LIMIT 1)"
    )


@register("break_regression_one", _one_break_sql(), digits=4)
def _(t):
    return breaks.break_tests(t("tsm"), "revenue", ["disc"], "t", 1).select("breaks", "rss", "dates")


@register("break_regression_tests", digits=4)
def _(t):
    return breaks.break_tests(t("panel"), "y", ["x"], "t", 3, by="unit")


@register("break_regression_coefficients", digits=4)
def _(t):
    return breaks.break_coefficients(t("panel"), "y", ["x"], "t", 2, by="unit")


@register("bubble_tests", digits=4)
def _(t):
    return breaks.bubble_tests(t("gaps"), "y", "t", 12, replicates=200, by="unit")


@register("bubble_path", digits=4)
def _(t):
    return breaks.bubble_path(t("tsm"), "revenue", "t", 30, replicates=200)


@register("bubble_episodes", digits=4)
def _(t):
    return breaks.bubble_episodes(t("panel"), "y", "t", replicates=60, level=0.5, by="unit")


@register("identify_weighted_posterior", digits=4)
def _(t):
    return restricted.summary(restricted.draws(t("tsm"), _PAIR, "t", zeros=[("disc", "revenue", 0)], signs=[("revenue", "revenue", 0, 1)], horizon=6, draws=200))


@register("identify_weighted_estimate", digits=4)
def _(t):
    return restricted.summary(restricted.draws(t("tsm"), _FOUR, "t", zeros=[("disc", "revenue", 0)], signs=[("revenue", "revenue", 0, 1), ("qty", "revenue", 0, 1)], horizon=4, draws=200, posterior=False))


@register("identify_effective_draws", digits=4)
def _(t):
    return restricted.effective_draws(restricted.draws(t("tsm"), _PAIR, "t", zeros=[("disc", "revenue", 0)], signs=[("revenue", "revenue", 0, 1)], horizon=1, draws=300))


# -- state space by a parallel scan ------------------------------------------------------

_LEVEL = statespace.local_level(0.05, 0.01, 5.0, 1.0)


def _observed(t):
    """Monthly discounts, every seventh month unseen."""
    return t("tsm").select("t", F.when(F.col("t") % 7 != 0, F.col("disc")).alias("y"))


_KALMAN = """WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY t) AS i, t, CASE WHEN t % 7 <> 0 THEN disc END AS y FROM {tsm}),
f AS (SELECT i, t, CASE WHEN y IS NULL THEN 5.0e0 ELSE 5 + (y - 5) / 1.05e0 END AS m, CASE WHEN y IS NULL THEN 1.0e0 ELSE 1 - 1 / 1.05e0 END AS p, CASE WHEN y IS NULL THEN 0.0e0 ELSE -0.5 * (ln(2 * pi() * 1.05e0) + power(y - 5, 2) / 1.05e0) END AS ll FROM o WHERE i = 1
UNION ALL SELECT o.i, o.t, CASE WHEN y IS NULL THEN m ELSE m + (p + 0.01e0) / (p + 0.06e0) * (y - m) END, CASE WHEN y IS NULL THEN p + 0.01e0 ELSE (p + 0.01e0) * 0.05e0 / (p + 0.06e0) END, CASE WHEN y IS NULL THEN 0.0e0 ELSE -0.5 * (ln(2 * pi() * (p + 0.06e0)) + power(y - m, 2) / (p + 0.06e0)) END FROM f JOIN o ON o.i = f.i + 1)"""


@register("statespace_filtered", _KALMAN + f" SELECT t, CAST(0 AS INT) AS state, {r('m')} AS mean, {r('p')} AS variance FROM f")
def _(t):
    return statespace.filtered(_observed(t), ["y"], "t", _LEVEL)


@register("statespace_smoothed", _KALMAN + f", s AS (SELECT i, t, m, p FROM f WHERE i = (SELECT max(i) FROM o) UNION ALL SELECT f.i, f.t, f.m + f.p / (f.p + 0.01e0) * (s.m - f.m), f.p + power(f.p / (f.p + 0.01e0), 2) * (s.p - f.p - 0.01e0) FROM s JOIN f ON f.i = s.i - 1) SELECT t, CAST(0 AS INT) AS state, {r('m')} AS mean, {r('p')} AS variance FROM s")
def _(t):
    return statespace.smoothed(_observed(t), ["y"], "t", _LEVEL)


@register("statespace_log_likelihood", _KALMAN + f" SELECT {r('sum(ll)', 5)} AS log_likelihood FROM f", digits=5)
def _(t):
    v = statespace.Line(_observed(t), ["y"], "t").log_likelihoods([_LEVEL])[0]
    return describe.rows(t("tsm").sparkSession, [{"log_likelihood": float(v)}], "log_likelihood double")


@register("statespace_forecast", _KALMAN + f" SELECT CAST(h AS INT) AS horizon, 'y' AS variable, {r('m')} AS forecast, {r('sqrt(p + 0.01e0 * h + 0.05e0)')} AS std_error FROM f CROSS JOIN range(1, 5) q(h) WHERE i = (SELECT max(i) FROM o)")
def _(t):
    return statespace.forecast(_observed(t), ["y"], "t", _LEVEL, 4).drop("lower", "upper")


@register("statespace_estimate", digits=3)
def _(t):
    return statespace.estimate(_observed(t), ["y"], "t", lambda p: statespace.local_level(float(np.exp(p[0])), float(np.exp(p[1])), 5.0, 1.0), [-3.0, -4.0], ["log_var_error", "log_var_level"])[0].select("term", "estimate", "std_error")


# -- structural models -----------------------------------------------------------------


@register("structural_solvers")
def _(t):
    return structural_more.solver_table(t("tsm").sparkSession, _growth(t), _GUESS).drop("residual")


@register("structural_moments")
def _(t):
    return structural_more.moments_table(t("tsm").sparkSession, structural.Solution(_growth(t), _GUESS), 2)


@register("structural_second_order")
def _(t):
    return structural_more.second_order_table(t("tsm").sparkSession, structural_more.Second(_growth(t), _GUESS))


@register("structural_second_order_simulation")
def _(t):
    return structural_more.simulate_second(t("tsm").sparkSession, structural_more.Second(_growth(t), _GUESS), 50, 10)


@register("structural_generalised_impulse")
def _(t):
    m = structural_more.Second(_growth(t), _GUESS)
    return structural_more.generalised_impulse(t("tsm").sparkSession, m.path, m.model.variables, m.model.shocks, "e", 10, draws=40)


for _k in ("pfi", "collocation"):

    @register(f"structural_policy_{_k}", digits=4)
    def _(t, k=_k):
        return structural_more.policy_table(t("tsm").sparkSession, structural_more.Policy(_growth(t), _GUESS, method=k)).where("state <> 'euler_error'")


@register("structural_policy_simulation", digits=4)
def _(t):
    return structural_more.simulate_policy(t("tsm").sparkSession, structural_more.Policy(_growth(t), _GUESS), 40, 5)


_PRIORS = {"rho": ("beta", 0.5, 0.2), "s": ("gamma", 1.0, 0.5)}
_Y0 = {"y": 0.0}


def _draws(t):
    return structural.posterior(_scaled(t), _AR, _PRIORS, ["y"], draws=100, burn=100, chains=2, guess=_Y0)


@register("structural_smc", digits=2)
def _(t):
    d, ml = structural_more.sequential(_scaled(t), _AR, _PRIORS, ["y"], particles=48, guess=_Y0)
    return d.agg(F.avg("rho").alias("rho"), F.avg("s").alias("s")).withColumn("log_ml", F.lit(ml))


@register("structural_posterior_mode", digits=3)
def _(t):
    return structural_more.posterior_mode(_scaled(t), _AR, _PRIORS, ["y"], guess=_Y0)


@register("structural_bayes_factor", digits=2)
def _(t):
    d, draws = _scaled(t), _draws(t)
    a = structural_more.bridge(d, draws, _AR, _PRIORS, ["y"], proposals=60, guess=_Y0)
    b = structural.log_prior("normal", 0.0, 1.0, 0.0)
    return d.sparkSession.createDataFrame([("bridge_log_ml", float(a)), ("against_white_noise", float(a - d.count() * b))], "statistic string, value double")


@register("structural_chain_diagnostics", digits=2)
def _(t):
    return structural_more.chain_diagnostics(_draws(t), ["rho", "s"])


@register("structural_chain_acf", digits=3)
def _(t):
    return structural_more.chain_acf(_draws(t), "rho", 10)


@register("structural_trace", digits=4)
def _(t):
    return structural_more.trace(_draws(t), "rho")


@register("structural_prior_posterior", digits=3)
def _(t):
    return structural_more.prior_posterior(_draws(t), _PRIORS)


@register("structural_identification", digits=3)
def _(t):
    return structural_more.identification(t("tsm").sparkSession, _growth(t), ["alpha", "beta", "rho"], ["c", "k"], guess=_GUESS)


@register("structural_prior_predictive", digits=3)
def _(t):
    # The prior of the persistence is drawn about the table's own.
    return structural_more.prior_predictive(t("tsm").sparkSession, _AR, _PRIORS | {"rho": ("beta", _persistence(t), 0.1)}, ["y"], 20, 60, guess=_Y0)


@register("structural_predictive_check", digits=3)
def _(t):
    d = _scaled(t)
    draws = _draws(t).select(F.row_number().over(_by_draw()).alias("draw"), "rho", "s")
    return structural_more.predictive_check(d, structural_more.predictive(d.sparkSession, draws.withColumn("draw", F.col("draw").cast("long")), _AR, ["rho", "s"], ["y"], 80, guess=_Y0), ["y"])


def _by_draw():
    from pyspark.sql import Window

    return Window.orderBy("chain", "draw")  # a few hundred draws


@register("structural_posterior_irf", digits=3)
def _(t):
    return structural_more.posterior_impulse(_draws(t), _AR, ["rho", "s"], 6, guess=_Y0)


@register("structural_posterior_fevd", digits=3)
def _(t):
    return structural_more.posterior_impulse(_draws(t), _AR, ["rho", "s"], 6, True, _Y0)


@register("structural_learning_rate", digits=2)
def _(t):
    return structural_more.learning_rate(_scaled(t), _AR, _PRIORS, ["y"], guess=_Y0)


@register("structural_impulse_matching", digits=4)
def _(t):
    spark = t("tsm").sparkSession
    m = multivariate.fitted_system(_scaled(t), ["y"], "t", 1)
    target = m.irf(8)[:, :, 0]
    return structural_more.match_impulses(spark, _AR, target, "e", ["y"], ["rho", "s"], guess=_Y0)


@register("structural_particle_filter", digits=3)
def _(t):
    return structural_more.particle_filter(_scaled(t), structural.Solution(_AR, _Y0), ["y"], noise=0.05, particles=200)


@register("structural_particle_smoother", digits=3)
def _(t):
    return structural_more.particle_smoother(_scaled(t), structural_more.Second(_AR, _Y0), ["y"], noise=0.05, particles=100, back=20)


def _economy(t):
    e = structural.aiyagari(rho=_persistence(t), risk=_risk(t), states=3, points=80, top=60.0, tol=1e-5)
    return structural_more.Heterogeneous(e, horizon=40)


@register("heterogeneous_impulse", digits=4)
def _(t):
    return structural_more.heterogeneous_impulse(t("tsm").sparkSession, _economy(t))


@register("heterogeneous_inequality", digits=4)
def _(t):
    return structural_more.inequality_impulse(t("tsm").sparkSession, _economy(t))


@register("heterogeneous_distribution", digits=4)
def _(t):
    return structural_more.distribution_impulse(t("tsm").sparkSession, _economy(t), horizon=3)


@register("heterogeneous_simulation", digits=4)
def _(t):
    return structural_more.simulate_heterogeneous(t("tsm").sparkSession, _economy(t), 40, replicates=4)


@register("continuous_steady_state", digits=3)
def _(t):
    m = structural_more.Continuous(income=(1 - 2 * _risk(t), 1 + 2 * _risk(t)), points=50)
    return structural_more.continuous_table(t("tsm").sparkSession, m, m.steady())


@register("continuous_transition", digits=3)
def _(t):
    m = structural_more.Continuous(income=(1 - 2 * _risk(t), 1 + 2 * _risk(t)), points=40)
    return structural_more.continuous_transition(t("tsm").sparkSession, m, m.steady(), periods=16)


# -- results, examples ---------------------------------------------------------------------


@register("report")
def _(t):
    f = regression.ols(t("xs"), "y", ["q"], "hc1")
    return results.report_rows(t("xs").sparkSession, f.table(), "Least squares")


@register("accessors", f"SELECT 'const' AS term, {r('regr_intercept(y, q)')} AS estimate FROM {{xs}} UNION ALL SELECT 'q', {r('regr_slope(y, q)')} FROM {{xs}}")
def _(t):
    f = regression.ols(t("xs"), "y", ["q"], "ols")
    return results.accessor_table(t("xs").sparkSession, f.table(), f.dof).select("term", "estimate")


_COV = "WITH " + sqlkit.regression("SELECT y, q, d FROM {xs}", "y", ["1.0e0", "q", "d"])


@register("covariance_rows", _COV + " " + " UNION ALL ".join(f"SELECT '{a}' AS term, '{b}' AS other_term, {r(f'v{i}_{j} * rss / (n - 3)', 9)} AS value FROM fit" for i, a in enumerate(("const", "q", "d")) for j, b in enumerate(("const", "q", "d"))), digits=9)
def _(t):
    return results.covariance(regression.ols(t("xs"), "y", ["q", "d"], "ols").table())


_W = "(b1 * b1 * v2_2 - 2 * b1 * b2 * v1_2 + b2 * b2 * v1_1) / (v1_1 * v2_2 - v1_2 * v1_2) * (n - 3) / rss"


@register("wald_two_terms", _COV + f" SELECT 'both_zero' AS test, {r(_W, 3)} AS statistic, 2.0e0 AS df FROM fit UNION ALL SELECT 'equal', {r('power(b1 - b2, 2) / (v1_1 - 2 * v1_2 + v2_2) * (n - 3) / rss', 3)}, 1.0e0 FROM fit", digits=3)
def _(t):
    f = results.Result(regression.ols(t("xs"), "y", ["q", "d"], "ols").table())
    both, equal = f.wald([{"q": 1.0}, {"d": 1.0}]), f.wald([{"q": 1.0, "d": -1.0}])
    return describe.rows(t("xs").sparkSession, [{"test": k, "statistic": w["statistic"], "df": float(w["df"])} for k, w in (("both_zero", both), ("equal", equal))], "test string, statistic double, df double")


@register("delta_method", _COV + f" SELECT {r('b2 / b1')} AS estimate, {r('sqrt((v2_2 - 2 * b2 / b1 * v1_2 + power(b2 / b1, 2) * v1_1) * rss / (n - 3)) / abs(b1)')} AS std_error FROM fit")
def _(t):
    f = results.Result(regression.ols(t("xs"), "y", ["q", "d"], "ols").table()).delta(lambda b: b["d"] / b["q"])
    return describe.rows(t("xs").sparkSession, [{k: f[k] for k in ("estimate", "std_error")}], "estimate double, std_error double")


@register("uncertainty_bounds", digits=5)
def _(t):
    return results.uncertainty_bounds(regression.ols(t("xs"), "y", ["q"], "ols").table())


@register("wide_table", f"{_IRF} SELECT CAST(h AS INT) AS horizon, {r('t21')} AS value FROM i")
def _(t):
    from ..operators import multivariate

    return results.wide(multivariate.irf(t("tsm"), _PAIR, "t", 1, 8), "disc", "revenue")


@register("reproduce", "SELECT 'estimate' AS column, 0.0e0 AS gap, true AS same")
def _(t):
    make = lambda: regression.ols(t("xs"), "y", ["q"], "ols").table().select("term", "estimate")
    return results.reproduce(make, make(), ["term"])


# -- nonlinear series, more of input-output, accessors -------------------------------------


@register("threshold_linearity", digits=4)
def _(t):
    return nonlinear.threshold_linearity(t("tsm"), "disc", "t", replicates=19)


@register("threshold_forecast", digits=3)
def _(t):
    return nonlinear.threshold_forecast(t("tsm"), "disc", "t", paths=100)


_SM = "SELECT d AS y, x, x * x AS x2, x * x * x AS x3, x * x * x * x AS x4 FROM (SELECT d, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x FROM (SELECT disc AS d, lag(disc) OVER (ORDER BY t) AS x FROM {tsm}) WHERE x IS NOT NULL)"
_SMF = ", ".join(sqlkit.regression(_SM, "y", ["1.0e0", "x", "x2", "x3", "x4"][: 2 + j], f"s{j}") for j in range(4))


@register("smooth_linearity", f"WITH {_SMF}, f AS (SELECT 'lm3' AS test, (s0.rss - s3.rss) / 3 / (s3.rss / (s3.n - 5)) AS s, 3.0e0 AS a, s3.n - 5 AS b FROM s0, s3 UNION ALL SELECT 'h4', (s2.rss - s3.rss) / (s3.rss / (s3.n - 5)), 1.0e0, s3.n - 5 FROM s2, s3 UNION ALL SELECT 'h3', (s1.rss - s2.rss) / (s2.rss / (s2.n - 4)), 1.0e0, s2.n - 4 FROM s1, s2 UNION ALL SELECT 'h2', (s0.rss - s1.rss) / (s1.rss / (s1.n - 3)), 1.0e0, s1.n - 3 FROM s0, s1) SELECT test, {r('s', 3)} AS statistic, {r(sqlkit.f_sf('s', 'a', 'b'), 3)} AS p_value FROM f", digits=3)
def _(t):
    return nonlinear.smooth_linearity(t("tsm"), "disc", "t")


@register("smooth_forecast", digits=3)
def _(t):
    return nonlinear.smooth_forecast(t("tsm"), "disc", "t", paths=100)


@register("bandwidth_sheather_jones", digits=4)
def _(t):
    return nonlinear.bandwidth_sj(t("tsm"), "disc", "t")


@register("io_domar_weights", f"SELECT i, {r('x / (SELECT sum(value) * 0.5 FROM {sales})')} AS weight FROM {_X}")
def _(t):
    return _io(t).domar_weights()


@register("io_productivity")
def _(t):
    return _io(t).productivity(0.5, 0.9)


@register("io_extension_intensities", f"SELECT i, {r('value * 0.5 / x')} AS intensity FROM {{sales}} JOIN {_X} USING (i)")
def _(t):
    a = _io(t)
    use = a.extension(t("sales").select("i", (F.col("value") * 0.5).alias("value")))
    return a.vector(intensity=np.array([use[n] for n in a.names]))


@register("io_ghosh_inverse_identity", f"SELECT i, {r('x', 5)} AS x FROM {_X}", digits=5)
def _(t):
    a = _io(t)
    return a.vector(x=(a.x - a.Z.sum(0)) @ a.G)


@register("io_allocation_coefficients", f"SELECT f.i, f.j, {r('f.value / x')} AS value FROM {{flows}} f JOIN {_X} x ON x.i = f.i")
def _(t):
    a = _io(t)
    return a.matrix(a.B)


@register("structural_facts", "SELECT CAST(3 AS INT) AS variables, CAST(1 AS INT) AS shocks, CAST(3 AS INT) AS stable_roots, true AS determined, true AS stable, round(" + _RHO + ", 6) + 0.0 AS largest_root")
def _(t):
    return structural_more.solution_facts(t("tsm").sparkSession, structural.Solution(_growth(t), _GUESS))


@register("structural_particle_posterior", digits=2)
def _(t):
    return structural_more.particle_posterior(_scaled(t), _AR, _PRIORS, ["y"], draws=24, particles=60, guess=_Y0)
