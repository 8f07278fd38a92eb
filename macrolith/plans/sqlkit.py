"""SQL text for DuckDB that solves small regressions, to compare the library's estimators with: normal equations by elimination, one step a CTE."""

from __future__ import annotations


def regression(source: str, y: str, x: list[str], name: str = "fit", weight: str = "1.0e0", by: str = "") -> str:
    """CTEs that end in ``name`` with b0.. (coefficients of x in order), v{i}_{j} (inverse of X'X), rss, tss and n. source is a SELECT with the columns; write 1.0e0 for a constant. by: one regression for each of its values."""
    k = len(x)
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    cols = ", ".join([f"({e}) AS x{i}" for i, e in enumerate(x)] + [f"({y}) AS y", f"({weight}) AS w"])
    terms = [f"sum(w * x{i} * x{j}) AS a{i}_{j}" for i in range(k) for j in range(k)] + [f"sum(w * x{i} * y) AS a{i}_{k}" for i in range(k)]
    terms += [f"{'1.0e0' if i == j else '0.0e0'} AS a{i}_{k + 1 + j}" for i in range(k) for j in range(k)]
    out = [f"{name}_x AS (SELECT {key}{cols} FROM ({source}))", f"{name}_0 AS (SELECT {key}{', '.join(terms)}, sum(w * y * y) AS yy, sum(w * y) AS sy, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'sum(w * x{i} * y) AS xy{i}' for i in range(k))} FROM {name}_x{group})"]
    width = 2 * k + 1
    keep = key + ", ".join(["yy", "sy", "n", *[f"xy{i}" for i in range(k)]])
    for p in range(k):
        cells = []
        for i in range(k):
            for c in range(width):
                cells.append(f"a{p}_{c} / a{p}_{p} AS a{i}_{c}" if i == p else f"a{i}_{c} - a{i}_{p} * a{p}_{c} / a{p}_{p} AS a{i}_{c}")
        out.append(f"{name}_{p + 1} AS (SELECT {', '.join(cells)}, {keep} FROM {name}_{p})")
    rss = " - ".join(["yy", *[f"a{i}_{k} * xy{i}" for i in range(k)]])
    b = ", ".join(f"a{i}_{k} AS b{i}" for i in range(k))
    v = ", ".join(f"a{i}_{k + 1 + j} AS v{i}_{j}" for i in range(k) for j in range(k))
    out.append(f"{name} AS (SELECT {key}{b}, {v}, {rss} AS rss, yy - sy * sy / n AS tss, n FROM {name}_{k})")
    return ",\n".join(out)


def inverse(source: str, n: int, name: str = "inv") -> str:
    """CTEs that end in ``name`` with one row m{i}_{j}, the inverse of the matrix of source (i, j, a), i and j from 0."""
    cells = [f"coalesce(sum(CASE WHEN i = {i} AND j = {j} THEN a END), 0) AS a{i}_{j}" for i in range(n) for j in range(n)] + [f"{'1.0e0' if i == j else '0.0e0'} AS a{i}_{n + j}" for i in range(n) for j in range(n)]
    out = [f"{name}_0 AS (SELECT {', '.join(cells)} FROM ({source}))"]
    for p in range(n):
        out.append(f"{name}_{p + 1} AS (SELECT " + ", ".join(f"a{p}_{c} / a{p}_{p} AS a{i}_{c}" if i == p else f"a{i}_{c} - a{i}_{p} * a{p}_{c} / a{p}_{p} AS a{i}_{c}" for i in range(n) for c in range(2 * n)) + f" FROM {name}_{p})")
    out.append(f"{name} AS (SELECT " + ", ".join(f"a{i}_{n + j} AS m{i}_{j}" for i in range(n) for j in range(n)) + f" FROM {name}_{n})")
    return ",\n".join(out)


_TERMS = "range(0, 300) q(term_)"


def normal_cdf(e: str) -> str:
    """By its series about zero; arguments up to 12."""
    z = f"least(12.0e0, abs({e}))"
    half = f"(SELECT exp(-power({z}, 2) / 2) / sqrt(2 * pi()) * sum(exp((2 * term_ + 1) * ln(greatest({z}, 1e-300)) - (term_ + 1) * ln(2.0e0) - lgamma(term_ + 1.5e0) + 0.5e0 * ln(pi()))) FROM {_TERMS})"
    return f"(0.5e0 + sign({e}) * {half})"


def normal_two_sided(e: str) -> str:
    return f"(2 * (1 - {normal_cdf(f'abs({e})')}))"


def chi2_sf(e: str, df: str) -> str:
    """1 less the series of the regularised gamma function."""
    return f"(1 - (SELECT sum(exp((({df}) / 2.0e0 + term_) * ln(greatest(({e}) / 2, 1e-300)) - ({e}) / 2 - lgamma(({df}) / 2.0e0 + term_ + 1))) FROM {_TERMS}))"


def beta_i(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta by its series, for small x."""
    return f"(SELECT sum(exp(lgamma(({a}) + ({b}) + term_) - lgamma({b}) - lgamma(({a}) + 1 + term_) + (({a}) + term_) * ln(greatest({x}, 1e-300)) + ({b}) * ln(1 - ({x})))) FROM {_TERMS})"


def t_two_sided(t: str, df: str) -> str:
    x = f"(power({t}, 2) / (({df}) + power({t}, 2)))"
    # Beyond 12 there is nothing left within the digits compared, and the series would need more terms.
    return f"(CASE WHEN abs({t}) > 12 THEN 0.0e0 ELSE 1 - {beta_i('0.5e0', f'({df}) / 2', x)} END)"


def f_sf(f: str, d1: str, d2: str) -> str:
    x = f"(({d1}) * ({f}) / (({d2}) + ({d1}) * ({f})))"
    return f"(1 - {beta_i(f'({d1}) / 2.0e0', f'({d2}) / 2.0e0', x)})"


def t_975(df: str) -> str:
    """The 97.5 % quantile of t, by its expansion for many degrees of freedom."""
    z = 1.959963984540054
    g1, g2, g3 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return f"({z!r}e0 + {g1!r}e0 / ({df}) + {g2!r}e0 / power({df}, 2) + {g3!r}e0 / power({df}, 3) + {g4!r}e0 / power({df}, 4))"


def r(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0"


def var1(source: str, a: str, b: str, order: str = "t") -> str:
    """CTEs of a two-variable autoregression of one lag with constant: va and vb as regression(), then v1 with one row: c1, c2, a11.. a22, residual covariances s11, s12, s22 over n rows."""
    lagged = f"SELECT {a} AS p, {b} AS q, lag({a}) OVER (ORDER BY {order}) AS p1, lag({b}) OVER (ORDER BY {order}) AS q1 FROM ({source}) QUALIFY row_number() OVER (ORDER BY {order}) > 1"
    x = ["1.0e0", "p1", "q1"]
    resid = f"v1 AS (SELECT any_value(va.b0) AS c1, any_value(vb.b0) AS c2, any_value(va.b1) AS a11, any_value(va.b2) AS a12, any_value(vb.b1) AS a21, any_value(vb.b2) AS a22, avg(power(p - va.b0 - va.b1 * p1 - va.b2 * q1, 2)) AS s11, avg((p - va.b0 - va.b1 * p1 - va.b2 * q1) * (q - vb.b0 - vb.b1 * p1 - vb.b2 * q1)) AS s12, avg(power(q - vb.b0 - vb.b1 * p1 - vb.b2 * q1, 2)) AS s22, any_value(va.n) AS n FROM ({lagged}) CROSS JOIN va CROSS JOIN vb)"
    return ",\n".join([regression(lagged, "p", x, "va"), regression(lagged, "q", x, "vb"), resid])
