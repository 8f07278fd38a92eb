"""Results as text, markup or pictures; accessors that read any tidy coefficient table; a manifest of a run; numerical guards; logging.

Tables are small by nature: a row a term, horizon or statistic. What is shown
takes at most ``MOST`` rows to the driver.
"""

from __future__ import annotations

import contextlib
import contextvars
import html
import json
import logging
import math
import platform
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from .describe import rows

MOST = 10_000
BACKENDS = ("text", "latex", "html", "markdown")
_backend: contextvars.ContextVar[str] = contextvars.ContextVar("backend", default="text")
log = logging.getLogger("macrolith")


# -- display ------------------------------------------------------------------------


def set_display_backend(name: str) -> None:
    if name not in BACKENDS:
        raise ValueError(f"display {name} is not known")
    _backend.set(name)


def get_display_backend() -> str:
    return _backend.get()


@contextlib.contextmanager
def display_backend(name: str) -> Iterator[None]:
    """The backend inside a with block only."""
    before = get_display_backend()
    set_display_backend(name)
    try:
        yield
    finally:
        _backend.set(before)


def _cells(table: DataFrame, digits: int) -> tuple[list[str], list[list[str]]]:
    got = table.limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"a table that is shown has {MOST} rows at most")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return table.columns, [[show(v) for v in r] for r in got]


def print_table(table: DataFrame, title: str = "", digits: int = 4, backend: str | None = None) -> str:
    """The rows in the backend's form."""
    names, cells = _cells(table, digits)
    kind = backend or get_display_backend()
    if kind == "html":
        row = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in r) + "</tr>"
        return (f"<h3>{html.escape(title)}</h3>" if title else "") + "<table>" + row(names, "th") + "".join(row(r, "td") for r in cells) + "</table>"
    if kind == "latex":
        safe = lambda c: c.replace("\\", "\\textbackslash{}").replace("_", "\\_").replace("%", "\\%").replace("&", "\\&")
        lines = [" & ".join(map(safe, r)) + r" \\" for r in [names, *cells]]
        return "\n".join([r"\begin{tabular}{" + "l" + "r" * (len(names) - 1) + "}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}"])
    if kind == "markdown":
        return "\n".join(["| " + " | ".join(r) + " |" for r in [names, ["-"] * len(names), *cells]])
    width = [max(len(r[i]) for r in [names, *cells]) for i in range(len(names))]
    line = lambda r: "  ".join(c.ljust(w) if not i else c.rjust(w) for i, (c, w) in enumerate(zip(r, width, strict=True))).rstrip()
    return "\n".join([*([title, "=" * len(title)] if title else []), line(names), "-" * (sum(width) + 2 * len(width) - 2), *map(line, cells)])


def report(table: DataFrame, title: str = "Estimates", notes: dict[str, object] | None = None, digits: int = 4) -> str:
    """A titled table; coefficient tables get marks of significance; notes follow as lines."""
    t = table
    if {"estimate", "p_value"} <= set(t.columns):
        t = t.withColumn("mark", F.when(F.col("p_value") < 0.01, "***").when(F.col("p_value") < 0.05, "**").when(F.col("p_value") < 0.1, "*").otherwise(""))
    return "\n".join([print_table(t, title, digits), *[f"{k}: {v}" for k, v in (notes or {}).items()]])


def wide(cube: DataFrame, variable: str, shock: str, horizons: list[int] | None = None) -> DataFrame:
    """One variable's response to one shock, a row a horizon with whatever bands the cube has."""
    d = cube.where((F.col("variable") == variable) & (F.col("shock") == shock))
    if horizons:
        d = d.where(F.col("horizon").isin(horizons))
    return d.drop("variable", "shock").orderBy("horizon")


def report_rows(spark: SparkSession, table: DataFrame, title: str = "Estimates") -> DataFrame:
    """line, text of a report."""
    return rows(spark, [{"line": i, "text": s} for i, s in enumerate(report(table, title).split("\n"))], "line int, text string")


# -- pictures -----------------------------------------------------------------------


def plot(table: DataFrame, x: str, y: str, group: str | None = None, lower: str | None = None, upper: str | None = None, title: str = "", size: tuple[int, int] = (640, 360)) -> str:
    """A page of its own with one line a group and its band, as scalable vector graphics."""
    cols = [x, y, *([group] if group else []), *([lower, upper] if lower and upper else [])]
    got = table.select(*cols).limit(MOST).toPandas()
    w, h, m = *size, 44
    lo, hi = (got[[lower, upper]].min().min(), got[[lower, upper]].max().max()) if lower and upper else (got[y].min(), got[y].max())
    lo, hi = float(min(lo, 0)), float(max(hi, 0))
    hi = hi if hi > lo else lo + 1
    x0, x1 = float(got[x].min()), float(got[x].max())
    px = lambda v: m + (float(v) - x0) / ((x1 - x0) or 1) * (w - 2 * m)
    py = lambda v: h - m - (float(v) - lo) / (hi - lo) * (h - 2 * m)
    inks = ("#1b6ca8", "#c8553d", "#3c896d", "#7a5195", "#b58900", "#546a76")
    parts = [f'<line x1="{m}" x2="{w - m}" y1="{py(0):.1f}" y2="{py(0):.1f}" stroke="#999"/>']
    groups = list(got.groupby(group)) if group else [("", got)]
    for k, (name, g) in enumerate(groups):
        g = g.sort_values(x)
        ink = inks[k % len(inks)]
        if lower and upper:
            ring = [f"{px(a):.1f},{py(b):.1f}" for a, b in zip(g[x], g[upper], strict=True)] + [f"{px(a):.1f},{py(b):.1f}" for a, b in zip(g[x][::-1], g[lower][::-1], strict=True)]
            parts.append(f'<polygon points="{" ".join(ring)}" fill="{ink}" opacity="0.15"/>')
        line = " ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in zip(g[x], g[y], strict=True))
        parts.append(f'<polyline points="{line}" fill="none" stroke="{ink}" stroke-width="1.6"/><text x="{w - m + 4}" y="{14 * k + m}" font-size="11" fill="{ink}">{html.escape(str(name))}</text>')
    ticks = "".join(f'<text x="4" y="{py(v):.1f}" font-size="10">{v:.3g}</text>' for v in np.linspace(lo, hi, 5)) + "".join(f'<text x="{px(v):.1f}" y="{h - m + 16}" font-size="10">{v:.3g}</text>' for v in np.linspace(x0, x1, 5))
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h3>{html.escape(title)}</h3><svg width="{w}" height="{h}" xmlns="http://www.w3.org/2000/svg">{"".join(parts)}{ticks}</svg>'


def save_plot(page: str, path: str) -> None:
    """Writes a page to a file on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)


# -- references ----------------------------------------------------------------------

#: Publications behind methods of the library: key, authors, year, title, where.
REFERENCES = {
    "hodrick_prescott": ("Hodrick, R. and Prescott, E.", 1997, "Postwar U.S. Business Cycles", "Journal of Money, Credit and Banking 29"),
    "hamilton_filter": ("Hamilton, J.", 2018, "Why You Should Never Use the Hodrick-Prescott Filter", "Review of Economics and Statistics 100"),
    "baxter_king": ("Baxter, M. and King, R.", 1999, "Measuring Business Cycles", "Review of Economics and Statistics 81"),
    "sims": ("Sims, C.", 1980, "Macroeconomics and Reality", "Econometrica 48"),
    "jorda": ("Jorda, O.", 2005, "Estimation and Inference of Impulse Responses by Local Projections", "American Economic Review 95"),
    "johansen": ("Johansen, S.", 1991, "Estimation and Hypothesis Testing of Cointegration Vectors", "Econometrica 59"),
    "newey_west": ("Newey, W. and West, K.", 1987, "A Simple, Positive Semi-Definite, Heteroskedasticity and Autocorrelation Consistent Covariance Matrix", "Econometrica 55"),
    "bai_ng": ("Bai, J. and Ng, S.", 2002, "Determining the Number of Factors in Approximate Factor Models", "Econometrica 70"),
    "garch": ("Bollerslev, T.", 1986, "Generalized Autoregressive Conditional Heteroskedasticity", "Journal of Econometrics 31"),
    "callaway_santanna": ("Callaway, B. and Sant'Anna, P.", 2021, "Difference-in-Differences with Multiple Time Periods", "Journal of Econometrics 225"),
    "sun_abraham": ("Sun, L. and Abraham, S.", 2021, "Estimating Dynamic Treatment Effects in Event Studies", "Journal of Econometrics 225"),
    "arellano_bond": ("Arellano, M. and Bond, S.", 1991, "Some Tests of Specification for Panel Data", "Review of Economic Studies 58"),
    "sequence_space": ("Auclert, A., Bardoczy, B., Rognlie, M. and Straub, L.", 2021, "Using the Sequence-Space Jacobian", "Econometrica 89"),
    "leontief": ("Leontief, W.", 1936, "Quantitative Input and Output Relations in the Economic Systems of the United States", "Review of Economics and Statistics 18"),
}


def refs(keys: list[str], form: str = "text") -> str:
    """Text, bibtex, latex or html."""
    out = []
    for k in keys:
        who, year, title, where = REFERENCES[k]
        out.append({"text": f"{who} ({year}). {title}. {where}.", "bibtex": f"@article{{{k},\n  author = {{{who}}},\n  year = {{{year}}},\n  title = {{{title}}},\n  journal = {{{where}}}\n}}", "latex": f"\\bibitem{{{k}}} {who} ({year}). \\emph{{{title}}}. {where}.", "html": f"<p>{html.escape(who)} ({year}). <i>{html.escape(title)}</i>. {html.escape(where)}.</p>"}[form])
    return "\n".join(out)


# -- accessors ----------------------------------------------------------------------


def covariance(table: DataFrame) -> DataFrame:
    """term, other_term, value: a row a pair of a coefficient table's terms."""
    known = _carried(table, "estimate")
    if not known:
        raise ValueError("the table's estimates carry no covariance")
    return rows(table.sparkSession, [{"term": a, "other_term": b, "value": v} for (a, b), v in known.items()], "term string, other_term string, value double")


def _carried(table: DataFrame, value: str) -> dict[tuple[str, str], float | None]:
    told = json.loads(table.schema[value].metadata.get("covariance", "{}")) if value in table.columns else {}
    return {(a, b): v for a, r in zip(told.get("terms", []), told.get("values", []), strict=True) for b, v in zip(told["terms"], r, strict=True)}


class Result:
    """Any tidy table of terms and estimates, read as a fitted model: one for all estimators whose results are such rows.

    covariance: rows (term, other_term, value); by default what the table's
    estimates carry. Without it only the errors are known.
    """

    def __init__(self, table: DataFrame, key: str = "term", value: str = "estimate", error: str = "std_error", dof: float | None = None, nobs: int | None = None, linear: bool = True, covariance: DataFrame | None = None):
        if {key, value} - set(table.columns):
            raise ValueError(f"the table needs {key} and {value}")
        self.table, self.key, self.value, self.error, self._dof, self._nobs, self._linear = table, key, value, error, dof, nobs, linear
        keep = [key, value] + ([error] if error in table.columns else [])
        got = table.select(*keep).limit(MOST).collect()
        self._v = {str(r[0]): r[1] for r in got}
        self._e = {str(r[0]): r[2] for r in got} if error in table.columns else {}
        if covariance is not None:
            self._c = {(str(r[0]), str(r[1])): r[2] for r in covariance.select("term", "other_term", "value").limit(MOST * 100).collect()}
        else:
            self._c = _carried(table, value)

    #: Rows that are not parameters.
    SUMMARY = ("loglik", "aic", "bic", "hqic", "r2", "n", "j", "j_p", "scale", "persistence", "halflife", "unconditional_variance", "arch_order", "garch_order")

    def coef(self) -> dict[str, float]:
        return {k: v for k, v in self._v.items() if k not in self.SUMMARY}

    def stderror(self) -> dict[str, float]:
        return {k: self._e.get(k) for k in self.coef()}

    def vcov(self) -> np.ndarray:
        """Covariance of all terms; where only errors are known, what lies off the diagonal is NaN."""
        e = self.stderror()
        own = lambda a, b: self._c.get((a, b), float(e[a]) ** 2 if a == b and e[a] is not None else None)
        return np.array([[math.nan if (v := own(a, b)) is None else v for b in e] for a in e], float).reshape(len(e), len(e))

    def _rows(self, weights: list[dict[str, float]]) -> np.ndarray:
        terms = list(self.coef())
        if unknown := {k for w in weights for k in w} - set(terms):
            raise ValueError(f"no terms {sorted(unknown)}")
        return np.array([[w.get(t, 0.0) for t in terms] for w in weights])

    def _spread(self, g: np.ndarray) -> np.ndarray:
        """g V g' over the terms that g uses."""
        used = np.flatnonzero(np.abs(g).max(0) > 0)
        v = g[:, used] @ self.vcov()[np.ix_(used, used)] @ g[:, used].T
        if not np.isfinite(v).all():
            raise ValueError("the covariance of these terms is not known")
        return v

    def combination(self, weights: dict[str, float], value: float = 0.0) -> dict[str, float]:
        """A weighted sum of terms: estimate, std_error, stat and p_value against a value."""
        g = self._rows([weights])
        b = float((g @ np.array([float(x) for x in self.coef().values()]))[0])
        return self._told(b, math.sqrt(max(0.0, float(self._spread(g)[0, 0]))), value)

    def _told(self, b: float, se: float, value: float) -> dict[str, float]:
        z = (b - value) / se if se > 0 else math.nan
        p = dist.t_two_sided(z, self._dof) if self._dof else 2 * (1 - dist.norm_cdf(abs(z)))
        return {"estimate": b, "std_error": se, "stat": z, "p_value": float(p)}

    def wald(self, restrictions: list[dict[str, float]], values: list[float] | None = None) -> dict[str, float]:
        """Do all weighted sums have their values (zero by default): statistic, df, p_value by chi-square."""
        g = self._rows(restrictions)
        d = g @ np.array([float(x) for x in self.coef().values()]) - np.array(values if values is not None else [0.0] * len(g))
        v = self._spread(g)
        df = int(np.linalg.matrix_rank(v))
        s = float(d @ np.linalg.pinv(v) @ d)
        return {"statistic": s, "df": df, "p_value": float(dist.chi2_sf(max(s, 0.0), df))}

    def delta(self, f: Callable[[dict[str, float]], float], value: float = 0.0, step: float = 1e-3) -> dict[str, float]:
        """A smooth function of the terms: estimate, std_error, stat and p_value, by central differences of fourth order."""
        b = {k: float(v) for k, v in self.coef().items()}
        g = np.zeros((1, len(b)))
        for i, (k, v) in enumerate(b.items()):
            h = step * (abs(v) or 1.0)
            g[0, i] = (8 * (f(b | {k: v + h}) - f(b | {k: v - h})) - f(b | {k: v + 2 * h}) + f(b | {k: v - 2 * h})) / (12 * h)
        return self._told(float(f(b)), math.sqrt(max(0.0, float(self._spread(g)[0, 0]))), value)

    def confint(self, level: float = 0.95) -> dict[str, tuple[float, float]]:
        z = dist.t_ppf(0.5 + level / 2, self._dof) if self._dof else dist.norm_ppf(0.5 + level / 2)
        return {k: (v - z * self._e[k], v + z * self._e[k]) for k, v in self.coef().items() if self._e.get(k) is not None}

    def dof(self) -> int:
        return len(self.coef())

    def nobs(self) -> int | None:
        return self._nobs if self._nobs is not None else (int(self._v["n"]) if "n" in self._v else None)

    def dof_residual(self) -> int | None:
        return None if self.nobs() is None else self.nobs() - self.dof()

    def _summary(self, name: str) -> float:
        if name not in self._v:
            raise ValueError(f"the table has no {name}")
        return float(self._v[name])

    loglikelihood = property(lambda self: self._summary("loglik"))
    aic = property(lambda self: self._summary("aic"))
    bic = property(lambda self: self._summary("bic"))
    r2 = property(lambda self: self._summary("r2"))

    def islinear(self) -> bool:
        return self._linear

    def predict(self, df: DataFrame, name: str = "fitted") -> DataFrame:
        """Sum of terms that are columns, and the constant."""
        out = F.lit(float(self._v.get("const", 0.0)))
        for k, v in self.coef().items():
            if k in df.columns:
                out = out + float(v) * F.col(k)
        return df.withColumn(name, out)

    def residuals(self, df: DataFrame, y: str) -> DataFrame:
        return self.predict(df, "_fit").withColumn("residual", F.col(y) - F.col("_fit")).drop("_fit")


class Forecast:
    """Rows of horizon, forecast and bands."""

    def __init__(self, table: DataFrame):
        self.table = table

    def point_forecast(self) -> DataFrame:
        return self.table.select(*[c for c in self.table.columns if c not in ("lower", "upper", "std_error")])

    def lower_bound(self) -> DataFrame:
        return self.table.drop("forecast", "upper", "std_error")

    def upper_bound(self) -> DataFrame:
        return self.table.drop("forecast", "lower", "std_error")

    def horizon(self) -> int:
        return int(self.table.agg(F.max("horizon")).first()[0])


def point_estimate(table: DataFrame) -> DataFrame:
    """The value column alone beside the keys."""
    return table.select(*[c for c in table.columns if c not in ("lower", "upper", "std_error", "ci_lower", "ci_upper", "stat", "p_value")])


def has_uncertainty(table: DataFrame) -> bool:
    return bool({"lower", "upper"} <= set(table.columns) or {"ci_lower", "ci_upper"} <= set(table.columns) or "std_error" in table.columns)


def uncertainty_bounds(table: DataFrame, level: float = 0.95) -> DataFrame:
    """lower and upper: those of the table, or normal ones about the value."""
    if {"lower", "upper"} <= set(table.columns):
        return table
    if {"ci_lower", "ci_upper"} <= set(table.columns):
        return table.withColumnsRenamed({"ci_lower": "lower", "ci_upper": "upper"})
    if "std_error" not in table.columns:
        raise ValueError("the table has neither bands nor errors")
    v = next(c for c in ("estimate", "value", "forecast", "att") if c in table.columns)
    z = dist.norm_ppf(0.5 + level / 2)
    return table.withColumns({"lower": F.col(v) - z * F.col("std_error"), "upper": F.col(v) + z * F.col("std_error")})


#: Estimators by name, for fit().
_FITS: dict[str, Callable[..., DataFrame]] = {}


def register_fit(name: str, f: Callable[..., DataFrame]) -> None:
    _FITS[name] = f


def fit(kind: str, *args, **options) -> DataFrame:
    """The estimator registered under a name."""
    if kind not in _FITS:
        raise ValueError(f"{kind} is not known; there are {', '.join(sorted(_FITS))}")
    return _FITS[kind](*args, **options)


def accessor_table(spark: SparkSession, table: DataFrame, dof: float | None = None) -> DataFrame:
    """term, estimate, std_error, lower, upper through the accessors."""
    r = Result(table, dof=dof)
    ci = r.confint()
    return rows(spark, [{"term": k, "estimate": float(v), "std_error": r.stderror()[k], "lower": ci.get(k, (None, None))[0], "upper": ci.get(k, (None, None))[1]} for k, v in r.coef().items()], "term string, estimate double, std_error double, lower double, upper double")


# -- reproducibility, guards ----------------------------------------------------------


def capture_manifest(spark: SparkSession, seed: int | None = None, **settings: object) -> dict:
    """What a run depends on."""
    git = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return {"seed": seed, "settings": settings, "python": platform.python_version(), "numpy": np.__version__, "spark": spark.version, "pyspark": pyspark.__version__, "parallelism": spark.sparkContext.defaultParallelism, "commit": git.stdout.strip() or None}


def manifest_table(spark: SparkSession, seed: int | None = None, **settings: object) -> DataFrame:
    return rows(spark, [{"key": k, "value": json.dumps(v)} for k, v in capture_manifest(spark, seed, **settings).items()], "key string, value string")


def reproduce(make: Callable[[], DataFrame], stored: DataFrame, keys: list[str], tol: float = 1e-8) -> DataFrame:
    """column, gap, same: a result made again and compared with the stored one, column by column."""
    again = make()
    nums = [f.name for f in again.schema if f.name not in keys and f.dataType.typeName() in ("double", "float", "integer", "long")]
    j = again.select(*keys, *[F.col(c).cast("double").alias(f"_a_{c}") for c in nums]).join(stored.select(*keys, *[F.col(c).cast("double").alias(f"_b_{c}") for c in nums]), keys, "full")
    gap = lambda c: F.max(F.when(F.col(f"_a_{c}").isNull() & F.col(f"_b_{c}").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")), F.lit(float("inf")))))
    return j.agg(F.array(*[F.struct(F.lit(c).alias("column"), gap(c).alias("gap")) for c in nums]).alias("v")).select(F.inline("v")).withColumn("same", F.col("gap") <= tol)


def default_abstol(single: bool = False) -> float:
    return 1e-5 if single else 1e-8


def default_reltol(single: bool = False) -> float:
    return math.sqrt(np.finfo(np.float32 if single else np.float64).eps)


def safe_cholesky(a: np.ndarray, jitter: float = 1e-10, most: int = 12) -> tuple[np.ndarray, float]:
    """The factor, with as little added to the diagonal as makes it exist, and what was added."""
    scale = float(np.mean(np.abs(np.diag(a)))) or 1.0
    add = 0.0
    for k in range(most):
        try:
            return np.linalg.cholesky(a + add * np.eye(len(a))), add
        except np.linalg.LinAlgError:
            add = jitter * scale * 10**k
            log.warning("a matrix is not positive definite; %g is added to its diagonal", add)
    raise ValueError("no jitter makes the matrix positive definite")


def set_log_level(level: str | int) -> None:
    log.setLevel(level)


@contextlib.contextmanager
def log_level(level: str | int) -> Iterator[None]:
    before = log.level
    log.setLevel(level)
    try:
        yield
    finally:
        log.setLevel(before)
