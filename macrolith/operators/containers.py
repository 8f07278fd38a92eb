"""Time series, panel and cross-section containers: a DataFrame with its keys and metadata. All changes give new objects."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FREQUENCIES = ("daily", "monthly", "quarterly", "yearly", "mixed", "other")


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def as_double(c: str) -> Column:
    """NaN is the missing value of the containers; it is NULL in every DataFrame here."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x).alias(c)


@dataclass(frozen=True)
class Data:
    df: DataFrame
    variables: tuple[str, ...]
    desc: str = ""
    vardesc: dict[str, str] = field(default_factory=dict)
    frequency: str = "other"
    tcodes: dict[str, int] = field(default_factory=dict)

    @property
    def nvars(self) -> int:
        return len(self.variables)

    def set_desc(self, text: str):
        return dataclasses.replace(self, desc=text)

    def set_vardesc(self, name: str, text: str):
        if name not in self.variables:
            raise KeyError(f"no variable {name}")
        return dataclasses.replace(self, vardesc=self.vardesc | {name: text})

    def rename(self, names: dict[str, str]):
        if missing := set(names) - set(self.variables):
            raise KeyError(f"no variable {sorted(missing)}")
        new = {v: names.get(v, v) for v in self.variables}
        if len(set(new.values())) < len(new):
            raise ValueError("names must differ")
        return dataclasses.replace(self, df=self.df.withColumnsRenamed(names), variables=tuple(new.values()), vardesc={new[k]: v for k, v in self.vardesc.items()}, tcodes={new[k]: v for k, v in self.tcodes.items()})

    def select(self, *names: str):
        keys = [c for c in self.df.columns if c not in self.variables]
        if missing := set(names) - set(self.variables):
            raise KeyError(f"no variable {sorted(missing)}")
        return dataclasses.replace(self, df=self.df.select(*keys, *names), variables=tuple(names), vardesc={k: v for k, v in self.vardesc.items() if k in names}, tcodes={k: v for k, v in self.tcodes.items() if k in names})

    def where(self, condition: Column | str):
        return dataclasses.replace(self, df=self.df.where(condition))

    def to_vector(self, name: str | None = None) -> DataFrame:
        if name is None and self.nvars != 1:
            raise ValueError("name the variable")
        return self.df.select(name or self.variables[0])

    def to_arrays(self) -> DataFrame:
        """Keys and one array column, the Spark form of a matrix."""
        keys = [c for c in self.df.columns if c not in self.variables]
        return self.df.select(*keys, F.array(*self.variables).alias("x"))

    def validate_for(self, kind: str) -> None:
        """Vector models need two variables, univariate ones exactly one."""
        many = {"var", "vecm", "bvar", "factor", "dfm", "favar", "gdfm"}
        one = {"arima", "garch", "egarch", "gjr", "sv", "ar", "ma", "arma"}
        if kind in many and self.nvars < 2:
            raise ValueError(f"{kind} needs at least two variables")
        if kind in one and self.nvars != 1:
            raise ValueError(f"{kind} needs exactly one variable")
        if kind not in many | one:
            raise ValueError(f"model {kind} is not known")


@dataclass(frozen=True)
class TimeSeries(Data):
    time: str = "t"

    def set_time_index(self, by: Column):
        return dataclasses.replace(self, df=self.df.withColumn(self.time, by))

    def set_dates(self, by: Column, name: str = "date"):
        """Labels of the times, a column beside them."""
        return dataclasses.replace(self, df=self.df.withColumn(name, by.cast("string")))

    def dates(self, name: str = "date") -> DataFrame:
        """Times and their labels; no rows if there are none."""
        return self.df.select(self.time, name) if name in self.df.columns else self.df.select(self.time, F.lit(None).cast("string").alias(name)).limit(0)


@dataclass(frozen=True)
class CrossSection(Data):
    obs: str = "obs_id"

    def set_obs_id(self, by: Column):
        return dataclasses.replace(self, df=self.df.withColumn(self.obs, by))


@dataclass(frozen=True)
class Panel(Data):
    unit: str = "unit"
    time: str = "t"
    cohort: str | None = None

    def groups(self) -> DataFrame:
        return self.df.select(self.unit).distinct()

    def ngroups(self) -> int:
        return self.groups().count()

    def counts(self) -> DataFrame:
        return self.df.groupBy(self.unit).agg(F.count("*").alias("n"), F.min(self.time).alias("first_t"), F.max(self.time).alias("last_t"))

    def is_balanced(self) -> bool:
        """Equal counts; the dates may differ."""
        return self.counts().select(F.count_distinct("n")).first()[0] <= 1

    def summary(self) -> DataFrame:
        return self.counts().agg(F.count("*").alias("groups"), F.min("n").alias("min_obs"), F.avg("n").alias("mean_obs"), F.max("n").alias("max_obs"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), (F.count_distinct("n") <= 1).alias("balanced"))

    def group_data(self, value) -> TimeSeries:
        return TimeSeries(self.df.where(F.col(self.unit) == F.lit(value)).drop(self.unit), self.variables, self.desc, self.vardesc, self.frequency, self.tcodes, self.time)


def time_series(df: DataFrame, time: str = "t", **options) -> TimeSeries:
    names = tuple(numeric_columns(df, (time,)))
    return TimeSeries(df.select(time, *[as_double(c) for c in names]), names, time=time, **options)


def cross_section(df: DataFrame, obs: str = "obs_id", **options) -> CrossSection:
    names = tuple(numeric_columns(df, (obs,)))
    return CrossSection(df.select(obs, *[as_double(c) for c in names]), names, obs=obs, **options)


def xtset(df: DataFrame, unit: str, time: str, cohort: str | None = None, check: bool = True, **options) -> Panel:
    """Numeric columns with unit and time; a (unit, time) pair may occur once. A time that is no integer becomes its dense rank."""
    keys = (unit, time) + ((cohort,) if cohort else ())
    names = tuple(numeric_columns(df, keys))
    out = df.select(*keys, *[as_double(c) for c in names])
    if not isinstance(df.schema[time].dataType, T.IntegralType):
        # Ranks of the distinct times only, which are few; joined back by value.
        ranks = out.select(time).distinct().withColumn("_rank", F.dense_rank().over(Window.orderBy(time)))
        out = out.join(ranks, time).withColumn(time, F.col("_rank")).drop("_rank").select(*keys, *names)
    if check and out.groupBy(unit, time).count().where("count > 1").limit(1).count():
        raise ValueError("a (unit, time) pair occurs more than once")
    return Panel(out, names, unit=unit, time=time, cohort=cohort, **options)
