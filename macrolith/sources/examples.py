"""Example data in the library's own forms: files with [metadata], [variables], [descriptions] and [data], read as tidy rows, and a few small built-in series.

A file's arrays are one a variable; panels stack units over years. NaN stays NaN.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Annual flow of the Nile at Aswan, 1871-1970 (Cobb, 1978).
NILE = (1120, 1160, 963, 1210, 1160, 1160, 813, 1230, 1370, 1140, 995, 935, 1110, 994, 1020, 960, 1180, 799, 958, 1140, 1100, 1210, 1150, 1250, 1260, 1220, 1030, 1100, 774, 840, 874, 694, 940, 833, 701, 916, 692, 1020, 1050, 969, 831, 726, 456, 824, 702, 1120, 1100, 832, 764, 821, 768, 845, 864, 862, 698, 845, 744, 796, 1040, 759, 781, 865, 845, 944, 984, 897, 822, 1010, 771, 676, 649, 846, 812, 742, 801, 1040, 860, 874, 848, 890, 744, 749, 838, 1050, 918, 986, 797, 923, 975, 815, 1020, 906, 901, 1170, 912, 746, 919, 718, 714, 740)
#: Ammonia plant, 21 days (Brownlee, 1965): air flow, water temperature, acid concentration, stack loss.
STACKLOSS = ((80, 27, 89, 42), (80, 27, 88, 37), (75, 25, 90, 37), (62, 24, 87, 28), (62, 22, 87, 18), (62, 23, 87, 18), (62, 24, 93, 19), (62, 24, 93, 20), (58, 23, 87, 15), (58, 18, 80, 14), (58, 18, 89, 14), (58, 17, 88, 13), (58, 18, 82, 11), (58, 19, 93, 12), (50, 18, 89, 8), (50, 18, 86, 7), (50, 19, 72, 8), (50, 19, 79, 8), (50, 20, 80, 9), (56, 20, 82, 15), (70, 20, 91, 15))

CATALOGUE = {"nile": "time series", "stackloss": "cross-section", "two_sectors": "input-output"}


def load_example(spark: SparkSession, name: str) -> DataFrame:
    if name == "nile":
        return spark.createDataFrame([(1871 + k, float(v)) for k, v in enumerate(NILE)], "t int, nile double")
    if name == "stackloss":
        return spark.createDataFrame([(k + 1, *map(float, r)) for k, r in enumerate(STACKLOSS)], "id int, air_flow double, water_temp double, acid_conc double, stack_loss double")
    if name == "two_sectors":
        return spark.createDataFrame([("Z", 0, 0, 150.0), ("Z", 0, 1, 500.0), ("Z", 1, 0, 200.0), ("Z", 1, 1, 100.0), ("Y", 0, 0, 350.0), ("Y", 1, 0, 1700.0)], "part string, i int, j int, value double")
    raise ValueError(f"example {name} is not known; there are {', '.join(sorted(CATALOGUE))}")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A file of one of the four kinds as tidy rows; the kind is told by its sections."""
    with open(path, "rb") as f:
        d = tomllib.load(f)
    if "Z" in d.get("data", {}):
        return input_output(spark, d)
    if "countries" in d:
        return panel(spark, d)
    return cross_section(spark, d) if "obs_id" in d.get("metadata", {}) or d.get("metadata", {}).get("kind") == "crosssection" else time_series(spark, d)


def _columns(d: dict) -> tuple[list[str], list[list[float]]]:
    names = d["variables"]["names"]
    return names, [[float(v) for v in d["data"][n]] for n in names]


def time_series(spark: SparkSession, d: dict) -> DataFrame:
    names, cols = _columns(d)
    schema = T.StructType([T.StructField("t", T.IntegerType()), *[T.StructField(n, T.DoubleType(), True, {"desc": d.get("descriptions", {}).get(n, "")}) for n in names]])
    return spark.createDataFrame([(k, *r) for k, r in enumerate(zip(*cols, strict=True), 1)], schema)


def cross_section(spark: SparkSession, d: dict) -> DataFrame:
    return time_series(spark, d).withColumnRenamed("t", "obs_id")


def panel(spark: SparkSession, d: dict) -> DataFrame:
    names, cols = _columns(d)
    units, years = d["countries"]["names"], d["metadata"]["years"]
    n = len(years)
    got = [(units[k // n], int(years[k % n]), *r) for k, r in enumerate(zip(*cols, strict=True))]
    return spark.createDataFrame(got, "unit string, t int, " + ", ".join(f"`{c}` double" for c in names))


def input_output(spark: SparkSession, d: dict) -> DataFrame:
    """part, i, j, value."""
    out = [(part, i, j, float(v)) for part, m in d["data"].items() for i, r in enumerate(m) for j, v in enumerate(r if isinstance(r, list) else [r])]
    return spark.createDataFrame(out, "part string, i int, j int, value double")


#: Public databases of input-output tables: name, version, whether an account is needed.
SOURCES = (("oecd", "v2023", False), ("wiod", "2013", False), ("exiobase3", "3", False), ("eora26", "26", True), ("gloria", "latest", False))


def list_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "source string, version string, needs_account boolean")
