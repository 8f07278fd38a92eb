"""Derived inputs, written once in SQL that both engines read: ``{table}`` stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SHIP = "CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT)"
_ORDER = "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT)"

BASE = {
    "xs": "SELECT l_orderkey AS id, l_returnflag AS flag, l_linestatus AS status, l_extendedprice / 1e4 AS y, l_quantity / 10 AS q, l_discount * 10 AS d, l_tax * 10 AS tax FROM {lineitem}",
    "tsm": f"SELECT {_SHIP} AS t, sum(l_extendedprice) / 1e6 AS revenue, sum(l_quantity) / 1e4 AS qty, avg(l_discount) * 100 AS disc, avg(l_tax) * 100 AS tax FROM {{lineitem}} GROUP BY {_SHIP}",
    "panel": f"SELECT c_nationkey AS unit, {_ORDER} AS t, sum(o_totalprice) / 1e6 AS y, CAST(count(*) AS DOUBLE) / 10 AS x FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY c_nationkey, {_ORDER}",
    "gaps": f"SELECT o_orderpriority AS unit, {_ORDER} AS t, sum(o_totalprice) / 1e6 AS y FROM {{orders}} WHERE o_orderstatus = 'P' GROUP BY o_orderpriority, {_ORDER}",
    "did": "SELECT c_nationkey AS unit, CAST(year(o_orderdate) AS INT) AS t, sum(o_totalprice) / 1e6 AS y, CASE WHEN n_regionkey = 0 THEN 0 WHEN n_regionkey <= 2 THEN 1997 ELSE 1999 END AS first FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY c_nationkey, CAST(year(o_orderdate) AS INT), CASE WHEN n_regionkey = 0 THEN 0 WHEN n_regionkey <= 2 THEN 1997 ELSE 1999 END",
    "hours": "SELECT event_type AS kind, CAST((day(ts) - 1) * 24 + hour(ts) AS INT) AS t, avg(value) AS v, CAST(count(*) AS DOUBLE) AS n FROM {events} GROUP BY event_type, CAST((day(ts) - 1) * 24 + hour(ts) AS INT)",
    "flows": "SELECT s.n_regionkey AS i, c.n_regionkey AS j, sum(l_extendedprice) / 1e6 AS value FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} s ON s_nationkey = s.n_nationkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} c ON c_nationkey = c.n_nationkey GROUP BY s.n_regionkey, c.n_regionkey",
    "sales": "SELECT n_regionkey AS i, sum(l_extendedprice) / 1e6 AS value FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_regionkey",
    "bin": "SELECT documents.doc_id AS id, CAST(labels.quality AS DOUBLE) AS y, ln(documents.n_chars) AS x, CASE WHEN documents.lang = 'en' THEN 1.0e0 ELSE 0.0e0 END AS en FROM {documents} documents JOIN {labels} labels ON documents.doc_id = labels.doc_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = [t for t in TABLES if f"{{{t}}}" in BASE[name]]
    return spark.sql(BASE[name], **{t: table(spark, sf_dir, t) for t in used})


def sql(text: str) -> str:
    """For DuckDB: ``{name}`` of a derived input becomes its query, of a table its name."""
    plain = {k: "(" + v.format(**{t: t for t in TABLES}) + ")" for k, v in BASE.items()}
    return text.format(**plain, **{t: t for t in TABLES})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed scale, for comparison between engines; never a negative zero."""
    return df.select(*[(F.round(f"`{f.name}`", digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])
