"""Files: input-output tables in delimited text or archives, tidy CSV, stored models, digests."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def read_table(spark: SparkSession, path: str, sectors: int, demand: int = 1, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """A headerless table: the first columns are Z, the next final demand. Returns (i, j, value) and (i, value)."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return _split(lines.select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("k")), sectors, demand, delimiter)


def _split(lines: DataFrame, sectors: int, demand: int, delimiter: str) -> tuple[DataFrame, DataFrame]:
    cells = lines.select("k", F.posexplode(F.split("line", "\\Q" + delimiter + "\\E")).alias("j", "value")).withColumn("value", F.col("value").cast("double"))
    # Lines are numbered in file order; a table has as many lines as sectors.
    order = {r.k: n for n, r in enumerate(lines.select("k").orderBy("k").limit(sectors).collect())}
    number = F.create_map(*[F.lit(x) for k, n in order.items() for x in (k, n)])
    cells = cells.where(F.col("k").isin(list(order))).withColumn("i", number[F.col("k")])
    return cells.where(F.col("j") < sectors).select("i", "j", "value"), cells.where((F.col("j") >= sectors) & (F.col("j") < sectors + demand)).groupBy("i").agg(F.sum("value").alias("value"))


def read_archive(spark: SparkSession, path: str, sectors: int, demand: int = 1, delimiter: str = ",", member: str = "", most: int = 1_000_000_000) -> tuple[DataFrame, DataFrame]:
    """As read_table, from the first csv, tsv or txt (or the named) member of a zip file."""

    def lines(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf.content:
                z = zipfile.ZipFile(io.BytesIO(raw))
                names = [n for n in z.infolist() if n.filename == member or (not member and n.filename.lower().endswith((".csv", ".tsv", ".txt")))]
                if not names or names[0].file_size > most:
                    raise ValueError("no such member, or it is too large")
                text = z.read(names[0]).decode().splitlines()
                yield pd.DataFrame({"line": text, "k": range(len(text))})[lambda d: d.line.str.strip() != ""]

    return _split(spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "line string, k long"), sectors, demand, delimiter)


def digest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    """Header, empty cells for missing values; as many files as partitions."""
    df.write.option("header", True).option("nullValue", "").option("emptyValue", '""').mode("overwrite").csv(path)


def save_model(table: DataFrame, path: str, kind: str, meta: dict | None = None) -> None:
    """A tidy table with a format version, a kind and further values."""
    table.withColumn("_model", F.lit(json.dumps({"format": FORMAT, "kind": kind, "meta": meta or {}}))).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, dict]:
    df = spark.read.parquet(path)
    head = json.loads(df.select("_model").first()[0])
    if head["format"] != FORMAT or head["kind"] != kind:
        raise ValueError(f"{path} holds {head['kind']} in format {head['format']}")
    return df.drop("_model"), head["meta"]


def melt(df: DataFrame, keys: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(keys, [c for c in df.columns if c not in keys], name, value)
