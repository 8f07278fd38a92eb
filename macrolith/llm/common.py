"""What the training-data operators share: batches of bounded size, the shared folder, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and a Python worker, and rows that a Parquet scan decodes at once.
BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 1024, 8 << 20, 1024
#: Bytes of a row group of stored rows, which its writer holds.
ROW_GROUP = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Very long texts must not make an Arrow batch outgrow a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="macrolith-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: short lineage, and lost executors lose nothing."""
    return reread(df, keep(df, name))


def keep(df: DataFrame, name: str) -> str:
    """Writes the rows below the shared folder and returns the path."""
    path = shared_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return path


def reread(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what keep() wrote, when nothing reads it any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that other columns can't clash with those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def by_batch(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def keep_rows(df: DataFrame, judge: Callable[[], Callable[[list[str | None]], list[bool]]], text: str = "text") -> DataFrame:
    """The rows, in all their columns, whose text the function that judge() makes (once a task) keeps."""
    k = df.columns.index(text)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = judge()
        for b in batches:
            yield b.filter(pa.array(f(b.column(k).to_pylist()), pa.bool_()))

    bounded_batches(df.sparkSession)
    return df.mapInArrow(go, df.schema)
