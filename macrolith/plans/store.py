"""Cut lineage in loops: rows go to the folder that driver and executors share and are read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder of our own where that is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[.*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="macrolith-")
        sc.setCheckpointDir(root)
    return root


class Kept:
    """Rows written below the shared folder; drop() deletes them when nothing reads them any more."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{shared_root(df.sparkSession).rstrip('/')}/loop-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    return Kept(df).rows
