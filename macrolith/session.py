"""Sessions with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "macrolith", cores: int | str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """For tests and benchmarks on one machine; a cluster brings its own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
