"""Parquet table scans by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def exists(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether a directory has a table, as Spark's file systems see it."""
    if not name.replace("_", "").isalnum():
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(_path(sf_dir, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table below a directory; filters and columns are pushed into it by Catalyst."""
    return spark.read.parquet(_path(sf_dir, name))
