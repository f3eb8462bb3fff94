"""Readers for the parquet tables. Each reader names the columns it needs so the
scan's ReadSchema is pruned before any plan is built on top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def file_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of every entry of the tables' folder, through the file system that Spark reads it with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((e.getPath().getName(), e.getLen(), e.getModificationTime()) for e in entries))
