"""Helpers shared by the operators: table reading, scratch tables, names, text in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.session import materialize, ship_package

__all__ = ["table", "saved", "fresh", "workers", "text_or_empty", "slices", "ids_like", "null_safe_semi"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The frame written once as Parquet in the folder that ``spark.checkpoint.dir`` names, and read
    again: lineage ends there and a lost executor costs no more than its unread files."""
    return materialize(df)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def workers(df: DataFrame) -> DataFrame:
    """Makes this package importable in the Python workers that will read ``df``."""
    ship_package(df.sparkSession)
    return df


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def null_safe_semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``on`` values (null equals null) are rows of ``keys``; the columns stay."""
    k = keys.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)])
    cond = None
    for i, c in enumerate(on):
        e = df[c].eqNullSafe(k[f"__k{i}"])
        cond = e if cond is None else cond & e
    return df.join(k, cond, "left_semi")


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A string column (null: empty) in runs of whole rows with about ``most`` bytes (a longer text
    makes a run alone): first row, row after the last, bytes, offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        yield first, last, data[offs[first]:offs[last]], offs[first:last + 1] - offs[first]
        first = last


def ids_like(df: DataFrame, col: str) -> str:
    """The SQL type of an identifier column, for the schemas of Python stages."""
    return df.schema[col].dataType.simpleString()
