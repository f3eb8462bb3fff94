"""Prediction log (S5–S8): an append-only parquet table.

Records carry the logged prediction fields, the P9 vector of the request (with
bathrooms = max(1, bhk − 1) and floor "1 out of 3", as the reference logs it), a
UTC timestamp and a deterministic id (SHA-256 of the request key and its time),
so a replayed batch produces the same ids and the stream can de-duplicate them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions.features import add_vectors
from rentlens.functions.text import py_round

RECORD_COLS = ["user_id", "city", "bhk", "size", "furnishing", "predicted_rent", "demand_risk",
               "risk_probability", "price_per_sqft"]


def prediction_records(scored: DataFrame, key_cols: list[str], ts, user_id: str | None = None) -> DataFrame:
    """S5 record shape from scored listings (M8 output or ``pricing.rent_band``).

    ``ts`` is the request's time (a column, or a literal for a whole batch) and comes from the data, not the
    clock; the id is the SHA-256 of the request key and that time, so a recomputed partition or a replayed
    batch yields the same ids."""
    when = (ts if isinstance(ts, Column) else F.lit(ts)).cast("timestamp")
    req = scored.select(
        (F.col(user_id).cast("string") if user_id else F.lit(None).cast("string")).alias("user_id"),
        "city", "bhk", "size", "furnishing", "predicted_rent", "demand_risk",
        py_round(F.col("risk_probability"), 3).alias("risk_probability"),
        "price_per_sqft",
        F.greatest(F.col("bhk") - 1, F.lit(1)).alias("bathroom"),
        F.lit("1 out of 3").alias("floor_txt"), F.lit(None).cast("string").alias("area_type"),
        F.lit(None).cast("string").alias("tenant"), when.alias("timestamp"),
        F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols],
                           F.date_format(when, "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256).alias("id"))
    return add_vectors(req, keep=RECORD_COLS + ["timestamp", "id"]).select(*RECORD_COLS, "vector", "timestamp", "id")


def append(records: DataFrame, path: str) -> None:
    """Append a batch to the log table."""
    records.write.mode("append").option("compression", "zstd").parquet(path)  # ids are hexadecimal digits: half the bytes


def recent(log: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` records (timestamp desc, id) — a top-k, planned as
    TakeOrderedAndProject (per-task top-n, then a merge of n·tasks rows)."""
    return log.orderBy(F.col("timestamp").desc(), F.col("id")).limit(n)


def count(log: DataFrame) -> DataFrame:
    """S7."""
    return log.agg(F.count(F.lit(1)).alias("prediction_count"))


def health(vectors: DataFrame, log: DataFrame, status: str = "table") -> DataFrame:
    """Vector count, prediction count, status — one aggregate per table."""
    v = vectors.agg(F.count(F.lit(1)).alias("listings_vectors"))
    return v.select(F.lit(status).alias("status"), "listings_vectors",
                    log.agg(F.count(F.lit(1))).scalar().alias("predictions_stored"))
