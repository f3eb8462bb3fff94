"""Dimension lookups (J1–J4) as left joins.

* J1 city constants: a fixed 6-row literal table — proven tiny, so it is
  broadcast explicitly.
* J2–J4 benchmarks derived from the data (one row per city or per city×bhk): left joins of the aggregate, which is
  written first. Its size is known when the join is planned, so it is broadcast while it is under Spark's byte threshold
  and the listings side is not shuffled (adaptive execution would measure it beside a shuffle of the listings); above
  it the join is a sort-merge join whose hot city is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens import constants as C
from rentlens.session import materialize


def city_constants(spark: SparkSession) -> DataFrame:
    rows = [(c, float(C.CITY_INCOME[c]), float(C.CITY_APPRECIATION[c]), float(C.CITY_SUPPLY[c]))
            for c in C.CITIES]
    return spark.createDataFrame(rows, "city string, income double, appreciation double, supply double")


def with_city_constants(df: DataFrame) -> DataFrame:
    """Income, appreciation and supply index by city, defaults for others."""
    k = city_constants(df.sparkSession).withColumnRenamed("city", "_cc_city")
    j = df.join(F.broadcast(k), df["city"] == k["_cc_city"], "left").drop("_cc_city")
    return j.withColumns({
        "income": F.coalesce(F.col("income"), F.lit(float(C.DEFAULT_INCOME))),
        "appreciation": F.coalesce(F.col("appreciation"), F.lit(C.DEFAULT_APPRECIATION)),
        "supply": F.coalesce(F.col("supply"), F.lit(C.DEFAULT_SUPPLY)),
    })


def with_benchmarks(df: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """City benchmark columns (null when the city has none); ``has_bench`` flags presence."""
    b = materialize(benchmarks.select(F.col("city").alias("_b_city"), "rent_p25", "rent_p50", "rent_p75",
                                      "rent_p90", "psf_p50", "psf_p75",
                                      F.col("n_listings").alias("city_count")))
    j = df.join(b, df["city"] == b["_b_city"], "left")
    return j.withColumn("has_bench", F.col("_b_city").isNotNull()).drop("_b_city")


def with_bhk_median(df: DataFrame, bhk_medians: DataFrame) -> DataFrame:
    """(city, bhk) median rent."""
    m = materialize(bhk_medians.select(F.col("city").alias("_m_city"), F.col("bhk").alias("_m_bhk"),
                                       F.col("median_rent").alias("bhk_median")))
    j = df.join(m, (df["city"] == m["_m_city"]) & (df["bhk"] == m["_m_bhk"]), "left")
    return j.drop("_m_city", "_m_bhk")


def with_city_median(df: DataFrame, medians: DataFrame, default: float = C.PREDICT_FALLBACK_MEDIAN,
                     out: str = "city_median") -> DataFrame:
    """City median rent, ``default`` when the city has none."""
    m = materialize(medians.select(F.col("city").alias("_cm_city"), F.col("median_rent").alias("_cm")))
    j = df.join(m, df["city"] == m["_cm_city"], "left").drop("_cm_city")
    return j.withColumn(out, F.coalesce(F.col("_cm"), F.lit(float(default)))).drop("_cm")
