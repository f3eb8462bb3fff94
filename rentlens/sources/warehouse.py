"""Co-located storage for the big join of the listings view.

Writing ``lineitem`` and ``orders`` as catalog tables bucketed (and sorted) by the
order key with the same bucket count lets Spark plan lineitem ⋈ orders as a
sort-merge join without an exchange on either side: the 100 TB shuffle of the
view happens once, at write time, instead of in every query. ``part`` is
bucketed by its key for the second join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rentlens.sources import listings as L
from rentlens.sources.tables import table

BUCKET_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey"}


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def bucket_tables(spark: SparkSession, sf_dir: str, buckets: int, prefix: str = "rl_") -> dict[str, str]:
    """Write the three view inputs as bucketed catalog tables; returns their names."""
    cols = {"lineitem": L.LINEITEM_COLS, "orders": L.ORDERS_COLS, "part": L.PART_COLS}
    names = {}
    for t, key in BUCKET_KEYS.items():
        names[t] = f"{prefix}{t}"
        write_bucketed(table(spark, sf_dir, t, *cols[t]), names[t], key, buckets)
    return names


def listings_from_catalog(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """The listings view over bucketed catalog tables."""
    return L.listings_view(spark.table(names["lineitem"]), spark.table(names["orders"]),
                           spark.table(names["part"]))
