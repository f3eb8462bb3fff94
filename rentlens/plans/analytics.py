"""Analytics bundles (A20, A21): named DataFrames over one cleaned frame, and the same as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.operators import stats as ST
from rentlens.session import materialize
from rentlens.sources import listings as L


def full_analytics(df: DataFrame, shared: str | None = "table", n_chunks: int = 4) -> dict[str, DataFrame]:
    """City summary, bhk × city medians, city × furnishing psf medians, demand heatmap, chunk profile, total
    rows and the city list, all read from one table of counts: the listings are scanned once. The table is written
    into the shared checkpoint folder (``shared``: see ``session.materialize``; None leaves it a plan)."""
    counts = ST.value_counts(df.withColumn("chunk", ST.chunk_of(n_chunks)), "chunk")
    c = materialize(counts, shared) if shared else counts
    return {
        "city_summary": ST.city_summary(c, weight="n"),
        "bhk_matrix": ST.bhk_city_median(c, weight="n"),
        "furnish_comparison": ST.furnish_comparison(c, weight="n"),
        "demand_heatmap": ST.demand_heatmap(c, weight="n"),
        "partitions": ST.chunk_profile(c, n_chunks, weight="n"),
        "total_rows": c.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_rows")),
        "cities": L.cities(c),
    }


def spark_aggregations(df: DataFrame, shared: str | None = None) -> dict[str, DataFrame]:
    """City stats, bhk × city means (bhk 1–4), furnishing stats, rows per
    physical partition and the total."""
    d = materialize(df, shared) if shared else df
    return {
        "city_stats": ST.city_stats(d),
        "bhk_stats": ST.bhk_city_mean(d),
        "furnish_stats": ST.furnishing_stats(d),
        "partition_sizes": ST.partition_rows(d),
        "total_rows": L.total_rows(d),
    }


#: The columns that name a row of each part; the others are its numbers.
BUNDLE_KEYS = {"city_summary": ["city"], "bhk_matrix": ["city", "bhk"], "furnish_comparison": ["city", "furnishing"],
               "demand_heatmap": ["city", "bhk"], "partitions": ["chunk"], "total_rows": [], "cities": ["city"],
               "city_stats": ["city"], "bhk_stats": ["city", "bhk"], "furnish_stats": ["furnishing"], "partition_sizes": []}


def long_table(parts: dict[str, DataFrame]) -> DataFrame:
    """A bundle as rows (part, key, metric, value): keys joined by ``|``, a null one as nothing. The city list has the
    metric ``present``; the sizes of physical partitions, whose numbers mean nothing, are added up."""
    out = None
    for name, part in parts.items():
        if name == "cities":
            part = part.withColumn("present", F.lit(1))
        if name == "partition_sizes":
            part = part.agg(F.sum("rows").alias("rows"))
        keys = BUNDLE_KEYS[name]
        numbers = [c for c in part.columns if c not in keys]
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
        rows = part.select(F.lit(name).alias("part"), key.alias("key"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])))
        out = rows if out is None else out.unionByName(rows)
    return out
