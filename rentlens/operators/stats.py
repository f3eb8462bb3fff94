"""Grouped statistics over cleaned listings.

Group keys with a null value are dropped (pandas ``groupby`` semantics). Simple
aggregates (count/sum/avg/min/max/stddev) are partially aggregated before the
shuffle, so a city holding a third of all rows costs one small partial row per
task. Medians and percentiles go through ``functions.quantiles``: counts per value
first, so no group's values ever meet unaggregated in one task.

``value_counts`` reduces the listings to one table of counts, from which every median, benchmark, premium and
share can be read (``weight="n"``): one pass over the listings for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens import constants as C
from rentlens.functions.quantiles import quantiles


def _keys_not_null(df: DataFrame, keys: list[str]) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond)


def _with_quantiles(df: DataFrame, base: DataFrame, keys: list[str], value: str,
                    probs: dict[str, float], method: str, weight: str | None = None) -> DataFrame:
    q = quantiles(df, value, probs, keys, method=method, weight=weight)
    return base.join(q, keys, "left")


COUNT_KEYS = ["city", "bhk", "furnishing", "rent", "price_per_sqft"]


def value_counts(df: DataFrame, *more: str) -> DataFrame:
    """The listings as counts: one row per different (city, bhk, furnishing, rent, psf, ``more``), with ``n``."""
    return df.groupBy(*COUNT_KEYS, *more).agg(F.count(F.lit(1)).alias("n"))


def _count(weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count(F.lit(1))


def _avg(c: str, weight: str | None) -> Column:
    """The mean of the values that are not null."""
    return F.sum(F.col(c) * F.col(weight)) / F.sum(F.when(F.col(c).isNotNull(), F.col(weight))) if weight else F.avg(c)


def _std(c: str, weight: str | None) -> Column:
    """The sample standard deviation; of counted whole numbers (below 1e12, as their counts) from exact sums."""
    if not weight:
        return F.stddev_samp(c)
    x, w = F.col(c).cast("decimal(12,0)"), F.when(F.col(c).isNotNull(), F.col(weight)).cast("decimal(12,0)")
    n, first, second = F.sum(w), F.sum(x * w), F.sum(x * x * w)
    spread = (n.cast("decimal(12,0)") * second - first * first).cast("double")
    return F.when(n > 1, F.sqrt(spread / n.cast("double") / (n - 1).cast("double")))


def city_summary(df: DataFrame, method: str = "exact", weight: str | None = None) -> DataFrame:
    """A1: per city mean/median/min/max/sample-std of rent, mean psf, count; rounded
    to 0 decimals half-even (the single-row std stays null)."""
    d = _keys_not_null(df, ["city"])
    base = d.groupBy("city").agg(
        _avg("rent", weight).alias("avg_rent"), F.min("rent").alias("min_rent"),
        F.max("rent").alias("max_rent"), _std("rent", weight).alias("std_rent"),
        _avg("price_per_sqft", weight).alias("avg_psf"), _count(weight).alias("n_listings"))
    base = _with_quantiles(d, base, ["city"], "rent", {"median_rent": 0.5}, method, weight)
    return base.select(
        "city", F.bround("avg_rent", 0).alias("avg_rent"), F.bround("median_rent", 0).alias("median_rent"),
        "min_rent", "max_rent", F.bround("std_rent", 0).alias("std_rent"),
        F.bround("avg_psf", 0).alias("avg_psf"), "n_listings")


def city_stats(df: DataFrame) -> DataFrame:
    """A2: per city mean, min, max, sample std of rent, mean psf, count (unrounded)."""
    return _keys_not_null(df, ["city"]).groupBy("city").agg(
        F.avg("rent").alias("avg_rent"), F.min("rent").alias("min_rent"),
        F.max("rent").alias("max_rent"), F.stddev_samp("rent").alias("std_rent"),
        F.avg("price_per_sqft").alias("avg_psf"), F.count(F.lit(1)).alias("n_listings"))


def city_aggregate(df: DataFrame) -> DataFrame:
    """A3: per city mean and median rent, mean psf, count."""
    d = _keys_not_null(df, ["city"])
    base = d.groupBy("city").agg(F.avg("rent").alias("avg_rent"), F.avg("price_per_sqft").alias("avg_psf"),
                                 F.count(F.lit(1)).alias("n_listings"))
    return _with_quantiles(d, base, ["city"], "rent", {"median_rent": 0.5}, "exact").select(
        "city", "avg_rent", "median_rent", "avg_psf", "n_listings")


def city_medians(df: DataFrame, method: str = "exact", weight: str | None = None) -> DataFrame:
    """A4: median rent per city."""
    return quantiles(_keys_not_null(df, ["city"]), "rent", {"median_rent": 0.5}, ["city"], method, weight=weight)


def bhk_city_median(df: DataFrame, bhk_range=(1, 4), method: str = "exact", weight: str | None = None) -> DataFrame:
    """A5: median rent by (bhk, city) for bhk in range (the filter runs before the shuffle)."""
    d = _keys_not_null(df.filter(F.col("bhk").between(*bhk_range)), ["bhk", "city"])
    return quantiles(d, "rent", {"median_rent": 0.5}, ["bhk", "city"], method, weight=weight)


def bhk_city_mean(df: DataFrame, bhk_range=(1, 4)) -> DataFrame:
    """Mean rent and count by (bhk, city), filtered on bhk after grouping;
    Catalyst pushes that key filter below the aggregate."""
    agg = _keys_not_null(df, ["bhk", "city"]).groupBy("bhk", "city").agg(
        F.avg("rent").alias("avg_rent"), F.count(F.lit(1)).alias("n"))
    return agg.filter(F.col("bhk").between(*bhk_range))


def furnish_comparison(df: DataFrame, method: str = "exact", weight: str | None = None) -> DataFrame:
    """Median psf and count by (city, furnishing)."""
    keys = ["city", "furnishing"]
    d = _keys_not_null(df, keys)
    base = d.groupBy(*keys).agg(_count(weight).alias("n_rows"))
    return _with_quantiles(d, base, keys, "price_per_sqft", {"median_psf": 0.5}, method, weight).withColumnRenamed("n_rows", "n").select(
        *keys, "median_psf", "n")


def furnishing_stats(df: DataFrame) -> DataFrame:
    """Mean rent and mean psf by furnishing."""
    return _keys_not_null(df, ["furnishing"]).groupBy("furnishing").agg(
        F.avg("rent").alias("avg_rent"), F.avg("price_per_sqft").alias("avg_psf"))


def psf_threshold(df: DataFrame, q: float = C.DEMAND_QUANTILE, method: str = "exact", weight: str | None = None) -> DataFrame:
    """Global quantile of psf as a one-row DataFrame ``(psf_q)``."""
    return quantiles(df, "price_per_sqft", {"psf_q": q}, [], method, weight=weight)


def with_demand_label(df: DataFrame, q: float = C.DEMAND_QUANTILE, method: str = "exact",
                      label: str = "high_demand", weight: str | None = None) -> DataFrame:
    """1 when psf >= the global quantile. The one-row threshold is a scalar
    subquery: computed once, its value is shipped with the task — no join."""
    thr = psf_threshold(df, q, method, weight).select("psf_q").scalar()
    return df.withColumn(label, (F.col("price_per_sqft") >= thr).cast("int"))


def demand_heatmap(df: DataFrame, q: float = C.DEMAND_QUANTILE, method: str = "exact", weight: str | None = None) -> DataFrame:
    """Share of high-demand listings by (city, bhk)."""
    lab = with_demand_label(df, q, method, weight=weight)
    return _keys_not_null(lab, ["city", "bhk"]).groupBy("city", "bhk").agg(
        _avg("high_demand", weight).alias("demand_rate"))


def demand_pivot(heat: DataFrame, cities=C.CITIES, bhks=(1, 2, 3, 4)) -> DataFrame:
    """A10: city rows × bhk columns of demand % (×100), missing cells 0. The pivot
    values are given, so Spark does not run a distinct job to find them."""
    d = heat.filter(F.col("city").isin(list(cities)) & F.col("bhk").isin(list(bhks)))
    p = d.groupBy("city").pivot("bhk", list(bhks)).agg(F.first(F.col("demand_rate") * 100))
    return p.select("city", *[F.coalesce(F.col(str(b)), F.lit(0.0)).alias(f"bhk_{b}") for b in bhks])


def city_benchmarks(df: DataFrame, method: str = "exact", weight: str | None = None) -> DataFrame:
    """Per city rent p25/p50/p75/p90, psf p50/p75, count — the risk benchmarks."""
    d = _keys_not_null(df, ["city"])
    rent_probs = {"rent_p25": .25, "rent_p50": .5, "rent_p75": .75, "rent_p90": .9}
    base = d.groupBy("city").agg(_count(weight).alias("n_listings"))
    rq = quantiles(d, "rent", rent_probs, ["city"], method, weight=weight)
    pq = quantiles(d, "price_per_sqft", {"psf_p50": .5, "psf_p75": .75}, ["city"], method, weight=weight)
    return base.join(rq, "city").join(pq, "city").select("city", *rent_probs, "psf_p50", "psf_p75", "n_listings")


def bhk_city_medians_all(df: DataFrame, method: str = "exact", weight: str | None = None) -> DataFrame:
    """Median rent by (city, bhk), all bhk values."""
    d = _keys_not_null(df, ["city", "bhk"])
    return quantiles(d, "rent", {"median_rent": 0.5}, ["city", "bhk"], method, weight=weight)


def furnish_premiums(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Per city median rent of Furnished and Semi-Furnished over the
    Unfurnished median; only cities whose Unfurnished median exists and is > 0."""
    d = _keys_not_null(df, ["city", "furnishing"])
    q = quantiles(d, "rent", {"m": 0.5}, ["city", "furnishing"], weight=weight)  # one row per (city, furnishing)

    def of(kind):
        return F.max(F.when(F.col("furnishing") == kind, F.col("m")))
    m = q.groupBy("city").agg(of("Unfurnished").alias("_base"), of("Furnished").alias("_furn"),
                              of("Semi-Furnished").alias("_semi"))
    m = m.filter(F.col("_base").isNotNull() & (F.col("_base") > 0))
    return m.select("city", (F.col("_furn") / F.col("_base")).alias("furnished"),
                    (F.col("_semi") / F.col("_base")).alias("semi_furnished"),
                    F.lit(1.0).alias("unfurnished"))


def market_kpis(df: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Listings, mean of the (rounded) city mean rents, mean of city mean psf,
    and the city with the highest mean rent (ties: alphabetically first)."""
    cs = summary if summary is not None else city_summary(df)
    kp = cs.agg(F.avg("avg_rent").alias("mean_city_rent"), F.avg("avg_psf").alias("mean_city_psf"),
                F.min_by("city", F.struct((-F.col("avg_rent")).alias("r"), F.col("city"))).alias("top_city"))
    n = df.agg(F.count(F.lit(1))).scalar()
    return kp.select(n.alias("total_rows"), "mean_city_rent", "mean_city_psf", "top_city")


def selection_kpis(df: DataFrame) -> DataFrame:
    """Count, mean rent, mean psf, mean size of a (filtered) selection."""
    return df.agg(F.count(F.lit(1)).alias("n_listings"), F.avg("rent").alias("avg_rent"),
                  F.avg("price_per_sqft").alias("avg_psf"), F.avg("size").alias("avg_size"))


def rent_box_stats(df: DataFrame, cap: float = C.CHART_RENT_CAP, method: str = "exact") -> DataFrame:
    """Per city box statistics of rent below the chart cap: min, q1, median,
    q3, max, 1.5·IQR fences, whiskers (extreme values inside the fences) and the
    number of outliers. Quartiles are linear-interpolated."""
    d = _keys_not_null(df.filter(F.col("rent") < cap), ["city"])
    q = quantiles(d, "rent", {"q1": .25, "median": .5, "q3": .75}, ["city"], method)
    q = q.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    r = F.col("rent")
    inside = (r >= F.col("lower_fence")) & (r <= F.col("upper_fence"))
    stats = d.join(q, "city").groupBy("city").agg(
        F.min(r).alias("min_rent"), F.max(r).alias("max_rent"),
        F.min(F.when(inside, r)).alias("lower_whisker"), F.max(F.when(inside, r)).alias("upper_whisker"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return stats.join(q, "city")


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows per physical partition, without Python workers."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def chunk_of(n_chunks: int, key: str = "l_orderkey") -> Column:
    return F.pmod(F.col(key), F.lit(n_chunks)).cast("int")


def chunk_profile(df: DataFrame, n_chunks: int = 4, key: str = "l_orderkey", weight: str | None = None) -> DataFrame:
    """Profile of ``n_chunks`` chunks assigned by ``pmod(key, n)``: rows, mean
    rent (0 decimals), distinct cities. Every row lands in a chunk. Counted listings have the column ``chunk``."""
    return df.groupBy((F.col("chunk") if weight else chunk_of(n_chunks, key)).alias("chunk")).agg(
        _count(weight).alias("rows"), F.bround(_avg("rent", weight), 0).alias("avg_rent"),
        F.count_distinct("city").alias("cities"))


def city_share(df: DataFrame) -> DataFrame:
    """Listing count and share of the total per city. The total is a window
    over the already-aggregated city rows (one row per city)."""
    c = _keys_not_null(df, ["city"]).groupBy("city").agg(F.count(F.lit(1)).alias("n_listings"))
    return c.withColumn("share", F.col("n_listings") / F.sum("n_listings").over(Window.partitionBy()))


def top_localities(df: DataFrame, city: str | None = None, top_n: int = 10) -> DataFrame:
    """K2: top-n localities by mean rent, with count. With ``city`` it is the
    reference's single-city report; without, the same per city via a
    ``row_number`` over the aggregated (city, locality) rows. Ties by locality."""
    d = df if city is None else df.filter(F.col("city") == city)
    agg = _keys_not_null(d, ["city", "locality"]).groupBy("city", "locality").agg(
        F.avg("rent").alias("avg_rent"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("city").orderBy(F.col("avg_rent").desc(), F.col("locality"))
    return agg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
