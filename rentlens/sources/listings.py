"""Listings: the one fact table every operator reads.

Two ways in:
  * ``read_listings_csv`` — the application's own CSV (header, declared schema, no
    ``inferSchema`` pass), renamed to snake_case;
  * ``listings_from_tables`` — the listings view over the driver's parquet tables
    (lineitem ⋈ orders ⋈ part), used by every registered query.

``clean`` is S1/S2: price per sqft, drop basements, keep psf in [2, 500].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens import constants as C
from rentlens.sources.tables import table

KEY_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
LISTING_COLS = ["city", "locality", "bhk", "size", "bathroom", "rent",
                "furnishing", "floor_txt", "area_type", "tenant"]

CSV_SCHEMA = T.StructType([
    T.StructField("Posted On", T.StringType()),
    T.StructField("BHK", T.IntegerType()),
    T.StructField("Rent", T.LongType()),
    T.StructField("Size", T.IntegerType()),
    T.StructField("Floor", T.StringType()),
    T.StructField("Area Type", T.StringType()),
    T.StructField("Area Locality", T.StringType()),
    T.StructField("City", T.StringType()),
    T.StructField("Furnishing Status", T.StringType()),
    T.StructField("Tenant Preferred", T.StringType()),
    T.StructField("Bathroom", T.IntegerType()),
    T.StructField("Point of Contact", T.StringType()),
])
CSV_RENAMES = {
    "City": "city", "Area Locality": "locality", "BHK": "bhk", "Size": "size",
    "Bathroom": "bathroom", "Rent": "rent", "Furnishing Status": "furnishing",
    "Floor": "floor_txt", "Area Type": "area_type", "Tenant Preferred": "tenant",
}

# Listings view over the driver tables: fixed derivation rules (FIXTURES.md §2).
VIEW_CITIES = C.CITIES + ["Pune"]  # position = o_custkey % 7; Pune is the unknown category


def read_listings_csv(spark: SparkSession, path: str,
                      schema: T.StructType = CSV_SCHEMA) -> DataFrame:
    """S1 scan: CSV with header and a declared schema, columns renamed."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)
    return df.select([F.col(f"`{src}`").alias(dst) for src, dst in CSV_RENAMES.items()])


CORRUPT = "_corrupt"


def csv_lines(spark: SparkSession, path: str, schema: T.StructType = CSV_SCHEMA) -> DataFrame:
    """Every record of CSV files with a header, parsed one line each: file, line (from 1, the header's), text, the parsed
    columns under their own names, and ``_corrupt``, the text where it does not fit the schema. Lines are numbered
    from counts of lines per piece of a file: no file passes through one task."""
    at = F.monotonically_increasing_id()  # lines of a piece are neighbours in one task
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                       at.alias("at"))
    pieces = raw.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("at").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    lines = raw.join(pieces, ["file", "start"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1)
    lines = lines.filter((F.col("line") > 1) & (F.trim("value") != ""))
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields),
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select("file", "line", "value", parsed.alias("_r")).select("file", "line", F.col("value").alias("text"), "_r.*")


def read_listings_checked(spark: SparkSession, path: str, schema: T.StructType = CSV_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """S1 scan with a rejects channel: (listings with the library's names, rejects: file, line, text)."""
    lines = csv_lines(spark, path, schema)
    good = lines.filter(F.col(CORRUPT).isNull()).select([F.col(f"`{src}`").alias(dst) for src, dst in CSV_RENAMES.items()])
    return good, lines.filter(F.col(CORRUPT).isNotNull()).select("file", "line", "text")


def checked_report(listings: DataFrame, rejects: DataFrame) -> DataFrame:
    """S1's report with rejects: rows, rejects, cities, and rows left after cleaning."""
    n = listings.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("city").alias("cities"))
    return n.select("rows", rejects.agg(F.count(F.lit(1))).scalar().alias("rejects"), "cities",
                    clean(listings).agg(F.count(F.lit(1))).scalar().alias("clean_rows"))


def _pick(values: list[str], index: Column) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(index == i, F.lit(v)) if out is None else out.when(index == i, F.lit(v))
    return out


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_returnflag"]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus"]
PART_COLS = ["p_partkey", "p_brand", "p_type", "p_size"]


def listings_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings view over the parquet tables of ``sf_dir``; only the 14 columns
    the view needs are read."""
    return listings_view(table(spark, sf_dir, "lineitem", *LINEITEM_COLS),
                         table(spark, sf_dir, "orders", *ORDERS_COLS),
                         table(spark, sf_dir, "part", *PART_COLS))


def listings_view(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Listings view: lineitem ⋈ orders ⋈ part, one listing per lineitem row.

    Both joins are inner equi-joins on foreign keys, so Catalyst may reorder them
    and AQE picks broadcast vs sort-merge from runtime sizes. When lineitem and
    orders are bucketed on the order key with the same bucket count
    (``sources.warehouse``), the big join needs no exchange at all.
    """
    li = lineitem.select(*LINEITEM_COLS)
    o = orders.select(*ORDERS_COLS)
    p = part.select(*PART_COLS)
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)

    cust7 = F.col("o_custkey") % 7
    m = F.lit(2) + F.col("l_partkey") % 18
    floor_txt = (
        F.when(F.col("l_partkey") % 97 == 0, F.lit(None).cast("string"))
        .when(F.col("l_suppkey") % 23 == 0, F.lit("Upper Basement out of 4"))
        .when(F.col("l_suppkey") % 7 == 0,
              F.concat(F.lit("Ground out of "), (F.lit(1) + F.col("l_partkey") % 9).cast("string")))
        .when(F.col("l_partkey") % 31 == 0, F.lit("3"))
        .otherwise(F.concat((F.lit(1) + F.col("l_orderkey") % m).cast("string"),
                            F.lit(" out of "), m.cast("string")))
    )
    return j.select(
        *[F.col(c) for c in KEY_COLS],
        F.when(F.col("o_custkey") % 101 == 0, F.lit(None).cast("string"))
        .otherwise(_pick(VIEW_CITIES, cust7)).alias("city"),
        F.col("p_brand").alias("locality"),
        (F.lit(1) + F.col("p_size") % 6).cast("int").alias("bhk"),
        F.floor((F.col("l_quantity") - 1) * 40).cast("int").alias("size"),
        (F.col("l_linenumber") % 5).cast("int").alias("bathroom"),
        F.floor(F.col("l_extendedprice") / 3 * (F.lit(1.0) + cust7 / F.lit(4.0))).cast("long").alias("rent"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "Unfurnished")
        .when(F.col("p_type").isin("MEDIUM", "STANDARD"), "Semi-Furnished")
        .when(F.col("p_type") == "PROMO", "Furnished")
        .otherwise("Other").alias("furnishing"),
        floor_txt.alias("floor_txt"),
        F.when(F.col("l_returnflag") == "A", "Super Area")
        .when(F.col("l_returnflag") == "N", "Carpet Area")
        .otherwise("Built Area").alias("area_type"),
        F.when(F.col("o_orderstatus") == "F", "Bachelors")
        .when(F.col("o_orderstatus") == "O", "Family")
        .otherwise("Bachelors/Family").alias("tenant"),
    )


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def price_per_sqft(rent: str | Column = "rent", size: str | Column = "size") -> Column:
    """Rent / max(size, 1), as double (cast first: ``rent * 1.0`` is decimal in Spark SQL)."""
    return _c(rent).cast("double") / F.greatest(_c(size).cast("double"), F.lit(1.0))


def not_basement(floor_txt: str | Column = "floor_txt") -> Column:
    """P2 predicate: floor text does not mention a basement; a null floor is kept."""
    return ~F.coalesce(F.lower(_c(floor_txt)).contains("basement"), F.lit(False))


def clean(listings: DataFrame, psf_min: float = C.PSF_MIN, psf_max: float = C.PSF_MAX,
          round_psf: int | None = None) -> DataFrame:
    """Add ``price_per_sqft``, drop basements (P2), keep psf in [min, max].

    ``round_psf`` rounds the stored value for display only (half-even); the range
    test always uses the unrounded value.
    """
    psf = price_per_sqft()
    out = listings.filter(not_basement()).withColumn("price_per_sqft", psf)
    out = out.filter(F.col("price_per_sqft").between(psf_min, psf_max))
    if round_psf is not None:
        out = out.withColumn("price_per_sqft", F.bround("price_per_sqft", round_psf))
    return out


def ingest_report(listings: DataFrame) -> DataFrame:
    """S1's report: rows (one aggregate job) and input partitions (plan metadata,
    no data moved to the driver)."""
    parts = listings.rdd.getNumPartitions()
    return listings.agg(F.count(F.lit(1)).alias("rows")).withColumn("partitions", F.lit(parts))


def clean_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned listings view over the driver tables."""
    return clean(listings_from_tables(spark, sf_dir))


def with_listing_id(listings: DataFrame) -> DataFrame:
    """Deterministic 64-bit id from the listing key (replaces random uuids)."""
    return listings.withColumn("listing_id", F.xxhash64(*[F.col(c) for c in KEY_COLS]))


def cities(listings: DataFrame) -> DataFrame:
    """Cities present (null dropped), sorted."""
    return listings.select("city").where(F.col("city").isNotNull()).distinct().orderBy("city")


def total_rows(listings: DataFrame) -> DataFrame:
    """Row count as a one-row DataFrame (no driver round trip)."""
    return listings.agg(F.count(F.lit(1)).alias("total_rows"))


def sample_rows(listings: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """S3 in its scalable form: a Bernoulli sample (each partition samples locally)."""
    return listings.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_by_key(listings: DataFrame, fraction: float, keys: list[str] = KEY_COLS) -> DataFrame:
    """S3 without chance: rows whose key's hash lies below the fraction, the same in every run and engine."""
    tag = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10)
    return listings.where(tag.cast("long") < int(fraction * (1 << 32)))


def head_rows(listings: DataFrame, n: int = 200) -> DataFrame:
    """S3 as the reference does it: the first n rows of the input (limit is the feature)."""
    return listings.limit(n)


def export_csv(listings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Export (already filtered) listings as CSV with a header, one file per task."""
    listings.write.mode(mode).option("header", True).csv(path)


def write_partitioned(listings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Materialise cleaned listings as parquet partitioned by city so city filters
    prune directories and other filters push into the scan."""
    listings.write.mode(mode).partitionBy("city").parquet(path)
