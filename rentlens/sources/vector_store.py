"""The listing vector table as a versioned store with upserts by key.

A store is a folder with ``data/load=<id>/part=<city>`` (Parquet files that never change) and ``manifest/version=<n>``
(one row per city: the load that holds it). An upsert rewrites only the cities it touches, as a new load: their rows
without the batch's keys, and the batch. Its manifest is one file, written last, so readers, who follow the greatest
version, see either the old or the new state. Tasks write their rows of each city where they are, without a shuffle to
fewer files: a writer that dies before has changed nothing (its load is never read).
One writer at a time; each has its own load id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.session import materialize, shuffles_cleaned
from rentlens.sources.listings import KEY_COLS

#: Rows that an upsert keeps are found in so many passes, by a hash of the key: shuffle files hold one pass's share of them.
PASSES = 4
#: The folder of rows without a city.
NO_CITY = "(none)"


def with_listing_key(listings: DataFrame) -> DataFrame:
    """The listing's key as 128 bits (MD5 of its key columns, as 32 hexadecimal digits)."""
    return listings.withColumn("listing_key", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in KEY_COLS])))


def _manifest(spark: SparkSession, root: str) -> tuple[int, list[tuple[str, str]]]:
    """The newest version and its cities with their loads (a row per city); version 0 is an empty store."""
    try:
        rows = spark.read.schema("part string, load string, version long").parquet(f"{root}/manifest")
    except Exception as e:  # noqa: BLE001 - only a missing folder is an empty store
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0, []
    newest = rows.agg(F.max("version")).first()[0]
    if newest is None:
        return 0, []
    return newest, [(r["part"], r["load"]) for r in rows.filter(F.col("version") == newest).collect() if r["load"]]


def _rows(spark: SparkSession, root: str, held: list[tuple[str, str]], schema) -> DataFrame:
    """The rows of the given cities, each read from its load alone (the folders prune the scan)."""
    own = None
    for load in sorted({x for _, x in held}):
        here = (F.col("load") == load) & F.col("part").isin([p for p, x in held if x == load])
        own = here if own is None else own | here
    if own is None:
        return spark.createDataFrame([], schema)
    every = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    df = spark.read.option("basePath", f"{root}/data").schema(every + ", load string, part string").parquet(
        *sorted({f"{root}/data/load={x}" for _, x in held}))
    return df.filter(own).drop("load", "part")


def read(spark: SparkSession, root: str, schema) -> DataFrame:
    """The store's rows as of the newest manifest; ``schema`` is that of the batches."""
    return _rows(spark, root, _manifest(spark, root)[1], schema)


def _publish(spark: SparkSession, root: str, version: int, held: list[tuple[str, str]]) -> None:
    """The manifest of a version: one file, which appears at once."""
    rows = [(p, x, version) for p, x in sorted(held)] or [(None, None, version)]
    spark.createDataFrame(rows, "part string, load string, version long").coalesce(1).write.mode("append").partitionBy("version").parquet(f"{root}/manifest")


def _one_per_key(batch: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row of each key. Hashes of the keys are counted first, so that only rows whose key comes again (or shares its
    hash) are grouped: whole rows of keys that come once are not shuffled."""
    hashed = batch.withColumn("_h", F.xxhash64(key))
    again = materialize(hashed.groupBy("_h").count().filter("count > 1").select("_h"))
    if again.isEmpty():
        return batch
    others = [c for c in batch.columns if c != key]
    pick = F.max_by(F.struct(*others), F.col(order)) if order else F.first(F.struct(*others))
    picked = hashed.join(again, "_h", "left_semi").groupBy(key).agg(pick.alias("_r")).select(
        key, *[F.col("_r")[c].alias(c) for c in others]).select(*batch.columns)
    return hashed.join(again, "_h", "left_anti").select(*batch.columns).unionByName(picked)


def upsert(batch: DataFrame, root: str, key: str = "listing_key", city: str = "city", order: str | None = None) -> int:
    """Rows of ``batch`` replace those with the same key, whatever their city; the others stay. Of several rows of a key
    in the batch the one with the greatest ``order`` counts (any one without ``order``). Returns the new version."""
    spark, schema = batch.sparkSession, batch.schema
    version, held = _manifest(spark, root)
    load = uuid.uuid4().hex
    part = F.coalesce(F.nullif(F.col(city).cast("string"), F.lit("")), F.lit(NO_CITY))

    def write(rows: DataFrame) -> None:
        with shuffles_cleaned(spark):
            rows.withColumn("part", part).write.mode("append").option("compression", "zstd").partitionBy("part").parquet(f"{root}/data/load={load}")

    def written() -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return spark.read.schema(f"{kinds}, part string").parquet(f"{root}/data/load={load}")
    write(_one_per_key(batch, key, order))
    new = written().select(key)  # of the batch's files: those written later are not in its list
    if not held:
        filled = {r[0] for r in written().select("part").distinct().collect()}
        _publish(spark, root, version + 1, [(p, load) for p in filled])
        return version + 1
    # cities of the batch, and of the others those that hold its keys now: a listing may have moved
    touched = {r[0] for r in written().select("part").distinct().collect()}
    if others := [(p, x) for p, x in held if p not in touched]:
        old = _rows(spark, root, others, schema).select(key, part.alias("p"))
        touched |= {r[0] for r in old.join(new, key, "left_semi").select("p").distinct().collect()}
    old, share = _rows(spark, root, [(p, x) for p, x in held if p in touched], schema), F.pmod(F.hash(key), F.lit(PASSES))
    for i in range(PASSES):
        write(old.filter(share == i).join(new.filter(share == i), key, "left_anti").select(*batch.columns))
    filled = {r[0] for r in written().select("part").distinct().collect()}
    _publish(spark, root, version + 1, [(p, x) for p, x in held if p not in touched] + [(p, load) for p in filled])
    return version + 1
