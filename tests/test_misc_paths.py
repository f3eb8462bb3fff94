import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from rentlens.functions.quantiles import quantiles
from rentlens.operators import models as MD
from rentlens.operators import similarity as SIM
from rentlens.sources import listings as L


def test_approx_quantiles_close(spark):
    df = spark.range(10000).select((F.col("id") % 7).cast("string").alias("g"), (F.col("id") * 1.0).alias("v"))
    ex = {r["g"]: r["m"] for r in quantiles(df, "v", {"m": 0.5}, ["g"], "exact").collect()}
    ap = {r["g"]: r["m"] for r in quantiles(df, "v", {"m": 0.5}, ["g"], "approx", accuracy=10000).collect()}
    for g in ex:
        assert ap[g] == pytest.approx(ex[g], rel=0.01)


def test_upsert_latest_keeps_newest(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", t), (1, "b", t + dt.timedelta(1)), (2, "c", t)] + [(3, f"x{i}", t + dt.timedelta(seconds=i)) for i in range(50)],
                               "listing_id long, v string, ts timestamp")
    out = {r["listing_id"]: r["v"] for r in SIM.upsert_latest(df, "ts").collect()}
    assert out == {1: "b", 2: "c", 3: "x49"}


def test_partitioned_listings_prune(spark, sf_small):
    path = tempfile.mkdtemp(prefix="rentlens-part-") + "/listings"
    L.write_partitioned(L.clean_listings(spark, sf_small), path)
    back = spark.read.parquet(path).filter(F.col("city") == "Delhi")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(city" in plan and "Delhi" in plan
    assert back.count() == L.clean_listings(spark, sf_small).filter(F.col("city") == "Delhi").count()


def test_fallback_and_rounded_psf(spark):
    df = spark.createDataFrame([(1, 1234, 0)], "bhk int, rent bigint, size int").withColumn("floor_txt", F.lit("1 out of 2"))
    fb = MD.fallback_scores(df).first()
    assert (fb["predicted_rent"], fb["demand_risk"], fb["rent_low"], fb["rent_high"]) == (15000.0, "Unknown", 12000.0, 18000.0)
    df2 = spark.createDataFrame([(3, 1000, "2 out of 3")], "size int, rent bigint, floor_txt string")
    assert L.clean(df2, round_psf=2).first()["price_per_sqft"] == 333.33


def test_ingest_report(spark, sf_small):
    df = L.clean_listings(spark, sf_small)
    r = L.ingest_report(df).first()
    assert r["rows"] == df.count() and r["partitions"] >= 1


def test_scale_conf():
    from rentlens.session import scale_conf
    c = scale_conf(100 * 2 ** 40, executors=1000, cores_per_executor=8)
    assert int(c["spark.sql.shuffle.partitions"]) == 524288
    assert int(scale_conf(10 * 2 ** 20, 2, 4)["spark.sql.shuffle.partitions"]) == 16
