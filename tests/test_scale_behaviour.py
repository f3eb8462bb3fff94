"""Behaviour under skew: one key holding most rows must not change results and
must not land whole in one task where the plan promises otherwise."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.functions.quantiles import quantiles
from rentlens.operators import similarity as SIM
from rentlens.streaming import login_state as LS
from tests import pymodel as PM

T0 = dt.datetime(2024, 1, 1)


def test_state_carries_across_small_arrow_batches(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        u = 0 if i % 10 else int(rng.integers(1, 4))  # user 0 holds 90 % of the events
        rows.append((i, T0 + dt.timedelta(seconds=float(i) * 0.7), u, "error" if rng.random() < 0.8 else "signup"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        thr = {r["event_id"]: r["allowed"] for r in LS.throttle(df).collect()}
        lock = {r["event_id"]: r["outcome"] for r in LS.lockout(LS.login_attempts(df)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    hot = [r for r in rows if r[2] == 0]
    secs = [(r[1] - T0) // dt.timedelta(microseconds=1) for r in hot]
    assert [thr[r[0]] for r in hot] == [a for a, _ in PM.token_bucket(secs)]
    assert [lock[r[0]] for r in hot] == PM.lockout([(s, r[3] == "signup") for s, r in zip(secs, hot)])


def test_no_quantile_plan_merges_raw_rows(spark):
    """Whole numbers are counted per value before ``percentile``; other numbers never reach it."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"), (F.col("id") * 0.37).alias("v"))
    plan = quantiles(df, "i", {"m": 0.5}, ["g"])._jdf.queryExecution().executedPlan().toString()
    scans = plan.index("partial_percentile"), plan.index("partial_count")
    assert scans[0] < scans[1]  # the counts lie below
    assert "percentile(" not in quantiles(df, "v", {"m": 0.5}, ["g"])._jdf.queryExecution().executedPlan().toString()


def test_similarity_blocks_balanced_under_hot_facet(spark):
    n = 300
    rng = np.random.default_rng(11)
    vecs = rng.normal(size=(n, 6))
    df = spark.createDataFrame([(i, vecs[i].tolist(), 0 if i % 20 else 1) for i in range(n)],
                               "id long, v array<double>, lab int")
    blocks = df.groupBy(F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(4)).alias("b")).count().collect()
    sizes = sorted(r["count"] for r in blocks)
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[0]  # block sizes do not follow the facet
    top = SIM.topk_similar(df, df, 3, q_id="id", q_vec="v", i_id="id", i_vec="v", q_facet="lab", i_facet="lab",
                           exclude_self=True, block_rows=80).collect()
    assert len(top) == 3 * n
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for r in top[:30]:
        assert r["score"] == pytest.approx(float(unit[r["query_id"]] @ unit[r["item_id"]]), abs=1e-9)


def test_hot_username_first_request_wins(spark):
    from rentlens.operators import accounts as AC
    n = 3000
    reqs = spark.range(n).select(
        F.col("id").alias("req_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hotname")).otherwise(F.concat(F.lit("user_"), F.col("id").cast("string")))
        .alias("username"),
        F.lit("Name").alias("full_name"),
        F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@x.co")).alias("email"),
        F.lit("Aa1!aaaa").alias("password"), F.lit("tenant").alias("role"))
    existing = spark.createDataFrame([("someone", "s@x.co")], "username string, email string")
    out = AC.register_batch(reqs, existing)
    hot = out.filter(F.col("username") == "hotname")
    assert hot.filter(F.col("error").isNull()).select("req_id").collect()[0]["req_id"] == 0
    assert hot.filter(F.col("error").isNotNull()).count() == n // 3 - 1
    assert out.filter(F.col("error").isNull()).count() == n - n // 3 + 1
