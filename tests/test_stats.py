import numpy as np
from pyspark.sql import functions as F
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rentlens.functions.quantiles import quantiles
from rentlens.operators import filters as FL
from rentlens.operators import stats as ST

SCHEMA = "city string, locality string, bhk int, size int, rent bigint, furnishing string, price_per_sqft double"


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        ("Mumbai", "A", 1, 500, 10000, "Furnished", 20.0),
        ("Mumbai", "A", 2, 800, 30000, "Unfurnished", 37.5),
        ("Mumbai", "B", 2, 900, 30000, "Semi-Furnished", 33.3),
        ("Mumbai", "B", 3, 1500, 90000, "Furnished", 60.0),
        ("Delhi", "C", 2, 1000, 25000, "Unfurnished", 25.0),   # one-row group
        (None, "D", 2, 1000, 99999, "Unfurnished", 99.999),     # null city dropped from groups
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_city_summary_matches_pandas(small):
    pdf = small.toPandas().dropna(subset=["city"])
    exp = pdf.groupby("city").agg(avg_rent=("rent", "mean"), median_rent=("rent", "median"),
                                  min_rent=("rent", "min"), max_rent=("rent", "max"),
                                  std_rent=("rent", "std"), avg_psf=("price_per_sqft", "mean"),
                                  n_listings=("rent", "count")).round(0)
    got = ST.city_summary(small).toPandas().set_index("city").sort_index()
    exp = exp.sort_index()
    for c in exp.columns:
        np.testing.assert_allclose(got[c].astype(float), exp[c].astype(float), equal_nan=True)
    assert pd.isna(got.loc["Delhi", "std_rent"])  # single-row std is null, like pandas NaN


def test_top_localities_ties(small):
    out = ST.top_localities(small, city="Mumbai", top_n=1).collect()
    assert [(r["locality"], r["avg_rent"]) for r in out] == [("B", 60000.0)]
    out = ST.top_localities(small, top_n=10).collect()
    assert {r["city"] for r in out} == {"Mumbai", "Delhi"}


def test_facets_and_kpis(small):
    sel = FL.facet_filter(small, cities=["Mumbai"], furnishing=["Furnished"], bhk=[1, 2, 3, 4],
                          rent_range=(5000, 150000))
    k = ST.selection_kpis(sel).first()
    assert k["n_listings"] == 2 and k["avg_rent"] == 50000.0
    assert FL.facet_filter(small, cities=[]).count() == 0
    assert FL.chart_rent_cap(small, 90000).count() == 4


def test_furnish_premiums_and_benchmarks(small):
    fp = {r["city"]: r for r in ST.furnish_premiums(small).collect()}
    assert fp["Mumbai"]["furnished"] == pytest.approx(50000 / 30000)
    assert fp["Mumbai"]["semi_furnished"] == pytest.approx(1.0)
    assert fp["Delhi"]["furnished"] is None
    b = {r["city"]: r for r in ST.city_benchmarks(small).collect()}
    assert b["Mumbai"]["rent_p50"] == 30000.0 and b["Mumbai"]["n_listings"] == 4
    assert b["Mumbai"]["rent_p90"] == pytest.approx(np.quantile([10000, 30000, 30000, 90000], 0.9))


def test_demand_labels(small):
    heat = {(r["city"], r["bhk"]): r["demand_rate"] for r in ST.demand_heatmap(small).collect()}
    q = np.quantile(small.toPandas()["price_per_sqft"], 0.6)
    assert ST.psf_threshold(small).first()["psf_q"] == pytest.approx(q)
    assert heat[("Mumbai", 3)] == 1.0 and heat[("Mumbai", 1)] == 0.0
    pv = {r["city"]: r for r in ST.demand_pivot(ST.demand_heatmap(small)).collect()}
    assert pv["Delhi"]["bhk_1"] == 0.0 and pv["Mumbai"]["bhk_3"] == 100.0


def _numpy(rows, probs):
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    return {g: [np.quantile(np.array(v, float), p) for p in probs.values()] for g, v in groups.items()}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.floats(0, 1000, allow_nan=False)),
                min_size=1, max_size=60), st.integers(0, 200), st.booleans())
def test_quantiles_of_any_groups(spark, rows, hot, whole):
    rows = rows + [("hot", 7.5)] * hot + [("hot", 1.0)]  # one heavy group with repeated values
    rows = [(g, int(v) if whole else v) for g, v in rows]
    df = spark.createDataFrame(rows, f"g string, v {'long' if whole else 'double'}")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p60": 0.6, "p90": 0.9, "p100": 1.0}
    got = {r["g"]: [r[p] for p in probs] for r in quantiles(df, "v", probs, ["g"]).collect()}
    exp = _numpy(rows, probs)
    assert got.keys() == exp.keys()
    for g in exp:
        assert got[g] == pytest.approx(exp[g], rel=1e-12, abs=1e-12)
    one = quantiles(df, "v", probs, []).first()
    assert [one[p] for p in probs] == pytest.approx(_numpy([("", v) for _, v in rows], probs)[""], rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_quantiles_do_not_depend_on_partitions_or_exchange_reuse(spark, parts, reuse):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 10 else "cold", float(v)) for i, v in enumerate(rng.lognormal(8, 2, 20_000))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    probs = {"m": 0.5, "p9": 0.9}
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {r["g"]: [r["m"], r["p9"]] for r in quantiles(df, "v", probs, ["g"]).collect()}
        one = quantiles(df, "v", probs, []).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    exp = _numpy(rows, probs)
    for g in exp:
        assert got[g] == pytest.approx(exp[g], rel=1e-12)
    assert [one["m"], one["p9"]] == pytest.approx(_numpy([("", v) for _, v in rows], probs)[""], rel=1e-12)


def test_bad_cells_only_cost_time(spark, monkeypatch):
    """Any cells that follow the order give exact ranks: here one cell, then two."""
    from rentlens.functions import quantiles as Q
    rows = [("a", float(v)) for v in np.random.default_rng(4).permutation(5000)]
    df = spark.createDataFrame(rows, "g string, v double")
    for log_cell, even_cell in (("0L", "0L"), ("0L", Q.EVEN_CELL), ("CASE WHEN _v < 100 THEN 1L ELSE 2L END", "CASE WHEN _v < 4000 THEN 1L ELSE 2L END")):
        monkeypatch.setattr(Q, "LOG_CELL", log_cell)
        monkeypatch.setattr(Q, "EVEN_CELL", even_cell)
        got = quantiles(df, "v", {"m": 0.5, "q": 0.901}, ["g"]).first()
        assert [got["m"], got["q"]] == pytest.approx(_numpy(rows, {"m": 0.5, "q": 0.901})["a"], rel=1e-12)


def test_quantiles_of_odd_doubles(spark):
    big, tiny, inf = 1.7976931348623157e308, 5e-324, float("inf")
    rows = [("a", v) for v in (-inf, -big, -1.0, -tiny, -0.0, 0.0, tiny, 1.0, 1.0000000000000002, big, inf)]
    rows += [("b", 1e9 + i * 1e-6) for i in range(999)] + [("c", v) for v in (big, -big)] + [("d", inf), ("d", inf)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles(df, "v", {"p1": 0.1, "m": 0.5, "p8": 0.8}, ["g"]).collect()}
    assert (got["a"]["p1"], got["a"]["m"], got["a"]["p8"]) == (-big, 0.0, 1.0000000000000002)
    assert got["b"]["m"] == 1e9 + 499 * 1e-6 and got["d"]["m"] == inf


def test_weights_are_repeated_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(f"g{i % 3}", float(v), int(w)) for i, (v, w) in enumerate(zip(rng.lognormal(3, 1, 300), rng.integers(1, 9, 300)))]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    each = df.withColumn("x", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    probs = {"a": 0.25, "b": 0.77}
    for frame, one in ((df, each), (df.withColumn("v", F.col("v").cast("long")), each.withColumn("v", F.col("v").cast("long")))):
        want = {r["g"]: (r["a"], r["b"]) for r in quantiles(one, "v", probs, ["g"]).collect()}
        got = {r["g"]: (r["a"], r["b"]) for r in quantiles(frame, "v", probs, ["g"], weight="n").collect()}
        assert got == want


def test_what_one_task_orders_does_not_grow_with_the_rows(spark, monkeypatch):
    """Ten times the rows, 90 % of them in one group: the cells of a group and the values that are put in order at the
    end stay the same."""
    from rentlens.functions import quantiles as Q
    kept = []
    old = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df: kept.append(old(df)) or kept[-1])
    most = []
    for n in (50_000, 500_000):
        kept.clear()
        df = spark.range(n).selectExpr("if(id % 10 < 9, 'hot', 'cold') AS g", f"exp(5 * ((id * 7919) % {n}) / {n}D) AS v")
        got = quantiles(df, "v", {"m": 0.5, "q": 0.9}, ["g"]).filter("g = 'hot'").first()
        values = kept[1]
        cells = df.selectExpr("g", "v AS _v").selectExpr("g", f"{Q.LOG_CELL} AS c").groupBy("g").agg(F.count_distinct("c").alias("n"))
        last = values.selectExpr("*", f"{Q.EVEN_CELL} AS c").groupBy("g", "_from", "c").count()
        most.append((cells.agg(F.max("n")).first()[0], last.agg(F.max("count")).first()[0]))
        assert got["m"] == pytest.approx(np.exp(2.5), rel=1e-3)
    assert most[1][0] <= 1.1 * most[0][0] and most[1][1] <= most[0][1] + 2


def test_quantiles_without_rows(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None)], "g string, v double")
    assert quantiles(df, "v", {"m": 0.5}, ["g"]).collect() == []
    assert quantiles(df.filter("false"), "v", {"m": 0.5}, []).first()["m"] is None


def test_counts_give_the_statistics_of_the_rows(small):
    c = ST.value_counts(small)
    assert c.agg(F.sum("n")).first()[0] == small.count()
    for f in (ST.city_summary, ST.city_medians, ST.bhk_city_median, ST.furnish_comparison, ST.demand_heatmap, ST.city_benchmarks,
              ST.bhk_city_medians_all, ST.furnish_premiums, ST.psf_threshold):
        rows, counted = (sorted(map(tuple, d.collect()), key=repr) for d in (f(small), f(c, weight="n")))
        assert len(rows) == len(counted)
        for a, b in zip(rows, counted):
            assert a == pytest.approx(b, nan_ok=True) if not any(isinstance(x, str) for x in a) else [
                x if isinstance(x, str) or x is None else pytest.approx(x) for x in a] == list(b), f.__name__


def test_box_stats(small):
    b = {r["city"]: r for r in ST.rent_box_stats(small).collect()}
    m = b["Mumbai"]
    assert m["q1"] == 25000.0 and m["q3"] == 45000.0
    assert m["upper_fence"] == 75000.0 and m["n_outliers"] == 1 and m["upper_whisker"] == 30000


def test_chunks_keep_all_rows(small):
    df = small.withColumn("l_orderkey", small["size"])
    assert sum(r["rows"] for r in ST.chunk_profile(df, 3).collect()) == small.count()
    assert sum(r["rows"] for r in ST.partition_rows(small).collect()) == small.count()
    share = {r["city"]: r["share"] for r in ST.city_share(small).collect()}
    assert share["Mumbai"] == pytest.approx(0.8)
