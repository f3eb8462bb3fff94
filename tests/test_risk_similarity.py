import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.operators import insights as IN
from rentlens.operators import risk as RK
from rentlens.operators import similarity as SIM

BENCH = {"Mumbai": dict(rent_p25=20000.0, rent_p50=40000.0, rent_p75=60000.0, rent_p90=90000.0,
                        psf_p50=40.0, psf_p75=50.0, count=1000),
         "Delhi": dict(rent_p25=10000.0, rent_p50=20000.0, rent_p75=30000.0, rent_p90=45000.0,
                       psf_p50=20.0, psf_p75=30.0, count=300),
         "Chennai": dict(rent_p25=8000.0, rent_p50=12000.0, rent_p75=15000.0, rent_p90=20000.0,
                         psf_p50=10.0, psf_p75=15.0, count=600)}
BHK_MED = {("Mumbai", 2): 45000.0, ("Delhi", 3): 10000.0, ("Chennai", 1): 0.0}


#: One row per branch: city, bhk, size, baths, furnishing, floor, rent, psf, deviation from the median, and the five
#: scores (price, supply, affordability, property, velocity) worked out by hand.
RISK = [
    # every price rule: 85 % off (50), above p90 (25), psf over 1.5 x p75 (20), 111 % over the bhk median (10), cut at 100;
    # supply 82 + 15 for furnished, at most 100, less 8 for over 900 listings; 95000 / 85000 of the income
    (("Mumbai", 2, 800, 2, "Furnished", "9 out of 10", 95000.0, 118.75, 85.0), (100, 89, 90, 18, 60)),
    # limits are not passed: 80 % counts as 30, at p90 as 12, psf at 75 as 8; 100 % over the bhk median is another 10
    (("Mumbai", 2, 1200, 2, "Semi-Furnished", "1 out of 4", 90000.0, 75.0, 80.0), (60, 82, 90, 0, 60)),
    (("Mumbai", 2, 599, 1, "Unfurnished", "Ground out of 3", 60000.0, 50.0, -40.0), (15, 74, 90, 22, 60)),
    (("Mumbai", 3, 590, 1, "Unfurnished", "2 out of 5", 25500.0, 40.0, 20.0), (0, 74, 45, 40, 60)),
    (("Mumbai", 1, 1000, 2, "Unfurnished", "17 out of 20", 38250.0, 38.25, -20.5), (15, 74, 70, 5, 60)),
    # under 400 listings: supply 70 + 8 + 10; the bhk median of 10000 is 155 % away
    (("Delhi", 3, 900, 3, "Semi-Furnished", "18 out of 20", 25500.0, 28.33, 27.5), (25, 88, 45, 8, 40)),
    (("Delhi", 2, 400, 1, "Unfurnished", "3 out of 9", 45000.0, 112.5, 125.0), (82, 80, 90, 12, 40)),
    # between 400 and 900 listings: supply as it is; a median of 0 says nothing
    (("Chennai", 1, 350, 1, "Unfurnished", None, 12000.0, 10.0, 0.0), (0, 55, 15, 10, 20)),
    # no benchmark: no price rule; default income, supply and growth; no listings known adds 10
    (("Pune", 2, 1000, 2, "Furnished", "1 out of 2", 150000.0, 150.0, 120.0), (0, 80, 90, 10, 40)),
    ((None, 0, 100, 0, None, "basement", 3000.0, 30.0, -90.0), (0, 65, 15, 50, 40)),
    (("Bangalore", 2, 1000, 1, "Furnished", "2 out of 4", 35100.0, 35.1, 0.0), (0, 100, 70, 10, 80)),
    (("Hyderabad", 2, 1000, 1, "Semi-Furnished", "2 out of 4", 17999.0, 18.0, 0.0), (0, 78, 15, 0, 60)),
    (("Kolkata", 2, 1000, 3, "Unfurnished", "2 out of 4", 13500.0, 13.5, 0.0), (0, 55, 45, 5, 20)),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, *r) for i, (r, _) in enumerate(RISK)]
    df = spark.createDataFrame(rows, "id int, city string, bhk int, size int, bathroom int, furnishing string,"
                                     " floor_txt string, predicted_rent double, price_per_sqft double,"
                                     " vs_median_pct double")
    bench = spark.createDataFrame([(c, b["rent_p25"], b["rent_p50"], b["rent_p75"], b["rent_p90"], b["psf_p50"],
                                    b["psf_p75"], b["count"]) for c, b in BENCH.items()],
                                  "city string, rent_p25 double, rent_p50 double, rent_p75 double, rent_p90 double,"
                                  " psf_p50 double, psf_p75 double, n_listings long")
    meds = spark.createDataFrame([(c, b, m) for (c, b), m in BHK_MED.items()],
                                 "city string, bhk int, median_rent double")
    return {r["id"]: r for r in RK.score_risk(df, bench, meds).collect()}


def test_risk_scores_by_hand(scored):
    weights = (0.3, 0.2, 0.25, 0.15, 0.1)
    for i, (row, scores) in enumerate(RISK):
        got = scored[i]
        assert [got[f"{n}_score"] for n in RK.NAMES] == pytest.approx(scores), row
        total = sum(w * s for w, s in zip(weights, scores))
        assert got["composite"] == pytest.approx(total, abs=1e-9)
        assert got["risk_level"] == ("Critical" if total >= 80 else "High" if total >= 60 else "Medium" if total >= 35 else "Low")
        assert got["report"]["composite"] == pytest.approx(total, abs=0.051) and len(got["report"]["factors"]) == 5
        assert '"factors"' in got["report_json"]


def test_risk_texts(scored):
    top, low, odd = scored[0], scored[7], scored[9]
    assert list(top["price_anomaly_signals"]) == [
        "Rent is +85% vs city median — extreme outlier", "Rent exceeds 90th percentile — top-tier pricing",
        "Price/sqft ₹119 is 2.4× the 75th pct", "2BHK segment median: ₹45,000 (+111% gap)"]
    assert list(top["supply_pressure_signals"]) == [
        "Mumbai supply pressure index: 82%", "Fully furnished units face elevated tenant competition",
        "High listing density — more supply options available"]
    assert list(top["affordability_signals"]) == ["Rent is 112% of median income — severe affordability stress",
                                                  "Mumbai median household income: ₹85,000/mo"]
    assert list(top["property_signals"]) == [
        "Spacious layout (400 sqft/BHK)", "Top floor — potential heat/maintenance issues",
        "Furnished inventory subject to wear and replacement cost"]
    assert list(top["market_velocity_signals"]) == ["Mumbai 5-yr CAGR 8.2% — strong growth trajectory",
                                                    "1-yr rent projection: ₹102,790 at current trajectory"]
    assert "price anomaly" in top["summary"] and len(top["actions"]) == 4
    assert list(low["price_anomaly_signals"]) == ["Rent is within normal city range"]
    assert list(low["property_signals"])[1] == "Ground floor — lower desirability, security concerns"
    assert list(odd["property_signals"])[:2] == ["Very small space per BHK (100 sqft) — tenant retention risk",
                                                 "Low bathroom ratio (0.0 per BHK)"]


def test_insights(spark):
    df = spark.createDataFrame(
        [("Mumbai", 1600, "Furnished", 0.7, 90000.0, "High", 0.734, 85.0, 95000.0, None),
         ("Kolkata", 500, None, 0.1, 5000.0, "Low", 0.1, 10.0, None, 0.0),
         ("Delhi", 900, "Semi-Furnished", 0.5, 40000.0, "Low", 0.2, 44.0, 40100.0, 50000.0)],
        "city string, size int, furnishing string, floor_ratio double, predicted_rent double, risk string,"
        " risk_prob double, price_per_sqft double, dl_rent double, city_median double")
    out = [r["i"] for r in df.select(IN.insights(dl_rent="dl_rent", city_median="city_median").alias("i")).collect()]
    assert len(out[0]) == 5 and out[0][0].startswith("This property commands") and "furnished furnishing" in out[0][0]
    assert any("73% confidence" in s for s in out[0]) is False  # the 6th message is cut by the limit of 5
    assert out[1][0].startswith("Competitive pricing relative to Kolkata")
    assert out[2] == ["Low demand risk signal — market appears well-supplied in this segment.",
                      "GBT and deep learning models agree within ₹100 — high confidence estimate."]


def _brute(q, qid, it, iid, k, qf=None, itf=None, exclude_self=False):
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    inn = it / np.linalg.norm(it, axis=1, keepdims=True)
    s = np.round(qn @ inn.T, 9)
    res = {}
    for a in range(len(qid)):
        cand = [(s[a, b], iid[b]) for b in range(len(iid))
                if (qf is None or qf[a] == itf[b]) and not (exclude_self and qid[a] == iid[b])]
        cand.sort(key=lambda t: (-t[0], t[1]))
        res[qid[a]] = [b for _, b in cand[:k]]
    return res


@pytest.mark.parametrize("block_rows", [7, 1000])
@pytest.mark.parametrize("facet", [False, True])
def test_topk_equals_brute_force(spark, block_rows, facet):
    rng = np.random.default_rng(3)
    n = 60
    vecs = rng.integers(0, 3, size=(n, 4)).astype(float) + 0.01  # many exact ties
    labels = rng.integers(0, 3, size=n)
    df = spark.createDataFrame([(int(i), vecs[i].tolist(), int(labels[i])) for i in range(n)],
                               "id long, v array<double>, lab int")
    got = SIM.topk_similar(df, df, 5, q_id="id", q_vec="v", i_id="id", i_vec="v",
                           q_facet="lab" if facet else None, i_facet="lab" if facet else None,
                           exclude_self=True, block_rows=block_rows, decimals=9).collect()
    few = SIM.topk_few(df.repartition(3), df.repartition(5), 5, q_id="id", q_vec="v", i_id="id", i_vec="v",
                       q_facet="lab" if facet else None, i_facet="lab" if facet else None, exclude_self=True, decimals=9)
    key = lambda r: (r["query_id"], r["rank"], r["item_id"], r["score"])
    assert sorted(map(key, few.collect())) == sorted(map(key, got))
    res = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        res.setdefault(r["query_id"], []).append(r["item_id"])
    exp = _brute(vecs, list(range(n)), vecs, list(range(n)), 5, labels if facet else None,
                 labels if facet else None, exclude_self=True)
    assert res == {k: v for k, v in exp.items() if v}


def test_few_queries_are_bounded_and_leave_items_in_place(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0, float(i)], "a" if i % 2 else None) for i in range(9)], "query_id long, vector array<double>, city string")
    items = df.withColumnRenamed("query_id", "item_id")
    top = SIM.topk_few(df.limit(2), items, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInPandas")  # only the candidates move
    assert SIM.topk_few(df.filter("false"), items, 3).count() == 0 and SIM.topk_few(df, items.filter("false"), 3).count() == 0
    same = SIM.topk_few(df, items, 9, q_facet="city", i_facet="city").collect()
    assert {r["query_id"] % 2 for r in same} == {1} == {r["item_id"] % 2 for r in same}  # a null facet matches nothing
    monkeypatch.setattr(SIM, "FEW_QUERIES", 5)
    with pytest.raises(ValueError):
        SIM.topk_few(df, items, 3)


def test_scores_rank_unrounded(spark):
    df = spark.createDataFrame([(1, [1.0, 1e-6]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    q = df.filter("id = 3")
    for f in (SIM.topk_similar, SIM.topk_few):
        args = dict(q_id="id", q_vec="v", i_id="id", i_vec="v", exclude_self=True)
        assert [r["item_id"] for r in f(q, df, 2, **args).orderBy("rank").collect()] == [2, 1]
        assert [r["item_id"] for r in f(q, df, 2, decimals=9, **args).orderBy("rank").collect()] == [1, 2]


def test_find_similar_listings(spark):
    rows = [("Mumbai", 2, 800, 2, "Furnished", 30000, "2 out of 5", "A", "Family", 37.5),
            ("Mumbai", 3, 1500, 3, "Unfurnished", 90000, "9 out of 10", "B", "Family", 60.0),
            ("Delhi", 2, 850, 2, "Furnished", 25000, "2 out of 5", "C", "Bachelors", 29.4),
            ("Delhi", 1, 400, 1, "Semi-Furnished", 12000, None, "D", "Family", 30.0)]
    listings = spark.createDataFrame(rows, "city string, bhk int, size int, bathroom int, furnishing string,"
                                           " rent bigint, floor_txt string, locality string, tenant string,"
                                           " price_per_sqft double")
    listings = listings.withColumns({"l_orderkey": F.lit(1), "l_linenumber": F.monotonically_increasing_id(),
                                     "l_partkey": F.lit(1), "l_quantity": F.lit(1.0), "l_extendedprice": F.lit(1.0)})
    vt = SIM.listing_vector_table(listings)
    q = spark.createDataFrame([(1, "Mumbai", 2, 820, 2, "Furnished", "2 out of 5", "Super Area", "Family")],
                              "query_id long, city string, bhk int, size int, bathroom int, furnishing string,"
                              " floor_txt string, area_type string, tenant string")
    top = SIM.find_similar(q, vt, k=2, same_city=True, max_rent=50000).collect()
    assert [r["city"] for r in top] == ["Mumbai"] and top[0]["rent"] == 30000
    top = SIM.find_similar(q, vt, k=8, min_rent=0, max_rent=0).collect()
    assert len(top) == 4  # 0 = no limit


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(1, 30), st.integers(1, 8), st.integers(0, 10_000))
def test_top_per_row_equals_full_sort(nq, ni, k, seed):
    rng = np.random.default_rng(seed)
    S = rng.integers(0, 4, size=(nq, ni)).astype(float) / 4  # many ties
    S[rng.random((nq, ni)) < 0.3] = -np.inf                   # masked pairs
    qids = np.arange(nq, dtype=np.int64) * 10
    iids = rng.permutation(ni).astype(np.int64)
    got = SIM._top_per_row(S, qids, iids, min(k, ni))
    exp = []
    for a in range(nq):
        cand = sorted([(-S[a, b], iids[b]) for b in range(ni) if np.isfinite(S[a, b])])[:min(k, ni)]
        exp += [(qids[a], i, -s) for s, i in cand]
    assert list(zip(got["query_id"], got["item_id"], got["score"])) == exp


LOW = "Low demand risk signal — market appears well-supplied in this segment."


@pytest.mark.parametrize("row,said", [
    # city, size, furnishing, floor, rent, risk, probability, psf, second model, median
    (("Pune", 1500, "Unfurnished", 0.6, 35001.0, "Low", 0.1, 80.0, None, None), [LOW]),  # every limit is not passed
    (("Pune", 1501, "Unfurnished", 0.61, 35001.0, "Low", 0.1, 80.01, None, None), [
        "This property commands a premium price per sqft — likely due to Pune demand and unfurnished furnishing.",
        "Higher floor placement typically adds 3-8% to rental premiums in Indian metros.",
        "Large unit size (1501 sqft) is the dominant rent driver — size_per_bhk ratio elevated.", LOW]),
    (("Delhi", 900, "Unfurnished", 0.0, 46501.0, "Low", 0.1, 24.99, None, 0.0), [  # median 0: the fixed 46500
        "Competitive pricing relative to Delhi average — good value signal for tenants.",
        "Delhi ranks as one of India's most expensive rental markets, driving above-median estimates.", LOW]),
    (("Delhi", 900, "Unfurnished", 0.0, 46501.0, "Low", 0.1, 25.0, None, 46501.0), [LOW]),
    (("Kolkata", 900, "Furnished", 0.0, 90000.0, "High", 0.739, 30.0, 82801.0, None), [  # 8 % of 90000 is 7200
        "Fully furnished units command a 15-25% rent premium vs unfurnished equivalents.",
        "High demand risk (73% confidence): supply constrained, rents likely to appreciate.",
        "GBT and deep learning models agree within ₹7,199 — high confidence estimate."]),
    (("Kolkata", 900, "Unfurnished", 0.0, 90000.0, "Low", 0.5, 30.0, 82800.0, None), [
        LOW, "Models diverge by ₹7,200 — uncertainty is higher; treat range as wider."]),
])
def test_insight_rules(spark, row, said):
    df = spark.createDataFrame([row], "city string, size int, furnishing string, floor_ratio double,"
                                      " predicted_rent double, risk string, risk_prob double, price_per_sqft double,"
                                      " dl_rent double, city_median double")
    assert list(df.select(IN.insights(dl_rent="dl_rent", city_median="city_median").alias("i")).first()["i"]) == said


def test_facets_have_cells_of_their_own(spark, monkeypatch):
    """Of ten facets only pairs within one are multiplied, also where a facet holds a third of the rows."""
    rng = np.random.default_rng(9)
    n = 900
    facet = [0 if i % 3 == 0 else 1 + i % 9 for i in range(n)]
    vecs = rng.normal(size=(n, 5))
    df = spark.createDataFrame([(i, vecs[i].tolist(), str(facet[i]) if i % 50 else None) for i in range(n)], "id long, v array<double>, f string")
    sizes = []
    old = SIM.materialize
    monkeypatch.setattr(SIM, "materialize", lambda d: sizes.append(old(d)) or sizes[-1])
    got = SIM.topk_similar(df, df, 4, q_id="id", q_vec="v", i_id="id", i_vec="v", q_facet="f", i_facet="f", exclude_self=True, block_rows=60)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    cos = unit @ unit.T
    for i in range(n):
        own = [j for j in range(n) if j != i and facet[j] == facet[i] and j % 50 and i % 50]
        want = sorted(own, key=lambda j: (-cos[i, j], j))[:4]
        assert [j for _, j in sorted(found.get(i, []))] == want
    blocks = {r["f"]: (r["nq"], r["ni"]) for r in sizes[0].collect()}
    held = {f: sum(1 for i in range(n) if i % 50 and str(facet[i]) == f) for f in blocks}
    pairs = sum(held[f] ** 2 for f in blocks)
    assert pairs < n * n / 5 and blocks["0"][0] == -(-held["0"] // 60) and None not in blocks


def test_projection_index_recall_and_buckets(spark):
    """At least 0.9 of the exact neighbours of every fiftieth vector; scores are exact; clustered vectors are met in few cells."""
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ask = emb.filter("vec_id % 50 = 0")
    kw = dict(q_id="vec_id", q_vec="embedding", i_id="vec_id", i_vec="embedding", exclude_self=True, decimals=9)
    exact = {(r.query_id, r.item_id): r.score for r in SIM.topk_similar(ask, emb, 8, **kw).collect()}
    near = {(r.query_id, r.item_id): r.score for r in SIM.topk_lsh(ask, emb, 8, **kw).collect()}
    assert len(near) == len(exact) == 8 * ask.count()
    same = near.keys() & exact.keys()
    assert len(same) >= 0.9 * len(exact) and all(abs(near[x] - exact[x]) < 2e-9 for x in same)

    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 32))
    rows = [(i, (centres[i % 20] + 0.1 * rng.standard_normal(32)).tolist()) for i in range(600)] + [(600 + i, centres[0].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    kw = dict(q_id="id", q_vec="v", i_id="id", i_vec="v", exclude_self=True, decimals=9, block_rows=100)
    few = df.filter("id % 50 = 0")
    exact = {(r.query_id, r.rank): r.item_id for r in SIM.topk_similar(few, df, 5, **kw).collect()}
    near = {(r.query_id, r.rank): r.item_id for r in SIM.topk_lsh(few, df, 5, tables=4, bits=6, **kw).collect()}
    assert len(near) == len(exact) and sum(near[x] == exact[x] for x in exact) >= 0.95 * len(exact)
    assert SIM.topk_lsh(few, df.limit(0), 5, **kw).count() == 0


def test_cells_without_a_facet_need_no_nested_loop(spark):
    from rentlens.operators import similarity as SIM
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, v array<double>")
    top = SIM.topk_similar(df, df, 2, q_id="id", q_vec="v", i_id="id", i_vec="v", exclude_self=True)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and top.count() == 12
    none = SIM.topk_similar(df.filter("id < 0"), df, 2, q_id="id", q_vec="v", i_id="id", i_vec="v", exclude_self=True)
    assert none.count() == 0


def test_wide_risk_projections_are_not_fused(spark):
    """Five factors, texts and report in one method of a stage would be too long for HotSpot to compile."""
    rows = [("Mumbai", 2, 800, 2, "Furnished", "9 out of 10", 95000.0, 118.75, 85.0)]
    df = spark.createDataFrame(rows, "city string, bhk int, size int, bathroom int, furnishing string, floor_txt string,"
                                     " predicted_rent double, price_per_sqft double, vs_median_pct double")
    bench = spark.createDataFrame([("Mumbai", *BENCH["Mumbai"].values())],
                                  "city string, rent_p25 double, rent_p50 double, rent_p75 double, rent_p90 double,"
                                  " psf_p50 double, psf_p75 double, n_listings long")
    meds = spark.createDataFrame([("Mumbai", 2, 45000.0)], "city string, bhk int, median_rent double")
    for out, made in ((RK.score_risk(df, bench, meds, report=False).select(*[f"{n}_score" for n in RK.NAMES], "composite", "risk_level"),
                       ["price_anomaly_score"]),
                      (RK.score_risk(df, bench, meds).select("summary", "actions", "property_signals"),
                       ["price_anomaly_score", "property_signals", "actions"]),
                      (RK.score_risk(df, bench, meds).select("report_json"), ["price_anomaly_score", "report_json"])):
        spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
        try:
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        finally:
            spark.conf.unset("spark.sql.debug.maxToStringFields")
        for name in made:
            own = [line for line in plan if f"AS {name}#" in line and "Project" in line]
            assert own and not any("*(" in line.split("Project")[0] for line in own), name


def test_messages_and_rounding(spark):
    from rentlens.functions.text import compact, py_round
    got = spark.range(1).select(compact([F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("a")]).alias("m")).first()
    assert got["m"] == ["a", "", "a"]
    xs = [0.25, 0.35, -0.04, -0.25, 12.35, 2.5, 1e8 + 0.05, 123456789.25, 1e300, -7.0, 0.0, -0.0, 0.05, 0.15, 99.95,
          *np.random.default_rng(3).normal(0, 1000, 500).tolist()]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", py_round("x", 1).alias("a"), py_round("x", 2).alias("b"))
    for r in rows.collect():
        assert (repr(r["a"]), repr(r["b"])) == (repr(round(r["x"], 1)), repr(round(r["x"], 2)))


def test_measured_lookups_do_not_shuffle_the_listings(spark):
    from rentlens.operators import lookups as LK
    big = spark.range(200000).select((F.col("id") % 7).cast("string").alias("city"), (F.col("id") % 3).cast("int").alias("bhk"), F.col("id").alias("rent"))
    medians = big.groupBy("city").agg(F.avg("rent").alias("median_rent"))
    both = big.groupBy("city", "bhk").agg(F.avg("rent").alias("median_rent"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")  # below the estimate of the aggregates, above what they are
    try:
        for out in (LK.with_city_median(big, medians), LK.with_bhk_median(big, both)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert LK.with_city_median(big, medians).filter("city_median IS NULL").isEmpty()


def test_like_reports_are_neighbours(spark):
    df = spark.createDataFrame([(i, "Pune" if i % 2 else "Delhi", float(i % 5)) for i in range(40)], "id long, city string, rent double").coalesce(1)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(RK.LK, "with_city_constants", lambda d: d)
        m.setattr(RK.LK, "with_benchmarks", lambda d, _: d)
        m.setattr(RK.LK, "with_bhk_median", lambda d, _: d)
        m.setattr(RK, "add_factor_scores", lambda d: d.withColumn("composite", F.lit(1.0)))
        got = [(r["city"], r["rent"]) for r in RK.score_risk(df, None, None, report=False, neighbours=["city", "rent"]).collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_cells_go_through_their_scores_by_tiles(tile):
    rng = np.random.default_rng(tile)
    Q, I = (SIM._unit_rows(rng.integers(-2, 3, size=(n, 4)).astype(float)) for n in (37, 50))  # many equal scores
    qids, iids = np.arange(37), rng.permutation(50)
    S = np.where(qids[:, None] != iids[None, :], np.round(Q @ I.T, 9), -np.inf)
    for k in (1, 5, 60):
        got = SIM._best_of_cell(Q, I, qids, iids, k, True, 9, tile)
        want = SIM._top_per_row(S, qids, iids, min(k, 50))
        key = ["query_id", "score", "item_id"]
        assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True).astype(got.dtypes))


def test_many_rows_are_dealt_into_few_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))], "id long, v array<float>")
    kw = dict(q_id="id", q_vec="v", i_id="id", i_vec="v", exclude_self=True, decimals=9, block_rows=10)
    got = []
    for blocks in (1, 3):
        monkeypatch.setattr(SIM, "BLOCKS", blocks)
        top = SIM.topk_similar(df, df, 4, **kw)
        assert "array<double>" not in top._jdf.queryExecution().optimizedPlan().toString()  # floats are shuffled as floats
        cells = SIM._cells(df, df, 4, "id", "v", "id", "v", None, None, True, 10, 9)
        assert cells.count() == 300 * 4 * blocks  # a query has k candidates in each item block
        got.append(sorted(map(tuple, top.collect())))
    assert got[0] == got[1] and len(got[0]) == 1200
