import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rentlens.functions import features as FT
from rentlens.functions import text as TX
from rentlens.sources import listings as L

SCHEMA = ("city string, locality string, bhk int, size int, bathroom int, rent bigint, furnishing string,"
          " floor_txt string, area_type string, tenant string")

ROWS = [
    ("Mumbai", "A", 2, 800, 2, 32000, "Furnished", None, "Super Area", "Family"),
    ("Delhi", "B", 3, 1200, 0, 24000, "Semi-Furnished", "Upper BaseMent out of 3", "Carpet Area", "Bachelors"),
    ("Pune", "C", 1, 0, 1, 2, "Unfurnished", "  Ground out of 4", "Built Area", "Bachelors/Family"),
    (None, "D", 0, 500, 3, 20000, "Other", "5", None, None),
    ("Chennai", "E", 4, 1000, 2, 500000, "Furnished", "12 out of 10", "Super Area", "Family"),
    ("Kolkata", "F", 2, 1000, 1, 40000, "Unfurnished", "ground", "Carpet Area", "Family"),
    ("Hyderabad", "G", 2, 1000, 1, 2000, "Unfurnished", "3 out of 7", "Carpet Area", "Family"),
    ("Bangalore", "H", 2, 1000, 1, 1999, "Unfurnished", "3 out of 7", "Carpet Area", "Family"),
]


@pytest.fixture(scope="module")
def listings(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_clean_rules(listings):
    out = {r["locality"]: r for r in L.clean(listings).collect()}
    # basement (mixed case) dropped, null floor kept
    assert "B" not in out and "A" in out
    # psf exactly 2 and 500 kept (inclusive), below 2 dropped; size 0 divides by 1
    assert "G" in out and out["G"]["price_per_sqft"] == 2.0
    assert "E" in out and out["E"]["price_per_sqft"] == 500.0
    assert "H" not in out
    assert "C" in out and out["C"]["price_per_sqft"] == 2.0


#: Worked out by hand, in the order of FEATURE_COLS.
FEATURES = {
    "A": [0, 2, 800, 2, 0, 0, 400, 1, 0, 2, math.log(801), 4],
    "B": [1, 3, 1200, 1, 1, 0, 400, 1 / 3, 1, 1, math.log(1201), 3],  # no bathroom counts as one; a basement is floor 0
    "C": [6, 1, 1, 1, 2, 0, 1, 1, 2, 0, math.log(2), 1],  # unknown city; size 0 counts as 1; ground of 4
    "D": [6, 1, 500, 3, 3, 0, 500, 3, 3, 3, math.log(501), 3],  # nulls and unknown names come last; "5" is no floor
    "E": [3, 4, 1000, 2, 0, 1.2, 250, 0.5, 0, 2, math.log(1001), 8],
    "F": [5, 2, 1000, 1, 2, 0, 500, 0.5, 1, 2, math.log(1001), 2],
    "G": [4, 2, 1000, 1, 2, 3 / 7, 500, 0.5, 1, 2, math.log(1001), 2],
    "H": [2, 2, 1000, 1, 2, 3 / 7, 500, 0.5, 1, 2, math.log(1001), 2],
}
KEEP = ["locality", "city", "bhk", "size", "bathroom", "furnishing", "floor_txt", "area_type", "tenant"]


def test_features(listings):
    for r in FT.add_features(listings, keep=KEEP).collect():
        assert [r[c] for c in FT.FEATURE_COLS] == pytest.approx(FEATURES[r["locality"]], rel=1e-12, abs=1e-12), r["locality"]


FLOORS = [
    (None, 0, 1, 0), ("Upper Basement out of 4", 0, 1, 0), ("lower basement", 0, 1, 0), ("  Ground out of 4", 0, 4, 0),
    ("Ground", 0, 1, 0), ("5", 0, 1, 0), ("12 out of 10", 12, 10, 1.2), ("3 out of 7", 3, 7, 3 / 7), ("Ground out of 0", 0, 0, 0),
    ("4 out of 0", 4, 0, 0), ("x out of 3", 0, 1, 0), ("10  out of  20 ", 10, 20, 0.5), ("3 Out Of 6", 3, 6, 0.5),
    ("3out of 6", 0, 1, 0), ("1 out of", 0, 1, 0), ("ground floor out of 9", 0, 9, 0), ("\t2\tout of 8", 2, 8, 0.25), ("", 0, 1, 0),
]


def test_floor_cases(spark):
    df = spark.createDataFrame([(c,) for c, *_ in FLOORS], "floor_txt string")
    got = [(r["floor_txt"], r["_fl"]["floor_n"], r["_fl"]["total_f"], r["_fl"]["ratio"]) for r in FT.with_floor(df).collect()]
    assert got == FLOORS


#: Before the division by the length: categories over their last index (unknown: a half), numbers over fixed limits.
VECTORS = {
    "A": [0, 1 / 3, 0.16, 1 / 3, 0, 0, 0.2, 1, 0, 1, math.log(801) / 10, 4 / 36],
    "D": [0.5, 1 / 6, 0.1, 0.5, 0.5, 0, 0.25, 1, 0.5, 0.5, math.log(501) / 10, 3 / 36],  # more baths than rooms count as 1
    "E": [0.6, 4 / 6, 0.2, 1 / 3, 0, 1.2, 0.125, 0.5, 0, 1, math.log(1001) / 10, 8 / 36],
}


def test_vectors_unit_length(listings):
    for r in FT.add_vectors(listings, keep=KEEP).collect():
        assert math.isclose(sum(x * x for x in r["vector"]), 1.0, rel_tol=1e-12)
        if raw := VECTORS.get(r["locality"]):
            length = math.sqrt(sum(x * x for x in raw))
            assert r["vector"] == pytest.approx([x / length for x in raw], abs=1e-12), r["locality"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9000), st.integers(0, 9)), min_size=1, max_size=20))
def test_vector_norm_property(spark, rows):
    df = spark.createDataFrame([("Mumbai", b, s, t, "Furnished", "2 out of 5", "Super Area", "Family")
                                for b, s, t in rows],
                               "city string, bhk int, size int, bathroom int, furnishing string,"
                               " floor_txt string, area_type string, tenant string")
    for r in FT.add_vectors(df, keep=["bhk"]).collect():
        assert math.isclose(sum(x * x for x in r["vector"]), 1.0, rel_tol=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30))
def test_python_compatible_formatting(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", TX.py_round("x", 1).alias("r1"), TX.py_round("x", 2).alias("r2"),
                     TX.py_round("x", -2).alias("rm2"), TX.signed("x", 0).alias("s0"),
                     TX.fixed("x", 1).alias("f1"), TX.grouped("x", 0).alias("g0"),
                     TX.percent("x", 0).alias("p0")).collect()
    for r in rows:
        x = r["x"]
        assert r["r1"] == round(x, 1) and r["r2"] == round(x, 2) and r["rm2"] == round(x, -2)
        assert r["s0"] == f"{x:+.0f}" and r["f1"] == f"{x:.1f}" and r["g0"] == f"{x:,.0f}"
        assert r["p0"] == f"{x:.0%}"


def test_listings_view_counts(spark, sf_small):
    raw = L.listings_from_tables(spark, sf_small)
    n = raw.count()
    assert n == spark.read.parquet(f"{sf_small}/lineitem.parquet").count()  # no row lost by the joins
    assert L.clean(raw).count() <= n


def test_formatting_edge_values(spark):
    xs = [-0.0, 0.0, 0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.49999999999999994, -0.4, 1e15 + 0.5, 2.0 ** 53,
          -1234567.5, 12.35, 2.675, 1e-7, -1e-7, 999999.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", TX.fixed("x", 0).alias("f0"), TX.signed("x", 0).alias("s0"),
                     TX.grouped("x", 0).alias("g0"), TX.percent("x", 0).alias("p0"),
                     TX.fixed("x", 1).alias("f1")).collect()
    for r in rows:
        x = r["x"]
        assert (r["f0"], r["s0"], r["g0"], r["p0"], r["f1"]) == \
            (f"{x:.0f}", f"{x:+.0f}", f"{x:,.0f}", f"{x:.0%}", f"{x:.1f}"), x


FRAGMENTS = ["1", "12", "0", "3", " ", "  ", "\t", "out of", "Out Of", "OUT OF", "ground", "Ground", "upper",
             "basement", "Basement", "lower", "floor", "x", "-", "5 out of 10", "out of 7", "99999999999999999999"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(FRAGMENTS), min_size=0, max_size=6).map("".join), min_size=1, max_size=20))
def test_any_floor_text_keeps_the_rules(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "floor_txt string")
    for r in FT.with_floor(df).collect():
        f, low = r["_fl"], r["floor_txt"].lower().strip()
        assert f["ratio"] == (f["floor_n"] / f["total_f"] if f["total_f"] > 0 else 0)
        if "basement" in low:
            assert (f["floor_n"], f["total_f"]) == (0, 1)
        elif not low[:1].isdigit():
            assert f["floor_n"] == 0


def test_view_matches_fixture_figures(spark):
    """Independent figures for the listings view at sf0.01 (FIXTURES.md §2)."""
    from pyspark.sql import functions as F
    raw = L.listings_from_tables(spark, "/root/testdata/sf0.01").withColumn("psf", L.price_per_sqft())
    r = raw.agg(F.count(F.lit(1)).alias("n"),
                F.sum((~L.not_basement()).cast("int")).alias("basement"),
                F.sum(F.col("floor_txt").isNull().cast("int")).alias("null_floor"),
                F.sum(F.col("city").isNull().cast("int")).alias("null_city"),
                F.sum(F.col("psf").between(2, 500).cast("int")).alias("psf_in_range"),
                F.avg((F.col("psf") >= 40).cast("double")).alias("share_ge_40"),
                F.percentile("psf", 0.6).alias("p60"),
                F.sum((F.col("size") > 1500).cast("int")).alias("gt1500"),
                F.sum((F.col("bathroom") == 0).cast("int")).alias("no_bath")).first()
    assert (r["n"], r["basement"], r["null_floor"], r["null_city"]) == (60000, 2993, 646, 698)
    assert (r["psf_in_range"], r["gt1500"], r["no_bath"]) == (55931, 14205, 8622)
    assert round(r["share_ge_40"], 3) == 0.398 and round(r["p60"], 2) == 39.79
