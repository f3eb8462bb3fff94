"""Plan regression tests: the physical plans keep the properties the design
relies on (partial aggregation, pruned scans, pushed filters, bounded
broadcasts, no cartesian products)."""

import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from rentlens.operators import filters as FL
from rentlens.operators import stats as ST
from rentlens.sources import listings as L


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_city_summary_partial_aggregation_and_pruned_scan(spark, sf_small):
    p = _plan(ST.city_summary(L.clean(L.listings_from_tables(spark, sf_small))))
    assert "partial_avg" in p and "partial_count" in p
    scan = [ln for ln in p.split("\n") if "FileScan parquet" in ln and "l_orderkey" in ln][0]
    for unused in ("l_discount", "l_tax", "l_shipdate", "l_linestatus"):
        assert unused not in scan


def test_facets_push_into_partitioned_scan(spark, sf_small):
    path = tempfile.mkdtemp(prefix="rentlens-plan-") + "/listings"
    L.write_partitioned(L.clean_listings(spark, sf_small), path)
    sel = FL.default_selection(spark.read.parquet(path))
    p = _plan(sel)
    import re
    part = re.findall(r"PartitionFilters: \[[^\]]*\]", p)[0]
    pushed = p.split("PushedFilters: [", 1)[1]
    assert "city" in part and "Mumbai" in part  # directories of other cities are never listed
    assert "furnishing" in pushed and "bhk" in pushed and "rent" in pushed


def test_no_cartesian_products_in_registered_queries(spark, sf_small):
    bad = []
    for name, fn in E.queries().items():
        p = _plan(fn(spark, sf_small))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(name)
    assert not bad
