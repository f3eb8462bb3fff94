from rentlens.sources import listings as L
from rentlens.sources import warehouse as WH


def test_bucketed_view_has_no_exchange_on_the_big_join(spark, sf_small):
    names = WH.bucket_tables(spark, sf_small, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = WH.listings_from_catalog(spark, names)
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        # the lineitem–orders join reads both sides straight from their buckets
        li_scan = [ln for ln in plan.split("\n") if "rl_lineitem" in ln or "rl_orders" in ln]
        assert li_scan and "Exchange hashpartitioning(l_orderkey" not in plan
        assert "Exchange hashpartitioning(o_orderkey" not in plan
        assert L.clean(view).count() == L.clean_listings(spark, sf_small).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
