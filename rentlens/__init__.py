"""rentlens — rental-market analytics as Spark jobs.

Every operator takes and returns DataFrames (usable with ``df.transform``); no
operator creates a session. The usual flow:

    from rentlens.sources import listings as L
    from rentlens.operators import stats, risk, pricing, similarity, models

    df = L.clean(L.read_listings_csv(spark, path))        # or L.clean_listings(spark, sf_dir)
    stats.city_summary(df)                                 # A1 … A22, K2
    priced = pricing.rent_band(df, "rent", stats.city_medians(df))
    risk.score_risk(priced, stats.city_benchmarks(df), stats.bhk_city_medians_all(df))
    similarity.find_similar(queries, similarity.listing_vector_table(df), k=8, same_city=True)

Modules: ``sources`` (listings, prediction log, bucketed tables), ``functions``
(column expressions, quantiles, Python-compatible formatting), ``operators``
(filters, stats, lookups, pricing, risk, insights, similarity, models, accounts),
``streaming`` (login state machines, prediction-log stream), ``plans`` (training
job, analytics bundles, registered queries).
"""
