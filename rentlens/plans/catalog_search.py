"""Registered similarity queries (K1, J5) over the ``embeddings`` table, with
``label`` as the facet in place of city. Every vector is a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.operators import similarity as SIM
from rentlens.plans.catalog import register
from rentlens.sources.tables import table

K = 8


def _sim_sql(same_label: bool) -> str:
    cond = "a.vec_id <> b.vec_id" + (" AND a.label = b.label" if same_label else "")
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, label, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm, v FROM e),
u AS (SELECT vec_id, label, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm) ELSE v END AS u FROM n),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id,
                 round(list_dot_product(a.u, b.u), 9) AS score
          FROM u a JOIN u b ON {cond})
SELECT query_id, item_id, rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs)
WHERE rank <= {K}"""


def _run(spark, sf, same_label: bool):
    emb = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    top = SIM.topk_similar(emb, emb, K, q_id="vec_id", q_vec="embedding", i_id="vec_id", i_vec="embedding",
                           q_facet="label" if same_label else None, i_facet="label" if same_label else None,
                           exclude_self=True, decimals=9)
    return top.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"),
                      F.col("score"))


@register("similar_vectors", _sim_sql(False))
def q_similar_vectors(spark, sf):
    """K1: exact top-8 cosine neighbours of every vector."""
    return _run(spark, sf, False)


@register("similar_vectors_same_label", _sim_sql(True))
def q_similar_vectors_same_label(spark, sf):
    """K1/J5 with the facet restriction (same label ≙ same city)."""
    return _run(spark, sf, True)


@register("similar_vectors_lsh", None)
def q_similar_vectors_lsh(spark, sf):
    """K1 approximate: the top-8 neighbours of every fiftieth vector among all, by random projections."""
    emb = table(spark, sf, "embeddings", "vec_id", "embedding")
    top = SIM.topk_lsh(emb.filter("vec_id % 50 = 0"), emb, K, q_id="vec_id", q_vec="embedding", i_id="vec_id", i_vec="embedding",
                       exclude_self=True, decimals=9)
    return top.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), "score")


# ------------------------------------------------------ listings (K1 + J5) ---

def _key_id(cols=("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")):
    """A 60-bit id from the listing key that SQL engines can reproduce (md5 prefix)."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _similar_listings(spark, sf, same_city=True, min_rent=None, max_rent=None):
    from rentlens.functions.features import add_vectors
    from rentlens.operators import stats as ST
    from rentlens.operators.lookups import with_city_median
    from rentlens.plans.catalog import clean
    from rentlens.sources.listings import KEY_COLS
    df = clean(spark, sf).where(F.col("city").isNotNull()).withColumn("lid", _key_id())
    # one query per city: the listing whose rent is closest to the city median
    # (ties by id), picked with a partially aggregated min_by — no window over a hot city
    with_med = with_city_median(df, ST.city_medians(df), out="_med")
    order = F.struct(F.abs(F.col("rent") - F.col("_med")).alias("d"), F.col("lid").alias("i"))
    reps = with_med.groupBy("city").agg(F.min_by(F.col("lid"), order).alias("query_id"))
    cols = ["lid", "city", "bhk", "size", "bathroom", "furnishing", "floor_txt", "area_type", "tenant"]
    queries = add_vectors(df.join(reps, df["lid"] == reps["query_id"], "left_semi").select(*cols)
                          .withColumnRenamed("lid", "query_id"), keep=["query_id", "city"])
    items = add_vectors(SIM.rent_limits(df, min_rent, max_rent).select(*cols), keep=["lid", "city"])
    facet = "city" if same_city else None
    top = SIM.topk_few(queries, items, K, q_id="query_id", q_vec="vector", i_id="lid", i_vec="vector",
                       q_facet=facet, i_facet=facet, exclude_self=True, decimals=9)
    return top.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), "score")


def _similar_listings_sql(same_city=True, limits="true") -> str:
    from rentlens.plans.catalog_scoring import _FLOOR_CTE, _unit
    from rentlens import constants as C
    key = ("('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),"
           " CAST(l_partkey AS VARCHAR), CAST(l_quantity AS VARCHAR), CAST(l_extendedprice AS VARCHAR))), 1, 15))::BIGINT")
    comps = (f"{_unit('city', C.CITIES)}, least(bhk_c / 6.0, 1.0), least(size_c / 5000.0, 1.0),"
             f" least(bath_c / 6.0, 1.0), {_unit('furnishing', C.FURNISH)}, floor_ratio,"
             " least((size_c / bhk_c) / 2000.0, 1.0), least(bath_c / bhk_c, 1.0),"
             f" {_unit('area_type', C.AREA_TYPES)}, {_unit('tenant', C.TENANTS)},"
             " least(ln(1 + size_c) / 10.0, 1.0), least((bhk_c * bath_c) / 36.0, 1.0)")
    from rentlens.plans.oracle_sql import with_listings
    return with_listings(f"""
SELECT query_id, item_id, rank, score FROM (
  SELECT q.lid AS query_id, i.lid AS item_id, round(list_dot_product(q.u, i.u), 9) AS score,
         row_number() OVER (PARTITION BY q.lid ORDER BY round(list_dot_product(q.u, i.u), 9) DESC, i.lid) AS rank
  FROM u q JOIN reps r ON q.lid = r.query_id JOIN u i ON q.lid <> i.lid AND {limits}
       {"AND q.city = i.city" if same_city else ""})
WHERE rank <= {K}""", _FLOOR_CTE + f""",
v AS (SELECT {key} AS lid, city, rent, [{comps}] AS c FROM flr WHERE city IS NOT NULL),
n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS nrm FROM v),
u AS (SELECT lid, city, rent, CASE WHEN nrm > 0 THEN list_transform(c, lambda x: x / nrm) ELSE c END AS u FROM n),
med AS (SELECT city, median(rent) AS m FROM listings WHERE city IS NOT NULL GROUP BY city),
reps AS (SELECT u.city, arg_min(u.lid, (abs(u.rent - med.m), u.lid)) AS query_id
         FROM u JOIN med ON u.city = med.city GROUP BY u.city)""")


@register("similar_listings", _similar_listings_sql())
def q_similar_listings(spark, sf):
    """K1 + J5 on listings: per city, the listing closest to the city's median rent
    is the query; its top-8 cosine-similar other listings of the same city over
    the whole listings table (no rent limit, as the search form's default)."""
    return _similar_listings(spark, sf)


@register("listing_search", _similar_listings_sql(same_city=False))
def q_listing_search(spark, sf):
    """K1: the search form without its city option: the same queries against every other listing."""
    return _similar_listings(spark, sf, same_city=False)


@register("listing_search_rents", _similar_listings_sql(same_city=False, limits="i.rent BETWEEN 10000 AND 60000"))
def q_listing_search_rents(spark, sf):
    """K1 + J5: the search form with both rent limits."""
    return _similar_listings(spark, sf, same_city=False, min_rent=10000, max_rent=60000)


@register("listing_search_city_rents", _similar_listings_sql(limits="i.rent <= 60000"))
def q_listing_search_city_rents(spark, sf):
    """K1 + J5: the search form with its city option and a highest rent."""
    return _similar_listings(spark, sf, max_rent=60000)
