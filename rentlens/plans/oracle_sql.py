"""DuckDB SQL for the correctness oracle.

The listings view and cleaning step are written once here as CTEs; each oracle
query is ``WITH <ctes> SELECT ...``. The SQL states the same semantics as the
Spark operators, independently (no shared code path).
"""

LISTINGS_CTE = """
listings_raw AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity, l.l_extendedprice,
    CASE WHEN o.o_custkey % 101 = 0 THEN NULL
         ELSE CASE o.o_custkey % 7 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Delhi' WHEN 2 THEN 'Bangalore'
              WHEN 3 THEN 'Chennai' WHEN 4 THEN 'Hyderabad' WHEN 5 THEN 'Kolkata' ELSE 'Pune' END
    END AS city,
    p.p_brand AS locality,
    CAST(1 + p.p_size % 6 AS INTEGER) AS bhk,
    CAST(floor((l.l_quantity - 1) * 40) AS INTEGER) AS size,
    CAST(l.l_linenumber % 5 AS INTEGER) AS bathroom,
    CAST(floor(l.l_extendedprice / 3 * (1.0 + CAST(o.o_custkey % 7 AS DOUBLE) / 4.0)) AS BIGINT) AS rent,
    CASE WHEN p.p_type IN ('ECONOMY', 'SMALL') THEN 'Unfurnished'
         WHEN p.p_type IN ('MEDIUM', 'STANDARD') THEN 'Semi-Furnished'
         WHEN p.p_type = 'PROMO' THEN 'Furnished' ELSE 'Other' END AS furnishing,
    CASE WHEN l.l_partkey % 97 = 0 THEN NULL
         WHEN l.l_suppkey % 23 = 0 THEN 'Upper Basement out of 4'
         WHEN l.l_suppkey % 7 = 0 THEN 'Ground out of ' || CAST(1 + l.l_partkey % 9 AS VARCHAR)
         WHEN l.l_partkey % 31 = 0 THEN '3'
         ELSE CAST(1 + l.l_orderkey % (2 + l.l_partkey % 18) AS VARCHAR) || ' out of '
              || CAST(2 + l.l_partkey % 18 AS VARCHAR) END AS floor_txt,
    CASE l.l_returnflag WHEN 'A' THEN 'Super Area' WHEN 'N' THEN 'Carpet Area' ELSE 'Built Area' END AS area_type,
    CASE o.o_orderstatus WHEN 'F' THEN 'Bachelors' WHEN 'O' THEN 'Family' ELSE 'Bachelors/Family' END AS tenant
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
),
listings AS (
  SELECT * FROM (
    SELECT *, CAST(rent AS DOUBLE) / greatest(CAST(size AS DOUBLE), 1.0) AS price_per_sqft
    FROM listings_raw
    WHERE NOT coalesce(lower(floor_txt) LIKE '%basement%', false)
  ) WHERE price_per_sqft BETWEEN 2 AND 500
)"""


def with_listings(body: str, extra_ctes: str = "") -> str:
    ctes = LISTINGS_CTE + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"
