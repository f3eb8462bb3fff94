"""Registered queries for features, vectors, pricing, risk and insights
(P4–P11, P17, P18, J1–J4, R1–R11, X1, M12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens import constants as C
from rentlens.functions import features as FT
from rentlens.functions.text import py_round
from rentlens.operators import insights as IN
from rentlens.operators import pricing as PR
from rentlens.operators import risk as RK
from rentlens.operators import stats as ST
from rentlens.plans.catalog import _DEMAND_CTE, clean, clean_shared, counts_shared, register, sql_round6
from rentlens.plans.oracle_sql import with_listings
from rentlens.sources.listings import KEY_COLS

KEYS_SQL = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"

# ------------------------------------------------------------------ features ---

_FLOOR_CTE = r"""
fl0 AS (SELECT *, regexp_replace(lower(floor_txt), '^\s+|\s+$', '', 'g') AS fv FROM listings),
fl1 AS (SELECT *, TRY_CAST(regexp_extract(fv, '^(\d+)\s+out of\s+(\d+)', 1) AS DOUBLE) AS fn_,
                  TRY_CAST(regexp_extract(fv, '^(\d+)\s+out of\s+(\d+)', 2) AS DOUBLE) AS fm_,
                  TRY_CAST(regexp_extract(fv, 'out of (\d+)', 1) AS DOUBLE) AS gt_ FROM fl0),
fl AS (SELECT *,
  CASE WHEN fv LIKE '%basement%' THEN 0.0 WHEN starts_with(fv, 'ground') THEN 0.0
       WHEN fn_ IS NOT NULL AND fm_ IS NOT NULL THEN fn_ ELSE 0.0 END::DOUBLE AS floor_n,
  CASE WHEN fv LIKE '%basement%' THEN 1.0 WHEN starts_with(fv, 'ground') THEN coalesce(gt_, 1.0)
       WHEN fn_ IS NOT NULL AND fm_ IS NOT NULL THEN fm_ ELSE 1.0 END::DOUBLE AS total_f FROM fl1),
flr AS (SELECT *, CASE WHEN total_f > 0 THEN floor_n / total_f ELSE 0.0 END AS floor_ratio,
  greatest(CAST(bhk AS DOUBLE), 1.0) AS bhk_c, greatest(CAST(size AS DOUBLE), 1.0) AS size_c,
  greatest(CAST(bathroom AS DOUBLE), 1.0) AS bath_c FROM fl)"""


def _enc(col: str, cats: list[str]) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {float(i)}" for i, v in enumerate(cats))
    return f"(CASE {col} {whens} ELSE {float(len(cats))} END)::DOUBLE"


def _unit(col: str, cats: list[str]) -> str:
    d = float(max(len(cats) - 1, 1))
    whens = " ".join(f"WHEN '{v}' THEN {i}::DOUBLE / {d}::DOUBLE" for i, v in enumerate(cats))
    return f"(CASE {col} {whens} ELSE 0.5::DOUBLE END)"


_FEATURES_SQL = with_listings(f"""
SELECT {KEYS_SQL}, {_enc('city', C.CITIES)} AS city_enc, bhk_c AS bhk_f, size_c AS size_f,
  bath_c AS bathroom_f, {_enc('furnishing', C.FURNISH)} AS furnishing_enc, floor_n, total_f, floor_ratio,
  size_c / bhk_c AS size_per_bhk, bath_c / bhk_c AS bath_per_bhk,
  {_enc('area_type', C.AREA_TYPES)} AS area_type_enc, {_enc('tenant', C.TENANTS)} AS tenant_enc,
  round_even(ln(1 + size_c), 6) AS log_size, bhk_c * bath_c AS bhk_bath_interaction,
  round_even(ln(1 + CAST(rent AS DOUBLE)), 6) AS log_rent,
  CASE WHEN price_per_sqft >= 40.0 THEN 1.0 ELSE 0.0 END::DOUBLE AS demand_fixed
FROM flr""", _FLOOR_CTE)


# Row-level transcendental outputs (logs, unit-vector components) are rounded with
# the fast bround/round_even pair: the two differ only on exact 7th-digit ties,
# which such values never produce. Rational outputs use the exact-binary rounding.
@register("listing_features", _FEATURES_SQL)
def q_listing_features(spark, sf):
    """12 features, parsed floor, log rent, fixed demand label."""
    df = FT.with_floor(clean(spark, sf))
    fl = F.col("_fl")
    out = FT.add_features(df, keep=KEY_COLS + ["_fl"])
    out = out.select(*KEY_COLS, "city_enc", "bhk_f", "size_f", "bathroom_f", "furnishing_enc",
                     fl["floor_n"].alias("floor_n"), fl["total_f"].alias("total_f"), "floor_ratio",
                     "size_per_bhk", "bath_per_bhk", "area_type_enc", "tenant_enc",
                     F.bround("log_size", 6).alias("log_size"), "bhk_bath_interaction",
                     F.bround("log_rent", 6).alias("log_rent"), "demand_fixed")
    return out


_VEC_SQL = with_listings(f"""
SELECT {KEYS_SQL}, {', '.join(f'round_even(c{i} / nrm, 6) AS v{i:02d}' for i in range(1, 13))}
FROM (SELECT *, sqrt({' + '.join(f'c{i} * c{i}' for i in range(1, 13))}) AS nrm FROM (
  SELECT {KEYS_SQL},
    {_unit('city', C.CITIES)} AS c1, least(bhk_c / 6.0, 1.0) AS c2, least(size_c / 5000.0, 1.0) AS c3,
    least(bath_c / 6.0, 1.0) AS c4, {_unit('furnishing', C.FURNISH)} AS c5, floor_ratio AS c6,
    least((size_c / bhk_c) / 2000.0, 1.0) AS c7, least(bath_c / bhk_c, 1.0) AS c8,
    {_unit('area_type', C.AREA_TYPES)} AS c9, {_unit('tenant', C.TENANTS)} AS c10,
    least(ln(1 + size_c) / 10.0, 1.0) AS c11, least((bhk_c * bath_c) / 36.0, 1.0) AS c12
  FROM flr))""", _FLOOR_CTE)


@register("listing_vectors", _VEC_SQL)
def q_listing_vectors(spark, sf):
    """Unit-length 12-dim similarity vectors (components rounded to 6 places)."""
    v = FT.add_vectors(clean(spark, sf), keep=KEY_COLS)
    return v.select(*KEY_COLS, *[F.bround(F.col("vector")[i - 1], 6).alias(f"v{i:02d}") for i in range(1, 13)])


# ------------------------------------------------------------------- pricing ---

_PRICED_CTE = """
med AS (SELECT city, median(rent) AS median_rent FROM listings WHERE city IS NOT NULL GROUP BY city),
band AS (SELECT l.*, coalesce(m.median_rent, 25000.0)::DOUBLE AS city_median
         FROM listings l LEFT JOIN med m ON l.city = m.city),
priced AS (SELECT * REPLACE (
    CAST(format('{:.2f}', CAST(rent AS DOUBLE) / greatest(CAST(size AS DOUBLE), 1.0)) AS DOUBLE) AS price_per_sqft),
  round_even(CAST(rent AS DOUBLE), -2) AS predicted_rent,
  round_even(CAST(rent AS DOUBLE) * 0.88::DOUBLE, -2) AS rent_low,
  round_even(CAST(rent AS DOUBLE) * 1.12::DOUBLE, -2) AS rent_high,
  CAST(format('{:.1f}', (CAST(rent AS DOUBLE) - city_median) / city_median * 100) AS DOUBLE) AS vs_median_pct
  FROM band)"""


def _priced(spark, sf):
    df = clean_shared(spark, sf)
    return PR.rent_band(df, "rent", ST.city_medians(counts_shared(spark, sf), weight="n"))


@register("rent_band", with_listings(
    f"SELECT {KEYS_SQL}, city, rent, predicted_rent, rent_low, rent_high, price_per_sqft, vs_median_pct,"
    " city_median FROM priced", _PRICED_CTE))
def q_rent_band(spark, sf):
    """P17 + P18 + J4: band, psf, deviation from the city median (listed rent as the estimate)."""
    return _priced(spark, sf).select(*KEY_COLS, "city", "rent", "predicted_rent", "rent_low", "rent_high",
                                     "price_per_sqft", "vs_median_pct", "city_median")


# ---------------------------------------------------------------------- risk ---

def _consts_sql() -> str:
    rows = ", ".join(f"('{c}', {float(C.CITY_INCOME[c])}::DOUBLE, {C.CITY_APPRECIATION[c]}::DOUBLE,"
                     f" {C.CITY_SUPPLY[c]}::DOUBLE)" for c in C.CITIES)
    return f"SELECT * FROM (VALUES {rows}) t(city, income, appreciation, supply)"


_RISK_CTE = _PRICED_CTE + "," + _FLOOR_CTE.replace("FROM listings)", "FROM priced)", 1) + f""",
bench AS (SELECT city, quantile_cont(rent, 0.75) AS rent_p75, quantile_cont(rent, 0.9) AS rent_p90,
                 quantile_cont(price_per_sqft, 0.75) AS psf_p75, count(*) AS city_count
          FROM listings WHERE city IS NOT NULL GROUP BY city),
bmed AS (SELECT city, bhk, median(rent) AS bhk_median FROM listings WHERE city IS NOT NULL GROUP BY city, bhk),
consts AS ({_consts_sql()}),
j AS (SELECT p.*, b.city IS NOT NULL AS has_bench, b.rent_p75, b.rent_p90, b.psf_p75, b.city_count,
             m.bhk_median, coalesce(k.income, 60000.0::DOUBLE) AS income,
             coalesce(k.appreciation, 6.0::DOUBLE) AS appreciation, coalesce(k.supply, 0.55::DOUBLE) AS supply,
             coalesce(p.city, 'None') AS city_s
      FROM flr p LEFT JOIN bench b ON p.city = b.city LEFT JOIN bmed m ON p.city = m.city AND p.bhk = m.bhk
      LEFT JOIN consts k ON p.city = k.city),
v AS (SELECT *, abs(vs_median_pct) AS dev,
        CASE WHEN bhk_median > 0 THEN (predicted_rent - bhk_median) / bhk_median * 100 END AS bhk_dev,
        CAST(size AS DOUBLE) / greatest(CAST(bhk AS DOUBLE), 1.0) AS spb,
        CAST(bathroom AS DOUBLE) / greatest(CAST(bhk AS DOUBLE), 1.0) AS bath_ratio,
        predicted_rent / income AS aff_ratio, supply * 100 AS sp_base,
        coalesce(city_count, 0) AS cnt FROM j),
sc AS (SELECT *,
  least(CAST(
    (CASE WHEN has_bench AND dev > 80 THEN 50 WHEN has_bench AND dev > 40 THEN 30 WHEN has_bench AND dev > 20 THEN 15 ELSE 0 END)
  + (CASE WHEN has_bench AND predicted_rent > rent_p90 THEN 25 WHEN has_bench AND predicted_rent > rent_p75 THEN 12 ELSE 0 END)
  + (CASE WHEN has_bench AND price_per_sqft > psf_p75 * 1.5 THEN 20 WHEN has_bench AND price_per_sqft > psf_p75 THEN 8 ELSE 0 END)
  + (CASE WHEN abs(bhk_dev) > 50 THEN 10 ELSE 0 END) AS DOUBLE), 100.0) AS price_anomaly_score,
  CASE WHEN furnishing = 'Furnished' THEN least(sp_base + 15, 100.0)
       WHEN furnishing = 'Semi-Furnished' THEN least(sp_base + 8, 100.0) ELSE sp_base END AS sp1,
  CASE WHEN aff_ratio >= 0.60 THEN 90.0 WHEN aff_ratio >= 0.45 THEN 70.0 WHEN aff_ratio >= 0.30 THEN 45.0
       ELSE 15.0 END::DOUBLE AS affordability_score,
  least(CAST((CASE WHEN spb < 200 THEN 25 WHEN spb < 300 THEN 12 ELSE 0 END)
  + (CASE WHEN bath_ratio < 0.5 THEN 15 WHEN bath_ratio >= 1.5 THEN 5 ELSE 0 END)
  + (CASE WHEN floor_ratio = 0 THEN 10 WHEN floor_ratio > 0.85 THEN 8 ELSE 0 END)
  + (CASE WHEN furnishing = 'Furnished' THEN 10 ELSE 0 END) AS DOUBLE), 100.0) AS property_score,
  CASE WHEN appreciation >= 9.0 THEN 80.0 WHEN appreciation >= 7.5 THEN 60.0 WHEN appreciation >= 6.0 THEN 40.0
       ELSE 20.0 END::DOUBLE AS market_velocity_score FROM v),
sc2 AS (SELECT *, CASE WHEN cnt < 400 THEN least(sp1 + 10, 100.0) WHEN cnt > 900 THEN greatest(sp1 - 8, 0.0)
                  ELSE sp1 END AS supply_pressure_score FROM sc),
comp AS (SELECT *, price_anomaly_score * 0.3::DOUBLE + supply_pressure_score * 0.2::DOUBLE
                   + affordability_score * 0.25::DOUBLE + property_score * 0.15::DOUBLE
                   + market_velocity_score * 0.1::DOUBLE AS composite FROM sc2),
lv AS (SELECT *, CASE WHEN composite >= 80 THEN 'Critical' WHEN composite >= 60 THEN 'High'
                      WHEN composite >= 35 THEN 'Medium' ELSE 'Low' END AS risk_level FROM comp)"""


def _scored(spark, sf, report: bool = True, neighbours=None):
    df = clean_shared(spark, sf)
    counts = counts_shared(spark, sf)
    priced = PR.rent_band(df, "rent", ST.city_medians(counts, weight="n"))
    return RK.score_risk(priced, ST.city_benchmarks(counts, weight="n"), ST.bhk_city_medians_all(counts, weight="n"), report=report,
                         neighbours=neighbours)


SCORE_COLS = [f"{n}_score" for n in RK.NAMES]


def _fmt1(c: str) -> str:
    return f"CAST(format('{{:.1f}}', {c}) AS DOUBLE)"


@register("risk_scores", with_listings(
    f"SELECT {KEYS_SQL}, city, predicted_rent, "
    + ", ".join(f"{_fmt1(c)} AS {c}" for c in SCORE_COLS)
    + f", {_fmt1('composite')} AS composite, risk_level FROM lv", _RISK_CTE))
def q_risk_scores(spark, sf):
    """R1–R7 with J1–J4: five factor scores, composite and level per listing."""
    s = _scored(spark, sf, report=False)
    return s.select(*KEY_COLS, "city", "predicted_rent", *[py_round(F.col(c), 1).alias(c) for c in SCORE_COLS],
                    py_round(F.col("composite"), 1).alias("composite"), "risk_level")


def _sig_sql() -> str:
    vs = "'Rent is ' || format('{:+.0f}', vs_median_pct) || '% vs city median — '"
    pa = f"""list_filter([
      CASE WHEN has_bench AND dev > 80 THEN {vs} || 'extreme outlier'
           WHEN has_bench AND dev > 40 THEN {vs} || 'significant deviation'
           WHEN has_bench AND dev > 20 THEN {vs} || 'moderate deviation' END,
      CASE WHEN has_bench AND predicted_rent > rent_p90 THEN 'Rent exceeds 90th percentile — top-tier pricing'
           WHEN has_bench AND predicted_rent > rent_p75 THEN 'Rent above 75th percentile — above-average market' END,
      CASE WHEN has_bench AND price_per_sqft > psf_p75 * 1.5 THEN 'Price/sqft ₹' || format('{{:.0f}}', price_per_sqft)
           || ' is ' || format('{{:.1f}}', price_per_sqft / psf_p75) || '× the 75th pct' END,
      CASE WHEN abs(bhk_dev) > 50 THEN CAST(bhk AS VARCHAR) || 'BHK segment median: ₹' || format('{{:,.0f}}', bhk_median)
           || ' (' || format('{{:+.0f}}', bhk_dev) || '% gap)' END], lambda x: x IS NOT NULL)"""
    pa = f"CASE WHEN len({pa}) = 0 THEN ['Rent is within normal city range'] ELSE {pa} END"
    sp = """list_filter([
      city_s || ' supply pressure index: ' || format('{:.0f}%', supply * 100),
      CASE WHEN furnishing = 'Furnished' THEN 'Fully furnished units face elevated tenant competition'
           WHEN furnishing = 'Semi-Furnished' THEN 'Semi-furnished segment is in moderate demand'
           ELSE 'Unfurnished segment has broader supply availability' END,
      CASE WHEN cnt < 400 THEN 'Limited comparable listings — thinner market data'
           WHEN cnt > 900 THEN 'High listing density — more supply options available' END], lambda x: x IS NOT NULL)"""
    af = """['Rent is ' || format('{:.0f}%', aff_ratio * 100) || ' of median income — ' ||
      CASE WHEN aff_ratio >= 0.60 THEN 'severe affordability stress' WHEN aff_ratio >= 0.45 THEN 'high stress zone'
           WHEN aff_ratio >= 0.30 THEN 'approaching RBI caution threshold' ELSE 'within healthy range' END,
      city_s || ' median household income: ₹' || format('{:,.0f}', income) || '/mo']"""
    pr = """list_filter([
      CASE WHEN spb < 200 THEN 'Very small space per BHK (' || format('{:.0f}', spb) || ' sqft) — tenant retention risk'
           WHEN spb < 300 THEN 'Compact layout (' || format('{:.0f}', spb) || ' sqft/BHK)'
           ELSE 'Spacious layout (' || format('{:.0f}', spb) || ' sqft/BHK)' END,
      CASE WHEN bath_ratio < 0.5 THEN 'Low bathroom ratio (' || format('{:.1f}', bath_ratio) || ' per BHK)'
           WHEN bath_ratio >= 1.5 THEN 'Premium bathroom ratio (' || format('{:.1f}', bath_ratio) || ' per BHK)' END,
      CASE WHEN floor_ratio = 0 THEN 'Ground floor — lower desirability, security concerns'
           WHEN floor_ratio > 0.85 THEN 'Top floor — potential heat/maintenance issues'
           ELSE 'Floor position ' || format('{:.0f}', floor_n) || '/' || format('{:.0f}', total_f)
                || ' — mid-range desirability' END,
      CASE WHEN furnishing = 'Furnished' THEN 'Furnished inventory subject to wear and replacement cost'
           ELSE 'Unfurnished — no furniture depreciation risk' END], lambda x: x IS NOT NULL)"""
    mv = """[city_s || ' 5-yr CAGR ' || CAST(appreciation AS VARCHAR) || '% — ' ||
      CASE WHEN appreciation >= 9.0 THEN 'rapidly appreciating market' WHEN appreciation >= 7.5 THEN 'strong growth trajectory'
           WHEN appreciation >= 6.0 THEN 'moderate appreciation' ELSE 'stable, slower market' END,
      '1-yr rent projection: ₹' || format('{:,.0f}', predicted_rent * (1 + appreciation / 100)) || ' at current trajectory']"""
    return dict(zip(RK.NAMES, [pa.replace("{{", "{").replace("}}", "}"), sp, af, pr, mv]))


def _sig_sql_joined() -> str:
    return ", ".join(f"array_to_string({e}, ' | ') AS {n}_signals" for n, e in _sig_sql().items())


def _summary_sql() -> str:
    labels = [RK.LABELS[n].lower() for n in RK.NAMES]
    top = ("CASE " + " ".join(
        f"WHEN {RK.NAMES[i]}_score >= greatest({', '.join(s + '_score' for s in RK.NAMES)}) THEN '{labels[i]}'"
        for i in range(len(labels))) + " END")
    parts = []
    for lvl, tpl in C.SUMMARY_TEMPLATES.items():
        t = "'" + tpl.replace("'", "''").replace("{city}", "' || city_s || '").replace("{top}", f"' || {top} || '") + "'"
        parts.append(f"WHEN risk_level = '{lvl}' THEN {t}")
    return "CASE " + " ".join(parts) + " END"


def _actions_list_sql() -> str:
    items = ", ".join(
        f"CASE WHEN {n}_score >= 60 THEN '" + C.FACTOR_ACTIONS[n].replace("'", "''").replace("{city}", "' || city_s || '") + "' END"
        for n in RK.NAMES)
    lst = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    dflt = "[" + ", ".join("'" + a + "'" for a in C.DEFAULT_ACTIONS) + "]"
    return f"CASE WHEN len({lst}) = 0 THEN {dflt} ELSE {lst}[1:4] END"


def _actions_sql() -> str:
    return f"array_to_string({_actions_list_sql()}, ' | ')"


def _level_sql(score: str, what: int) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {lv[0]} THEN '{lv[what]}'" for lv in C.LEVELS[:-1]) \
        + f" ELSE '{C.LEVELS[-1][what]}' END"


def _report_json_sql() -> str:
    sig = _sig_sql()
    factors = ", ".join(
        "{" + f"'name': '{n}', 'label': '{RK.LABELS[n]}', 'score': {_fmt1(n + '_score')},"
        f" 'weight': {RK.WEIGHTS[n]}::DOUBLE, 'description': '{C.FACTOR_DESCRIPTIONS[n]}', 'signals': {sig[n]},"
        f" 'level': {_level_sql(n + '_score', 1)}, 'color': {_level_sql(n + '_score', 2)},"
        f" 'icon': {_level_sql(n + '_score', 3)}" + "}" for n in RK.NAMES)
    report = ("{" + f"'composite': {_fmt1('composite')}, 'level': risk_level, 'color': {_level_sql('composite', 2)},"
              f" 'icon': {_level_sql('composite', 3)}, 'summary': {_summary_sql()}, 'actions': {_actions_list_sql()},"
              f" 'demand_risk': 'Low', 'risk_probability': 0.0::DOUBLE, 'factors': [{factors}]" + "}")
    return with_listings(f"SELECT {KEYS_SQL}, CAST(to_json({report}) AS VARCHAR) AS report_json FROM lv", _RISK_CTE)


@register("risk_reports", with_listings(
    f"SELECT {KEYS_SQL}, risk_level, CASE risk_level "
    + " ".join(f"WHEN '{lv}' THEN '{col}'" for _, lv, col, _ in C.LEVELS) + " END AS risk_color, "
    + f"{_summary_sql()} AS summary, {_actions_sql()} AS actions, {_sig_sql_joined()} FROM lv", _RISK_CTE))
def q_risk_reports(spark, sf):
    """Signals per factor, summary and actions (arrays shown joined by ' | ')."""
    s = _scored(spark, sf)
    return s.select(*KEY_COLS, "risk_level", "risk_color", "summary",
                    F.array_join("actions", " | ").alias("actions"),
                    *[F.array_join(f"{n}_signals", " | ").alias(f"{n}_signals") for n in RK.NAMES])


@register("risk_report_json", _report_json_sql())
def q_risk_report_json(spark, sf):
    """The nested report (struct with arrays of factor structs) as JSON text."""
    return _scored(spark, sf, neighbours=["city", "rent"]).select(*KEY_COLS, "report_json")


# ------------------------------------------------------------------ insights ---

def _insight_frame(spark, sf):
    df = clean_shared(spark, sf)
    counts = counts_shared(spark, sf)
    priced = PR.rent_band(df, "rent", ST.city_medians(counts, weight="n"))
    heat = ST.demand_heatmap(counts, weight="n")
    second = ST.bhk_city_medians_all(counts, weight="n").select("city", "bhk", py_round(F.col("median_rent"), -2).alias("dl_rent"))
    j = (priced.join(heat, ["city", "bhk"], "left")
         .join(second, ["city", "bhk"], "left")
         .withColumn("risk_prob", F.coalesce(F.col("demand_rate"), F.lit(0.0)))
         .withColumn("risk", F.when(F.col("risk_prob") >= 0.5, "High").otherwise("Low"))
         .transform(FT.with_floor).withColumn("floor_ratio", F.col("_fl")["ratio"]))
    return j


def _insights_sql() -> str:
    T = C.INSIGHTS

    def lit(t):
        return "'" + t.replace("'", "''") + "'"

    def fill(t, **parts):
        out = lit(t)
        for k, v in parts.items():
            out = out.replace("{" + k + "}", f"' || {v} || '").replace("{" + k + ":,.0f}", f"' || {v} || '")
        return out
    fallback = "CASE city " + " ".join(f"WHEN '{c}' THEN {float(m)}" for c, m in C.CITY_MEDIANS.items()) \
        + f" ELSE {float(C.INSIGHT_FALLBACK_MEDIAN)} END"
    med = f"(CASE WHEN city_median IS NULL OR city_median = 0 THEN {fallback} ELSE city_median END)"
    diff = "abs(dl_rent - predicted_rent)"
    prem = ", ".join(f"'{c}'" for c in C.PREMIUM_CITIES)
    items = [
        f"CASE WHEN price_per_sqft > 80 THEN {fill(T['high_price_per_sqft'], city='city_s', furnishing="lower(coalesce(furnishing, 'None'))")}"
        f" WHEN price_per_sqft < 25 THEN {fill(T['low_price_per_sqft'], city='city_s')} END",
        f"CASE WHEN floor_ratio > 0.6 THEN {lit(T['high_floor'])} END",
        f"CASE WHEN city IN ({prem}) AND predicted_rent > {med} THEN {fill(T['premium_city'], city='city_s')} END",
        f"CASE WHEN furnishing = 'Furnished' THEN {lit(T['furnished_premium'])} END",
        f"CASE WHEN size > 1500 THEN {fill(T['large_unit'], size='CAST(size AS VARCHAR)')} END",
        f"CASE WHEN risk_prob >= 0.5 THEN {fill(T['high_risk'], risk_pct='CAST(CAST(trunc(risk_prob * 100) AS INTEGER) AS VARCHAR)')}"
        f" ELSE {lit(T['low_risk'])} END",
        f"CASE WHEN dl_rent IS NOT NULL THEN CASE WHEN {diff} < 0.08::DOUBLE * predicted_rent"
        f" THEN {fill(T['ensemble_agreement'], diff=f"format('{{:,.0f}}', {diff})")}"
        f" ELSE {fill(T['ensemble_diverge'], diff=f"format('{{:,.0f}}', {diff})")} END END",
    ]
    lst = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)[1:5]"
    agree = "abs(dl_rent - predicted_rent) / greatest(predicted_rent, 1.0) * 100"
    ctes = (_PRICED_CTE + "," + _FLOOR_CTE.replace("FROM listings)", "FROM priced)", 1) + "," + _DEMAND_CTE
            + """,
second AS (SELECT city, bhk, round_even(median(rent)::DOUBLE, -2) AS dl_rent FROM listings
           WHERE city IS NOT NULL GROUP BY city, bhk),
ij AS (SELECT p.*, coalesce(h.demand_rate, 0.0) AS risk_prob, s.dl_rent, coalesce(p.city, 'None') AS city_s
       FROM flr p LEFT JOIN heat h ON p.city = h.city AND p.bhk = h.bhk
       LEFT JOIN second s ON p.city = s.city AND p.bhk = s.bhk)""")
    return with_listings(f"SELECT {KEYS_SQL}, array_to_string({lst}, ' | ') AS insights,"
                         f" {sql_round6(agree)} AS agreement_pct, coalesce({agree} < 8, false) AS models_agree FROM ij", ctes)



@register("prediction_insights", _insights_sql())
def q_prediction_insights(spark, sf):
    """X1 + M12 over every listing: listed rent as the estimate, the (city, bhk)
    demand rate as the risk probability, the (city, bhk) median as the second
    opinion."""
    j = _insight_frame(spark, sf)
    return j.select(*KEY_COLS, F.array_join(IN.insights(dl_rent="dl_rent", city_median="city_median"), " | ")
                    .alias("insights"),
                    py_round(IN.agreement_pct("dl_rent", "predicted_rent"), 6).alias("agreement_pct"),
                    F.coalesce(IN.agreement_pct("dl_rent", "predicted_rent") < 8, F.lit(False)).alias("models_agree"))
