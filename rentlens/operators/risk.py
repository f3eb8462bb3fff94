"""Five-factor risk score with signals, summary, actions and a nested report
(R1–R11), as one wide projection over listings joined with their benchmarks.

Input columns: city, bhk, size, bathroom, furnishing, floor_txt, predicted_rent,
price_per_sqft, vs_median_pct. ``score_risk`` does the J1–J3 lookups itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens import constants as C
from rentlens.functions.features import with_floor
from rentlens.functions.text import apart, compact, fixed, grouped, percent, py_round, py_str, signed
from rentlens.operators import lookups as LK

WEIGHTS = {name: w for name, _, w in C.FACTORS}
LABELS = {name: label for name, label, _ in C.FACTORS}
NAMES = [name for name, _, _ in C.FACTORS]


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def price_anomaly() -> tuple[Column, Column]:
    """R1."""
    pred, psf, vs = _d("predicted_rent"), _d("price_per_sqft"), _d("vs_median_pct")
    hb = F.col("has_bench")
    dev = F.abs(vs)
    p75psf = F.col("psf_p75")
    bmed = _d("bhk_median")
    bhk_dev = F.when(bmed > 0, (pred - bmed) / bmed * 100)
    bhk_hit = F.coalesce(F.abs(bhk_dev) > 50, F.lit(False))
    score = (F.when(hb & (dev > 80), 50).when(hb & (dev > 40), 30).when(hb & (dev > 20), 15).otherwise(0)
             + F.when(hb & (pred > F.col("rent_p90")), 25).when(hb & (pred > F.col("rent_p75")), 12).otherwise(0)
             + F.when(hb & (psf > p75psf * 1.5), 20).when(hb & (psf > p75psf), 8).otherwise(0)
             + F.when(bhk_hit, 10).otherwise(0))
    vs_txt = F.concat(F.lit("Rent is "), signed(vs, 0), F.lit("% vs city median — "))
    # the fallback message is decided from the (cheap) conditions, so the formatted
    # array is built once (no size() check over it)
    none_fired = ~((hb & ((dev > 20) | (pred > F.col("rent_p75")) | (psf > p75psf * 1.5))) | bhk_hit)
    signals = compact([
        F.when(hb & (dev > 80), F.concat(vs_txt, F.lit("extreme outlier")))
        .when(hb & (dev > 40), F.concat(vs_txt, F.lit("significant deviation")))
        .when(hb & (dev > 20), F.concat(vs_txt, F.lit("moderate deviation"))),
        F.when(hb & (pred > F.col("rent_p90")), F.lit("Rent exceeds 90th percentile — top-tier pricing"))
        .when(hb & (pred > F.col("rent_p75")), F.lit("Rent above 75th percentile — above-average market")),
        F.when(hb & (psf > p75psf * 1.5), F.concat(
            F.lit("Price/sqft ₹"), fixed(psf, 0), F.lit(" is "), fixed(psf / p75psf, 1), F.lit("× the 75th pct"))),
        F.when(bhk_hit, F.concat(F.col("bhk").cast("string"), F.lit("BHK segment median: ₹"), grouped(bmed, 0),
                                 F.lit(" ("), signed(bhk_dev, 0), F.lit("% gap)"))),
        F.when(F.coalesce(none_fired, F.lit(True)), F.lit("Rent is within normal city range")),
    ])
    return F.least(score.cast("double"), F.lit(100.0)), signals


def supply_pressure() -> tuple[Column, Column]:
    """R2."""
    furn = F.col("furnishing")
    base = F.col("supply") * 100
    s1 = (F.when(furn == "Furnished", F.least(base + 15, F.lit(100.0)))
          .when(furn == "Semi-Furnished", F.least(base + 8, F.lit(100.0))).otherwise(base))
    cnt = F.coalesce(F.col("city_count"), F.lit(0))
    score = (F.when(cnt < 400, F.least(s1 + 10, F.lit(100.0)))
             .when(cnt > 900, F.greatest(s1 - 8, F.lit(0.0))).otherwise(s1))
    signals = compact([
        F.concat(py_str("city"), F.lit(" supply pressure index: "), percent(F.col("supply"), 0)),
        F.when(furn == "Furnished", F.lit("Fully furnished units face elevated tenant competition"))
        .when(furn == "Semi-Furnished", F.lit("Semi-furnished segment is in moderate demand"))
        .otherwise(F.lit("Unfurnished segment has broader supply availability")),
        F.when(cnt < 400, F.lit("Limited comparable listings — thinner market data"))
        .when(cnt > 900, F.lit("High listing density — more supply options available")),
    ])
    return score, signals


def affordability() -> tuple[Column, Column]:
    """R3."""
    ratio = _d("predicted_rent") / F.col("income")
    score = F.when(ratio >= 0.60, 90.0).when(ratio >= 0.45, 70.0).when(ratio >= 0.30, 45.0).otherwise(15.0)
    head = F.concat(F.lit("Rent is "), percent(ratio, 0), F.lit(" of median income — "))
    signals = F.array(
        F.concat(head, F.when(ratio >= 0.60, F.lit("severe affordability stress"))
                 .when(ratio >= 0.45, F.lit("high stress zone"))
                 .when(ratio >= 0.30, F.lit("approaching RBI caution threshold"))
                 .otherwise(F.lit("within healthy range"))),
        F.concat(py_str("city"), F.lit(" median household income: ₹"), grouped(F.col("income"), 0), F.lit("/mo")),
    )
    return score, signals


def property_signals() -> tuple[Column, Column]:
    """R4."""
    bhk1 = F.greatest(_d("bhk"), F.lit(1.0))
    spb = _d("size") / bhk1
    bath = _d("bathroom") / bhk1
    fl = F.col("_fl")
    ratio = fl["ratio"]
    furnished = apart("furnishing") == "Furnished"  # all five factors are one projection
    score = (F.when(spb < 200, 25).when(spb < 300, 12).otherwise(0)
             + F.when(bath < 0.5, 15).when(bath >= 1.5, 5).otherwise(0)
             + F.when(ratio == 0, 10).when(ratio > 0.85, 8).otherwise(0)
             + F.when(furnished, 10).otherwise(0))
    signals = compact([
        F.when(spb < 200, F.concat(F.lit("Very small space per BHK ("), fixed(spb, 0),
                                   F.lit(" sqft) — tenant retention risk")))
        .when(spb < 300, F.concat(F.lit("Compact layout ("), fixed(spb, 0), F.lit(" sqft/BHK)")))
        .otherwise(F.concat(F.lit("Spacious layout ("), fixed(spb, 0), F.lit(" sqft/BHK)"))),
        F.when(bath < 0.5, F.concat(F.lit("Low bathroom ratio ("), fixed(bath, 1), F.lit(" per BHK)")))
        .when(bath >= 1.5, F.concat(F.lit("Premium bathroom ratio ("), fixed(bath, 1), F.lit(" per BHK)"))),
        F.when(ratio == 0, F.lit("Ground floor — lower desirability, security concerns"))
        .when(ratio > 0.85, F.lit("Top floor — potential heat/maintenance issues"))
        .otherwise(F.concat(F.lit("Floor position "), fixed(fl["floor_n"], 0), F.lit("/"),
                            fixed(fl["total_f"], 0), F.lit(" — mid-range desirability"))),
        F.when(furnished, F.lit("Furnished inventory subject to wear and replacement cost"))
        .otherwise(F.lit("Unfurnished — no furniture depreciation risk")),
    ])
    return F.least(score.cast("double"), F.lit(100.0)), signals


def market_velocity() -> tuple[Column, Column]:
    """R5 (with the 1-year projection)."""
    a = F.col("appreciation")
    score = F.when(a >= 9.0, 80.0).when(a >= 7.5, 60.0).when(a >= 6.0, 40.0).otherwise(20.0)
    head = F.concat(py_str("city"), F.lit(" 5-yr CAGR "), a.cast("string"), F.lit("% — "))
    future = _d("predicted_rent") * (1 + a / 100)
    signals = F.array(
        F.concat(head, F.when(a >= 9.0, F.lit("rapidly appreciating market"))
                 .when(a >= 7.5, F.lit("strong growth trajectory"))
                 .when(a >= 6.0, F.lit("moderate appreciation"))
                 .otherwise(F.lit("stable, slower market"))),
        F.concat(F.lit("1-yr rent projection: ₹"), grouped(future, 0), F.lit(" at current trajectory")),
    )
    return score, signals


FACTOR_FUNCS = {
    "price_anomaly": price_anomaly, "supply_pressure": supply_pressure,
    "affordability": affordability, "property": property_signals, "market_velocity": market_velocity,
}


def level_of(score: Column, what: int = 1) -> Column:
    """Level name (what=1), colour (2) or icon (3) for a 0–100 score."""
    out = None
    for threshold, *vals in C.LEVELS:
        v = F.lit(vals[what - 1])
        out = F.when(score >= threshold, v) if out is None else out.when(score >= threshold, v)
    return out.otherwise(F.lit(C.LEVELS[-1][what]))


def add_factor_scores(df: DataFrame) -> DataFrame:
    """``<factor>_score`` and ``<factor>_signals`` for the five factors and
    ``composite`` = Σ score·weight, in factor order."""
    df = with_floor(df)
    cols = {}
    for name in NAMES:
        s, sig = FACTOR_FUNCS[name]()
        cols[f"{name}_score"] = s
        cols[f"{name}_signals"] = sig
    out = df.withColumns(cols)
    composite = None
    for name in NAMES:
        term = F.col(f"{name}_score") * F.lit(WEIGHTS[name])
        composite = term if composite is None else composite + term
    return out.withColumn("composite", composite)


def add_report(df: DataFrame, clf_risk: str | None = None, clf_prob: str | None = None) -> DataFrame:
    """level/colour/icon, summary from the top factor (first wins ties),
    actions (≤4), and the nested report struct plus its JSON text."""
    comp = F.col("composite")
    top = F.array_max(F.array(*[
        F.struct(F.col(f"{n}_score").alias("s"), F.lit(-i).alias("o"), F.lit(LABELS[n].lower()).alias("label"))
        for i, n in enumerate(NAMES)]))["label"]
    level = level_of(comp, 1)
    city = py_str(apart("city"))
    summary = None
    for lvl, tpl in C.SUMMARY_TEMPLATES.items():
        pre, _, rest = tpl.partition("{city}")
        mid, _, post = rest.partition("{top}")
        txt = F.concat(F.lit(pre), city, F.lit(mid), top, F.lit(post)) if "{top}" in tpl \
            else F.concat(F.lit(pre), city, F.lit(rest))
        summary = F.when(level == lvl, txt) if summary is None else summary.when(level == lvl, txt)
    acts = []
    for n in NAMES:
        pre, _, post = C.FACTOR_ACTIONS[n].partition("{city}")
        text = F.concat(F.lit(pre), city, F.lit(post)) if "{city}" in C.FACTOR_ACTIONS[n] else F.lit(pre)
        acts.append(F.when(F.col(f"{n}_score") >= 60, text))
    any_high = None
    for n in NAMES:
        c = F.col(f"{n}_score") >= 60
        any_high = c if any_high is None else (any_high | c)
    acts += [F.when(~any_high, F.lit(a)) for a in C.DEFAULT_ACTIONS]
    actions = F.slice(compact(acts), 1, 4)
    out = df.withColumns({
        "risk_level": level, "risk_color": level_of(comp, 2), "risk_icon": level_of(comp, 3),
        "summary": summary, "actions": actions,
    })
    factors = F.array(*[F.struct(
        F.lit(n).alias("name"), F.lit(LABELS[n]).alias("label"),
        py_round(F.col(f"{n}_score"), 1).alias("score"), F.lit(WEIGHTS[n]).alias("weight"),
        F.lit(C.FACTOR_DESCRIPTIONS[n]).alias("description"), F.col(f"{n}_signals").alias("signals"),
        level_of(F.col(f"{n}_score"), 1).alias("level"), level_of(F.col(f"{n}_score"), 2).alias("color"),
        level_of(F.col(f"{n}_score"), 3).alias("icon")) for n in NAMES])
    report = F.struct(
        py_round(apart("composite"), 1).alias("composite"), F.col("risk_level").alias("level"),
        F.col("risk_color").alias("color"), F.col("risk_icon").alias("icon"), F.col("summary"),
        F.col("actions"),
        (F.col(clf_risk) if clf_risk else F.lit("Low")).alias("demand_risk"),
        (F.col(clf_prob).cast("double") if clf_prob else F.lit(0.0)).alias("risk_probability"),
        factors.alias("factors"))
    return out.withColumn("report", report).withColumn("report_json", F.to_json(F.col("report")))


def score_risk(df: DataFrame, benchmarks: DataFrame, bhk_medians: DataFrame,
               clf_risk: str | None = None, clf_prob: str | None = None, report: bool = True,
               neighbours: list[str] | None = None) -> DataFrame:
    """R1–R11 end to end: J1–J3 lookups, factor scores and the report.
    ``report=False`` stops at the scores, the composite and its level (R1–R7). Listings with equal ``neighbours`` columns
    come next to each other within a task: sorted before the texts are made, reports that are alike compress better."""
    j = LK.with_bhk_median(LK.with_benchmarks(LK.with_city_constants(df), benchmarks), bhk_medians)
    if neighbours:
        j = j.sortWithinPartitions(*neighbours)
    scored = add_factor_scores(j)
    if not report:
        return scored.withColumn("risk_level", level_of(F.col("composite"), 1))
    return add_report(scored, clf_risk, clf_prob)
