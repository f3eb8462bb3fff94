"""Feature columns: the 12-feature matrix (P7), targets (P8), the unit-length
similarity vector (P9) and demand labels (P10, P11).

Every function returns Column expressions or a single ``select`` over the input,
never a chain of ``withColumn`` calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens import constants as C
from rentlens.functions import encode as E


def with_defaults(df: DataFrame) -> DataFrame:
    """Add any absent listing column with its default value."""
    missing = {k: F.lit(v) for k, v in C.DEFAULTS.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


def with_floor(df: DataFrame, col: str = "floor_txt", out: str = "_fl") -> DataFrame:
    """Parse the floor text once per row into ``out`` = struct(floor_n, total_f,
    ratio) (P5, P6), in three projections: normalised text, the three regex
    results, then the struct. Each stage's outputs are non-cheap and referenced
    more than once, so Catalyst keeps the stages apart and every regex runs once
    per row (inlined, the CASE branches would repeat them)."""
    if out in df.columns:
        return df
    v = F.col("_fv")
    df = df.withColumn("_fv", F.regexp_replace(F.lower(F.col(col)), r"^\s+|\s+$", ""))
    df = df.withColumns({
        "_fb": v.contains("basement"), "_fg": v.startswith("ground"),
        "_fgt": F.regexp_extract(v, r"out of (\d+)", 1).try_cast("double"),
        "_fn": F.regexp_extract(v, r"^(\d+)\s+out of\s+(\d+)", 1).try_cast("double"),
        "_fm": F.regexp_extract(v, r"^(\d+)\s+out of\s+(\d+)", 2).try_cast("double"),
    })
    b, g, gt, n, m = (F.coalesce(F.col("_fb"), F.lit(False)), F.coalesce(F.col("_fg"), F.lit(False)),
                      F.col("_fgt"), F.col("_fn"), F.col("_fm"))
    nm = n.isNotNull() & m.isNotNull()
    floor_n = F.when(b | g, 0.0).when(nm, n).otherwise(0.0)
    total_f = F.when(b, 1.0).when(g, F.coalesce(gt, F.lit(1.0))).when(nm, m).otherwise(1.0)
    df = df.withColumn(out, F.struct(floor_n.alias("floor_n"), total_f.alias("total_f")))
    df = df.withColumn(out, F.struct(F.col(out)["floor_n"].alias("floor_n"), F.col(out)["total_f"].alias("total_f"),
                                     E.ratio_of(F.col(out)["floor_n"], F.col(out)["total_f"]).alias("ratio")))
    return df.drop("_fv", "_fb", "_fg", "_fgt", "_fn", "_fm")


def _clamped(name: str) -> Column:
    """max(value, 1) as double; a null value takes the column default."""
    return F.greatest(F.coalesce(F.col(name).cast("double"), F.lit(float(C.DEFAULTS[name]))),
                      F.lit(1.0))


def feature_columns() -> list[Column]:
    """The 12 model features, in model order, named as ``constants.FEATURE_NAMES``."""
    size, bhk, bath = _clamped("size"), _clamped("bhk"), _clamped("bathroom")
    return [
        E.city_enc().alias("city_enc"),
        bhk.alias("bhk_f"),
        size.alias("size_f"),
        bath.alias("bathroom_f"),
        E.furnishing_enc().alias("furnishing_enc"),
        F.col("_fl")["ratio"].alias("floor_ratio"),
        (size / bhk).alias("size_per_bhk"),
        (bath / bhk).alias("bath_per_bhk"),
        E.area_type_enc().alias("area_type_enc"),
        E.tenant_enc().alias("tenant_enc"),
        F.log1p(size).alias("log_size"),
        (bhk * bath).alias("bhk_bath_interaction"),
    ]


# Output column name of each feature, in model order (bhk/size/bathroom are
# suffixed so the raw listing columns stay available next to them).
FEATURE_COLS = ["city_enc", "bhk_f", "size_f", "bathroom_f", "furnishing_enc", "floor_ratio",
                "size_per_bhk", "bath_per_bhk", "area_type_enc", "tenant_enc", "log_size",
                "bhk_bath_interaction"]


def log_rent(c: str = "rent") -> Column:
    """P8 target; invert with ``F.expm1``."""
    return F.log1p(F.col(c).cast("double"))


def demand_fixed(psf: str = "price_per_sqft", threshold: float = C.DEMAND_FIXED_PSF) -> Column:
    """P10: 1.0 when psf >= a fixed threshold."""
    return (F.col(psf) >= F.lit(threshold)).cast("double")


def add_features(listings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """P7 + P8 + P10 in one projection: key/listing columns, 12 features, log_rent,
    fixed demand label."""
    df = with_floor(with_defaults(listings))
    keep = [c for c in (keep if keep is not None else listings.columns)]
    extra = []
    if "rent" in df.columns:
        extra.append(log_rent().alias("log_rent"))
    if "price_per_sqft" in df.columns:
        extra.append(demand_fixed().alias("demand_fixed"))
    return df.select(*[F.col(c) for c in keep], *feature_columns(), *extra)


def raw_components() -> list[Column]:
    """P9 before normalising: 12 components, each capped at 1 (needs ``with_floor``)."""
    size, bhk, bath = _clamped("size"), _clamped("bhk"), _clamped("bathroom")
    return [
        E.unit_category("city", C.CITIES),
        F.least(bhk / 6.0, F.lit(1.0)),
        F.least(size / 5000.0, F.lit(1.0)),
        F.least(bath / 6.0, F.lit(1.0)),
        E.unit_category("furnishing", C.FURNISH),
        F.col("_fl")["ratio"],
        F.least((size / bhk) / 2000.0, F.lit(1.0)),
        F.least(bath / bhk, F.lit(1.0)),
        E.unit_category("area_type", C.AREA_TYPES),
        E.unit_category("tenant", C.TENANTS),
        F.least(F.log1p(size) / 10.0, F.lit(1.0)),
        F.least((bhk * bath) / 36.0, F.lit(1.0)),
    ]


def raw_vector() -> Column:
    return F.array(*raw_components())


def unit_normalise(arr: Column) -> Column:
    """Divide an array<double> by its L2 norm unless the norm is 0."""
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(arr, lambda x: x / norm)).otherwise(arr)


def add_vectors(listings: DataFrame, keep: list[str]) -> DataFrame:
    """Unit-length similarity vector with plain arithmetic (12 fixed
    components: no higher-order functions, so the projection stays in
    whole-stage codegen). Components first, then the norm, in two projections."""
    df = with_floor(with_defaults(listings))
    comps = [f"_c{i}" for i in range(12)]
    raw = df.select(*[F.col(c) for c in keep], *[c.alias(n) for c, n in zip(raw_components(), comps)])
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in comps[1:]), F.col(comps[0]) * F.col(comps[0])))
    raw = raw.withColumn("_norm", norm)
    vec = F.array(*[F.when(F.col("_norm") > 0, F.col(c) / F.col("_norm")).otherwise(F.col(c)) for c in comps])
    return raw.select(*[F.col(c) for c in keep], vec.alias("vector"))
