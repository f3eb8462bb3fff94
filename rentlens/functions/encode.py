"""Column expressions: category codes (P4) and floor parsing.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlens import constants as C


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordinal(c: str | Column, categories: list[str]) -> Column:
    """Position in ``categories``; anything else (null included) = len(categories)."""
    col = _c(c)
    out = None
    for i, v in enumerate(categories):
        out = F.when(col == v, F.lit(float(i))) if out is None else out.when(col == v, F.lit(float(i)))
    return out.otherwise(F.lit(float(len(categories))))


def unit_category(c: str | Column, categories: list[str]) -> Column:
    """P9 category scaling: index / max(n-1, 1); unknown = 0.5."""
    col = _c(c)
    denom = float(max(len(categories) - 1, 1))
    out = None
    for i, v in enumerate(categories):
        val = F.lit(i / denom)
        out = F.when(col == v, val) if out is None else out.when(col == v, val)
    return out.otherwise(F.lit(0.5))


def city_enc(c="city"):
    return ordinal(c, C.CITIES)


def furnishing_enc(c="furnishing"):
    return ordinal(c, C.FURNISH)


def area_type_enc(c="area_type"):
    return ordinal(c, C.AREA_TYPES)


def tenant_enc(c="tenant"):
    return ordinal(c, C.TENANTS)


def ratio_of(floor_n: Column, total_f: Column) -> Column:
    """Floor / total, 0 when total <= 0 (guarded: ANSI division by zero raises)."""
    return F.when(total_f > 0, floor_n / total_f).otherwise(F.lit(0.0))
