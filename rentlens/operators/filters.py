"""Row filters and display projections over cleaned listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens import constants as C


def facet_filter(df: DataFrame, cities=None, furnishing=None, bhk=None,
                 rent_range: tuple[float, float] | None = None) -> DataFrame:
    """City ∈, furnishing ∈, bhk ∈, rent between (inclusive).

    ``None`` skips a facet; an empty list keeps no rows (as an empty selection
    does in the reference). All four are simple predicates on source columns, so
    they push into a parquet scan of materialised listings.
    """
    cond = F.lit(True)
    for col, values in (("city", cities), ("furnishing", furnishing), ("bhk", bhk)):
        if values is not None:
            cond = cond & (F.col(col).isin(list(values)) if values else F.lit(False))
    if rent_range is not None:
        cond = cond & F.col("rent").between(rent_range[0], rent_range[1])
    return df.filter(cond)


def default_selection(df: DataFrame) -> DataFrame:
    f = C.DEFAULT_FACETS
    return facet_filter(df, f["cities"], f["furnishing"], f["bhk"], f["rent_range"])


def admin_selection(df: DataFrame) -> DataFrame:
    """P12 with the admin page's default choices: all cities and furnishings, 1 to 3 rooms, any rent."""
    return facet_filter(df, list(C.CITIES), list(C.FURNISH), [1, 2, 3])


def chart_rent_cap(df: DataFrame, cap: float = C.CHART_RENT_CAP) -> DataFrame:
    """Rows with rent below the chart cap."""
    return df.filter(F.col("rent") < cap)


def listing_table(df: DataFrame, columns: list[str] = C.DISPLAY_COLUMNS) -> DataFrame:
    """Display projection sorted by rent descending (ties by the remaining columns)."""
    return df.select(*columns).orderBy(F.col("rent").desc(), *[F.col(c) for c in columns if c != "rent"])


def rename_for_display(df: DataFrame, names: dict[str, str] = C.DISPLAY_NAMES) -> DataFrame:
    """Display names for the columns present."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def log_view(log: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Timestamp as ``yyyy-MM-dd HH:mm``; id and secret columns dropped if present."""
    out = log.withColumn(ts_col, F.date_format(F.col(ts_col), "yyyy-MM-dd HH:mm"))
    return out.drop("_id", "password_hash", "id")
