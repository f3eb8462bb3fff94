"""Grouped quantiles with linear interpolation (pandas ``quantile`` / DuckDB ``quantile_cont`` semantics).

``exact`` is one plan for each kind of value, whatever the size:

* whole numbers: rows are counted per (group, value) first, which spreads over all reducers, and
  ``percentile`` with these counts as frequencies sees one row per different value;
* other numbers: ranks are found in rounds that narrow an interval around each of them. The first round counts
  cells of the logarithm; the values of the cells that hold a wanted rank are then counted, cut into ``CELLS`` cells
  of equal width, and in the last round only the values of the cells that hold a rank there are put in order. Cells
  follow the values' order whatever rounding does, so the answer is exact; the last ones are narrower than 1e-9 of
  the value, so what one task orders is bounded by the number of cells and of doubles there, not by the rows of a
  group. Only counts are shuffled. The intervals and the values in them are written once (two small jobs).

``approx`` is ``percentile_approx`` (fixed-size sketch per group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.session import materialize

#: Cells per unit of the logarithm, and of each interval.
LOG_CELLS, CELLS = 1024, 1 << 20
#: The logarithm of the least double lies above minus this.
LEAST_LOG = 745.0


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str],
              method: str = "exact", accuracy: int = 10000, weight: str | None = None) -> DataFrame:
    """One row per group of ``by`` with one double column per entry of ``probs``.
    Nulls in ``value`` are ignored; a group with no values or with a null key is absent. With ``weight`` each row
    counts as so many (a table of counts)."""
    d = df.where(F.col(value).isNotNull())
    for b in by:
        d = d.where(F.col(b).isNotNull())
    if method == "approx":
        return d.groupBy(*by).agg(*[F.percentile_approx(F.col(value).cast("double"), p, accuracy).cast("double").alias(n)
                                    for n, p in probs.items()])
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")
    n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    if isinstance(df.schema[value].dataType, T.IntegralType):
        counts = d.groupBy(*by, F.col(value).alias("_v")).agg((F.sum(n) if weight else F.count(F.lit(1))).alias("_n"))
        return counts.groupBy(*by).agg(*[F.percentile(F.col("_v").cast("double"), p, F.col("_n")).alias(name)
                                         for name, p in probs.items()])
    return _by_rounds(d.select(*by, F.col(value).cast("double").alias("_v"), n.alias("_n")), probs, by)


#: A cell number that never falls when ``_v`` rises (``ln`` is monotone); NaN comes last, as Spark orders it.
LOG_CELL = f"""CASE WHEN isnan(_v) THEN {int(4 * LEAST_LOG * LOG_CELLS) + 1}L WHEN _v = 0 THEN 0L
    WHEN abs(_v) = double('Infinity') THEN bigint(signum(_v)) * {int(4 * LEAST_LOG * LOG_CELLS)}L
    ELSE bigint(signum(_v)) * floor((ln(abs(_v)) + {LEAST_LOG}D) * {LOG_CELLS}) END"""
#: The cell of equal width inside an interval (halves first: the difference of two doubles may exceed the doubles).
EVEN_CELL = f"""CASE WHEN _to > _from AND abs(_to) < double('Infinity') AND abs(_from) < double('Infinity')
    THEN least(floor((_v / 2 - _from / 2) / (_to / 2 - _from / 2) * {CELLS}), {CELLS - 1}L) ELSE 0L END"""
BOUNDS = ["min(_v) AS _low", "max(_v) AS _high", "sum(_n) AS _n"]
INTERVAL = ["_from", "_to", "_before", "_all"]


def _by_rounds(rows: DataFrame, probs: dict[str, float], by: list[str]) -> DataFrame:
    by = [f"`{b}`" for b in by]
    position = [f"{float(p)!r}D * (_all - 1)" for p in probs.values()]
    wanted = [(f"{k}{i}", f"bigint({f}({pos}))") for i, pos in enumerate(position) for k, f in (("a", "floor"), ("b", "ceil"))]

    def counted(values: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
        return values.groupBy(*map(F.expr, keys)).agg(*map(F.expr, sums))

    def narrowed(cells: DataFrame, order: str, interval: list[str]) -> DataFrame:
        """From counts of cells in order: one row per group, ``_at`` with the group's rows, and for each wanted rank the
        least and greatest value of the cell that holds it and the rows before that cell."""
        if by:
            cells = cells.repartition(*map(F.expr, by))  # one shuffle for the windows and the grouping after them
        part = "PARTITION BY " + ", ".join(by + interval) if by + interval else ""
        end = f"sum(_n) OVER ({part} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
        if interval:
            cells = cells.selectExpr("*", f"_before + {end} AS _end")
        else:
            cells = cells.selectExpr("*", f"{end} AS _end", f"sum(_n) OVER ({'PARTITION BY ' + ', '.join(by) if by else ''}) AS _all")
        found = [f"'{y}_{name}', max(CASE WHEN _end > {k} AND _end - _n <= {k} THEN {x} END)" for name, k in wanted
                 for x, y in (("_low", "low"), ("_high", "high"), ("_end - _n", "before"))]
        return counted(cells, by, [f"named_struct({', '.join(found)}, 'all', max(_all)) AS _at"])

    def held(values: DataFrame, at: DataFrame) -> DataFrame:
        """The values inside an interval, with the interval."""
        own = [f"CASE WHEN _v BETWEEN _at.low_{n} AND _at.high_{n} THEN named_struct('f', _at.low_{n}, 't', _at.high_{n}, 'b', _at.before_{n}) END"
               for n, _ in wanted]
        d = values.join(at, [b.strip("`") for b in by]) if by else values.withColumn("_at", at.scalar())
        d = d.selectExpr(*by, "_v", "_n", f"coalesce({', '.join(own)}) AS _own", "_at.all AS _all").where("_own IS NOT NULL")
        return d.selectExpr(*by, "_v", "_n", "_own.f AS _from", "_own.t AS _to", "_own.b AS _before", "_all")

    # the first intervals are written, so Spark knows their size: few groups are broadcast, more are joined with a shuffle
    at = materialize(narrowed(counted(rows, [*by, f"{LOG_CELL} AS _cell"], BOUNDS), "_cell", []))
    values = materialize(counted(held(rows, at), [*by, "_v", *INTERVAL], BOUNDS[2:]))
    at = narrowed(counted(values, [*by, *INTERVAL, f"{EVEN_CELL} AS _cell"], BOUNDS), "_cell", INTERVAL)
    last = held(values.drop(*INTERVAL), at).selectExpr("*", "_v AS _low", "_v AS _high")
    at = narrowed(last, "_v", INTERVAL).selectExpr(*by, "_at", "_at.all AS _all")
    return at.selectExpr(*by, *[f"CASE WHEN _at.low_a{i} = _at.low_b{i} THEN _at.low_a{i} ELSE _at.low_a{i} + ({pos} - floor({pos}))"
                                f" * (_at.low_b{i} - _at.low_a{i}) END AS `{name}`" for i, (name, pos) in enumerate(zip(probs, position))])
