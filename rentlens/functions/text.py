"""Python-compatible number formatting and rounding as JVM-side expressions.

Python rounds and formats from the exact binary value of a double, half-even.
Spark's ``bround``/``round`` start from the shortest decimal string instead
(``bround(12.35, 1)`` is 12.4, Python gives 12.3), while ``format_number`` uses
``DecimalFormat``, which rounds from the exact binary value, half-even — the
same as Python. So every decimal rounding here goes through ``format_number``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_round(c, ndigits: int = 0) -> Column:
    """Python ``round(x, ndigits)`` for doubles. For ndigits <= 0 a tie can only
    be an exactly representable value, where ``bround`` is already exact."""
    x = _c(c).cast("double")
    if ndigits <= 0:
        return F.bround(x, ndigits)
    finite = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    text = F.replace(F.format_number(x, ndigits), F.lit(","), F.lit("")).cast("double")
    # away from a tie, the whole number next to x * 10**n is sure; divided by 10**n it is the double its text is read as
    scaled = x * F.lit(float(10 ** ndigits))
    sure = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.rint(scaled)) < 0.499)
    return F.when(sure, F.rint(scaled) / F.lit(float(10 ** ndigits))).when(finite, text).otherwise(x)


def _fixed0(x: Column) -> Column:
    """``f"{x:.0f}"`` without DecimalFormat: ``bround(x, 0)`` is exactly Python's
    rounding here (a tie can only be an exactly representable n.5), printed as a
    long; a negative value that rounds to 0 (or -0.0 itself) prints as "-0"."""
    r = F.bround(x, 0)
    neg_zero = (r == 0) & x.cast("string").startswith("-")
    fast = F.concat(F.when(neg_zero, F.lit("-")).otherwise(F.lit("")), r.cast("long").cast("string"))
    slow = F.replace(F.format_number(x, 0), F.lit(","), F.lit(""))
    return F.when(F.abs(x) < 1e15, fast).otherwise(slow)


def fixed(c, ndigits: int = 0) -> Column:
    """``f"{x:.{n}f}"``."""
    x = _c(c).cast("double")
    if ndigits == 0:
        return _fixed0(x)
    return F.replace(F.format_number(x, ndigits), F.lit(","), F.lit(""))


def grouped(c, ndigits: int = 0) -> Column:
    """``f"{x:,.{n}f}"`` (also ``f"{i:,}"`` for integers with n=0)."""
    return F.format_number(_c(c).cast("double"), ndigits)


def signed(c, ndigits: int = 0) -> Column:
    """``f"{x:+.{n}f}"``."""
    txt = fixed(_c(c).cast("double"), ndigits)
    return F.concat(F.when(txt.startswith("-"), F.lit("")).otherwise(F.lit("+")), txt)


def percent(c, ndigits: int = 0) -> Column:
    """``f"{x:.{n}%}"`` (x·100 in double arithmetic, as Python does)."""
    return F.concat(fixed(_c(c).cast("double") * 100, ndigits), F.lit("%"))


def py_str(c) -> Column:
    """``str(x)`` for a string that may be null (None → "None")."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def compact(items: list[Column]) -> Column:
    """Ordered list of the non-null messages (a conditional message is a ``when``
    without ``otherwise``). Not by a lambda: Spark does not compile the arguments of one. A byte that is in no text
    stands for null, so each message is made once."""
    none = F.lit(b"\xff").cast("string")
    return F.array_remove(F.array(*[F.coalesce(i, none) for i in items]), none)


def apart(c) -> Column:
    """The column as it is, through a lambda. Spark does not fuse a projection that has one into its stage's single
    method, which above 8000 bytes HotSpot never compiles; the projection's expressions become small methods instead.
    For a plain column of a wide projection, one that is always read."""
    return F.element_at(F.transform(F.array(_c(c)), lambda x: x), 1)
