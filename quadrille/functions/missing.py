"""Missing-value rules: NaN, infinities and blank text mean "no value", never a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def num(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def finite(c: Column | str) -> Column:
    """The value, or null if it is null, NaN or infinite."""
    v = num(c)
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def or_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def key(c: Column | str, kind: str) -> Column:
    """A group or join key with its missing values as null; text is trimmed of nothing, blank text is missing."""
    col = F.col(c) if isinstance(c, str) else c
    if kind == "string":
        return F.when(col != "", col)
    if kind in ("double", "float"):
        return finite(col)
    return col


def divide(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0 or either is missing."""
    return or_nan(F.try_divide(finite(a), finite(b)))
