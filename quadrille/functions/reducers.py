"""Reducers over groups, with explicit rules for missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import NAN, finite, or_nan

NAMES = ("mean", "median", "sum", "min", "max", "count", "std", "sem", "first", "sigma_clip", "trimmed_mean")


def reduce_column(name: str, value: Column | str, *, empty_sum: float = 0.0, order: Column | None = None) -> Column:
    """Aggregate expression of a reducer over the finite values of a group.

    Groups without a finite value give NaN, but for count (0) and sum (`empty_sum`: 0 in tables, NaN
    between domains).  std and sem are of samples and need two values.  All but median, first,
    sigma_clip and trimmed_mean combine before the shuffle.
    """
    f = finite(value)
    n = F.count(f)
    if name == "mean":
        return or_nan(F.avg(f))
    if name == "median":
        return or_nan(F.percentile(f, 0.5))
    if name == "sum":
        return F.coalesce(F.sum(f), F.lit(empty_sum))
    if name in ("min", "max"):
        return or_nan(getattr(F, name)(f))
    if name == "count":
        return n
    if name == "std":
        return F.when(n >= 2, F.stddev_samp(f)).otherwise(NAN)
    if name == "sem":
        return F.when(n >= 2, F.stddev_samp(f) / F.sqrt(n)).otherwise(NAN)
    if name == "first":
        if order is None:
            raise ValueError("first needs an order")
        return or_nan(F.min_by(value, order))
    if name == "trimmed_mean":
        # drop one lowest and one highest value; with two values or fewer keep all
        return or_nan(F.when(n <= 2, F.avg(f)).otherwise((F.sum(f) - F.min(f) - F.max(f)) / (n - 2)))
    if name == "sigma_clip":
        return or_nan(clipped_mean(F.collect_list(f)))
    raise ValueError(f"unknown reducer {name!r}; one of {', '.join(NAMES)}")


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _median(a: Column) -> Column:
    n = F.size(a)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, let(F.array_sort(a), lambda s: (F.element_at(s, lo) + F.element_at(s, hi)) / 2))


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))


def clipped_mean(values: Column, rounds: int = 3) -> Column:
    """Mean of what stays within 3 scaled median deviations of the median, in up to `rounds` rounds."""

    def within(kept: Column, middle: Column) -> Column:
        spread = _median(F.transform(kept, lambda v: F.abs(v - middle))) * (3 * 1.4826)
        return let(spread, lambda s: F.filter(kept, lambda v: F.abs(v - middle) <= s))

    for _ in range(rounds):
        values = let(values, lambda kept: let(_median(kept), lambda middle: within(kept, middle)))
    return let(values, _mean)
