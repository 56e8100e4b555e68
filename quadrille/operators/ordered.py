"""Order over whole tables without sorting them in one task: running sums, numbers, ranks and exact percentiles.

Rows are dealt to cells, by a function that never falls as the order rises: of a number, the
logarithm of its distance to the group's least, 185 cells to a factor of e; of a text, its first two characters.  Cells are sorted
each in a task of its own, and running sums over the cells' totals, a few thousand rows at most for
numbers, give each cell its start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST = "\U0010ffff"


def dealt(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """df with _cell, which rises with `by` inside each group; missing values are in the last cell."""
    if df.schema[by].dataType.simpleString() == "string":
        return df.withColumn("_cell", F.coalesce(F.substring(by, 1, 2), F.lit(LAST)))
    v = F.col(by).cast("double")
    least = df.groupBy(*keys).agg(F.min(v).alias("_least"))
    d = df.join(least, list(keys)) if keys else df.crossJoin(F.broadcast(least))  # one row
    far = v - F.col("_least")
    cell = F.when(v.isNull() | F.isnan(v), 1 << 40).when(far > 0, F.floor(F.log(far) * 185) + 200_000).otherwise(0)
    return d.withColumn("_cell", cell.cast("long")).drop("_least")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], by: str, amount: str | None, name: str, total: str | None = None) -> DataFrame:
    """Adds the running sum of `amount` (rows, if none) in each group by `order`, whose first column is `by`, and the group's total."""
    keys = list(keys)
    d = dealt(df, keys, by)
    one = F.col(amount) if amount else F.lit(1)
    cells = d.groupBy(*keys, "_cell").agg(F.sum(one).alias("_in"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_in").over(own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(*keys, "_cell", before.alias("_before"), F.sum("_in").over(own).alias("_total"))
    here = F.sum(one).over(Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = d.withColumn("_here", here)
    # the cells of all groups are null-safe keys: a missing group key is a group
    other = cells.select(*[F.col(k).alias(f"_at_key{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_at_cell"), "_before", "_total")
    same = F.col("_cell") == F.col("_at_cell")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_at_key{i}"))
    out = out.join(other, same).withColumn(name, F.col("_before") + F.col("_here"))
    return out.select(*df.columns, name, *([F.col("_total").alias(total)] if total else []))


def numbered(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Adds start, start + 1, ... by `order` (missing values last), which should tell all rows apart."""
    asc = [F.col(c).asc_nulls_last() for c in order]
    out = running(df, [], asc, order[0], None, name)
    return out.withColumn(name, (F.col(name) + (start - 1)).cast("long"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each name, the percentile of the group's non-null values, interpolated; groups of any size, value by value."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    c = running(c, keys, [value], value, "_c", "_upto", "_n")
    agg = []
    for p in shares.values():
        at = (F.col("_n") - 1) * float(p)
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value)))
        part = F.max(at - F.floor(at))
        agg.append(low + (high - low) * part)
    return c.groupBy(*keys).agg(*[a.cast("double").alias(n) for n, a in zip(shares, agg)])
