"""Table operators: aggregate, join, concat, conditions, curation, arithmetic, unique objects, registration."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import COORDS, Refusal, kind, need
from ..functions.missing import divide, finite, key, num, or_nan
from ..functions.reducers import reduce_column
from ..functions.units import Unit, UnitError
from .ordered import numbered, percentiles

DEFAULT_REDUCERS = ("mean", "sem", "count")


def names(text: str | Sequence[str]) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()] if isinstance(text, str) else list(text)


def aggregate(df: DataFrame, group_by="t", value: str = "area", reducers="mean,sem,count") -> DataFrame:
    """One row per combination of keys: id 1..K in key order, the coordinates, n, and <value>_<reducer>.

    A missing key (NaN, infinite, null or blank) is a group of its own, sorted last.  Coordinates that
    are keys carry through, -1 where missing; the others are 0.  A blank group_by gives one row.  A
    batch's b is always a key.  `group` and `file` carry through where one value is shared, else "".
    """
    keys, wanted = names(group_by), names(reducers) or list(DEFAULT_REDUCERS)
    need(df, *keys, value)
    if kind(df, value) == "string":
        raise Refusal(f"{value} is text; aggregate needs numbers")
    if "b" in df.columns and "b" not in keys:
        keys = ["b", *keys]
    d = df.select(*[key(k, kind(df, k)).alias(f"_k{i}") for i, k in enumerate(keys)], num(value).alias("_v"), *[F.col(c).alias(f"_p_{c}") for c in ("group", "file") if c in df.columns and c not in keys])
    pooled = [c[3:] for c in d.columns if c.startswith("_p_")]
    shared = [F.when(F.min(f"_p_{c}") == F.max(f"_p_{c}"), F.min(f"_p_{c}")).otherwise("").alias(c) for c in pooled]
    out = d.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n"), *shared, *[reduce_column(r, "_v").alias(f"{value}_{r}") for r in wanted])
    if not keys:
        out = out.where("n > 0")
    out = numbered(out, [f"_k{i}" for i in range(len(keys))], "id") if keys else out.withColumn("id", F.lit(1).cast("long"))
    coords = {c: F.lit(0.0 if c in "zyx" else 0).cast("double" if c in "zyx" else "long").alias(c) for c in ("m", "t", "c", "z", "y", "x")}
    cols: list[Column] = []
    for i, k in enumerate(keys):
        if k in coords:
            coords[k] = F.coalesce(F.col(f"_k{i}").cast("double" if k in "zyx" else "long"), F.lit(-1)).alias(k)
        else:
            text = kind(df, k) == "string"
            cols.append((F.coalesce(F.col(f"_k{i}"), F.lit("")) if text else or_nan(F.col(f"_k{i}").cast("double")) if kind(df, k) in ("double", "float") else F.col(f"_k{i}")).alias(k))
    return out.select("id", *coords.values(), *cols, *pooled, "n", *[f"{value}_{r}" for r in wanted])


JOIN_KEYS = {"id_m_t": ("id", "m", "t"), "id": ("id",), "m_t": ("m", "t"), "track": ("track_id",), "label": ("label",)}


def join(left: DataFrame, right: DataFrame, on: str = "id_m_t", how: str = "left", prefix: str = "other_", check: bool = True) -> DataFrame:
    """Lookup join: each left row gets the columns of the one right row with its key, under a prefix.

    A missing key, and track_id 0, never match.  Duplicate right keys are refused.  Unmatched rows get
    NaN in numeric and "" in text columns; how=inner drops them.
    """
    keys = [*JOIN_KEYS.get(on, names(on))]
    if "b" in left.columns and "b" in right.columns:
        keys = ["b", *keys]
    need(left, *keys)
    need(right, *keys)
    usable = lambda d, k: (F.when(F.col(k) > 0, F.col(k)) if k == "track_id" else key(k, kind(d, k)))
    carried = [c for c in right.columns if c not in keys and c not in COORDS]
    clash = [prefix + c for c in carried if prefix + c in left.columns]
    if clash:
        raise Refusal(f"the join would name columns twice: {', '.join(clash)}; choose another prefix")
    r = right.select(*[usable(right, k).alias(f"_r{i}") for i, k in enumerate(keys)], *[F.col(c).alias(prefix + c) for c in carried])
    for i in range(len(keys)):
        r = r.where(F.col(f"_r{i}").isNotNull())
    if check:
        twice = r.groupBy(*[f"_r{i}" for i in range(len(keys))]).count().where("count > 1").limit(1).collect()
        if twice:
            raise Refusal(f"the right table has several rows for one key {tuple(twice[0])[:-1]}")
    hit = r.withColumn("_hit", F.lit(True))
    on_ = [usable(left, k) == F.col(f"_r{i}") for i, k in enumerate(keys)]
    out = left.join(hit, on_, "left" if how == "left" else "inner")
    fill = []
    for c in carried:
        n = prefix + c
        t = kind(right, c)
        if t == "string":
            fill.append(F.coalesce(F.col(n), F.lit("")).alias(n))
        elif t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"):
            fill.append((or_nan(F.col(n).cast("double")) if how == "left" else F.col(n).cast("double")).alias(n))
        else:
            fill.append(F.col(n))
    return out.select(*left.columns, *fill)


def concat(tables: Sequence[DataFrame], labels: Sequence[str] | None = None) -> DataFrame:
    """Rows of all tables under one schema, with `condition` and `input`; ids shifted past those before.

    Columns that a table lacks are NaN or "" there.  condition_value is added if every label is a number.
    """
    labels = list(labels or [str(i) for i in range(len(tables))])
    if len(labels) != len(tables):
        raise Refusal(f"{len(labels)} labels for {len(tables)} tables")
    kinds = {len({"z"} & set(t.columns)) for t in tables}
    if len(kinds) > 1:
        raise Refusal("2-D and 3-D tables don't concatenate")
    numeric = all(re.fullmatch(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*", x) for x in labels)
    out, shift = None, 0
    for i, (t, lab) in enumerate(zip(tables, labels)):
        t = t.withColumn("condition", F.lit(lab)).withColumn("input", F.lit(i).cast("long"))
        if numeric:
            t = t.withColumn("condition_value", F.lit(float(lab)))
        if "id" in t.columns:
            most = t.agg(F.max("id")).first()[0] if i + 1 < len(tables) else None
            t = t.withColumn("id", (F.col("id") + shift).cast("long"))
            shift += int(most or 0)
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    fill = [(F.coalesce(c, F.lit("")) if k == "string" else or_nan(F.col(c).cast("double")) if k in ("double", "float") else F.col(c)).alias(c) for c, k in out.dtypes]
    return out.select(*fill)


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def condition(column: str, op: str, value: float | str | None = None, kind_: str = "double") -> Column:
    """A test that a missing value never passes, but for is_nan (not finite); null counts as false.

    Comparisons are plain ones between the column and a literal, so that they reach the scan: as NaN
    sorts above infinity, one more comparison keeps NaN and infinities out.
    """
    if op in ("is_finite", "is_nan"):
        ok = finite(column).isNotNull()
        return ok if op == "is_finite" else ~ok
    c = F.col(column)
    if kind_ in INTEGRAL and isinstance(value, (int, float)) and float(value).is_integer():
        value = int(value)
    v = F.lit(value)
    test = {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "==": c == v, "!=": c != v}[op]
    if kind_ == "string":
        return test & (c != "")
    if kind_ in ("double", "float") and op != "==":
        above, below = c > float("-inf"), c < float("inf")
        return test & (below if op[0] == ">" else above if op[0] == "<" else above & below)
    return test


def if_else(df: DataFrame, conditions: Sequence[tuple], match: str = "all") -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail) 1 to 4 conditions (column, op, value)."""
    if not 1 <= len(conditions) <= 4:
        raise Refusal("one to four conditions")
    need(df, *[c[0] for c in conditions])
    flag = None
    for c in conditions:
        test = condition(c[0], c[1], c[2] if len(c) > 2 else None, kind(df, c[0]))
        flag = test if flag is None else (flag & test if match == "all" else flag | test)
    return df.where(flag), df.where(~F.coalesce(flag, F.lit(False)))


SCOPES = {"plane": ("m", "t", "z", "c"), "volume": ("m", "t", "c"), "series": ("m", "c"), "dataset": ("c",)}


def scope_keys(df: DataFrame, scope: str) -> list[str]:
    return [k for k in ("b", *SCOPES[scope]) if k in df.columns]


def filter_labels(df: DataFrame, column: str, method: str = "otsu", keep: str = "above", scope: str = "dataset", level: float = 0.0, percentile: float = 50.0) -> DataFrame:
    """Rows whose value is at or beyond the cut of their own scope's population; adds `cut`.

    A scope without spread has no cut and loses all its rows, but for fixed and percentile cuts.
    """
    from .thresholds import group_levels

    need(df, column)
    keys = scope_keys(df, scope)
    if method == "fixed":
        return df.where(condition(column, ">=" if keep == "above" else "<=", float(level), kind(df, column))).withColumn("cut", F.lit(float(level)))
    d = df.withColumn("_v", finite(column))
    if method == "percentile":
        # a plane or series is of bounded size; a whole table is not
        cuts = percentiles(d, keys, "_v", {"cut": percentile / 100}) if scope == "dataset" else d.groupBy(*keys).agg(F.percentile("_v", percentile / 100).alias("cut"))
    else:
        cuts = group_levels(d, "_v", keys, method)
    d = d.join(cuts, keys) if keys else d.crossJoin(F.broadcast(cuts))
    side = F.col("_v") >= F.col("cut") if keep == "above" else F.col("_v") <= F.col("cut")
    return d.where(side).select(*df.columns, "cut")


def parse_ids(text: str) -> list[int]:
    """'3,7-9' as [3, 7, 8, 9]."""
    out: list[int] = []
    for part in names(text):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m:
            raise Refusal(f"{part!r} is no id or range")
        out += range(int(m[1]), int(m[2] or m[1]) + 1)
    return out


def parse_merges(text: str) -> dict[int, int]:
    """'5>3, 6>5' with chains resolved: {5: 3, 6: 3}; a cycle is refused."""
    step = {}
    for part in names(text):
        m = re.fullmatch(r"(\d+)\s*>\s*(\d+)", part)
        if not m:
            raise Refusal(f"{part!r} is no merge like 5>3")
        step[int(m[1])] = int(m[2])
    out = {}
    for a in step:
        seen, at = {a}, step[a]
        while at in step:
            if at in seen:
                raise Refusal(f"merges go round in a circle at {at}")
            seen.add(at)
            at = step[at]
        out[a] = at
    return out


def curate_objects(df: DataFrame, id_column: str = "id", drop: str = "", merge: str = "") -> DataFrame:
    """Drops the listed ids and renames merged ones; <id>_before keeps the old id.  Rows without an id stay."""
    need(df, id_column)
    gone, into = parse_ids(drop), parse_merges(merge)
    if set(into.values()) & set(gone):
        raise Refusal("ids are merged into a dropped id")
    i = F.col(id_column)
    out = df.where(i.isNull() | ~i.isin(gone)) if gone else df
    out = out.withColumn(f"{id_column}_before", i)
    if into:
        table = F.create_map(*[F.lit(x).cast("long") for p in into.items() for x in p])
        out = out.withColumn(id_column, F.coalesce(F.try_element_at(table, i.cast("long")), i))
    return out


def reduce_scalar(df: DataFrame, source: str, reducer: str = "mean", name: str = "score") -> DataFrame:
    """One row, one column: a reducer over all values; over none, count and sum are 0 and the others NaN."""
    need(df, source)
    return df.agg(reduce_column(reducer, source).cast("double").alias(name))


def values(df: DataFrame, op: str, a: str, b: str | float | None = None, name: str = "", a_unit: str | None = None, b_unit: str | None = None, scale: float = 1.0) -> DataFrame:
    """A column of a op b; units are checked when the plan is built and kept in the column's metadata."""
    need(df, a)
    unit = {f.name: f.metadata.get("unit") for f in df.schema.fields}
    ua = Unit.parse(a_unit if a_unit is not None else unit.get(a))
    ub = Unit.parse(b_unit if b_unit is not None else unit.get(b) if isinstance(b, str) else None)
    x = finite(a)
    y = finite(b) if isinstance(b, str) else finite(F.lit(float(b if b is not None else 1.0)))
    out_unit = ua
    if op in ("add", "subtract", "min", "max"):
        if ua and ub:
            y = y * ub.to(ua)
        both = x.isNotNull() & y.isNotNull()
        r = {"add": x + y, "subtract": x - y, "min": F.when(both, F.least(x, y)), "max": F.when(both, F.greatest(x, y))}[op]
    elif op == "multiply":
        r, out_unit = x * y, ua.times(ub) if ua and ub else ua
    elif op == "divide":
        r, out_unit = F.try_divide(x, y), ua.times(ub, -1) if ua and ub else ua
    elif op == "power":
        if ub and not ub.plain:
            raise UnitError("an exponent has no unit")
        r, out_unit = F.pow(x, y), ua.power(b) if ua and isinstance(b, (int, float)) else None
    elif op == "abs":
        r = F.abs(x)
    elif op == "sqrt":
        r, out_unit = F.when(x >= 0, F.sqrt(x)), ua.power(0.5) if ua else None
    elif op == "log10":
        if ua and not ua.plain:
            raise UnitError("log10 needs a number without a unit")
        r = F.when(x > 0, F.log10(x))
    elif op == "to_physical":
        r, out_unit = x * float(scale), Unit.parse("um")
    elif op == "to_pixels":
        r, out_unit = F.try_divide(x, F.lit(float(scale))), Unit.parse("px")
    else:
        raise Refusal(f"unknown operation {op!r}")
    n = name or f"{a}_{op}"
    return df.withColumn(n, or_nan(finite(r)).alias(n, metadata={"unit": str(out_unit)} if out_unit else {}))


def image(df: DataFrame, other: DataFrame | float, op: str) -> DataFrame:
    """Pixelwise operation with another voxel table (axes it lacks are broadcast) or a number; x / 0 is NaN."""
    axes = [a for a in ("b", "m", "t", "z", "c", "y", "x") if a in df.columns]
    if isinstance(other, DataFrame):
        on = [a for a in axes if a in other.columns]
        d = df.join(other.select(*on, num("value").alias("_o")), on)
        y = F.col("_o")
    else:
        d, y = df, F.lit(float(other))
    x = num("value")
    r = {
        "add": x + y, "subtract": x - y, "multiply": x * y, "divide": divide(x, y), "min": F.least(x, y), "max": F.greatest(x, y), "difference": F.abs(x - y), "mean": (x + y) / 2,
    }[op]
    return d.select(*axes, r.alias("value"))


def mask_math(a: DataFrame, b: DataFrame | None, op: str, frame: DataFrame | None = None) -> DataFrame:
    """Set operations on voxel masks given as key rows; invert needs the frame's keys."""
    keys = a.columns
    if op in ("union", "xor"):
        # one shuffle, without a table of each map task's keys, which hardly repeat; as many partitions as the input's size asks, so that a task's share does not grow
        both = a.withColumn("_s", F.lit(1)).union(b.select(*keys).withColumn("_s", F.lit(2)))
        size = int(str(both._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(parts, min(size >> 21, 5_000)) if size < 1 << 44 else parts  # Spark says 8 EB where it does not know
        sides = both.repartition(parts, *keys).groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
        return (sides.where("_s < 3") if op == "xor" else sides).drop("_s")
    a = a.distinct()
    if op == "invert":
        return frame.select(*keys).distinct().join(a, keys, "left_anti")
    b = b.select(*keys).distinct()
    if op == "intersect":
        return a.join(b, keys, "left_semi")
    if op == "subtract":
        return a.join(b, keys, "left_anti")
    raise Refusal(f"unknown operation {op!r}")


