"""Series behind plots, and the statistics reported with them; each an aggregation, ready to draw."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import Refusal, need
from ..functions import special
from ..functions.missing import finite, or_nan
from ..functions.reducers import reduce_column
from .ordered import percentiles, running


def half_width(error: str, sd: Column, n: Column) -> Column:
    """Error bar of a mean: 0 below two values; ci95 by Student's t, from a table of quantiles up to 200 degrees and the normal limit beyond."""
    if error == "none":
        return F.lit(0.0)
    if error == "sd":
        w = sd
    else:
        w = sd / F.sqrt(n)
        if error == "ci95":
            q = F.array(*[F.lit(special.t_quantile(0.975, d)) for d in range(1, 201)])
            df = (n - 1).cast("double")
            z = 1.959963984540054
            # beyond the table: the expansion of t about the normal quantile
            tail = F.lit(z) + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
            w = w * F.when(n <= 201, F.try_element_at(q, F.greatest(n - 1, F.lit(1)).cast("int"))).otherwise(tail)
    return F.when(n < 2, 0.0).otherwise(w)


def xy(df: DataFrame, x: str, y: str, group_by: Sequence[str] = (), error: str = "sem") -> DataFrame:
    """Mean, error and n of y at each x of each group."""
    need(df, x, y, *group_by)
    d = df.select(*group_by, F.col(x).alias("x"), finite(y).alias("_y")).where("_y is not null and x is not null")
    out = d.groupBy(*group_by, "x").agg(F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("_sd"), F.count("_y").alias("n"))
    return out.withColumn("error", F.coalesce(half_width(error, F.col("_sd"), F.col("n")), F.lit(0.0))).drop("_sd")


def pooled(df: DataFrame, keys: Sequence[str], n: str = "n", mean: str = "mean", sd: str = "sd") -> DataFrame:
    """Rows (n, mean, sd) of parts recombined to the mean and sd of the whole."""
    total = F.sum(n)
    m = F.sum(F.col(n) * F.col(mean)) / total
    square = F.sum((F.col(n) - 1) * F.col(sd) * F.col(sd) + F.col(n) * F.col(mean) * F.col(mean))
    return df.groupBy(*keys).agg(total.alias("n"), m.alias("mean"), F.when(total > 1, F.sqrt(F.greatest((square - total * m * m) / (total - 1), F.lit(0.0)))).alias("sd"))


def linear_fit(df: DataFrame, x: str, y: str, group_by: Sequence[str] = (), log_x: bool = False, log_y: bool = False) -> DataFrame:
    """slope, intercept, r2, n in plotted coordinates; no row below two points or one distinct x."""
    fx, fy = finite(x), finite(y)
    px = F.when(fx > 0, F.log10(fx)) if log_x else fx
    py = F.when(fy > 0, F.log10(fy)) if log_y else fy
    d = df.select(*group_by, px.alias("_x"), py.alias("_y")).where("_x is not null and _y is not null")
    out = d.groupBy(*group_by).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_syy("_y", "_x").alias("_s"), F.corr("_x", "_y").alias("_r"), F.count(F.lit(1)).alias("n"))
    return out.where("n >= 2 and slope is not null").withColumn("r2", F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_r") * F.col("_r"))).drop("_s", "_r")


def exponential_fit(df: DataFrame, x: str, y: str, group_by: Sequence[str] = (), min_y: float = 0.0) -> DataFrame:
    """A exp(k x) by least squares on ln y: amplitude, rate, length -1/k."""
    d = df.select(*group_by, finite(x).alias("_x"), finite(y).alias("_y")).where(f"_x is not null and _y > 0 and _y >= {min_y}")
    out = d.groupBy(*group_by).agg(F.regr_slope(F.log("_y"), F.col("_x")).alias("rate"), F.regr_intercept(F.log("_y"), F.col("_x")).alias("_a"), F.count(F.lit(1)).alias("n"))
    return out.where("rate is not null").withColumn("amplitude", F.exp("_a")).withColumn("length", F.try_divide(F.lit(-1.0), F.col("rate"))).drop("_a")


def timeseries(df: DataFrame, value: str, group_by: Sequence[str] = (), dt: float = 1.0, error: str = "sem") -> DataFrame:
    out = xy(df, "t", value, group_by, error)
    return out.withColumn("time", F.col("x") * float(dt))


def frame_times(frames: DataFrame, dt: float | None = None) -> DataFrame:
    """time of each frame: by clock (Julian days from the first), else its own seconds, else t * dt, else t."""
    jd0 = F.min("frame_time_jd").over(Window.partitionBy(F.lit(0))) if "frame_time_jd" in frames.columns else None
    if jd0 is not None:
        return frames.withColumn("time", (F.col("frame_time_jd") - jd0) * 86400)
    if "frame_time_s" in frames.columns:
        return frames.withColumn("time", F.col("frame_time_s"))
    return frames.withColumn("time", F.col("t") * float(dt) if dt else F.col("t").cast("double"))


def time_unit(seconds: float) -> tuple[str, float]:
    return ("s", 1.0) if seconds < 90 else ("min", 60.0) if seconds < 5400 else ("h", 3600.0)


def histogram(df: DataFrame, value: str, group_by: Sequence[str] = (), bins: int = 30, normalize: str = "count") -> DataFrame:
    """Counts (or density, or percent) of each group in bins shared by all groups: bin, left, right, value."""
    d = df.select(*group_by, finite(value).alias("_v")).where("_v is not null")
    ends = d.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))  # one row
    d = d.crossJoin(F.broadcast(ends))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins)
    at = F.least(F.floor((F.col("_v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    h = d.withColumn("_w", width).groupBy(*group_by, at.alias("bin"), "lo", "_w").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*group_by)) if group_by else F.sum("count").over(Window.partitionBy(F.lit(0)))
    v = {"count": F.col("count").cast("double"), "density": F.col("count") / (total * F.col("_w")), "percent": 100.0 * F.col("count") / total}[normalize]
    return h.select(*group_by, "bin", (F.col("lo") + F.col("bin") * F.col("_w")).alias("left"), (F.col("lo") + (F.col("bin") + 1) * F.col("_w")).alias("right"), v.alias("value"))


def box(df: DataFrame, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, and the number beyond."""
    d = df.select(*group_by, finite(value).alias("_v")).where("_v is not null")
    q, n = percentiles(d, group_by, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75}), d.groupBy(*group_by).agg(F.count(F.lit(1)).alias("n"))
    q = q.join(n, list(group_by)) if group_by else q.crossJoin(F.broadcast(n))
    d = d.join(q, list(group_by)) if group_by else d.crossJoin(F.broadcast(q))
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(lo, hi)
    return d.groupBy(*group_by, "q1", "median", "q3", "n").agg(F.min(F.when(inside, F.col("_v"))).alias("low"), F.max(F.when(inside, F.col("_v"))).alias("high"), F.sum((~inside).cast("long")).alias("outliers"))


def ecdf(df: DataFrame, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Share of each group's values at or below each distinct value; counts are combined before they are ordered."""
    d = df.select(*group_by, finite(value).alias("x")).where("x is not null").groupBy(*group_by, "x").agg(F.count(F.lit(1)).alias("_n"))
    d = running(d, group_by, ["x"], "x", "_n", "_upto", "_total")
    return d.select(*group_by, "x", (F.col("_upto") / F.col("_total")).alias("share"))


def kde(df: DataFrame, value: str, group_by: Sequence[str] = (), points: int = 128) -> DataFrame:
    """Gaussian density of each group on a grid over its range, bandwidth by Scott's rule.

    Values are first counted on a fine grid (1024 cells), so the sum at each point has a fixed number of terms.
    """
    cells = 1024
    d = df.select(*group_by, finite(value).alias("_v")).where("_v is not null")
    s = d.groupBy(*group_by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.stddev_samp("_v").alias("sd"), F.count(F.lit(1)).alias("n")).where("n > 1 and sd > 0")
    s = s.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    d = d.join(s, list(group_by)) if group_by else d.crossJoin(F.broadcast(s))
    step = (F.col("hi") - F.col("lo")) / cells
    h = d.withColumn("_c", F.least(F.floor((F.col("_v") - F.col("lo")) / step), F.lit(cells - 1))).groupBy(*group_by, "_c", "lo", "hi", "bw", "n").agg(F.count(F.lit(1)).alias("_k"))
    h = h.withColumn("_x", F.col("lo") + (F.col("_c") + 0.5) * (F.col("hi") - F.col("lo")) / cells)
    h = h.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") - 3 * F.col("bw") + F.col("_i") * (F.col("hi") - F.col("lo") + 6 * F.col("bw")) / (points - 1))
    z = (F.col("x") - F.col("_x")) / F.col("bw")
    return h.groupBy(*group_by, "_i").agg(F.max("x").alias("x"), F.sum(F.col("_k") * F.exp(-z * z / 2) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density")).drop("_i")


def heatmap(df: DataFrame, row: str, column: str, value: str, reducer: str = "mean") -> DataFrame:
    """row, column, value, n of each cell that has finite values; the spread of one value is 0."""
    d = df.select(F.col(row).alias("row"), F.col(column).alias("column"), finite(value).alias("_v")).where("_v is not null")
    v = F.coalesce(F.stddev_samp("_v"), F.lit(0.0)) if reducer == "std" else reduce_column(reducer, "_v").cast("double")
    return d.groupBy("row", "column").agg(v.alias("value"), F.count(F.lit(1)).alias("n"))


def heatmap_pivot(df: DataFrame, row: str, column: str, value: str, columns: Sequence, reducer: str = "mean") -> DataFrame:
    """The same as a table with one column for each of the given column values."""
    h = heatmap(df, row, column, value, reducer)
    return h.groupBy("row").pivot("column", list(columns)).agg(F.max("value"))


def field_limits(df: DataFrame, value: str, low: float = 2.0, high: float = 98.0, keys: Sequence[str] = ("m", "t")) -> DataFrame:
    """Colour limits of each frame."""
    own = [k for k in keys if k in df.columns]
    return df.groupBy(*own).agg(F.percentile(finite(value), low / 100).alias("low"), F.percentile(finite(value), high / 100).alias("high"))


def bar_series(df: DataFrame, category: str, value: str, group_by: Sequence[str] = (), error: str = "sem") -> DataFrame:
    return xy(df, category, value, group_by, error).withColumnRenamed("x", category)


def strip_series(df: DataFrame, category: str, value: str, width: float = 0.3) -> DataFrame:
    """Raw values with a sideways place from a hash of the row, the same in every run."""
    place = (F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(10_000)) / 10_000 - 0.5) * width
    return df.select(category, finite(value).alias("value"), place.alias("jitter")).where("value is not null")


def superplot_series(df: DataFrame, category: str, replicate: str, value: str) -> DataFrame:
    """Mean of each replicate, and over replicates their mean, sem and number."""
    means = df.select(category, replicate, finite(value).alias("_v")).where("_v is not null").groupBy(category, replicate).agg(F.avg("_v").alias("replicate_mean"))
    w = Window.partitionBy(category)
    n = F.count(F.lit(1)).over(w)
    return means.withColumn("mean", F.avg("replicate_mean").over(w)).withColumn("replicates", n).withColumn("sem", F.coalesce(F.stddev_samp("replicate_mean").over(w) / F.sqrt(n), F.lit(0.0)))


def rose_series(df: DataFrame, angle: str, bins: int = 12, weight: str | None = None) -> DataFrame:
    """Weights of angles (degrees) in equal sectors."""
    d = df.select(finite(angle).alias("_a"), (finite(weight) if weight else F.lit(1.0)).alias("_w")).where("_a is not null and _w is not null")
    sector = F.floor(F.pmod(F.col("_a"), F.lit(360.0)) / (360.0 / bins)).cast("int")
    return d.groupBy(sector.alias("sector")).agg(F.sum("_w").alias("weight"))


def hexbin_series(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Counts in hexagons: each point goes to the nearer of two rectangular lattices."""
    d = df.select((finite(x) / size).alias("_x"), (finite(y) / (size * math.sqrt(3))).alias("_y")).where("_x is not null and _y is not null")
    ax, ay = F.rint("_x"), F.rint("_y")
    bx, by = F.floor("_x") + 0.5, F.floor("_y") + 0.5
    da = F.pow(F.col("_x") - ax, 2) + 3 * F.pow(F.col("_y") - ay, 2)
    db = F.pow(F.col("_x") - bx, 2) + 3 * F.pow(F.col("_y") - by, 2)
    d = d.select(F.when(da < db, ax).otherwise(bx).alias("hx"), F.when(da < db, ay).otherwise(by).alias("hy"))
    return d.groupBy("hx", "hy").agg(F.count(F.lit(1)).alias("count")).select((F.col("hx") * size).alias("x"), (F.col("hy") * size * math.sqrt(3)).alias("y"), "count")


def normalize_series(df: DataFrame, y: str, x: str, series: Sequence[str], method: str = "max") -> DataFrame:
    w = Window.partitionBy(*series)
    v = F.col(y)
    if method == "first":
        first = F.first(y).over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return df.withColumn(y, or_nan(F.try_divide(v, first)))
    if method == "max":
        return df.withColumn(y, or_nan(F.try_divide(v, F.max(y).over(w))))
    lo, hi = F.min(y).over(w), F.max(y).over(w)
    return df.withColumn(y, or_nan(F.try_divide(v - lo, hi - lo)))


def survival(df: DataFrame, duration: str, event: str | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """Kaplan-Meier: at each event time the number at risk, events, and the share surviving; censored rows leave the risk set."""
    hit = F.col(event).cast("int") if event else F.lit(1)
    d = df.select(*group_by, finite(duration).alias("time"), hit.alias("_e")).where("time is not null")
    at = d.groupBy(*group_by, "time").agg(F.count(F.lit(1)).alias("_n"), F.sum("_e").alias("events"))
    w = Window.partitionBy(*group_by) if group_by else Window.partitionBy(F.lit(0))
    at = at.withColumn("at_risk", F.sum("_n").over(w.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0))).where("events > 0")
    step = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk")))
    run = w.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    dead = F.max((F.col("events") >= F.col("at_risk")).cast("int")).over(run)
    at = at.withColumn("survival", F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(step).over(run))))
    return at.drop("_n")


def median_survival(curve: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    return curve.where("survival <= 0.5").groupBy(*group_by).agg(F.min("time").alias("median"))


def msd(df: DataFrame, max_lag: int, axes: Sequence[str] = ("y", "x"), track: str = "track_id") -> DataFrame:
    """Mean squared displacement by lag over all pairs of one track, by an equi-join per lag; n pairs."""
    d = df.where(F.col(track) > 0).select(track, "t", *axes)
    lags = d.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("_t", F.col("t") + F.col("lag"))
    later = d.select(F.col(track), F.col("t").alias("_t"), *[F.col(a).alias(f"_{a}") for a in axes])
    pairs = lags.join(later, [track, "_t"])
    square = sum((F.pow(F.col(f"_{a}") - F.col(a), 2) for a in axes), F.lit(0.0))
    return pairs.groupBy("lag").agg(F.avg(square).alias("msd"), F.count(F.lit(1)).alias("n"))


def power_fit(curve: DataFrame, least: int = 10) -> DataFrame:
    """Exponent and factor of msd = D lag^alpha over lags with enough pairs."""
    d = curve.where((F.col("n") >= least) & (F.col("msd") > 0))
    return d.agg(F.regr_slope(F.log("msd"), F.log(F.col("lag").cast("double"))).alias("alpha"), F.exp(F.regr_intercept(F.log("msd"), F.log(F.col("lag").cast("double")))).alias("factor"))


def ranks(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Average ranks of ties; values are counted before they are ordered, so equal values travel once."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    c = running(c, keys, [value], value, "_c", "_upto").select(*keys, value, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(c, [*keys, value])


def correlation(df: DataFrame, x: str, y: str, method: str = "pearson", group_by: Sequence[str] = ()) -> DataFrame:
    d = df.select(*group_by, finite(x).alias("_x"), finite(y).alias("_y")).where("_x is not null and _y is not null")
    if method == "spearman":
        d = ranks(ranks(d, "_x", group_by, "_rx"), "_y", group_by, "_ry").select(*group_by, F.col("_rx").alias("_x"), F.col("_ry").alias("_y"))
    return d.groupBy(*group_by).agg(or_nan(F.corr("_x", "_y")).alias("r"), F.count(F.lit(1)).alias("n"))


def moments(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.select(F.col(group).alias("group"), finite(value).alias("_v")).where("_v is not null").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.var_samp("_v").alias("var"))


def compare(df: DataFrame, value: str, group: str, test: str = "welch", pair_by: str | None = None, most_groups: int = 200) -> list[dict]:
    """Tests between groups: welch, student, mann_whitney, paired, wilcoxon over all pairs; kruskal, anova over all at once; tukey.

    Only counts, means, variances and rank sums leave the cluster, one row a group (or pair); p is NaN
    where there is too little data.
    """
    d = df.select(F.col(group).alias("group"), finite(value).alias("v"), *([F.col(pair_by).alias("pair")] if pair_by else [])).where("v is not null")
    rows = sorted(moments(df, value, group).limit(most_groups + 1).collect(), key=lambda r: str(r["group"]))
    if len(rows) > most_groups:
        raise Refusal(f"more than {most_groups} groups")
    n, mean, var = ({r["group"]: r[k] for r in rows} for k in ("n", "mean", "var"))
    names = list(n)
    pairs = list(itertools.combinations(names, 2))
    out = []
    if test in ("welch", "student", "tukey"):
        total, k = sum(n.values()), len(names)
        within = sum((n[g] - 1) * (var[g] or 0) for g in names) / (total - k) if total > k else math.nan
        for a, b in pairs:
            if min(n[a], n[b]) < 2:
                out.append({"a": a, "b": b, "statistic": math.nan, "p": math.nan})
                continue
            if test == "tukey":
                s = math.sqrt(within / 2 * (1 / n[a] + 1 / n[b]))
                q = abs(mean[a] - mean[b]) / s if s else math.nan
                out.append({"a": a, "b": b, "statistic": q, "p": special.studentized_range_tail(q, k, total - k)})
                continue
            sa, sb = var[a] / n[a], var[b] / n[b]
            if test == "student":
                dof = n[a] + n[b] - 2
                s = math.sqrt(((n[a] - 1) * var[a] + (n[b] - 1) * var[b]) / dof * (1 / n[a] + 1 / n[b]))
            else:
                s = math.sqrt(sa + sb)
                dof = (sa + sb) ** 2 / (sa**2 / (n[a] - 1) + sb**2 / (n[b] - 1)) if s else math.nan
            stat = (mean[a] - mean[b]) / s if s else math.nan
            out.append({"a": a, "b": b, "statistic": stat, "p": special.t_two_sided(stat, dof)})
        return out
    if test == "anova":
        total, k = sum(n.values()), len(names)
        grand = sum(n[g] * mean[g] for g in names) / total if total else math.nan
        between = sum(n[g] * (mean[g] - grand) ** 2 for g in names) / max(1, k - 1)
        inner = sum((n[g] - 1) * (var[g] or 0) for g in names) / (total - k) if total > k else math.nan
        f = between / inner if inner else math.nan
        return [{"a": None, "b": None, "statistic": f, "p": special.f_tail(f, k - 1, total - k)}]
    if test in ("kruskal", "mann_whitney"):
        chosen = [None] if test == "kruskal" else pairs
        for p in chosen:
            own = d if p is None else d.where(F.col("group").isin(*p))
            r = ranks(own.select("group", "v"), "v")
            sums = {x["group"]: (x["n"], x["s"]) for x in r.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("s")).collect()}
            ties = own.groupBy("v").count().agg(F.sum(F.pow(F.col("count"), 3) - F.col("count"))).first()[0] or 0.0
            total = sum(x[0] for x in sums.values())
            if p is None:
                h = 12 / (total * (total + 1)) * sum(s * s / m for m, s in sums.values()) - 3 * (total + 1) if total > 1 else math.nan
                h /= (1 - ties / (total**3 - total)) or math.nan
                out.append({"a": None, "b": None, "statistic": h, "p": special.chi2_tail(h, len(sums) - 1) if len(sums) > 1 else math.nan})
            else:
                (na, sa), (nb, _) = sums.get(p[0], (0, 0.0)), sums.get(p[1], (0, 0.0))
                u = sa - na * (na + 1) / 2
                sd = math.sqrt(na * nb / 12 * (total + 1 - ties / (total * (total - 1)))) if total > 1 else 0.0
                z = (abs(u - na * nb / 2) - 0.5) / sd if sd else math.nan
                out.append({"a": p[0], "b": p[1], "statistic": u, "p": min(1.0, special.normal_two_sided(max(z, 0.0))) if sd else math.nan})
        return out
    if test in ("paired", "wilcoxon"):
        for a, b in pairs:
            both = d.where(F.col("group") == F.lit(a)).select("pair", F.col("v").alias("va")).join(d.where(F.col("group") == F.lit(b)).select("pair", F.col("v").alias("vb")), "pair").withColumn("d", F.col("va") - F.col("vb"))
            if test == "paired":
                m = both.agg(F.count(F.lit(1)), F.avg("d"), F.stddev_samp("d")).first()
                stat = m[1] / (m[2] / math.sqrt(m[0])) if m[0] > 1 and m[2] else math.nan
                out.append({"a": a, "b": b, "statistic": stat, "p": special.t_two_sided(stat, m[0] - 1)})
            else:
                r = ranks(both.where("d != 0").withColumn("ad", F.abs("d")).select("d", "ad"), "ad")
                m = r.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)), F.coalesce(F.sum(F.col("rank") * F.col("rank")), F.lit(0.0))).first()
                k, w, square = m
                sd = math.sqrt(square / 4) if square else 0.0
                z = (w - k * (k + 1) / 4) / sd if sd else math.nan
                out.append({"a": a, "b": b, "statistic": min(w, k * (k + 1) / 2 - w), "p": special.normal_two_sided(z) if sd else math.nan})
        return out
    raise Refusal(f"unknown test {test!r}")


def stars(p: float) -> str:
    return "n/a" if math.isnan(p) else next((s for cut, s in ((1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (0.05, "*")) if p <= cut), "ns")


def bracket_levels(spans: Sequence[tuple[int, int]]) -> list[int]:
    """Heights for brackets over categories, so that none crosses another: the lowest free one, short brackets first."""
    taken: list[list[tuple[int, int]]] = []
    out = [0] * len(spans)
    for i in sorted(range(len(spans)), key=lambda i: (abs(spans[i][1] - spans[i][0]), min(spans[i]))):
        a, b = sorted(spans[i])
        level = next((n for n, row in enumerate(taken) if all(b <= x or a >= y for x, y in row)), len(taken))
        if level == len(taken):
            taken.append([])
        taken[level].append((a, b))
        out[i] = level
    return out


def reslice(voxels: DataFrame, axis: str, at: int) -> DataFrame:
    return voxels.where(F.col(axis) == at).drop(axis)


def coded_projection(voxels: DataFrame) -> DataFrame:
    """Brightest value along z and the plane that has it (the lowest of several)."""
    keys = [k for k in ("b", "m", "t", "c", "y", "x") if k in voxels.columns]
    return voxels.groupBy(*keys).agg(F.max(F.struct(F.col("value"), (-F.col("z")).alias("neg"))).alias("_t")).select(*keys, F.col("_t.value").alias("value"), (-F.col("_t.neg")).alias("z"))


def profile(voxels: DataFrame, y0: float, x0: float, y1: float, x1: float, points: int) -> DataFrame:
    """Nearest values at evenly spaced places of a line, for each frame (a kymograph, with t kept)."""
    spark = voxels.sparkSession
    ts = np.linspace(0, 1, points)
    line = spark.createDataFrame([(i, int(np.rint(y0 + (y1 - y0) * s)), int(np.rint(x0 + (x1 - x0) * s))) for i, s in enumerate(ts)], "place int, y long, x long")
    return voxels.join(F.broadcast(line), ["y", "x"])  # the line's points are a parameter's count


def coloc(a: DataFrame, b: DataFrame, ta: float | None = None, tb: float | None = None, keys: Sequence[str] = ("m", "t", "z", "y", "x")) -> DataFrame:
    """Pearson's r and Manders' M1, M2 of two channels, with Otsu's levels where none are given."""
    from .thresholds import group_levels

    on = [k for k in keys if k in a.columns and k in b.columns]
    d = a.select(*on, finite("value").alias("va")).join(b.select(*on, finite("value").alias("vb")), on)
    level = lambda c, t: F.lit(float(t)).alias("l" + c) if t is not None else None
    for c, tcut in (("va", ta), ("vb", tb)):
        fixed = level(c, tcut)
        d = d.withColumn("l" + c, fixed) if fixed is not None else d.crossJoin(F.broadcast(group_levels(d, c, [], "otsu").select(F.col("cut").alias("l" + c))))
    share = lambda v, other, cut: F.try_divide(F.sum(F.when(F.col(other) > F.col(cut), F.col(v))), F.sum(v))
    return d.agg(or_nan(F.corr("va", "vb")).alias("pearson"), or_nan(share("va", "vb", "lvb")).alias("m1"), or_nan(share("vb", "va", "lva")).alias("m2"))
