"""Histogram thresholds as window sums over binned counts, one level a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def li_level(x: np.ndarray, n: np.ndarray) -> float:
    """The level that equals the logarithmic mean of the means on its two sides, for n values at each of x."""
    low = x.min()
    v, t = x - low, (x * n).sum() / n.sum() - low
    for _ in range(1000):
        a, b = n[v > t] @ v[v > t], n[v <= t] @ v[v <= t]
        na, nb = n[v > t].sum(), n[v <= t].sum()
        if not na or not nb or b <= 0:
            break
        hi, lo = a / na, b / nb
        new = (hi - lo) / (np.log(hi) - np.log(lo)) if hi > lo > 0 else t
        if abs(new - t) < 1e-9:
            break
        t = new
    return float(t + low)


def li_levels(x: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([li_level(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(x, n)])


def histogram(df: DataFrame, value: str, keys: list[str], bins: int = BINS) -> DataFrame:
    """keys, bin, n, center, lo, hi: counts over `bins` even bins between each group's least and greatest value."""
    d = df.where(F.col(value).isNotNull())
    ends = d.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    d = d.join(ends, keys) if keys else d.crossJoin(F.broadcast(ends))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    d = d.withColumn("bin", F.when(F.col("hi") > F.col("lo"), at).otherwise(0))
    h = d.groupBy(*keys, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("center", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)


def group_levels(df: DataFrame, value: str, keys: list[str], method: str) -> DataFrame:
    """keys, cut: the level by which a group's values divide; groups without spread have none.

    Levels come from 256 counts a group, so groups of any size cost one combining aggregation; otsu, yen
    and triangle are running sums over those counts, li iterates on them.
    """
    if method == "mean":
        return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("cut"), F.min(value).alias("a"), F.max(value).alias("b")).where("a < b").drop("a", "b")
    h = histogram(df, value, keys).where("hi > lo")
    w = Window.partitionBy(*keys).orderBy("bin") if keys else Window.orderBy("bin")
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    if method == "otsu":
        n0 = F.sum("n").over(w)
        s0 = F.sum(F.col("n") * F.col("center")).over(w)
        n, s = F.sum("n").over(every), F.sum(F.col("n") * F.col("center")).over(every)
        h = h.withColumn("n0", n0).withColumn("s0", s0).withColumn("nn", n).withColumn("ss", s).where("n0 < nn")
        gap = F.col("s0") / F.col("n0") - (F.col("ss") - F.col("s0")) / (F.col("nn") - F.col("n0"))
        h = h.withColumn("score", F.col("n0") * (F.col("nn") - F.col("n0")) * gap * gap)
        return h.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("bin")).alias("k"), "center")).alias("top")).select(*keys, F.col("top.center").alias("cut"))
    if method == "yen":
        p = F.col("n") / F.sum("n").over(every)
        h = h.withColumn("p", p).withColumn("p1", F.sum("p").over(w)).withColumn("q1", F.sum(F.col("p") * F.col("p")).over(w)).withColumn("q", F.sum(F.col("p") * F.col("p")).over(every))
        h = h.where((F.col("q") - F.col("q1") > 1e-15) & (F.col("p1") < 1 - 1e-12))
        h = h.withColumn("score", -F.log(F.col("q1") * (F.col("q") - F.col("q1"))) + 2 * F.log(F.col("p1") * (1 - F.col("p1"))))
        return h.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("bin")).alias("k"), "center")).alias("top")).select(*keys, F.col("top.center").alias("cut"))
    if method == "triangle":
        peak = F.max(F.struct("n", (-F.col("bin")).alias("k"))).over(every)
        h = h.withColumn("pk", -peak["k"]).withColumn("pn", peak["n"]).withColumn("first", F.min("bin").over(every)).withColumn("last", F.max("bin").over(every))
        left = F.col("pk") - F.col("first") >= F.col("last") - F.col("pk")
        far = F.when(left, F.col("first")).otherwise(F.col("last"))
        side = F.when(left, F.col("bin") <= F.col("pk")).otherwise(F.col("bin") >= F.col("pk"))
        width = F.abs(far - F.col("pk"))
        dist = F.col("pn") * F.abs(F.col("bin") - far) - width * F.col("n")
        h = h.where(side).withColumn("score", dist)
        return h.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("bin")).alias("k"), "center")).alias("top")).select(*keys, F.col("top.center").alias("cut"))
    if method == "li":
        lists = h.groupBy(*keys).agg(F.collect_list("center").alias("x"), F.collect_list("n").alias("n"))
        return lists.select(*keys, F.pandas_udf(li_levels, "double")("x", "n").alias("cut"))
    raise ValueError(f"unknown method {method!r}")
