"""Model fits on tables: standard curves, point sources, gradient maps, clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..core import Refusal
from ..functions.missing import finite, or_nan
from ..functions.special import erfc


def standard_points(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """Weighted mean signal at each standard concentration; x <= 0 are blanks (with their sd and n)."""
    w = finite(weight) if weight else F.lit(1.0)
    d = df.select(F.when(finite(x) > 0, finite(x)).otherwise(0.0).alias("x"), finite(y).alias("_y"), w.alias("_w")).where("_y is not null and _w > 0")
    return d.groupBy("x").agg((F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).alias("y"), F.stddev_samp("_y").alias("sd"), F.count(F.lit(1)).alias("n"))


def langmuir_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bmax, Kd of y = Bmax x / (Kd + x) by Gauss-Newton steps on ln Kd, Bmax solved for in each."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    ok = (x > 0) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(x) < 2:
        raise Refusal("a Langmuir fit needs two standards above zero")

    def at(log_kd: float) -> tuple[float, float]:
        f = x / (math.exp(log_kd) + x)
        b = float(f @ y / (f @ f))
        return float(((y - b * f) ** 2).sum()), b

    grid = np.linspace(math.log(x.min()) - 7, math.log(x.max()) + 7, 400)
    i = int(np.argmin([at(g)[0] for g in grid]))
    lo, hi = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(100):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if at(a)[0] < at(b)[0] else (a, hi)
    k = (lo + hi) / 2
    return at(k)[1], math.exp(k)


def standard_curve(df: DataFrame, signal: str, standards: DataFrame | None = None, x: str = "x", y: str = "y", weight: str | None = None, model: str = "langmuir", typed: dict | None = None, name: str = "concentration", draws: int = 0, seed: int = 0) -> DataFrame:
    """Signals turned to concentrations by a fitted or typed curve, with a flag; draws > 0 adds a Monte-Carlo spread of the curve.

    Standards are first averaged on the cluster, one row a concentration; the fit sees those few rows.
    """
    if typed:
        p, top, low, lod, spread = typed, math.inf, 0.0, -math.inf, None
        pts = None
    else:
        pts = standard_points(standards, x, y, weight).orderBy("x").toPandas()
        blank, real = pts[pts.x <= 0], pts[pts.x > 0]
        if len(real) < 2:
            raise Refusal("the curve needs two standards above zero")
        if model == "langmuir":
            b, k = langmuir_fit(real.x.to_numpy(), real.y.to_numpy())
            p = {"bmax": b, "kd": k}
        else:
            s, i = np.polyfit(real.x, real.y, 1)
            p = {"slope": float(s), "intercept": float(i)}
        top, low = float(real.x.max()), float(real.x.min())
        lod = float(blank.y.iloc[0] + 3 * np.nan_to_num(blank.sd.iloc[0])) if len(blank) else -math.inf
        spread = real
    v = finite(signal)
    if model == "langmuir":
        inverse = F.when((v < p["bmax"]) & (v >= 0), F.lit(p["kd"]) * v / (F.lit(p["bmax"]) - v))
    else:
        inverse = F.try_divide(v - p["intercept"], F.lit(p["slope"]))
    c = F.col(name)
    over = v >= p["bmax"] if model == "langmuir" else F.lit(False)
    flag = F.when(v.isNull(), "no signal").when(over, "above Bmax").when(v < lod, "below LOD").when(c < low, "below range").when(c > top, "above range").otherwise("in range")
    out = df.withColumn(name, or_nan(inverse)).withColumn(f"{name}_flag", flag)
    if draws and spread is not None and model == "linear":
        rng = np.random.default_rng(seed)
        sd = np.nan_to_num((spread.sd / np.sqrt(spread.n)).to_numpy())
        fits = [np.polyfit(spread.x, spread.y + rng.normal(size=len(spread)) * sd, 1) for _ in range(draws)]
        lo, hi = np.percentile([f[0] for f in fits], [16, 84])
        out = out.withColumn(f"{name}_sd", F.abs(c) * float((hi - lo) / 2 / abs(p["slope"])))
    return out


def crank(r, tau, d: float, half_space: bool = False):
    """Concentration at r a time tau after a point source of rate 1 turned on."""
    r, tau = np.asarray(r, float), np.asarray(tau, float)
    with np.errstate(all="ignore"):
        c = erfc(r / (2 * np.sqrt(d * np.maximum(tau, 1e-300)))) / (4 * np.pi * d * r)
    c = np.where(tau > 0, c * (2 if half_space else 1), 0.0)
    return np.where(r > 0, c, np.nan)


def point_source_fit(df: DataFrame, value: str, distance: str = "distance_um", time: str = "t", group: Sequence[str] = (), d: float = 20.0, start: float = 0.0, half_space: bool = False, weight: str = "relative", bootstrap: int = 200, seed: int = 0) -> DataFrame:
    """Rate of a continuous point source by weighted least squares in each group, with a bootstrap spread; one task a group."""
    schema = ", ".join([f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group] + ["rate double", "rate_sd double", "r2 double", "n long"])
    cols = [*group, distance, time, value]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r, t, y = (pdf[c].to_numpy(float) for c in (distance, time, value))
        f = crank(r, t - start, d, half_space)
        ok = np.isfinite(f) & np.isfinite(y) & (f > 0)
        f, y = f[ok], y[ok]
        row = {g: pdf[g].iloc[0] for g in group}
        if len(f) < 2:
            return pd.DataFrame([row | {"rate": np.nan, "rate_sd": np.nan, "r2": np.nan, "n": len(f)}])
        w = {"relative": 1 / np.maximum(f * f, 1e-300), "sqrt": 1 / f, "absolute": np.ones_like(f)}[weight]
        solve = lambda i: float((w[i] * f[i] * y[i]).sum() / (w[i] * f[i] * f[i]).sum())
        every = np.arange(len(f))
        q = solve(every)
        rng = np.random.default_rng(seed)
        sd = float(np.std([solve(rng.choice(every, len(every))) for _ in range(bootstrap)])) if bootstrap else np.nan
        tot = ((y - y.mean()) ** 2).sum()
        return pd.DataFrame([row | {"rate": q, "rate_sd": sd, "r2": 1 - ((y - q * f) ** 2).sum() / tot if tot else 1.0, "n": len(f)}])

    d_ = df.select(*cols)
    return d_.groupBy(*group).applyInPandas(fit, schema) if group else d_.groupBy(F.lit(0).alias("_")).applyInPandas(fit, schema)


def idw_map(points: DataFrame, value: str, spacing: float, reach: float, power: float = 2.0, prior: float = 0.0, keys: Sequence[str] = ("m", "t")) -> DataFrame:
    """Inverse-distance field of ln(value) on a grid: points within reach of each node, met by a grid join; exp of the weighted mean.

    A point less than 1e-9 away decides alone.
    """
    from .spatial import within

    own = [k for k in keys if k in points.columns]
    p = points.select(*own, F.col("y"), F.col("x"), F.log(finite(value)).alias("v")).where("v is not null").withColumn("id", F.lit(0))
    box = p.groupBy(*own).agg(*[f(a).alias(f"{n}{a}") for a in ("y", "x") for n, f in (("lo", F.min), ("hi", F.max))])
    node = lambda a: F.explode(F.sequence(F.floor(F.col(f"lo{a}") / spacing).cast("long"), F.ceil(F.col(f"hi{a}") / spacing).cast("long")))
    nodes = box.withColumn("gy", node("y")).withColumn("gx", node("x")).select(*own, "gy", "gx", (F.col("gy") * spacing).alias("y"), (F.col("gx") * spacing).alias("x"))
    near = within(nodes, p, reach, on=own)
    w = F.pow(F.greatest("dist", F.lit(1e-9)), F.lit(-power))
    w0 = prior**-power if prior else 0.0
    out = near.groupBy(*own, "gy", "gx", "y", "x").agg((F.sum(w * F.col("v_r")) / (F.sum(w) + w0)).alias("_m"), F.min_by("v_r", "dist").alias("_n"), F.min("dist").alias("_d"), F.count(F.lit(1)).alias("n"))
    return out.select(*own, "gy", "gx", "y", "x", F.exp(F.when(F.col("_d") < 1e-9, F.col("_n")).otherwise(F.col("_m"))).alias("value"), "n")


def trend_map(points: DataFrame, value: str, distance: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Exponential trend of value over distance from a source, per group."""
    from .figure import exponential_fit

    return exponential_fit(points, distance, value, group_by)


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1)
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
    for _ in range(rounds):
        own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return own, c


def gmm(x: np.ndarray, k: int, seed: int = 0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Membership and Bayesian information criterion of a full-covariance Gaussian mixture."""
    n, d = x.shape
    own, c = kmeans(x, k, seed)
    cov = np.array([np.cov(x[own == i].T) if (own == i).sum() > d else np.cov(x.T) for i in range(k)]).reshape(k, d, d) + 1e-6 * np.eye(d)
    pi, last = np.bincount(own, minlength=k) / n, -np.inf
    for _ in range(rounds):
        logp = np.stack([np.log(pi[i] + 1e-300) - 0.5 * (np.einsum("ij,jk,ik->i", x - c[i], np.linalg.inv(cov[i]), x - c[i]) + np.linalg.slogdet(cov[i])[1] + d * math.log(2 * math.pi)) for i in range(k)], 1)
        top = logp.max(1, keepdims=True)
        like = float((top[:, 0] + np.log(np.exp(logp - top).sum(1))).sum())
        r = np.exp(logp - top)
        r /= r.sum(1, keepdims=True)
        w = r.sum(0) + 1e-12
        pi, c = w / n, (r.T @ x) / w[:, None]
        cov = np.array([((x - c[i]).T * r[:, i]) @ (x - c[i]) / w[i] for i in range(k)]) + 1e-6 * np.eye(d)
        if abs(like - last) < 1e-6 * abs(like):
            break
        last = like
    return r.argmax(1), (k * (1 + d + d * (d + 1) / 2) - 1) * math.log(n) - 2 * like


def cluster_points(df: DataFrame, n_clusters: int = 1, relax: float = 0.0, method: str = "gmm", axes: Sequence[str] = ("y", "x"), keys: Sequence[str] = ("m", "t", "c"), seed: int = 0) -> DataFrame:
    """cluster of each point of a frame: k-means, or the Gaussian mixture of best BIC with n_clusters +- relax percent."""
    own = [k for k in keys if k in df.columns]
    schema = StructType([*df.schema.fields, StructField("cluster", LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = pdf[list(axes)].to_numpy(float)
        lo, hi = math.floor(n_clusters * (1 - relax / 100)), math.ceil(n_clusters * (1 + relax / 100))
        ks = [k for k in range(max(1, lo), hi + 1) if k <= len(x)] or [1]
        if method == "kmeans":
            own_ = kmeans(x, ks[len(ks) // 2], seed)[0]
        else:
            own_ = min((gmm(x, k, seed) for k in ks), key=lambda r: r[1])[0]
        return pdf.assign(cluster=own_.astype(np.int64))

    return df.groupBy(*own).applyInPandas(run, schema)
