"""Sequence analytics: velocities, folds, neighbours, temporal gain, normalisation, vector validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..core import Refusal, need
from ..functions.missing import NAN, finite, or_nan
from .spatial import knn, within
from .tables import scope_keys

GROUP = ("b", "m", "t", "z", "c")


def velocity(df: DataFrame, dt: float = 1.0, axes: Sequence[str] = ("y", "x"), track: str = "track_id") -> DataFrame:
    """v<axis> and speed from the row before in the track; NaN on the first row, off tracks, or where time stands still."""
    need(df, track, "t", *axes)
    own = [k for k in ("b",) if k in df.columns]
    w = Window.partitionBy(*own, track).orderBy("t")
    span = (F.col("t") - F.lag("t").over(w)) * float(dt)
    on = F.col(track) > 0
    for a in axes:
        df = df.withColumn(f"v{a}", or_nan(F.when(on & (span > 0), (F.col(a) - F.lag(a).over(w)) / span)))
    return df.withColumn("speed", F.sqrt(sum((F.pow(F.col(f"v{a}"), 2) for a in axes), F.lit(0.0))))


def fold(value: Column, mean: Column) -> Column:
    return or_nan(F.when(mean > 0, value / mean))


def frame_fold(df: DataFrame, value: str, name: str = "frame_fold") -> DataFrame:
    """Value over the mean of its frame and channel; NaN unless that mean is positive."""
    w = Window.partitionBy(*[k for k in GROUP if k in df.columns])
    return df.withColumn(name, fold(finite(value), F.avg(finite(value)).over(w)))


def self_fold(df: DataFrame, value: str, name: str = "self_fold", track: str = "track_id") -> DataFrame:
    """Value over the mean of its own track; NaN off tracks."""
    w = Window.partitionBy(*[k for k in ("b",) if k in df.columns], track)
    return df.withColumn(name, F.when(F.col(track) > 0, fold(finite(value), F.avg(finite(value)).over(w))).otherwise(NAN))


def neighbour_metrics(df: DataFrame, k: int, least: float = 1.0) -> DataFrame:
    """Mean and population spread of the distance to the k nearest others of the frame, and local divergence and curl of velocity; distances count as `least` at least in the latter."""
    near = knn(df, k)
    r2 = F.pow(F.greatest(F.col("dist"), F.lit(float(least))), 2)
    dy, dx = F.col("y_r") - F.col("y"), F.col("x_r") - F.col("x")
    agg = [F.avg("dist").alias("nn_dist_mean"), F.stddev_pop("dist").alias("nn_dist_std")]
    if {"vy", "vx"} <= set(df.columns):
        own = lambda c: F.coalesce(finite(c), F.lit(0.0))
        dvy, dvx = finite("vy_r") - own("vy"), finite("vx_r") - own("vx")
        div, curl = (dy * dvy + dx * dvx) / r2, (dy * dvx - dx * dvy) / r2
        agg += [F.when(F.count(div) >= 2, F.avg(div)).alias("divergence"), F.when(F.count(curl) >= 2, F.avg(curl)).alias("curl")]
    out = near.groupBy("id").agg(*agg)
    added = [c for c in out.columns if c != "id"]
    return df.join(out, "id", "left").select(*df.columns, *[or_nan(F.col(c)).alias(c) for c in added])


def density_grid(df: DataFrame, step: float, sigma: float = 0.0) -> DataFrame:
    """Objects per area on a grid: counts in cells, smoothed by Gaussian weights of neighbouring cells, over the cell's area."""
    keys = [k for k in ("b", "m", "t") if k in df.columns]
    cells = df.groupBy(*keys, F.floor(F.col("y") / step).alias("gy"), F.floor(F.col("x") / step).alias("gx")).agg(F.count(F.lit(1)).alias("n"))
    if sigma <= 0:
        return cells.withColumn("density", F.col("n") / step**2)
    s, reach = sigma / step, int(np.ceil(3 * sigma / step))
    taps = [(i, j, float(np.exp(-(i * i + j * j) / (2 * s * s)))) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    total = sum(w for *_, w in taps)
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w / total).alias("w")) for i, j, w in taps])
    out = cells.withColumn("_m", F.explode(moves)).groupBy(*keys, (F.col("gy") + F.col("_m.i")).alias("gy"), (F.col("gx") + F.col("_m.j")).alias("gx")).agg(F.sum(F.col("n") * F.col("_m.w")).alias("n"))
    return out.withColumn("density", F.col("n") / step**2)


FIELDS = {"density": (), "mean_area": ("area",), "intensity": ("_i",), "fold_change": ("_i",), "velocity": ("vy", "vx"), "speed": ("vy", "vx"), "divergence": ("vy", "vx"), "curl": ("vy", "vx")}


def object_field(df: DataFrame, height: int, width: int, fields: Sequence[str] | str = ("density", "speed", "divergence"), step: int = 10, smooth: float = 20.0, intensity: str = "mean_intensity", dt: float = 1.0, pixel_um: float = 1.0) -> DataFrame:
    """Object measurements on a regular grid of nodes (y, x every `step` pixels), one grid a frame.

    density counts objects in cells and divides by the cell's area; the others are interpolated linearly
    between objects, with the mean outside their hull, and all are smoothed by a Gaussian of `smooth`
    pixels.  divergence and curl are differences of the gridded velocity.  Columns: the frame's keys, y, x
    and one or two a field; lengths in micrometres.  A frame's objects meet in one task.
    """
    import pyarrow as pa

    from ..functions import kernels as K

    fields = [f.strip() for f in fields.split(",")] if isinstance(fields, str) else list(fields)
    for f in fields:
        if f not in FIELDS:
            raise Refusal(f"unknown field {f!r}; one of {', '.join(FIELDS)}")
    used = list(dict.fromkeys(c for f in fields for c in FIELDS[f]))
    if "vy" in used:
        need(df, "track_id")
        df = velocity(df, dt)
    need(df, *(c for c in used if c not in ("_i", "vy", "vx")), *([intensity] if "_i" in used else []))
    keys = [k for k in GROUP if k in df.columns]
    d = df.select(*[F.col(k).cast("long").alias(k) for k in keys], *[F.col(a).cast("double").alias(a) for a in ("y", "x")], *[F.col(intensity if c == "_i" else c).cast("double").alias(c) for c in used])
    d = d.where(finite("y").isNotNull() & finite("x").isNotNull())
    names = [n for f in fields for n in (("velocity_y", "velocity_x") if f == "velocity" else (f,))]
    gy, gx = np.arange(0, height, step), np.arange(0, width, step)
    sigma, h = smooth / step, step * pixel_um

    def run(t: pa.Table) -> pa.Table:
        p = np.stack([t.column(a).to_numpy() for a in ("y", "x")], 1)
        at = np.stack(np.meshgrid(gy, gx, indexing="ij"), -1).reshape(-1, 2)
        grid = lambda v: K.gaussian(K.scatter_linear(p, v, at, "mean").reshape(len(gy), len(gx)), sigma)
        col = lambda c: t.column(c).to_numpy()
        got: dict[str, np.ndarray] = {}
        if "density" in fields:
            counts = np.zeros((len(gy), len(gx)))
            np.add.at(counts, (np.clip(p[:, 0] // step, 0, len(gy) - 1).astype(int), np.clip(p[:, 1] // step, 0, len(gx) - 1).astype(int)), 1.0)
            got["density"] = K.gaussian(counts, sigma) / h**2
        if "mean_area" in fields:
            got["mean_area"] = grid(col("area") * pixel_um**2)
        if "_i" in used:
            v = col("_i")
            good = v[np.isfinite(v)]
            got["intensity"] = grid(v)
            got["fold_change"] = grid(v / good.mean() if len(good) and good.mean() > 0 else np.full(len(v), np.nan))
        if "vy" in used:
            vy, vx = grid(col("vy") * pixel_um), grid(col("vx") * pixel_um)
            slope = lambda v, k: np.gradient(v, h, axis=k) if v.shape[k] > 1 else np.zeros(v.shape)
            got |= {"velocity_y": vy, "velocity_x": vx, "speed": np.hypot(vy, vx), "divergence": slope(vx, 1) + slope(vy, 0), "curl": slope(vx, 0) - slope(vy, 1)}
        n = len(at)
        return pa.table([pa.array(np.full(n, t.column(k)[0].as_py()), pa.int64()) for k in keys] + [pa.array(at[:, i], pa.int64()) for i in (0, 1)] + [pa.array(got[c].ravel()) for c in names], names=[*keys, "y", "x", *names])

    return d.groupBy(*keys).applyInArrow(run, ", ".join([f"{k} long" for k in [*keys, "y", "x"]] + [f"{c} double" for c in names]))


def grid_derivative(df: DataFrame, value: str, axis: str, keys: Sequence[str], h: float = 1.0) -> Column:
    """Central difference along a grid axis, one-sided at edges and gaps, NaN alone."""
    others = [k for k in keys if k != axis]
    w = Window.partitionBy(*others).orderBy(axis)
    at, v = F.col(axis), finite(value)
    prev = F.when(F.lag(axis).over(w) == at - 1, F.lag(v).over(w))
    nxt = F.when(F.lead(axis).over(w) == at + 1, F.lead(v).over(w))
    return or_nan(F.when(v.isNotNull(), F.coalesce((nxt - prev) / (2 * h), (nxt - v) / h, (v - prev) / h)))


def grid_div_curl(df: DataFrame, keys: Sequence[str] = ("m", "t"), y: str = "gy", x: str = "gx", h: float = 1.0) -> DataFrame:
    """Divergence and curl of vy, vx on a grid."""
    k = [c for c in keys if c in df.columns]
    for name, v, a in (("_yy", "vy", y), ("_xx", "vx", x), ("_xy", "vx", y), ("_yx", "vy", x)):
        df = df.withColumn(name, grid_derivative(df, v, a, [*k, y, x], h))
    return df.withColumn("divergence", F.col("_yy") + F.col("_xx")).withColumn("curl", F.col("_xy") - F.col("_yx")).drop("_yy", "_xx", "_xy", "_yx")


def track_displacement(df: DataFrame, reference: str = "first_frame", axes: Sequence[str] = ("y", "x"), min_length: int = 2) -> DataFrame:
    """disp_<axis> of tracked rows against the track's first or previous row."""
    w = Window.partitionBy(*[k for k in ("b",) if k in df.columns], "track_id").orderBy("t")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.where("track_id > 0").withColumn("_n", F.count(F.lit(1)).over(whole)).where(F.col("_n") >= min_length).drop("_n")
    for a in axes:
        base = F.first(a).over(w) if reference == "first_frame" else F.lag(a).over(w)
        d = d.withColumn(f"disp_{a}", or_nan(F.col(a) - base))
    return d


def local_gradient(df: DataFrame, radius: float, field: Sequence[str] = ("disp_y", "disp_x"), keys: Sequence[str] = ("m", "t")) -> DataFrame:
    """grad_<ij> = d field_i / d axis_j by a plane fit over the rows within a radius, itself included; NaN where the fit is singular."""
    on = [k for k in keys if k in df.columns]
    usable = df
    for f in field:
        usable = usable.where(finite(f).isNotNull())
    near = within(usable, usable, radius, on=on)
    dy, dx = F.col("y_r") - F.col("y"), F.col("x_r") - F.col("x")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(dy).alias("sy"), F.sum(dx).alias("sx"), F.sum(dy * dy).alias("syy"), F.sum(dx * dx).alias("sxx"), F.sum(dy * dx).alias("syx")]
    for i, f in enumerate(field):
        v = F.col(f"{f}_r")
        sums += [F.sum(v).alias(f"v{i}"), F.sum(v * dy).alias(f"vy{i}"), F.sum(v * dx).alias(f"vx{i}")]
    s = near.groupBy("id").agg(*sums)
    n = F.col("n")
    cyy, cxx, cyx = F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syx") - F.col("sy") * F.col("sx") / n
    det = cyy * cxx - cyx * cyx
    good = (n >= 3) & (det > 1e-9 * cyy * cxx)
    names = []
    for i, f in enumerate(field):
        a = F.col(f"vy{i}") - F.col(f"v{i}") * F.col("sy") / n
        b = F.col(f"vx{i}") - F.col(f"v{i}") * F.col("sx") / n
        comp = f[-1]
        s = s.withColumn(f"grad_{comp}y", F.when(good, (a * cxx - b * cyx) / det)).withColumn(f"grad_{comp}x", F.when(good, (b * cyy - a * cyx) / det))
        names += [f"grad_{comp}y", f"grad_{comp}x"]
    return df.join(s.select("id", *names), "id", "left").select(*df.columns, *[or_nan(F.col(c)).alias(c) for c in names])


def accumulate_field(df: DataFrame, keys: Sequence[str] = ("m", "c")) -> DataFrame:
    """Cumulative displacement of nodes from frame-to-frame increments: each step is read where the node has moved to (nearest node).

    Strictly ordered in time, so each series is one task; series run in parallel.
    """
    own = [k for k in keys if k in df.columns]
    schema = StructType([*df.schema.fields, StructField("cum_y", DoubleType()), StructField("cum_x", DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="stable").reset_index(drop=True)
        out, cum, start = [], None, None
        for _, f in pdf.groupby("t", sort=True):
            p, u = f[["y", "x"]].to_numpy(float), np.nan_to_num(f[["disp_y", "disp_x"]].to_numpy(float))
            if cum is None:
                start, cum = p, u.copy()
            else:
                at = start + cum
                # some nodes at a time, so that the distances stay small beside the frame
                near = np.concatenate([((at[i : i + 256, None] - p[None]) ** 2).sum(-1).argmin(1) for i in range(0, len(at), 256)])
                cum = cum + u[near]
            f = f.copy()
            n = min(len(f), len(cum))
            f["cum_y"], f["cum_x"] = np.nan, np.nan
            f.iloc[:n, f.columns.get_indexer(["cum_y", "cum_x"])] = cum[:n]
            out.append(f)
        return pd.concat(out)

    return df.groupBy(*own).applyInPandas(run, schema)


def temporal_gain(frames: DataFrame, reference: str = "series_mean", window: int = 11, threshold: float = 0.1, keys: Sequence[str] = ("m", "c"), value: str = "value") -> DataFrame:
    """gain of each frame (keys, t, value = its mean): to the series' mean, a centred rolling mean with held edges, or an exponential fit."""
    own = [k for k in keys if k in frames.columns]
    every = Window.partitionBy(*own)
    top = F.max(F.col(value)).over(every)
    d = frames.withColumn("_o", F.greatest(F.col(value), F.greatest(F.lit(1e-12), top * 1e-9)))
    if reference == "series_mean":
        return d.withColumn("gain", F.avg("_o").over(every) / F.col("_o")).drop("_o")
    order = every.orderBy("t")
    if reference == "rolling_mean":
        h = max(3, window | 1) // 2
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        i, n = F.row_number().over(order) - 1, F.count(F.lit(1)).over(every)
        near = F.sum("_o").over(order.rowsBetween(-h, h))
        held = F.greatest(F.lit(0), F.lit(h) - i) * F.first("_o").over(whole) + F.greatest(F.lit(0), i + h - (n - 1)) * F.last("_o").over(whole)
        g = (near + held) / (2 * h + 1) / F.col("_o")
        return d.withColumn("gain", F.when(F.abs(g - 1) <= threshold, 1.0).otherwise(g)).drop("_o")
    if reference == "exponential_fit":
        fit = d.groupBy(*own).agg(F.regr_slope(F.log("_o"), F.col("t").cast("double")).alias("_k"), F.regr_intercept(F.log("_o"), F.col("t").cast("double")).alias("_a"))
        d = d.join(fit, own).withColumn("_f", F.exp(F.col("_a") + F.col("_k") * F.col("t")))
        return d.withColumn("gain", F.avg("_f").over(every) / F.col("_f")).drop("_o", "_k", "_a", "_f")
    raise ValueError(f"unknown reference {reference!r}")


def apply_gain(voxels: DataFrame, gains: DataFrame) -> DataFrame:
    on = [k for k in ("b", "m", "t", "c") if k in voxels.columns and k in gains.columns]
    return voxels.join(gains.select(*on, "gain"), on).withColumn("value", F.col("value") * F.col("gain")).drop("gain")


def normalize(df: DataFrame, low: float = 1.0, high: float = 99.0, scope: str = "plane", bounds: str = "percentile", value: str = "value") -> DataFrame:
    """Value on [0, 1] between two percentiles of its scope, or two fixed values; 0 throughout where they coincide."""
    if bounds == "absolute":
        lo, hi, d = F.lit(float(low)), F.lit(float(high)), df
    else:
        keys = scope_keys(df, scope)
        p = df.groupBy(*keys).agg(F.percentile(finite(value), low / 100).alias("_lo"), F.percentile(finite(value), high / 100).alias("_hi"))
        d, lo, hi = df.join(p, keys), F.col("_lo"), F.col("_hi")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return d.withColumn(value, F.when(hi <= lo, 0.0).otherwise(scaled)).drop("_lo", "_hi")


def gamma(df: DataFrame, g: float, full: float | None = None) -> DataFrame:
    """(v / scale)^g * scale, over the declared full scale or each plane's own maximum."""
    scale = F.lit(float(full)) if full else F.max("value").over(Window.partitionBy(*[k for k in GROUP if k in df.columns]))
    return df.withColumn("_s", scale).withColumn("value", F.when(F.col("_s") > 0, F.pow(F.greatest(F.col("value"), F.lit(0.0)) / F.col("_s"), F.lit(float(g))) * F.col("_s")).otherwise(0.0)).drop("_s")


def piv_validate(df: DataFrame, s2n: float = 1.0, max_disp: float = 0.0, std: float = 10.0, median: float = 2.0, replace: bool = True, keys: Sequence[str] = ("m", "t"), eps: float = 0.1) -> DataFrame:
    """flag of each vector (gy, gx, u, v, s2n): weak, too long, far from the frame's mean, or unlike its neighbours; optionally replaced by their median."""
    own = [k for k in keys if k in df.columns]
    w = Window.partitionBy(*own)
    bad = F.col("s2n") < s2n
    if max_disp > 0:
        bad = bad | (F.sqrt(F.pow("u", 2) + F.pow("v", 2)) > max_disp)
    for c in ("u", "v"):
        bad = bad | (F.abs(F.col(c) - F.avg(c).over(w)) > std * F.stddev_samp(c).over(w))
    d = df.withColumn("flag", F.coalesce(bad, F.lit(False)))
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    around = d.where("not flag").withColumn("_m", F.explode(moves)).select(*own, (F.col("gy") + F.col("_m.i")).alias("gy"), (F.col("gx") + F.col("_m.j")).alias("gx"), F.col("u").alias("_u"), F.col("v").alias("_v"))
    mid = around.groupBy(*own, "gy", "gx").agg(F.percentile("_u", 0.5).alias("_mu"), F.percentile("_v", 0.5).alias("_mv"))
    spread = around.join(mid, [*own, "gy", "gx"]).groupBy(*own, "gy", "gx").agg(
        F.max("_mu").alias("_mu"), F.max("_mv").alias("_mv"), F.percentile(F.abs(F.col("_u") - F.col("_mu")), 0.5).alias("_ru"), F.percentile(F.abs(F.col("_v") - F.col("_mv")), 0.5).alias("_rv")
    )
    d = d.join(spread, [*own, "gy", "gx"], "left")
    odd = (F.abs(F.col("u") - F.col("_mu")) / (F.col("_ru") + eps) > median) | (F.abs(F.col("v") - F.col("_mv")) / (F.col("_rv") + eps) > median)
    d = d.withColumn("flag", F.col("flag") | F.coalesce(odd, F.lit(False)))
    if replace:
        d = d.withColumn("u", F.when(F.col("flag"), F.coalesce("_mu", F.col("u"))).otherwise(F.col("u"))).withColumn("v", F.when(F.col("flag"), F.coalesce("_mv", F.col("v"))).otherwise(F.col("v")))
    return d.drop("_mu", "_mv", "_ru", "_rv")
