"""Stencil operators: a numpy kernel over each plane, volume or series, one Arrow group a unit.

A unit's voxels meet in one task, as large as one plane or volume of the acquisition; the number of units
grows with the data, and they run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Refusal
from ..functions import kernels as K
from .ordered import percentiles, running

UNITS = {"plane": ("b", "m", "t", "z", "c"), "volume": ("b", "m", "t", "c"), "series": ("b", "m", "c")}
SPACE = {"plane": ("y", "x"), "volume": ("z", "y", "x"), "series": ("t", "z", "y", "x")}


def dense(table: pa.Table, axes: Sequence[str], value: str = "value", fill: float = 0.0) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """The unit as an array, each row's index in it, and the least coordinate of each axis."""
    at = [table.column(a).to_numpy().astype(np.int64) for a in axes]
    low = np.array([a.min() for a in at])
    idx = tuple(a - m for a, m in zip(at, low))
    out = np.full([int(i.max()) + 1 for i in idx], fill)
    out[idx] = np.nan_to_num(table.column(value).to_numpy(zero_copy_only=False).astype(float), nan=fill)
    return out, idx, low


def units(df: DataFrame, unit: str) -> tuple[list[str], list[str]]:
    keys = [k for k in UNITS[unit] if k in df.columns]
    axes = [a for a in SPACE[unit] if a in df.columns]
    return keys, axes


def per_unit(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], unit: str = "plane", value: str = "value", name: str | None = None, kind: str = "double") -> DataFrame:
    """Applies an array kernel of equal output shape to each unit."""
    keys, axes = units(df, unit)
    name = name or value
    cols = [*keys, *axes]
    schema = ", ".join([f"{c} long" for c in cols] + [f"{name} {kind}"])

    def run(table: pa.Table) -> pa.Table:
        a, idx, _ = dense(table, axes, value)
        out = kernel(a)[idx]
        return pa.table([table.column(c).cast(pa.int64()) for c in cols] + [pa.array(out.astype(np.int64 if kind == "long" else float))], names=[*cols, name])

    return df.select(*[F.col(c).cast("long").alias(c) for c in cols], F.col(value).cast("double").alias(value)).groupBy(*keys).applyInArrow(run, schema)


def unit_rows(df: DataFrame, find: Callable[[np.ndarray], np.ndarray], columns: Sequence[str], unit: str = "plane", value: str = "value") -> DataFrame:
    """Rows found in each unit: the first columns are coordinates (moved back to the frame), the rest as given."""
    keys, axes = units(df, unit)
    schema = ", ".join([f"{c} long" for c in keys] + [f"{c} double" for c in [*axes, *columns]])

    def run(table: pa.Table) -> pa.Table:
        a, _, low = dense(table, axes, value)
        rows = np.asarray(find(a), float).reshape(-1, len(axes) + len(columns)) if a.size else np.empty((0, len(axes) + len(columns)))
        rows[:, : len(axes)] += low
        return pa.table([pa.array(np.full(len(rows), table.column(k)[0].as_py()), pa.int64()) for k in keys] + [pa.array(rows[:, i]) for i in range(rows.shape[1])], names=[*keys, *axes, *columns])

    return df.select(*[F.col(c).cast("long").alias(c) for c in [*keys, *axes]], F.col(value).cast("double").alias(value)).groupBy(*keys).applyInArrow(run, schema)


#: Enhancement operators: name -> kernel(array, **parameters).
FILTERS: dict[str, Callable] = {
    "enhance.gaussian": lambda a, sigma=1.0: K.gaussian(a, sigma),
    "enhance.median": lambda a, radius=1: K.median(a, radius),
    "enhance.morphology": lambda a, radius=1, op="erode": K.morphology(a, radius, op),
    "enhance.morphological_gradient": lambda a, radius=1, blend=0.0: (1 - blend) * K.gradient_magnitude(a, radius) + blend * a,
    "enhance.tophat": lambda a, radius=2, variant="white": K.tophat(a, radius, variant),
    "enhance.dog": lambda a, low=1.0, high=0.0, rescale=False: K.dog(a, low, high, rescale),
    "enhance.unsharp": lambda a, amount=1.0, radius=1.0: K.unsharp(a, amount, radius),
    "enhance.bilateral": lambda a, sigma_spatial=1.0, sigma_color=0.1: K.bilateral(a, sigma_spatial, sigma_color),
    "enhance.clahe": lambda a, clip_limit=0.01, tile_grid=8: K.clahe(a, clip_limit, tile_grid),
    "enhance.nlm": lambda a, h=0.1, patch_size=3, patch_distance=3: K.nlm(a, h, patch_size, patch_distance),
    "enhance.tv_denoise": lambda a, weight=0.1: K.tv_denoise(a, weight),
    "enhance.wavelet_denoise": lambda a, **o: K.wavelet_denoise(a, **o),
    "enhance.deconvolve": lambda a, sigma=1.5, iterations=10: K.richardson_lucy(a, sigma, iterations),
    "enhance.subtract_background": lambda a, **o: K.subtract_background(a, **o),
    "enhance.flatten_field": lambda a, **o: K.flatten_field(a, **o),
    "analysis.threshold_local": lambda a, block=5.0, offset=0.0: (a > K.gaussian(a, block / 6) - offset).astype(float),
    "analysis.edt": lambda a, spacing=1.0: K.edt(a > 0, spacing),
    "transform.rotate": lambda a, angle=0.0: K.rotate(a, angle),
    "piv.smooth": lambda a, strength=0.05: K.smooth_field(a, strength),
}


def enhance(df: DataFrame, kernel: str, /, unit: str = "plane", **parameters) -> DataFrame:
    f = FILTERS[kernel]
    return per_unit(df, lambda a: f(a, **parameters), unit)


def remove_blobs(df: DataFrame, min_radius: float, max_radius: float, threshold: float = 0.05, expand: float = 1.5, action: str = "zero", method: str = "log") -> DataFrame:
    """Round blobs found and filled with 0, the surrounding median, or a surface through the rest."""

    def run(a: np.ndarray) -> np.ndarray:
        out, y, x = a.copy(), *np.mgrid[: a.shape[0], : a.shape[1]]
        gone = np.zeros(a.shape, bool)
        for r in K.spots(a, min_radius, max_radius, threshold, method):
            gone |= (y - r[0]) ** 2 + (x - r[1]) ** 2 <= (expand * r[2]) ** 2
        if action == "zero":
            out[gone] = 0
        elif gone.any() and not gone.all():
            out[gone] = np.median(a[~gone]) if action == "median" else K.polynomial_surface(a, 2, ~gone)[gone]
        return out

    return per_unit(df, run)


def first_numbers(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds _first, the labels of all units before, to one row a unit with its number of labels _n."""
    if not keys:
        return counts.withColumn("_first", F.lit(0))
    return running(counts, [], keys, keys[0], "_n", "_first").withColumn("_first", F.col("_first") - F.col("_n"))


def label(df: DataFrame, connectivity: int | None = None, unit: str = "plane", value: str = "value", regions: str = "components") -> DataFrame:
    """label_id of the foreground, numbered over all units in their order; 0 elsewhere.

    Units are labelled in parallel; their counts, one row a unit, give each unit's first number.
    """
    keys, _ = units(df, unit)
    if regions == "whole":
        d = per_unit(df, lambda a: (a > 0).astype(float), unit, value, "label_id", "long")
    else:
        d = per_unit(df, lambda a: K.label(a > 0, connectivity), unit, value, "label_id", "long")
    n = d.groupBy(*keys).agg(F.max("label_id").alias("_n"))
    first = first_numbers(n, keys)
    out = d.join(first.drop("_n"), keys) if keys else d.crossJoin(F.broadcast(first.drop("_n")))
    return out.withColumn("label_id", F.when(F.col("label_id") > 0, F.col("label_id") + F.col("_first")).otherwise(0)).drop("_first")


def threshold(df: DataFrame, method: str = "otsu", scope: str = "plane", level: float = 0.5, regions: DataFrame | None = None) -> DataFrame:
    """value 1 above the level of its scope, which never pools channels; per_label takes each region's own level."""
    from .tables import scope_keys
    from .thresholds import group_levels

    keys = scope_keys(df, scope) if scope not in ("per_label", "per_roi") else ["label_id"]
    d = df
    if keys == ["label_id"]:
        on = [k for k in ("b", "m", "t", "z", "c", "y", "x") if k in df.columns and k in regions.columns]
        d = df.join(regions.where("label_id > 0").select(*on, "label_id"), on)
    if method == "fixed":
        return d.withColumn("value", (F.col("value") > level).cast("double"))
    cuts = group_levels(d, "value", keys, method)
    d = d.join(cuts, keys, "left") if keys else d.crossJoin(F.broadcast(cuts))
    return d.withColumn("value", F.coalesce((F.col("value") > F.col("cut")).cast("double"), F.lit(0.0))).drop("cut")


def multiotsu(df: DataFrame, classes: int = 3, unit: str = "volume") -> DataFrame:
    return per_unit(df, lambda a: K.multiotsu_classes(a, classes).astype(float), unit, name="class", kind="long")


def histogram_threshold(df: DataFrame, method: str = "single", direction: str = "above", low: float = 0.0, high: float = 0.0, scope: str = "plane", strict: float = 0.0, permissive: float = 0.0) -> DataFrame:
    """Mask by fixed cuts, by percentiles of the scope, relative to the scope's mean, or by hysteresis (permissive regions that touch strict ones)."""
    if method == "hysteresis":

        def run(a: np.ndarray) -> np.ndarray:
            lab = K.label(a > permissive, a.ndim)
            return np.isin(lab, np.setdiff1d(lab[a > strict], [0])).astype(float)

        return per_unit(df, run)
    from .tables import scope_keys

    lo, hi, d = F.lit(float(low)), F.lit(float(high)), df
    if method in ("percentile", "relative"):
        keys = scope_keys(df, scope)
        if method == "percentile" and scope == "dataset":
            cuts = percentiles(df, keys, "value", {"_lo": low / 100, "_hi": high / 100})
        else:
            agg = [F.percentile("value", low / 100).alias("_lo"), F.percentile("value", high / 100).alias("_hi")] if method == "percentile" else [(F.avg("value") * low).alias("_lo"), (F.avg("value") * high).alias("_hi")]
            cuts = df.groupBy(*keys).agg(*agg)
        d = df.join(cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))  # one row
        lo, hi = F.col("_lo"), F.col("_hi")
    v = F.col("value")
    test = {"above": v > lo, "below": v < hi, "between": v.between(lo, hi), "outside": (v < lo) | (v > hi)}[direction]
    return d.withColumn("value", test.cast("double")).drop("_lo", "_hi")


def segment(df: DataFrame, method: str = "threshold", level: str = "otsu", fixed: float = 0.5, min_area: int = 0, max_area: int = 0, holes: bool = False, min_distance: int = 3, connectivity: int | None = None, unit: str = "plane") -> DataFrame:
    """Labels of bright objects: threshold and components, or a watershed on the distance inside; filtered by area."""
    if method in ("stardist", "cellsam"):
        raise Refusal(f"{method} needs its model package, which is not installed")

    def run(a: np.ndarray) -> np.ndarray:
        cut = fixed if level == "fixed" else float(a.mean()) if level == "mean" else K.otsu(a)
        mask = a > cut
        if holes:
            mask = K.fill_holes(mask)
        if method == "watershed" and mask.any() and not mask.all():
            d = K.edt(mask)
            markers = np.zeros(a.shape, np.int64)
            for i, p in enumerate(K.peaks(d, min_distance, 0.0), 1):
                markers[tuple(p)] = i
            lab = K.watershed(-d, markers, mask)
        else:
            lab = K.label(mask, connectivity)
        n = np.bincount(lab.ravel())
        bad = np.flatnonzero((n < min_area) | ((n > max_area) if max_area else False))
        lab[np.isin(lab, bad[bad > 0])] = 0
        return np.unique(np.append(lab.ravel(), 0), return_inverse=True)[1][:-1].reshape(a.shape).astype(float)

    keys, _ = units(df, unit)
    d = per_unit(df, run, unit, name="label_id", kind="long")
    first = first_numbers(d.groupBy(*keys).agg(F.max("label_id").alias("_n")), keys).drop("_n")
    return d.join(first, keys).withColumn("label_id", F.when(F.col("label_id") > 0, F.col("label_id") + F.col("_first")).otherwise(0)).drop("_first")


def spots(df: DataFrame, min_radius: float, max_radius: float, threshold: float = 0.1, method: str = "log", polarity: str = "bright", unit: str = "plane") -> DataFrame:
    return unit_rows(df, lambda a: K.spots(a, min_radius, max_radius, threshold, method, polarity), ["radius", "response"], unit)


def particles(df: DataFrame, distance: float = 2.0, threshold: float = 0.0, min_size: int = 4, mode: str = "log", unit: str = "plane") -> DataFrame:
    return unit_rows(df, lambda a: K.particles(a, distance, threshold, min_size, mode), ["intensity"], unit)


def beads(df: DataFrame, diameter: float, min_snr: float = 5.0, slab: int = 3, overlap: int = 1) -> DataFrame:
    return unit_rows(df, lambda a: K.beads(a, diameter, min_snr, slab, overlap), ["snr"], "volume")


def drift(df: DataFrame, reference: str = "first", upsample: int = 20) -> DataFrame:
    """drift_y, drift_x, confidence of each frame: the shift that brings it onto the first frame (or adds up from the previous).

    Measured on the middle plane of a stack.  Only frames that are there are compared, each with the one before it.
    """
    keys = [k for k in ("b", "m", "c") if k in df.columns]
    schema = ", ".join([f"{k} long" for k in keys] + ["t long", "drift_y double", "drift_x double", "confidence double"])

    def run(table: pa.Table) -> pa.Table:
        a, idx, low = dense(table, ["t", "y", "x"])
        there = np.unique(idx[0])
        rows, total, before = [], np.zeros(2), there[0]
        for i in there:
            s, c = K.phase_shift(a[there[0] if reference == "first" else before], a[i], upsample)
            total = s if reference == "first" else total + s
            rows.append([*total, c])
            before = i
        r = np.array(rows)
        return pa.table([pa.array(np.full(len(r), table.column(k)[0].as_py()), pa.int64()) for k in keys] + [pa.array(there + low[0], pa.int64())] + [pa.array(r[:, i]) for i in range(3)], names=[*keys, "t", "drift_y", "drift_x", "confidence"])

    d = df
    if "z" in df.columns:
        d = df.where(F.col("z") == ((df.agg(F.max("z")).first()[0] or 0) + 1) // 2)
    return d.select(*[F.col(k).cast("long").alias(k) for k in keys], *[F.col(a).cast("long").alias(a) for a in ("t", "y", "x")], F.col("value").cast("double").alias("value")).groupBy(*keys).applyInArrow(run, schema)


def align_drift(df: DataFrame, channel: int | None = None, reference: str = "first", upsample: int = 20, interp: str = "linear") -> dict[str, DataFrame]:
    """image: every plane and channel moved onto its series' reference frame; drift: the shifts, measured on one channel (the least, if none is named)."""
    d = df
    if "c" in df.columns:
        c = channel if channel is not None else df.agg(F.min("c")).first()[0]
        d = df.where(F.col("c") == c).drop("c")
    table = drift(d, reference, upsample)
    return {"image": shift(df, table, interp=interp), "drift": table}


def shift(df: DataFrame, shifts: DataFrame, invert: bool = False, interp: str = "linear") -> DataFrame:
    """Frames moved by their stored shift, joined on the frame."""
    on = [k for k in ("b", "m", "t") if k in df.columns and k in shifts.columns]
    d = df.join(shifts.select(*on, "drift_y", "drift_x").dropDuplicates(on), on)
    keys, axes = units(df, "plane")
    cols = [*keys, *axes]

    def run(table: pa.Table) -> pa.Table:
        a, idx, _ = dense(table, axes)
        s = np.array([table.column("drift_y")[0].as_py(), table.column("drift_x")[0].as_py()]) * (-1 if invert else 1)
        return pa.table([table.column(c).cast(pa.int64()) for c in cols] + [pa.array(K.move(a, s, interp)[idx])], names=[*cols, "value"])

    return d.groupBy(*keys).applyInArrow(run, ", ".join([f"{c} long" for c in cols] + ["value double"]))


def rigid(df: DataFrame, dy: float = 0.0, dx: float = 0.0, angle: float = 0.0, interp: str = "linear") -> DataFrame:
    return per_unit(df, lambda a: K.move(K.rotate(a, angle) if angle else a, (dy, dx), interp))


def resample(df: DataFrame, scale: float) -> DataFrame:
    """Planes at another scale, round(size * scale) pixels, that begin at the rounded scaled place of the plane's first."""
    keys, axes = units(df, "plane")
    schema = ", ".join([f"{c} long" for c in [*keys, *axes]] + ["value double"])

    def run(table: pa.Table) -> pa.Table:
        a, _, low = dense(table, axes)
        out = K.resample(a, scale)
        at = np.indices(out.shape).reshape(2, -1) + np.rint(low * scale).astype(np.int64)[:, None]
        return pa.table([pa.array(np.full(out.size, table.column(k)[0].as_py()), pa.int64()) for k in keys] + [pa.array(x, pa.int64()) for x in at] + [pa.array(out.ravel())], names=[*keys, *axes, "value"])

    return df.select(*[F.col(c).cast("long").alias(c) for c in [*keys, *axes]], F.col("value").cast("double").alias("value")).groupBy(*keys).applyInArrow(run, schema)


def frame_pairs(df: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: Sequence[str], reference: str = "previous_frame", reference_frame: int = 0) -> DataFrame:
    """Rows (y, x, columns) from each pair of frames of a series: every frame with the one before, or with a fixed one."""
    keys = [k for k in ("b", "m", "z", "c") if k in df.columns]
    schema = ", ".join([f"{k} long" for k in keys] + ["t long"] + [f"{c} double" for c in ("y", "x", *columns)])
    prev = df.select(*keys, "y", "x", F.col("value").alias("_ref"), (F.col("t") + 1).alias("t")) if reference == "previous_frame" else df.where(F.col("t") == reference_frame).select(*keys, "y", "x", F.col("value").alias("_ref"))
    d = df.join(prev, [*keys, "y", "x", *(["t"] if reference == "previous_frame" else [])])

    def run(table: pa.Table) -> pa.Table:
        b, _, low = dense(table, ["y", "x"])
        a, _, _ = dense(table, ["y", "x"], "_ref")
        r = np.asarray(kernel(a, b), float).reshape(-1, 2 + len(columns))
        r[:, :2] += low
        return pa.table([pa.array(np.full(len(r), table.column(k)[0].as_py()), pa.int64()) for k in [*keys, "t"]] + [pa.array(r[:, i]) for i in range(r.shape[1])], names=[*keys, "t", "y", "x", *columns])

    return d.groupBy(*keys, "t").applyInArrow(run, schema)


def optical_flow(df: DataFrame, method: str = "tvl1", radius: int = 7, rounds: int = 10, attachment: float = 15.0, tightness: float = 0.3, **options) -> DataFrame:
    """Displacement of every pixel between frames: tvl1 (least total variation) or ilk (least squares in a window of `radius`)."""
    if method not in ("tvl1", "ilk"):
        raise Refusal(f"unknown method {method!r}; tvl1 or ilk")

    def run(a, b):
        u = K.flow_ilk(a, b, radius, rounds) if method == "ilk" else K.flow_tvl1(a, b, attachment, tightness, rounds=rounds)
        y, x = np.indices(a.shape)
        return np.stack([y.ravel(), x.ravel(), u[0].ravel(), u[1].ravel()], 1)

    return frame_pairs(df, run, ["vy", "vx"], **options)


def piv(df: DataFrame, window: int = 32, passes: int = 2, overlap: float = 0.5, **options) -> DataFrame:
    return frame_pairs(df, lambda a, b: K.piv(a, b, window, passes, overlap), ["v", "u", "s2n"], **options)


def initial_guess(df: DataFrame, window: int = 40, **options) -> DataFrame:
    """Whole-pixel seed of each node by one correlation pass."""

    def run(a, b):
        r = K.piv_pass(a, b, min(window, *a.shape), 0.5)
        r[:, 2:4] = np.rint(r[:, 2:4])
        return r

    return frame_pairs(df, run, ["disp_y", "disp_x", "s2n"], **options)


def tessellate(points: DataFrame, keys: Sequence[str] = ("m", "t"), cluster: str = "cluster", min_points: int = 3) -> DataFrame:
    """Hull corners of each cluster, in order: vertex rows (keys, cluster, corner, y, x)."""
    own = [k for k in keys if k in points.columns]
    cols = [*own, cluster]
    schema = ", ".join([f"{c} long" for c in cols] + ["corner long", "y double", "x double"])

    def run(table: pa.Table) -> pa.Table:
        p = np.stack([table.column("y").to_numpy(), table.column("x").to_numpy()], 1).astype(float)
        h = p[K.convex_hull(p)] if len(p) >= min_points else np.empty((0, 2))
        return pa.table([pa.array(np.full(len(h), table.column(c)[0].as_py()), pa.int64()) for c in cols] + [pa.array(np.arange(len(h)), pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=[*cols, "corner", "y", "x"])

    return points.select(*[F.col(c).cast("long").alias(c) for c in cols], F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).groupBy(*cols).applyInArrow(run, schema)


def rasterize_mesh(vertices: DataFrame, voxels: DataFrame, keys: Sequence[str] = ("m", "t"), cluster: str = "cluster") -> DataFrame:
    """Voxels inside closed outlines, by counting the edges a ray crosses: edges meet the voxels of their rows in an equi-join on y."""
    own = [k for k in keys if k in vertices.columns and k in voxels.columns]
    w = Window.partitionBy(*own, cluster).orderBy("corner").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = Window.partitionBy(*own, cluster).orderBy("corner")
    e = vertices.select(*own, cluster, F.col("y").alias("y0"), F.col("x").alias("x0"), F.coalesce(F.lead("y").over(o), F.first("y").over(w)).alias("y1"), F.coalesce(F.lead("x").over(o), F.first("x").over(w)).alias("x1"))
    lo, hi = F.ceil(F.least("y0", "y1")).cast("long"), F.ceil(F.greatest("y0", "y1")).cast("long") - 1
    e = e.where("y0 != y1").withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("y", F.explode(F.sequence("_lo", "_hi")))
    e = e.withColumn("_at", F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).select(*own, cluster, "y", "_at")
    hit = voxels.join(e, [*own, "y"]).where(F.col("x") < F.col("_at"))
    inside = hit.groupBy(*voxels.columns, cluster).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return inside.groupBy(*voxels.columns).agg(F.min(cluster).alias("label_id"))
