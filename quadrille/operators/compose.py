"""Operators that are compositions of others: strain of tracked or correlated fields, alignment, rasterised fields."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Refusal
from ..functions import kernels as K
from ..functions.missing import or_nan
from . import figure as G
from . import fits as X
from . import image as I
from . import spatial as S
from . import tensor as N
from . import windows as W
from .image import dense


def track_field(df: DataFrame, radius: float = 20.0, reference: str = "first_frame", strain_type: str = "infinitesimal", min_length: int = 2, velocity: bool = False, dt: float = 1.0, constitutive: str = "none", young: float = 1000.0, poisson: float = 0.45, plane: str = "strain") -> DataFrame:
    """Displacement of tracked rows, its local gradient within a radius, strain, and linear-elastic stress if asked for."""
    d = W.track_displacement(df, reference, min_length=min_length)
    if velocity:
        d = W.velocity(d, dt)
    d = N.strain(W.local_gradient(d, radius), strain_type)
    return N.stress(d, "linear_elastic", young, poisson, plane=plane) if constitutive == "linear_elastic" else d


def field_strain(df: DataFrame, method: str = "plane_fit", radius: float = 20.0, strain_type: str = "infinitesimal", spacing: float = 1.0, keys: Sequence[str] = ("m", "t")) -> DataFrame:
    """Strain of a displacement field: plane fits within a radius, or differences on its lattice (gy, gx)."""
    if method == "plane_fit":
        g = W.local_gradient(df, radius, keys=keys)
    elif method in ("fd", "direct"):
        g = N.lattice_gradient(df, keys=keys, h=spacing)
    else:
        raise Refusal(f"{method} strain needs a finite-element solver; use plane_fit or fd")
    return N.strain(g, strain_type)


def rasterize_nearest(points: DataFrame, voxels: DataFrame, value: str, reach: float, on: Sequence[str] = ("m", "t")) -> DataFrame:
    """Each voxel takes the value of the nearest point within reach, NaN beyond; ties go to the lowest id."""
    on = [k for k in on if k in points.columns and k in voxels.columns]
    best = S.within(voxels, points, reach, on=on).groupBy(*voxels.columns).agg(F.min_by(f"{value}_r", F.struct("dist", "id_r")).alias("_v"))
    return voxels.join(best, voxels.columns, "left").select(*voxels.columns, or_nan(F.col("_v").cast("double")).alias(value))


def rasterize_linear(points: DataFrame, voxels: DataFrame, value: str, on: Sequence[str] = ("m", "t")) -> DataFrame:
    """Each voxel takes the points' value by linear interpolation over their Delaunay triangles, and the nearest point's outside their hull; a frame is one group."""
    on = [k for k in on if k in points.columns and k in voxels.columns]
    p = points.select(*[F.col(k).cast("long").alias(k) for k in on], *[F.col(c).cast("double").alias(c) for c in ("y", "x", value)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in voxels.schema.fields) + f", `{value}` double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            got = np.full(left.num_rows, np.nan)
        else:
            at, src = (np.stack([t.column(a).to_numpy().astype(float) for a in ("y", "x")], 1).reshape(-1, 2) for t in (left, right))
            got = K.scatter_linear(src, right.column(value).to_numpy(), at)
        return left.append_column(value, pa.array(got, pa.float64()))

    both = lambda d: d.groupBy(*on) if on else d.groupBy(F.lit("all").alias("_all"))
    return both(voxels).cogroup(both(p)).applyInArrow(run, schema)


def rasterize_field(points: DataFrame, voxels: DataFrame, value: str, method: str = "linear", reach: float = 50.0, on: Sequence[str] = ("m", "t")) -> DataFrame:
    if method == "linear":
        return rasterize_linear(points, voxels, value, on)
    if method == "nearest":
        return rasterize_nearest(points, voxels, value, reach, on)
    raise Refusal(f"unknown method {method!r}; linear or nearest")


def align_to(df: DataFrame, reference: DataFrame, min_ncc: float = 0.3, highpass: float = 5.0, upsample: int = 20, frame: int = 0) -> DataFrame:
    """shift_y, shift_x, ncc of each position against the same field of a reference: what moves the reference's image onto it.

    A shift is kept only if the images then agree (normalised correlation of at least min_ncc), else it is 0.
    """
    keys = [k for k in ("m", "c") if k in df.columns and k in reference.columns]
    at = lambda d: d.where(F.col("t") == frame) if "t" in d.columns else d
    d = at(df).select(*keys, "y", "x", "value").join(at(reference).select(*keys, "y", "x", F.col("value").alias("_ref")), [*keys, "y", "x"])

    def run(t: pa.Table) -> pa.Table:
        a, b = dense(t, ["y", "x"])[0], dense(t, ["y", "x"], "_ref")[0]
        if highpass:
            a, b = a - K.gaussian(a, highpass), b - K.gaussian(b, highpass)
        s, _ = K.phase_shift(a, b, upsample)
        m = int(np.ceil(np.abs(s).max())) + 1
        inner = tuple(slice(m, n - m) for n in a.shape)
        score = K.ncc(a[inner], K.move(b, s)[inner]) if min(a.shape) > 2 * m + 2 else 0.0
        if score < min_ncc:
            s = np.zeros(2)
        return pa.table([pa.array([t.column(k)[0].as_py()], pa.int64()) for k in keys] + [pa.array([v]) for v in (float(s[0]), float(s[1]), float(score))], names=[*keys, "shift_y", "shift_x", "ncc"])

    return d.groupBy(*keys).applyInArrow(run, ", ".join([f"{k} long" for k in keys] + ["shift_y double", "shift_x double", "ncc double"]))


def align_image(df: DataFrame, reference: DataFrame, interp: str = "linear", **options) -> dict[str, DataFrame]:
    """image: every plane moved onto its position's reference; shifts: what align_to() found."""
    shifts = align_to(df, reference, **options)
    on = [k for k in ("m",) if k in shifts.columns]
    table = shifts.groupBy(*on).agg(F.min_by("shift_y", "c").alias("drift_y"), F.min_by("shift_x", "c").alias("drift_x")) if "c" in shifts.columns else shifts.select(*on, F.col("shift_y").alias("drift_y"), F.col("shift_x").alias("drift_x"))
    return {"image": I.shift(df, table, invert=True, interp=interp), "shifts": shifts}


def gradient_map(points: DataFrame, value: str, method: str = "idw", **options) -> DataFrame:
    """A field from scattered values: inverse distances, an exponential trend over distance, or a point source."""
    if method == "idw":
        return X.idw_map(points, value, **options)
    if method == "trend":
        return X.trend_map(points, value, **options)
    if method == "point_source":
        return X.point_source_fit(points, value, **options)
    raise Refusal(f"unknown method {method!r}; idw, trend or point_source")


def langmuir_series(df: DataFrame, x: str, y: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Bmax, Kd of each group, fitted to the group's mean at each x."""
    import pandas as pd

    means = G.xy(df, x, y, group_by, "none")
    schema = ", ".join([f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group_by] + ["bmax double", "kd double"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {g: pdf[g].iloc[0] for g in group_by}
        try:
            b, k = X.langmuir_fit(pdf["x"].to_numpy(float), pdf["mean"].to_numpy(float))
        except Refusal:
            b, k = np.nan, np.nan
        return pd.DataFrame([row | {"bmax": b, "kd": k}])

    keys = list(group_by) or [F.lit(0).alias("_")]
    return means.groupBy(*keys).applyInPandas(fit, schema)


def xy(df: DataFrame, x: str, y: str, group_by: Sequence[str] = (), error: str = "sem", fit: str = "none") -> DataFrame:
    """The series of a plot, or its fit by group."""
    if fit == "none":
        return G.xy(df, x, y, group_by, error)
    fits = {"linear": G.linear_fit, "exponential": G.exponential_fit, "langmuir": langmuir_series}
    if fit not in fits:
        raise Refusal(f"unknown fit {fit!r}; one of {', '.join(fits)}")
    return fits[fit](df, x, y, group_by)
