"""Tensor algebra on columns: strain, principal values, rotation, volume change, stress; all closed-form expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import or_nan
from .windows import grid_derivative, local_gradient

Matrix = list[list[Column]]


def grad(df: DataFrame) -> tuple[Matrix, int]:
    """The displacement gradient G[i][j] = d u_i / d j, in 3-D if the table has grad_zz."""
    axes = "zyx" if "grad_zz" in df.columns else "yx"
    return [[F.col(f"grad_{i}{j}") for j in axes] for i in axes], len(axes)


def eye(n: int) -> Matrix:
    return [[F.lit(float(i == j)) for j in range(n)] for i in range(n)]


def add(a: Matrix, b: Matrix, s: float = 1.0) -> Matrix:
    return [[x + y * s for x, y in zip(r, q)] for r, q in zip(a, b)]


def mul(a: Matrix, b: Matrix) -> Matrix:
    n = len(a)
    return [[sum((a[i][k] * b[k][j] for k in range(1, n)), a[i][0] * b[0][j]) for j in range(n)] for i in range(n)]


def tr(a: Matrix) -> Column:
    return sum((a[i][i] for i in range(1, len(a))), a[0][0])


def t(a: Matrix) -> Matrix:
    return [list(r) for r in zip(*a)]


def det(a: Matrix) -> Column:
    if len(a) == 2:
        return a[0][0] * a[1][1] - a[0][1] * a[1][0]
    return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])


def inverse2(a: Matrix) -> Matrix:
    d = F.nullif(det(a), F.lit(0.0))
    return [[a[1][1] / d, -a[0][1] / d], [-a[1][0] / d, a[0][0] / d]]


def inverse3(a: Matrix) -> Matrix:
    d = F.nullif(det(a), F.lit(0.0))
    minor = lambda i, j: a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]
    return [[minor(j, i) / d for j in range(3)] for i in range(3)]


def scale(a: Matrix, s) -> Matrix:
    return [[x * s for x in r] for r in a]


def eigen2(a: Matrix) -> tuple[Column, Column, Column]:
    """Principal values, largest first, and the counter-clockwise screen angle of the first in (-90, 90] degrees."""
    m, d = (a[0][0] + a[1][1]) / 2, (a[0][0] - a[1][1]) / 2
    r = F.sqrt(d * d + a[0][1] * a[0][1])
    # the eigenvector of the larger value is (a_yx, e1 - a_yy); where that vanishes, an axis
    vy, vx = a[0][1], m + r - a[0][0]
    none, along = (F.abs(vx) < 1e-300) & (F.abs(vy) < 1e-300), F.when(a[0][0] >= a[1][1], 1.0).otherwise(0.0)
    vy, vx = F.when(none, along).otherwise(vy), F.when(none, 1.0 - along).otherwise(vx)
    angle = F.degrees(F.atan2(-vy, vx))
    return m + r, m - r, F.when(angle <= -90, angle + 180).when(angle > 90, angle - 180).otherwise(angle)


def eigen3(a: Matrix) -> tuple[Column, Column, Column]:
    """Principal values of a symmetric 3 x 3 matrix, largest first, by the trigonometric formula."""
    q = tr(a) / 3
    p1 = a[0][1] * a[0][1] + a[0][2] * a[0][2] + a[1][2] * a[1][2]
    p2 = sum(((a[i][i] - q) * (a[i][i] - q) for i in range(3)), F.lit(0.0)) + 2 * p1
    p = F.sqrt(p2 / 6)
    safe = F.nullif(p, F.lit(0.0))
    b = [[(a[i][j] - q * float(i == j)) / safe for j in range(3)] for i in range(3)]
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det(b) / 2))
    phi = F.acos(r) / 3
    e1 = F.coalesce(q + 2 * p * F.cos(phi), q)
    e3 = F.coalesce(q + 2 * p * F.cos(phi + 2 * math.pi / 3), q)
    return e1, 3 * q - e1 - e3, e3


def log_sym2(c: Matrix) -> Matrix:
    """Logarithm of a symmetric positive 2 x 2 matrix."""
    m, d = (c[0][0] + c[1][1]) / 2, (c[0][0] - c[1][1]) / 2
    r = F.sqrt(d * d + c[0][1] * c[0][1])
    l1, l2 = F.log(m + r), F.log(m - r)
    k = F.coalesce((l1 - l2) / F.nullif(2 * r, F.lit(0.0)), 1 / m)
    mean = (l1 + l2) / 2
    return [[mean + k * d, k * c[0][1]], [k * c[0][1], mean - k * d]]


def log_sym3(c: Matrix) -> Matrix:
    """Logarithm of a symmetric positive 3 x 3 matrix, by its eigenvectors in Arrow batches: powers of the matrix lose too much where two of its values meet."""
    at = [(i, j) for i in range(3) for j in range(i, 3)]

    @F.pandas_udf("array<double>")
    def run(*columns: pd.Series) -> pd.Series:
        m = np.empty((len(columns[0]), 3, 3))
        for (i, j), v in zip(at, columns):
            m[:, i, j] = m[:, j, i] = v.to_numpy(float)
        good = np.isfinite(m).all((1, 2))
        w, v = np.linalg.eigh(np.where(good[:, None, None], m, np.eye(3)))
        good &= w[:, 0] > 0
        out = (v * np.log(np.maximum(w, 1e-300))[:, None, :]) @ v.transpose(0, 2, 1)
        return pd.Series([[float(x[i, j]) for i, j in at] if ok else None for x, ok in zip(out, good)])

    flat = run(*[c[i][j] for i, j in at])
    return [[flat[at.index((min(i, j), max(i, j)))] for j in range(3)] for i in range(3)]


def strain_tensor(g: Matrix, measure: str) -> Matrix:
    n = len(g)
    if measure == "infinitesimal":
        return scale(add(g, t(g)), 0.5)
    f = add(g, eye(n))
    if measure == "green_lagrange":
        return scale(add(mul(t(f), f), eye(n), -1), 0.5)
    if measure == "euler_almansi":
        inv = inverse2(f) if n == 2 else inverse3(f)
        return scale(add(eye(n), mul(t(inv), inv), -1), 0.5)
    if measure == "hencky":
        c = mul(t(f), f)
        return scale(log_sym2(c) if n == 2 else log_sym3(c), 0.5)
    raise ValueError(f"unknown measure {measure!r}")


def strain(df: DataFrame, measure: str = "infinitesimal") -> DataFrame:
    """strain_<ij>, principal values and angle, equivalent, greatest shear and volumetric strain."""
    g, n = grad(df)
    e = strain_tensor(g, measure)
    axes = "zyx"[-n:]
    out = df.select("*", *[or_nan(e[i][j]).alias(f"strain_{axes[i]}{axes[j]}") for i in range(n) for j in range(i, n)])
    c = [[F.col(f"strain_{axes[min(i, j)]}{axes[max(i, j)]}") for j in range(n)] for i in range(n)]
    if n == 2:
        e1, e2, angle = eigen2(c)
        out = out.withColumn("principal_1", or_nan(e1)).withColumn("principal_2", or_nan(e2)).withColumn("principal_angle", or_nan(angle))
        out = out.withColumn("equivalent", or_nan(2 / math.sqrt(3) * F.sqrt(F.greatest(tr(c) * tr(c) - det(c), F.lit(0.0)))))
        return out.withColumn("max_shear", (F.col("principal_1") - F.col("principal_2")) / 2).withColumn("volumetric", tr(c))
    e1, e2, e3 = eigen3(c)
    out = out.withColumn("principal_1", or_nan(e1)).withColumn("principal_2", or_nan(e2)).withColumn("principal_3", or_nan(e3))
    dev = [[c[i][j] - (tr(c) / 3 if i == j else 0.0) for j in range(3)] for i in range(3)]
    square = sum((dev[i][j] * dev[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    return out.withColumn("equivalent", or_nan(F.sqrt(square * 2 / 3))).withColumn("max_shear", (F.col("principal_1") - F.col("principal_3")) / 2).withColumn("volumetric", tr(c))


def rotation(df: DataFrame) -> DataFrame:
    """curl and the finite rotation angle in degrees (2-D), or the curl vector (3-D)."""
    g, n = grad(df)
    if n == 2:
        f = add(g, eye(2))
        return df.withColumn("curl", or_nan(g[1][0] - g[0][1])).withColumn("rotation", or_nan(F.degrees(F.atan2(f[1][0] - f[0][1], f[1][1] + f[0][0]))))
    return df.withColumn("curl_z", or_nan(g[1][2] - g[2][1])).withColumn("curl_y", or_nan(g[2][0] - g[0][2])).withColumn("curl_x", or_nan(g[0][1] - g[1][0]))


def volume_change(df: DataFrame) -> DataFrame:
    """jacobian det(I + G), dilatation J - 1, divergence tr G."""
    g, n = grad(df)
    j = det(add(g, eye(n)))
    return df.withColumn("jacobian", or_nan(j)).withColumn("dilatation", or_nan(j - 1)).withColumn("divergence", or_nan(tr(g)))


def embed(a: Matrix, zz: Column) -> Matrix:
    """A plane tensor in (y, x) as one in (z, y, x), with zz and no coupling to z."""
    zero = F.lit(0.0)
    return [[zz, zero, zero], *[[zero, *row] for row in a]]


def named(df: DataFrame, prefix: str, a: Matrix) -> tuple[DataFrame, Matrix]:
    """The tensor's entries as columns of their own, so that what is built on them is computed once."""
    n = len(a)
    df = df.select("*", *[a[i][j].alias(f"{prefix}{i}{j}") for i in range(n) for j in range(n)])
    return df, [[F.col(f"{prefix}{i}{j}") for j in range(n)] for i in range(n)]


def free_stretch(j: Column, lam: float, mu: float) -> Column:
    """The stretch s across a neo-Hookean sheet that leaves its faces free: mu (s^2 - 1) + lam log(j s) = 0.

    Newton's method in log s: the left side is convex and rising there, so every start converges.
    """
    step = lambda u, _: u - (mu * (F.exp(2 * u) - 1) + lam * (F.log(j) + u)) / (2 * mu * F.exp(2 * u) + lam)
    return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0.0), step))


def stress(df: DataFrame, model: str = "linear_elastic", young: float = 1000.0, poisson: float = 0.45, viscosity: float = 1e-3, plane: str = "strain") -> DataFrame:
    """Cauchy stress from the gradient of a displacement, or of a velocity (newtonian_fluid).

    Adds stress_<ij>, principal stresses stress_p1..p3 (largest first), pressure, von_mises, max_shear and
    energy (strain energy density).  A field in a plane is a thick block (`plane` strain: nothing moves
    along z) or a thin sheet (stress: its faces are free), and all of these come from the tensor in space,
    whose stress_zz is given too.  A fluid has a deviator only and no energy.  NaN where the
    gradient is missing or turns space inside out.
    """
    g, n = grad(df)
    if plane not in ("strain", "stress"):
        raise ValueError(f"plane is strain or stress, not {plane!r}")
    mu, lam = young / (2 * (1 + poisson)), young * poisson / ((1 + poisson) * (1 - 2 * poisson))
    sheet = plane == "stress" and n == 2
    own = df.columns
    energy = F.lit(None).cast("double")
    if model in ("linear_elastic", "newtonian_fluid"):
        e = strain_tensor(g, "infinitesimal")
        if model == "newtonian_fluid":
            zz = F.lit(0.0)
        else:
            zz = -lam / (lam + 2 * mu) * tr(e) if sheet else F.lit(0.0)
        df, e = named(df, "_e", e if n == 3 else embed(e, zz))
        if model == "newtonian_fluid":
            s = scale(add(e, scale(eye(3), tr(e) / 3), -1), 2 * viscosity)
        else:
            s = add(scale(eye(3), lam * tr(e)), e, 2 * mu)
            energy = sum((s[i][j] * e[i][j] for i in range(3) for j in range(3)), F.lit(0.0)) / 2
    elif model in ("saint_venant_kirchhoff", "neo_hookean"):
        f = add(g, eye(n))
        if n == 2:
            if not sheet:
                zz = F.lit(1.0)
            elif model == "neo_hookean":
                zz = free_stretch(F.when(det(f) > 0, det(f)), lam, mu)
            else:
                left = 1 - 2 * lam / (lam + 2 * mu) * tr(strain_tensor(g, "green_lagrange"))
                zz = F.sqrt(F.when(left > 0, left))
            f = embed(f, zz)
        df, f = named(df, "_f", f)
        df = df.withColumn("_j", F.when(det(f) > 0, det(f)))
        j = F.col("_j")
        if model == "neo_hookean":
            df, b = named(df, "_e", mul(f, t(f)))
            s = scale(add(scale(add(b, eye(3), -1), mu), scale(eye(3), lam * F.log(j))), 1 / j)
            energy = mu / 2 * (tr(b) - 3) - mu * F.log(j) + lam / 2 * F.log(j) * F.log(j)
        else:
            df, e = named(df, "_e", scale(add(mul(t(f), f), eye(3), -1), 0.5))
            df, second = named(df, "_s", add(scale(eye(3), lam * tr(e)), e, 2 * mu))
            s = scale(mul(mul(f, second), t(f)), 1 / j)
            energy = lam / 2 * tr(e) * tr(e) + mu * sum((e[i][k] * e[i][k] for i in range(3) for k in range(3)), F.lit(0.0))
            energy = F.when(j.isNotNull(), energy)
    else:
        raise ValueError(f"unknown model {model!r}")
    at = [(i, k) for i in range(3) for k in range(i, 3)]
    name = lambda i, k: f"stress_{'zyx'[min(i, k)]}{'zyx'[max(i, k)]}"
    out = df.select(*own, *[s[i][k].alias(name(i, k)) for i, k in at], energy.alias("energy"))
    c = [[F.col(name(i, k)) for k in range(3)] for i in range(3)]
    p1, p2, p3 = eigen3(c)
    shear = c[0][1] * c[0][1] + c[0][2] * c[0][2] + c[1][2] * c[1][2]
    apart = sum((F.pow(c[i][i] - c[k][k], 2) for i, k in ((0, 1), (1, 2), (0, 2))), F.lit(0.0))
    out = out.withColumn("stress_p1", p1).withColumn("stress_p2", p2).withColumn("stress_p3", p3).withColumn("pressure", -tr(c) / 3).withColumn("von_mises", F.sqrt(apart / 2 + 3 * shear))
    out = out.withColumn("max_shear", (F.col("stress_p1") - F.col("stress_p3")) / 2)
    shown = [name(i, k) for i, k in at if n == 3 or i == k or i > 0]
    return out.select(*own, *[or_nan(F.col(x)).alias(x) for x in (*shown, "stress_p1", "stress_p2", "stress_p3", "pressure", "von_mises", "max_shear", "energy")])


def lattice_gradient(df: DataFrame, field: Sequence[str] = ("disp_y", "disp_x"), keys: Sequence[str] = ("m", "t"), y: str = "gy", x: str = "gx", h: float = 1.0) -> DataFrame:
    """grad_<ij> on a regular lattice: central differences, one-sided at edges and holes."""
    own = [k for k in keys if k in df.columns]
    cols = [grid_derivative(df, f, a, [*own, y, x], h).alias(f"grad_{f[-1]}{n}") for f in field for n, a in (("y", y), ("x", x))]
    return df.select("*", *cols)


def gradient(df: DataFrame, method: str = "lattice", radius: float = 0.0, **options) -> DataFrame:
    return lattice_gradient(df, **options) if method == "lattice" else local_gradient(df, radius, **options)


def grid(spark, height: int, width: int, step: int, frames: int = 1, margin: int | None = None, depth: int = 0) -> DataFrame:
    """Nodes of a correlation lattice, one row a node and frame: id, t, (z,) y, x and zero displacement."""
    m = step // 2 if margin is None else margin
    line = lambda n: F.explode(F.sequence(F.lit(m), F.lit(max(m, n - 1 - m)), F.lit(step)))
    d = spark.range(frames).withColumnRenamed("id", "t")
    if depth:
        d = d.withColumn("z", line(depth))
    d = d.withColumn("y", line(height)).withColumn("x", line(width))
    ny, nx = max(0, height - 1 - 2 * m) // step + 1, max(0, width - 1 - 2 * m) // step + 1
    zi = F.floor((F.col("z") - m) / step) * (ny * nx) if depth else F.lit(0)
    node = zi + F.floor((F.col("y") - m) / step) * nx + F.floor((F.col("x") - m) / step)
    return d.withColumn("id", node.cast("long")).withColumn("disp_y", F.lit(0.0)).withColumn("disp_x", F.lit(0.0))
