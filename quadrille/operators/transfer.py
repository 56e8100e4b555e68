"""Moving attributes between domains: lattice reduce and broadcast, and the bridges to labels, points and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import LATTICE, AxisSizes, Refusal, need, spine
from ..functions.missing import finite, or_nan
from ..functions.reducers import reduce_column

NAN = float("nan")


def present(df: DataFrame, domain: str) -> list[str]:
    return [a for a in LATTICE[domain] if a in df.columns]


def lattice(df: DataFrame, source: str, target: str, attr: str, reducer: str = "mean", sizes: AxisSizes | None = None) -> DataFrame:
    """An attribute on another lattice domain: dropped axes are reduced, new axes are filled from the spine.

    The reduction is one grouped aggregate; the broadcast is a cross join of the reduced rows with an
    axis spine, whose size the axis sizes fix.
    """
    need(df, attr)
    if source == target:
        raise Refusal("source and target are the same domain")
    keep = [a for a in present(df, source) if a in LATTICE[target]]
    drop = [a for a in present(df, source) if a not in LATTICE[target]]
    out = df
    if drop:
        order = F.struct(*drop)
        out = df.groupBy(*keep).agg(reduce_column(reducer, attr, empty_sum=NAN if reducer == "sum" else 0.0, order=order).alias(attr))
    new = [a for a in LATTICE[target] if a not in LATTICE[source] and (sizes is None or getattr(sizes, a) > 1 or a != "b")]
    if new:
        if sizes is None:
            raise Refusal(f"the axes {', '.join(new)} need their sizes")
        out = out.crossJoin(spine(df.sparkSession, sizes, tuple(new)))
    return out.select(*[a for a in LATTICE[target] if a in keep or a in new], attr)


VOXEL_KEYS = ("b", "m", "t", "z", "c", "y", "x")


def voxel_to_label(voxels: DataFrame, raster: DataFrame, attr: str = "value", reducer: str = "mean", label: str = "label_id") -> DataFrame:
    """Reduces voxels over each label of a raster; ids must be whole numbers and 0 is background."""
    if dict(raster.dtypes)[label] not in ("int", "bigint", "smallint", "tinyint"):
        raise Refusal(f"{label} is not a whole number")
    on = [k for k in VOXEL_KEYS if k in voxels.columns and k in raster.columns]
    d = voxels.join(raster.where(F.col(label) > 0), on)
    return d.groupBy(F.col(label).alias("id")).agg(reduce_column(reducer, attr, empty_sum=NAN).alias(attr))


def label_to_voxel(raster: DataFrame, table: DataFrame, attr: str, background: float = 0.0, label: str = "label_id") -> DataFrame:
    """Paints each voxel with its label's value."""
    on = [k for k in VOXEL_KEYS if k in raster.columns]
    d = raster.join(table.select(F.col("id").alias(label), F.col(attr).alias("_v")), label, "left")
    return d.select(*on, F.coalesce("_v", F.lit(background)).alias(attr))


def nearest_voxel(points: DataFrame, sizes: AxisSizes) -> DataFrame:
    """Points' coordinates rounded half to even and clipped to the frame, as _z, _y, _x."""
    clip = lambda a: F.greatest(F.lit(0), F.least(F.rint(a).cast("long"), F.lit(getattr(sizes, a) - 1)))
    for a in ("z", "y", "x"):
        points = points.withColumn(f"_{a}", clip(a) if a in points.columns else F.lit(0).cast("long"))
    return points


def voxel_to_point(points: DataFrame, voxels: DataFrame, sizes: AxisSizes, attr: str = "value", name: str = "") -> DataFrame:
    """Samples the nearest voxel at each point, by an equi-join on rounded coordinates."""
    d = nearest_voxel(points, sizes)
    on = [k for k in ("b", "m", "t", "c") if k in points.columns and k in voxels.columns]
    space = [a for a in ("z", "y", "x") if a in voxels.columns]
    right = voxels.select(*on, *[F.col(a).cast("long").alias(f"_{a}") for a in space], F.col(attr).alias("_v"))
    return d.join(right, [*on, *[f"_{a}" for a in space]], "left").withColumn(name or attr, or_nan(F.col("_v").cast("double"))).drop("_v", "_z", "_y", "_x")


def point_to_voxel(points: DataFrame, attr: str, sizes: AxisSizes, reducer: str = "sum") -> DataFrame:
    """Splats points on their nearest voxels; collisions are summed, averaged or the greatest taken."""
    d = nearest_voxel(points, sizes)
    on = [k for k in ("b", "m", "t", "c") if k in points.columns]
    return d.groupBy(*on, F.col("_z").alias("z"), F.col("_y").alias("y"), F.col("_x").alias("x")).agg(reduce_column(reducer, attr, empty_sum=NAN).alias(attr))


def containing_label(points: DataFrame, raster: DataFrame, sizes: AxisSizes, label: str = "label_id") -> DataFrame:
    """Adds the label under each point, 0 outside."""
    d = nearest_voxel(points, sizes)
    on = [k for k in ("b", "m", "t", "c") if k in points.columns and k in raster.columns]
    space = [a for a in ("z", "y", "x") if a in raster.columns]
    right = raster.select(*on, *[F.col(a).cast("long").alias(f"_{a}") for a in space], F.col(label).alias("_l"))
    return d.join(right, [*on, *[f"_{a}" for a in space]], "left").withColumn(label, F.coalesce("_l", F.lit(0))).drop("_l", "_z", "_y", "_x")


def point_to_label(points: DataFrame, raster: DataFrame, attr: str, sizes: AxisSizes, reducer: str = "mean") -> DataFrame:
    d = containing_label(points, raster, sizes).where("label_id > 0")
    return d.groupBy(F.col("label_id").alias("id")).agg(reduce_column(reducer, attr, empty_sum=NAN).alias(attr))


def label_to_point(points: DataFrame, raster: DataFrame, table: DataFrame, attr: str, sizes: AxisSizes) -> DataFrame:
    d = containing_label(points, raster, sizes)
    return d.join(table.select(F.col("id").alias("label_id"), F.col(attr).alias("_v")), "label_id", "left").withColumn(attr, or_nan(F.col("_v").cast("double"))).drop("_v")


def member_to_track(members: DataFrame, membership: DataFrame, attr: str, reducer: str = "mean") -> DataFrame:
    """Reduces members over their track; missing members and track ids of 0 or less don't count."""
    d = membership.where("track_id > 0").join(members.select(F.col("id").alias("member_id"), attr), "member_id")
    return d.groupBy("track_id").agg(reduce_column(reducer, attr, empty_sum=NAN).alias(attr))


def track_to_member(membership: DataFrame, tracks: DataFrame, attr: str) -> DataFrame:
    """A track's value at its members; a member of several tracks takes the first, by track and time."""
    first = membership.groupBy("member_id").agg(F.min_by("track_id", F.struct("track_id", "t")).alias("track_id"))
    return first.join(tracks.select("track_id", attr), "track_id", "left").select("member_id", or_nan(F.col(attr).cast("double")).alias(attr))


def track_to_timepoint(membership: DataFrame) -> DataFrame:
    """Number of distinct tracks active at each time."""
    return membership.where("track_id > 0").groupBy("t").agg(F.countDistinct("track_id").alias("tracks"))


def timepoint_to_track(membership: DataFrame, table: DataFrame, attr: str) -> DataFrame:
    return membership.join(table.select("t", attr), "t", "left")


def member_to_frame(members: DataFrame, attr: str, reducer: str = "mean") -> DataFrame:
    keys = [k for k in ("b", "m", "t") if k in members.columns]
    return members.groupBy(*keys).agg(reduce_column(reducer, attr, empty_sum=NAN).alias(attr))


def frame_to_member(members: DataFrame, frames: DataFrame, attr: str) -> DataFrame:
    keys = [k for k in ("b", "m", "t") if k in members.columns and k in frames.columns]
    return members.join(frames.select(*keys, F.col(attr).alias("_v")), keys, "left").withColumn(attr, or_nan(F.col("_v").cast("double"))).drop("_v")


#: Bridges between domains, with whether the hop reduces.
BRIDGES = {
    ("voxel", "label"): True, ("label", "voxel"): False, ("voxel", "point"): False, ("point", "voxel"): True,
    ("point", "label"): True, ("label", "point"): False, ("label", "track"): True, ("point", "track"): True,
    ("track", "label"): False, ("track", "point"): False, ("track", "timepoint"): True, ("timepoint", "track"): False,
    ("label", "frame"): True, ("frame", "label"): False, ("point", "frame"): True, ("frame", "point"): False,
}


def plan(source: str, target: str) -> list[str]:
    """Shortest route of domains from source to target; lattice to lattice is one hop."""
    if source == target:
        raise Refusal("source and target are the same domain")
    edges: dict[str, list[str]] = {}
    for a, b in BRIDGES:
        edges.setdefault(a, []).append(b)
    for a in LATTICE:
        edges.setdefault(a, []).extend(b for b in LATTICE if b != a)
    seen, queue = {source: None}, [source]
    while queue:
        at = queue.pop(0)
        if at == target:
            out = [at]
            while seen[at] is not None:
                at = seen[at]
                out.append(at)
            return out[::-1]
        for b in edges.get(at, ()):
            if b not in seen:
                seen[b] = at
                queue.append(b)
    raise Refusal(f"no way from {source} to {target}")


def label_to_points(raster: DataFrame, image: DataFrame | None = None, position: str = "centroid", unit: tuple[str, ...] = ("m", "t", "c", "z")) -> DataFrame:
    """One point a region: centroid, intensity-weighted centroid, or the region's own voxel nearest the centroid."""
    unit = [u for u in unit if u in raster.columns]
    d = raster.where("label_id > 0")
    space = [a for a in ("z", "y", "x") if a in d.columns and a not in unit]
    if position == "weighted":
        if image is None:
            raise Refusal("a weighted position needs an image")
        on = [k for k in VOXEL_KEYS if k in d.columns and k in image.columns]
        d = d.join(image.select(*on, finite("value").alias("_v")), on)
        out = d.groupBy(*unit, "label_id").agg(*[or_nan(F.try_divide(F.sum(F.col("_v") * F.col(a)), F.sum("_v"))).alias(a) for a in space])
    else:
        out = d.groupBy(*unit, "label_id").agg(*[F.avg(a).alias(a if position == "centroid" else f"_c{a}") for a in space])
        if position == "inside":
            near = d.join(out, [*unit, "label_id"])
            dist = sum((F.pow(F.col(a) - F.col(f"_c{a}"), 2) for a in space), F.lit(0.0))
            best = F.min_by(F.struct(*space), F.struct(F.round(dist, 9).alias("d"), *space))
            out = near.groupBy(*unit, "label_id").agg(best.alias("p")).select(*unit, "label_id", *[F.col(f"p.{a}").cast("double").alias(a) for a in space])
    return out.withColumnRenamed("label_id", "label")


def raster_variance(pixels: str, axis: str):
    """Population variance of an axis over an object's pixels, one after another in raster order.

    The last bits of yy - xx decide between 0 and half a turn for an object as wide as high, so its order is fixed:
    a grouped variance would depend on how partitions met.
    """
    start = F.struct(*[F.lit(0.0).alias(n) for n in ("n", "mean", "sum")])

    def add(s, p):
        v, n = p[axis].cast("double"), s["n"] + 1
        d = v - s["mean"]
        mean = s["mean"] + d / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["sum"] + d * (v - mean)).alias("sum"))

    return F.aggregate(pixels, start, add, lambda s: s["sum"] / s["n"])


def measure(raster: DataFrame, image: DataFrame, stats=("mean", "max", "min", "count"), shape: bool = False) -> DataFrame:
    """Per label: intensity statistics, area and centroid, and shape from moments; one grouped aggregate."""
    on = [k for k in VOXEL_KEYS if k in raster.columns and k in image.columns]
    d = raster.where("label_id > 0").join(image.select(*on, "value"), on)
    space = [a for a in ("z", "y", "x") if a in d.columns]
    named = {"sum": "total", "mean": "mean", "max": "max", "min": "min", "median": "median", "std": "std"}
    agg = [F.count(F.lit(1)).alias("area"), *[F.avg(a).alias(a) for a in space]]
    agg += [reduce_column(s, "value").alias(f"{named[s]}_intensity") for s in stats if s in named]
    if shape:
        place = [k for k in ("b", "m", "t", "c", "z", "y", "x") if k in d.columns]
        agg += [F.array_sort(F.collect_list(F.struct(*place))).alias("_px"), F.covar_pop("y", "x").alias("_yx"), *[f(a).alias(f"_{n}{a}") for a in ("y", "x") for n, f in (("lo", F.min), ("hi", F.max))]]
    out = d.groupBy(F.col("label_id").alias("id")).agg(*agg)
    if shape:
        yy, xx, yx = raster_variance("_px", "y") + 1 / 12, raster_variance("_px", "x") + 1 / 12, F.when(F.abs("_yx") > 1e-12, F.col("_yx")).otherwise(0.0)
        root = F.sqrt(F.pow((yy - xx) / 2, 2) + yx * yx)
        l1, l2 = (yy + xx) / 2 + root, F.greatest((yy + xx) / 2 - root, F.lit(0.0))
        out = out.withColumn("axis_major", 4 * F.sqrt(l1)).withColumn("axis_minor", 4 * F.sqrt(l2)).withColumn("eccentricity", F.sqrt(F.greatest(1 - F.try_divide(l2, l1), F.lit(0.0))))
        out = out.withColumn("orientation", 0.5 * F.atan2(2 * yx, yy - xx)).withColumn("extent", F.col("area") / ((F.col("_hiy") - F.col("_loy") + 1) * (F.col("_hix") - F.col("_lox") + 1)))
        out = out.drop("_px", "_yx", "_loy", "_hiy", "_lox", "_hix")
        out = out.join(perimeters(raster), "id").join(hull_areas(raster), "id").withColumn("solidity", F.col("area") / F.col("convex_area")).drop("convex_area")
    return out


#: Length that a border pixel adds, by 1 + 2 x its edge neighbours + 10 x its corner neighbours on the border.
BORDER = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: 2**0.5, 33: 2**0.5, 13: (1 + 2**0.5) / 2, 23: (1 + 2**0.5) / 2}


def perimeters(raster: DataFrame) -> DataFrame:
    """id, perimeter of each label: its border pixels (those with a 4-neighbour outside), each weighted by how the border runs through it."""
    own = [k for k in VOXEL_KEYS if k in raster.columns and k not in ("y", "x")]
    d = raster.where("label_id > 0").select(*own, "label_id", "y", "x")
    steps = lambda moves: F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(w).alias("w")) for a, b, w in moves]))
    place = [*own, "label_id", "y", "x"]

    def gathered(pixels: DataFrame, moves) -> DataFrame:
        """Sum of the weights of the moves that lead from other pixels to a place."""
        m = pixels.withColumn("_m", steps(moves)).select(*own, "label_id", (F.col("y") + F.col("_m.dy")).alias("y"), (F.col("x") + F.col("_m.dx")).alias("x"), "_m.w")
        return m.groupBy(*place).agg(F.sum("w").alias("_w"))

    edge, corner = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    inner = gathered(d, [(a, b, 1) for a, b in edge]).where("_w = 4").select(*place)
    border = d.join(inner, place, "left_anti")
    code = border.join(gathered(border, [(0, 0, 1), *[(a, b, 2) for a, b in edge], *[(a, b, 10) for a, b in corner]]), place)
    length = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in BORDER.items() for x in (k, v)]), F.col("_w").cast("int")), F.lit(0.0))
    return code.groupBy(F.col("label_id").alias("id")).agg(F.sum(length).alias("perimeter"))


def hull_areas(raster: DataFrame) -> DataFrame:
    """id, convex_area of each label: pixels of its convex hull, one object a group."""
    import numpy as np
    import pyarrow as pa

    from ..functions import kernels as K

    def run(t: pa.Table) -> pa.Table:
        p = np.stack([t.column(a).to_numpy() for a in ("y", "x")], 1)
        return pa.table({"id": pa.array([t.column("label_id")[0].as_py()], pa.int64()), "convex_area": pa.array([K.hull_area(p)], pa.int64())})

    # of each row of an object only the first and the last pixel can be a corner
    ends = raster.where("label_id > 0").groupBy(F.col("label_id").cast("long").alias("label_id"), F.col("y").cast("long").alias("y")).agg(F.min("x").cast("long").alias("a"), F.max("x").cast("long").alias("b"))
    ends = ends.select("label_id", "y", F.explode(F.array("a", "b")).alias("x"))
    return ends.groupBy("label_id").applyInArrow(run, "id long, convex_area long")


def measure_pixels(raster: DataFrame, image: DataFrame, max_rows: int = 5_000_000) -> DataFrame:
    """One row a voxel of every region, with its intensity and its distance to the region's centroid; refused beyond max_rows."""
    on = [k for k in VOXEL_KEYS if k in raster.columns and k in image.columns]
    d = raster.where("label_id > 0")
    if d.limit(max_rows + 1).count() > max_rows:
        raise Refusal(f"more than {max_rows} pixels")
    centre = d.groupBy("label_id").agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
    d = d.join(image.select(*on, F.col("value").alias("intensity")), on).join(centre, "label_id")
    return d.withColumn("centroid_dist", F.sqrt(F.pow(F.col("y") - F.col("_cy"), 2) + F.pow(F.col("x") - F.col("_cx"), 2))).drop("_cy", "_cx")
