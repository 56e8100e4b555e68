"""Selection, cropping, re-indexing and concatenation of the acquisition axes."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Refusal, need
from ..functions.reducers import reduce_column
from .ordered import numbered


def reindex(df: DataFrame, axis: str, keep: Sequence[int]) -> DataFrame:
    """Rows of the chosen indices of an axis, renumbered in the order given.

    A literal map, so it is a filter pushed to the scan and a projection; nothing is joined.
    """
    need(df, axis)
    keep = [int(k) for k in keep]
    if len(set(keep)) != len(keep):
        raise Refusal("an index is chosen twice")
    d = df.where(F.col(axis).isin(keep))
    if keep == list(range(keep[0], keep[0] + len(keep))) if keep else True:
        return d.withColumn(axis, F.col(axis) - (keep[0] if keep else 0))
    table = F.create_map(*[F.lit(v) for i, k in enumerate(keep) for v in (k, i)])
    return d.withColumn(axis, F.element_at(table, F.col(axis).cast("int")).cast("long"))


def select_channels(df: DataFrame, channels: Sequence[int]) -> DataFrame:
    return reindex(df, "c", channels)


def select_position(df: DataFrame, position: int) -> DataFrame:
    return reindex(df, "m", [position])


def select_plane(df: DataFrame, plane: int = 0) -> DataFrame:
    return reindex(df, "z", [plane])


def select_frame(df: DataFrame, frame: int = 0) -> DataFrame:
    return reindex(df, "t", [frame])


def select_batch(df: DataFrame, member: int) -> DataFrame:
    return reindex(df, "b", [member])


def split(df: DataFrame, axis: str, size: int) -> list[DataFrame]:
    """One table for each index of an axis (taps of the split operators); a plan each, computed only where used."""
    return [reindex(df, axis, [k]) for k in range(size)]


def ranges(df: DataFrame, axis: str, groups: str) -> list[DataFrame]:
    """Tables of index groups such as '0-3,7;8-9'."""
    from .tables import parse_ids

    return [reindex(df, axis, parse_ids(g)) for g in groups.split(";")]


def select_group(df: DataFrame, positions: DataFrame, group: Sequence[int], gap_factor: float = 3.0) -> DataFrame:
    """Rows at positions of the chosen specimen groups, positions renumbered; see position_groups."""
    chosen = position_groups(positions, gap_factor).where(F.col("specimen").isin(list(group)))
    if chosen.limit(1).count() == 0:
        raise Refusal(f"no position is in group {list(group)}")
    new = chosen.select("m", (F.row_number().over(Window.orderBy("m")) - 1).cast("long").alias("_m"))
    return df.join(new, "m").withColumn("m", F.col("_m")).drop("_m")


def position_groups(positions: DataFrame, gap_factor: float = 3.0) -> DataFrame:
    """m, x, y -> specimen: a new group starts where the step from the position before exceeds gap_factor median steps.

    Positions are a table of an experiment's fields, a few rows an acquisition, so one ordered window does.
    """
    w = Window.orderBy("m")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    d = positions.withColumn("_s", step)
    middle = d.agg(F.percentile("_s", 0.5).alias("_mid"))
    d = d.crossJoin(F.broadcast(middle))  # one row
    new = F.when(F.col("_s") > F.col("_mid") * gap_factor, 1).otherwise(0)
    return d.withColumn("specimen", F.sum(new).over(w).cast("long")).drop("_s", "_mid")


def crop(df: DataFrame, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None, z: tuple[int, int] | None = None) -> DataFrame:
    """Rows inside half-open windows of y, x and z, moved so that the window starts at 0."""
    for axis, window in (("y", y), ("x", x), ("z", z)):
        if window is not None:
            a, b = window
            if b <= a:
                raise Refusal(f"the {axis} window is empty")
            df = df.where((F.col(axis) >= a) & (F.col(axis) < b)).withColumn(axis, F.col(axis) - a)
    return df


def crop_region(df: DataFrame, region: DataFrame, keep: str = "inside", extent: str = "frame", fill: float | None = None, margin: int = 0, unit: Sequence[str] = ("m", "t")) -> DataFrame:
    """Voxels of a mask (key rows): frame keeps coordinates and blanks the rest, fit crops to the mask's box."""
    keys = region.columns
    if extent == "fit":
        unit = [u for u in unit if u in keys]
        box = region.groupBy(*unit).agg(*[f(a).alias(f"_{n}{a}") for a in ("y", "x") for n, f in (("lo", F.min), ("hi", F.max))])
        d = df.join(box, unit) if unit else df.crossJoin(F.broadcast(box))
        for a in ("y", "x"):
            d = d.where(F.col(a).between(F.col(f"_lo{a}") - margin, F.col(f"_hi{a}") + margin))
        return d.select(*[(F.col(c) - F.greatest(F.col(f"_lo{c}") - margin, F.lit(0))).alias(c) if c in ("y", "x") else F.col(c) for c in df.columns])
    if fill is None:
        return df.join(region.distinct(), keys, "left_semi" if keep == "inside" else "left_anti")
    inside = df.join(region.distinct().withColumn("_in", F.lit(True)), keys, "left")
    ok = F.col("_in").isNotNull() if keep == "inside" else F.col("_in").isNull()
    return inside.withColumn("value", F.when(ok, F.col("value")).otherwise(F.lit(float(fill)))).drop("_in")


def crop_objects(df: DataFrame, labels: DataFrame, keys: Sequence[str] = ("m", "t", "z", "y", "x")) -> DataFrame:
    """Each object's voxels with coordinates from its own box: adds label_id; one plan for all objects."""
    d = df.join(labels.where("label_id > 0"), list(keys))
    box = d.groupBy("label_id").agg(F.min("y").alias("_y"), F.min("x").alias("_x"))
    return d.join(box, "label_id").withColumn("y", F.col("y") - F.col("_y")).withColumn("x", F.col("x") - F.col("_x")).drop("_y", "_x")


def crop_to(df: DataFrame, stage: DataFrame, region: tuple[float, float, float, float], pixel_um: float, margin_um: float = 0.0) -> DataFrame:
    """Voxels whose stage position (position's x_um, y_um by m, plus pixels) is in a box (y0, y1, x0, x1) in um."""
    y0, y1, x0, x1 = region
    d = df.join(stage.select("m", F.col("y_um").alias("_y"), F.col("x_um").alias("_x")), "m")
    d = d.withColumn("_y", F.col("_y") + F.col("y") * pixel_um).withColumn("_x", F.col("_x") + F.col("x") * pixel_um)
    return d.where(F.col("_y").between(y0 - margin_um, y1 + margin_um) & F.col("_x").between(x0 - margin_um, x1 + margin_um)).drop("_y", "_x")


def trim_indices(n: int, fraction: float | None = 0.5, count: int | None = None, spacing: str = "span") -> list[int]:
    """Evenly spaced indices of n: over the whole span, or with one stride from the start."""
    k = min(n, max(1, math.floor(n * fraction + 0.5) if count is None else count))
    if k == 1:
        return [0]
    if spacing == "span":
        return [i * (n - 1) // (k - 1) for i in range(k)]
    step = (n - 1) // (k - 1)
    return [i * step for i in range(k)]


def trim(df: DataFrame, axis: str, n: int, **options) -> DataFrame:
    return reindex(df, axis, trim_indices(n, **options))


def respaced(keep: Sequence[int], spacing: float | None) -> float | None:
    """Spacing of an axis after a choice of indices: uniform steps multiply it, uneven ones drop it."""
    steps = {b - a for a, b in zip(keep, keep[1:])}
    return None if spacing is None or len(steps) > 1 else spacing * (steps.pop() if steps else 1)


def time_shift_rows(df: DataFrame, delta: int, n: int, direction: str = "later") -> DataFrame:
    """Structure rows moved in time; those moved off the axis go."""
    d = delta if direction == "later" else -delta
    return df.withColumn("t", F.col("t") + d).where(F.col("t").between(0, n - 1))


def time_shift_image(df: DataFrame, delta: int, n: int, direction: str = "later", edges: str = "hold") -> DataFrame:
    """Lattice values moved in time: at the edge the nearest frame is held, or 0 put.

    Each frame goes to the frames that show it, an explode of a short sequence; no join.
    """
    d = delta if direction == "later" else -delta
    t = F.col("t")
    if edges == "blank":
        moved = df.withColumn("t", t + d).where(F.col("t").between(0, n - 1))
        gone = df.where(~(t + d).between(0, n - 1)).withColumn("t", F.when(t + d < 0, t + d + n).otherwise(t + d - n)).withColumn("value", F.lit(0.0))
        return moved.unionByName(gone)
    first = F.when(t == 0, F.least(F.lit(0), t + d)).otherwise(t + d)
    last = F.when(t == n - 1, F.greatest(F.lit(n - 1), t + d)).otherwise(t + d)
    targets = F.filter(F.sequence(first, last), lambda v: (v >= 0) & (v < n))
    return df.withColumn("t", F.explode(targets)).withColumn("t", F.col("t").cast("long"))


def merge(parts: Sequence[DataFrame], axis: str, sizes: Sequence[int]) -> DataFrame:
    """Inputs one after another along an axis."""
    out, at = None, 0
    for d, n in zip(parts, sizes):
        d = d.withColumn(axis, F.col(axis) + at)
        out = d if out is None else out.unionByName(d)
        at += n
    return out


def sequence_number(name: str) -> list[int]:
    return [int(x) for x in re.findall(r"\d+", name)]


def file_order(files: Sequence[str], clocks: Sequence[float | None] | None = None, rule: str | None = None) -> list[int]:
    """Order of input files: by clock if all have one, else by the numbers in their names, else as given."""
    if rule in (None, "time") and clocks and all(c is not None for c in clocks):
        return sorted(range(len(files)), key=lambda i: (clocks[i], i))
    if rule in (None, "time", "sequence") and all(sequence_number(f) for f in files):
        return sorted(range(len(files)), key=lambda i: (sequence_number(files[i]), i))
    return list(range(len(files)))


def timeseries(parts: Sequence[DataFrame], sizes: Sequence[int], files: Sequence[str], axis: str = "t", clocks=None, order: str | None = None) -> DataFrame:
    """Files laid end to end along an axis in file_order()."""
    at = file_order(files, clocks, order)
    return merge([parts[i] for i in at], axis, [sizes[i] for i in at])


def merge_frames(frames: DataFrame) -> DataFrame:
    """file, t, clock -> the frames' new t in order of clock, each file's own order kept, ties by file."""
    own = Window.partitionBy("file").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = frames.withColumn("_c", F.max("clock").over(own))
    return numbered(d, ["_c", "file", "t"], "new_t", 0).drop("_c")


def batch(parts: Sequence[DataFrame]) -> DataFrame:
    """Datasets under a new outer axis b."""
    out = None
    for k, d in enumerate(parts):
        d = d.withColumn("b", F.lit(k).cast("long"))
        out = d if out is None else out.unionByName(d)
    return out


def zproject(df: DataFrame, method: str = "max") -> DataFrame:
    """One plane of a stack: max, mean, sum, min or median over z."""
    keys = [a for a in ("b", "m", "t", "c", "y", "x") if a in df.columns]
    return df.groupBy(*keys).agg(reduce_column(method, "value").alias("value"))


def stack(df: DataFrame, method: str = "mean") -> DataFrame:
    """One frame of a series: mean, median, sigma_clip, trimmed_mean, max or sum over t."""
    keys = [a for a in ("b", "m", "z", "c", "y", "x") if a in df.columns]
    return df.groupBy(*keys).agg(reduce_column(method, "value").alias("value"))


def downsample(df: DataFrame, factor: float) -> DataFrame:
    """Block means: the pixel at floor(y * factor), floor(x * factor), for factors below 1."""
    if not 0 < factor <= 1:
        raise Refusal("block means need a factor in (0, 1]")
    keys = [a for a in ("b", "m", "t", "z", "c") if a in df.columns]
    d = df.withColumn("y", F.floor(F.col("y") * factor)).withColumn("x", F.floor(F.col("x") * factor))
    return d.groupBy(*keys, "y", "x").agg(reduce_column("mean", "value").alias("value"))


def stitch(df: DataFrame, tiles: DataFrame, blend: str = "mean", tile_size: tuple[int, int] | None = None) -> DataFrame:
    """One mosaic from positions: tile offsets (m, oy, ox in pixels) added, overlaps blended by feather, max, mean or overwrite."""
    keys = [a for a in ("b", "t", "z", "c") if a in df.columns]
    d = df.join(tiles, "m").withColumn("_y", F.col("y") + F.col("oy")).withColumn("_x", F.col("x") + F.col("ox"))
    if blend == "feather":
        h, w = tile_size
        edge = F.least(F.col("y") + 1, F.lit(h) - F.col("y"), F.col("x") + 1, F.lit(w) - F.col("x")).cast("double")
        value = F.sum(F.col("value") * F.col("_w")) / F.sum("_w")
        d = d.withColumn("_w", edge)
    else:
        value = {"max": F.max("value"), "mean": F.avg("value"), "overwrite": F.max_by("value", "m")}[blend]
    return d.groupBy(*keys, F.col("_y").alias("y"), F.col("_x").alias("x")).agg(value.alias("value"))


def stitch_points(points: DataFrame, tiles: DataFrame, tile_size: tuple[int, int]) -> DataFrame:
    """Points moved with their tiles; in an overlap a point stays only in the tile whose centre is nearest."""
    h, w = tile_size
    d = points.join(tiles, "m").withColumn("y", F.col("y") + F.col("oy")).withColumn("x", F.col("x") + F.col("ox")).drop("oy", "ox")
    centres = F.broadcast(tiles.select(F.col("m").alias("_tm"), (F.col("oy") + h / 2).alias("_cy"), (F.col("ox") + w / 2).alias("_cx"), "oy", "ox"))
    # tiles are the fields of one mosaic, so the range join's right side is small
    near = d.join(centres, (F.col("y") >= F.col("oy")) & (F.col("y") < F.col("oy") + h) & (F.col("x") >= F.col("ox")) & (F.col("x") < F.col("ox") + w))
    dist = F.pow(F.col("y") - F.col("_cy"), 2) + F.pow(F.col("x") - F.col("_cx"), 2)
    keys = [c for c in d.columns]
    best = near.groupBy(*keys).agg(F.min_by("_tm", F.struct(dist.alias("d"), F.col("_tm"))).alias("_best"))
    return best.where("_best = m").drop("_best").withColumn("m", F.lit(0).cast("long"))
