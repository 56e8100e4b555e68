"""Spatial joins without a Cartesian product: neighbours within a radius meet in grid cells of that size."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Refusal, need
from ..functions.missing import finite
from .ordered import numbered


def within(left: DataFrame, right: DataFrame, radius: float, axes=("y", "x"), on=(), suffix: str = "_r") -> DataFrame:
    """Pairs of rows with equal `on` and a distance of at most `radius`; adds dist.

    Space is cut into cells as wide as the radius; each right row goes to the 3^d cells around its own,
    so a pair meets in the left row's cell, once, by an equi-join that shuffles on the cell.
    """
    if radius <= 0:
        raise Refusal("the radius must be positive")
    cell = lambda a: F.floor(F.col(a) / radius).cast("long")
    for a in axes:
        left, right = left.where(finite(a).isNotNull()), right.where(finite(a).isNotNull())
    r = right.select(*[F.col(c).alias(c + suffix) for c in right.columns], *[cell(a).alias(f"_q{a}") for a in axes])
    around = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"d{a}") for a, v in zip(axes, step)]) for step in itertools.product((-1, 0, 1), repeat=len(axes))])
    r = r.withColumn("_d", F.explode(around))
    for a in axes:
        r = r.withColumn(f"_q{a}", F.col(f"_q{a}") + F.col(f"_d.d{a}"))
    r = r.drop("_d")
    lq = left
    for a in axes:
        lq = lq.withColumn(f"_l{a}", cell(a))
    cond = [F.col(f"_l{a}") == F.col(f"_q{a}") for a in axes] + [F.col(k) == F.col(k + suffix) for k in on]
    d2 = sum((F.pow(F.col(a) - F.col(a + suffix), 2) for a in axes), F.lit(0.0))
    out = lq.join(r, cond).where(d2 <= radius * radius).withColumn("dist", F.sqrt(d2))  # the root would round what is just beyond onto the radius
    return out.drop(*[f"_l{a}" for a in axes], *[f"_q{a}" for a in axes])


def checkpoints(spark) -> None:
    """Refuses to go on without a shared checkpoint folder, but where the driver does all the work (tests)."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise Refusal("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(folder)


def label_components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """id, component (least id reachable) of every node; large-star and small-star rounds, each written to the checkpoint folder."""

    def neighbours_least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    checkpoints(nodes.sparkSession)
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(neighbours_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        least = neighbours_least(large)
        small = large.join(least, "u")
        e = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct().checkpoint()
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def unique_objects(df: DataFrame, tolerance: float, x: str = "stage_x_um", y: str = "stage_y_um", order_by=("t", "m"), keep_first: int = 0) -> DataFrame:
    """Adds object_uid, sighting (1 is the first) and sightings: rows of a batch linked by distance, single linkage.

    Rows of an object with the same order key are one sighting; a missing order key comes last; a row
    without a finite position is an object of its own.  Objects are numbered by first sighting.
    """
    need(df, "id", x, y, *order_by)
    batch = ["b"] if "b" in df.columns else []
    d = df.withColumn("_y", finite(y)).withColumn("_x", finite(x))
    pts = d.select("id", *batch, F.col("_y").alias("y"), F.col("_x").alias("x"))
    pairs = within(pts, pts, tolerance, on=batch).where("id < id_r").select(F.col("id").alias("a"), F.col("id_r").alias("b"))
    d = d.join(label_components(pts.select("id"), pairs), "id")
    order = [F.col(o).asc_nulls_last() for o in order_by]
    own = Window.partitionBy("component")
    d = d.withColumn("sighting", F.dense_rank().over(own.orderBy(*order)).cast("long")).withColumn("sightings", F.max("sighting").over(own).cast("long"))
    firsts = d.groupBy("component").agg(F.min(F.struct(*[F.struct(F.col(o).isNull().alias("null"), F.col(o).alias("v")).alias(f"o{i}") for i, o in enumerate(order_by)], "id")).alias("_first"))
    o0, key = F.col("_first.o0.v"), F.struct("_first", "component")
    firsts = firsts.withColumn("_o", o0 if d.schema[order_by[0]].dataType.simpleString() == "string" else o0.cast("double")).withColumn("_key", key)
    uid = numbered(firsts, ["_o", "_key"], "object_uid").select("component", "object_uid")
    out = d.join(uid, "component").select(*df.columns, "object_uid", "sighting", "sightings")
    return out.where(F.col("sighting") <= keep_first) if keep_first else out


def greedy_pairs(pairs: DataFrame, keys: list[str], score=("dist",)) -> DataFrame:
    """One-to-one pairs (a, b) of each group, taken in order of score, a, b while both ends are free.

    The order is sequential, so each group is decided in one vectorised task; groups are pairs of frames
    of one position, and run in parallel.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*score, "a", "b"], kind="stable")
        ua, ub, keep = set(), set(), []
        for a, b in zip(pdf["a"].to_numpy(), pdf["b"].to_numpy()):
            ok = a not in ua and b not in ub
            keep.append(ok)
            if ok:
                ua.add(a), ub.add(b)
        return pdf[np.array(keep, bool)]

    return pairs.groupBy(*keys).applyInPandas(pick, pairs.schema)


def number_tracks(rows: DataFrame, links: DataFrame) -> DataFrame:
    """track_id, t, member_id: components of the links, numbered 1..K by first appearance (t, id)."""
    comp = label_components(rows.select("id"), links.select("a", "b"))
    d = rows.select("id", "t").join(comp, "id")
    first = d.groupBy("component").agg(F.min(F.struct("t", "id")).alias("_f")).select("component", "_f.t", "_f.id")
    number = numbered(first, ["t", "id"], "track_id").select("component", "track_id")
    return d.join(number, "component").select("track_id", "t", F.col("id").alias("member_id"))


def nearest_first(left: DataFrame, right: DataFrame, radius: float, axes, keys: list[str]) -> DataFrame:
    """a, b, dist: greedy_pairs() of all pairs within a radius of each group, which are never listed.

    Pairs of a dense frame grow with its square; its points, which meet in one task, do not.
    """
    import pyarrow as pa

    from ..functions import kernels as K

    def run(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        at = lambda t, end="": np.stack([t.column(a + end).to_numpy() for a in axes], 1).reshape(-1, len(axes))
        got = K.greedy_match(at(l), l.column("id").to_numpy(), at(r, "_r"), r.column("id_r").to_numpy(), radius) if l.num_rows and r.num_rows else ([], [], [])
        return pa.table({n: pa.array(v, pa.float64() if n == "dist" else pa.int64()) for n, v in zip(("a", "b", "dist"), got)})

    def there(d: DataFrame, suffix: str = ""):
        for a in axes:
            d = d.where(finite(a).isNotNull())
        for k in keys:
            d = d.where(F.col(k).isNotNull())
        cols = [*[F.col(k) for k in keys], F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in axes]]
        d = d.select(*cols)
        return d.select(*[F.col(c).alias(c + suffix) for c in d.columns]).groupBy(*[k + suffix for k in keys])

    return there(left).cogroup(there(right, "_r")).applyInArrow(run, "a long, b long, dist double")


def link_points(points: DataFrame, max_distance: float, axes=("y", "x"), keys=("m", "c"), max_gap: int = 0, min_length: int = 1) -> DataFrame:
    """Tracks by greedy nearest neighbours between consecutive present times (and up to max_gap frames beyond)."""
    if max_distance <= 0:
        raise Refusal("the radius must be positive")
    keys = [k for k in keys if k in points.columns]
    times = points.select(*keys, "t").distinct()
    order = Window.partitionBy(*keys).orderBy("t")
    links = None
    for gap in range(max_gap + 1):
        step = times.withColumn("_next", F.lead("t", gap + 1).over(order))
        left = points.join(step, [*keys, "t"]).where("_next is not null").select(*keys, F.col("_next").alias("tt"), "id", "t", *axes)
        if links is not None:
            left = left.join(links.select(F.col("a").alias("id")), "id", "left_anti")
        right = points.select(*keys, F.col("t").alias("tt"), "id", *axes)
        if links is not None:
            right = right.join(links.select(F.col("b").alias("id")), "id", "left_anti")
        new = nearest_first(left, right, float(max_distance), axes, [*keys, "tt"]).select("a", "b")
        links = new if links is None else links.union(new)
    tracks = number_tracks(points, links)
    if min_length > 1:
        n = Window.partitionBy("track_id")
        tracks = tracks.withColumn("_n", F.count(F.lit(1)).over(n)).where(F.col("_n") >= min_length).drop("_n")
    return tracks


def link_labels(raster: DataFrame, iou_threshold: float = 0.0, keys=("m", "c")) -> DataFrame:
    """Tracks by overlap of label masks between t and t+1: greedy by IoU, then ids."""
    keys = [k for k in keys if k in raster.columns]
    d = raster.where("label_id > 0")
    area = d.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t"))
    space = [a for a in ("z", "y", "x") if a in d.columns]
    nxt = d.select(*keys, *space, (F.col("t") - 1).alias("t"), F.col("label_id").alias("b"))
    both = d.select(*keys, *space, "t", F.col("label_id").alias("a")).join(nxt, [*keys, *space, "t"]).groupBy(*keys, "t", "a", "b").agg(F.count(F.lit(1)).alias("o"))
    both = both.join(area.select(F.col("label_id").alias("a"), F.col("n").alias("na")), "a").join(area.select(F.col("label_id").alias("b"), F.col("n").alias("nb")), "b")
    both = both.withColumn("dist", -F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).where(-F.col("dist") >= iou_threshold)
    links = greedy_pairs(both.select(*keys, "t", "a", "b", "dist"), [*keys, "t"])
    return number_tracks(area.select(F.col("label_id").alias("id"), "t"), links)


def knn(df: DataFrame, k: int, axes=("y", "x"), keys=("m", "t", "z", "c")) -> DataFrame:
    """The k nearest other rows of each row in its own group, all of them where there are fewer: columns of both, dist and rank (ties by id).

    The first search radius of a group is that of a disc which holds k + 1 rows on average, so most rows
    find theirs in the nine cells around them; those that don't look again eight times as far, until every
    row has k neighbours or all of its group.  A round's findings are checkpointed.
    """
    on = [c for c in keys if c in df.columns]
    checkpoints(df.sparkSession)
    d = df
    for a in axes:
        d = d.where(finite(a).isNotNull())
    ends = [f(a).alias(f"_{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    size = d.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *ends)
    widest = F.greatest(*[F.col(f"_hi{a}") - F.col(f"_lo{a}") for a in axes]) if len(axes) > 1 else F.col(f"_hi{axes[0]}") - F.col(f"_lo{axes[0]}")
    radius = widest * F.pow((F.lit(float(k + 1)) / F.col("_n")), F.lit(1.0 / len(axes)))
    size = size.select(*on, F.when(radius > 0, radius).otherwise(1.0).alias("_radius"), F.least(F.lit(k), F.col("_n") - 1).alias("_most"))
    d = (d.join(size, on) if on else d.crossJoin(F.broadcast(size))).checkpoint()
    own = [c for c in d.columns if c in df.columns]
    around = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"d{a}") for a, v in zip(axes, step)]) for step in itertools.product((-1, 0, 1), repeat=len(axes))])
    out, left, reach = None, d.where("_most > 0"), 1.0
    while True:
        cell = lambda a, r=reach: F.floor(F.col(a) / (F.col("_radius") * r)).cast("long")
        right = d.select(*[F.col(c).alias(c + "_r") for c in own], *[cell(a).alias(f"_q{a}") for a in axes])
        at = left.withColumn("_d", F.explode(around)).select(*left.columns, *[(cell(a) + F.col(f"_d.d{a}")).alias(f"_l{a}") for a in axes])
        cond = [F.col(f"_l{a}") == F.col(f"_q{a}") for a in axes] + [F.col(c) == F.col(c + "_r") for c in on] + [F.col("id") != F.col("id_r")]
        dist = F.sqrt(sum((F.pow(F.col(a) - F.col(a + "_r"), 2) for a in axes), F.lit(0.0)))
        near = at.join(right, cond).withColumn("dist", dist).where(F.col("dist") <= F.col("_radius") * reach)
        w = Window.partitionBy("id", *on)
        near = near.withColumn("rank", F.row_number().over(w.orderBy("dist", "id_r"))).where(F.col("rank") <= k).withColumn("_found", F.count(F.lit(1)).over(w))
        near = near.where("_found >= _most").select(*own, *[c + "_r" for c in own], "dist", "rank").checkpoint()
        out = near if out is None else out.union(near)
        left = left.join(near.select("id", *on).distinct(), ["id", *on], "left_anti").checkpoint()
        if left.isEmpty():
            return out
        reach *= 8


def voronoi(seeds: DataFrame, voxels: DataFrame, reach: float, axes=("y", "x"), on=("m", "t")) -> DataFrame:
    """Each voxel's nearest seed within reach, 0 where there is none; ties go to the lowest id.

    seeds and voxels may carry `arena`; a voxel then competes only among seeds of its own arena.
    """
    on = [k for k in (*on, "arena") if k in seeds.columns and k in voxels.columns]
    near = within(voxels, seeds, reach, axes=axes, on=on)
    best = near.groupBy(*voxels.columns).agg(F.min(F.struct("dist", "id_r")).alias("s"))
    return voxels.join(best.select(*voxels.columns, F.col("s.id_r").alias("seed")), voxels.columns, "left").withColumn("seed", F.coalesce("seed", F.lit(0)))


def grow_points(points: DataFrame, voxels: DataFrame, radius: float, overlap: str = "nearest", axes=("y", "x"), on=("m", "t")) -> DataFrame:
    """Voxels within a radius of a point, as the point's label: of several the nearest, the union (1), or one merged object."""
    on = [k for k in on if k in points.columns and k in voxels.columns]
    near = within(voxels, points, radius, axes=axes, on=on)
    keys = voxels.columns
    if overlap == "union":
        return near.select(*keys).distinct().withColumn("label_id", F.lit(1).cast("long"))
    best = near.groupBy(*keys).agg(F.min(F.struct("dist", "id_r")).alias("s")).select(*keys, F.col("s.id_r").alias("label_id"))
    if overlap == "nearest":
        return best
    touching = within(points, points, 2 * radius, axes=axes, on=on).where("id < id_r").select(F.col("id").alias("a"), F.col("id_r").alias("b"))
    comp = label_components(points.select("id"), touching)
    return best.join(comp.select(F.col("id").alias("label_id"), "component"), "label_id").select(*keys, F.col("component").alias("label_id"))


def boundary_band(raster: DataFrame, steps: int, on=("m", "t", "z", "c")) -> DataFrame:
    """Background voxels within `steps` 4-neighbour steps of a label, as the lowest label that reaches them."""
    on = [k for k in on if k in raster.columns]
    keys = [*on, "y", "x"]
    frame = raster.select(*keys)
    grown = raster.where("label_id > 0").select(*keys, "label_id")
    start = grown
    for _ in range(steps):
        moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])
        spread = grown.withColumn("_m", F.explode(moves)).withColumn("y", F.col("y") + F.col("_m.dy")).withColumn("x", F.col("x") + F.col("_m.dx"))
        nxt = spread.groupBy(*keys).agg(F.min("label_id").alias("n")).join(frame, keys, "left_semi")
        grown = nxt.join(grown, keys, "left").select(*keys, F.coalesce("label_id", "n").alias("label_id"))
    return grown.join(start.select(*keys), keys, "left_anti")


def extract_boundary(raster: DataFrame, on=("m", "t", "z", "c")) -> DataFrame:
    """Voxels of a label with a 4-neighbour that is not of it (or off the frame)."""
    on = [k for k in on if k in raster.columns]
    d = raster.where("label_id > 0").select(*on, "y", "x", "label_id")
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    spread = d.withColumn("_m", F.explode(moves)).select(*on, (F.col("y") + F.col("_m.dy")).alias("y"), (F.col("x") + F.col("_m.dx")).alias("x"), "label_id")
    inner = spread.groupBy(*on, "y", "x", "label_id").agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    return d.join(inner.drop("n"), [*on, "y", "x", "label_id"], "left_anti")


def roi_mask(spark, shapes: list[dict], height: int, width: int) -> DataFrame:
    """y, x of pixels inside an ordered list of shapes: the last shape that covers a pixel decides (op add or clear); invert at the end flips.

    Shapes are drawn by hand, so they are few; each is an analytic predicate over the frame's rows.
    """
    y, x = F.col("y"), F.col("x")
    d = spark.range(height).withColumnRenamed("id", "y").crossJoin(spark.range(width).withColumnRenamed("id", "x"))
    on, flip = F.lit(False), False
    for s in shapes:
        k = s["kind"]
        if k == "invert":
            on = ~on
            continue
        if k == "rect":
            test = y.between(s["y0"], s["y1"]) & x.between(s["x0"], s["x1"])
        elif k in ("ellipse", "circle"):
            ry, rx = s.get("ry", s.get("r")), s.get("rx", s.get("r"))
            test = F.pow((y - s["cy"]) / ry, 2) + F.pow((x - s["cx"]) / rx, 2) <= 1
        elif k == "polygon":
            p = s["points"]
            hits = F.lit(0)
            for (y0, x0), (y1, x1) in zip(p, [*p[1:], p[0]]):
                if y0 != y1:
                    crosses = ((y0 > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
                    hits = hits + crosses.cast("int")
            test = hits % 2 == 1
        elif k == "brush":
            test = F.lit(False)
            for cy, cx in s["points"]:
                test = test | (F.pow(y - cy, 2) + F.pow(x - cx, 2) <= s["r"] ** 2)
        else:
            raise Refusal(f"unknown shape {k!r}")
        on = (on & ~test) if s.get("op", "add") == "clear" else (on | test)
    return d.where(on if not flip else ~on)


def draw_regions(spark, shapes: list[dict], height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(raster y, x, label_id; table id, area, y, x): each shape a label, later shapes over earlier ones."""
    raster = None
    for i, s in enumerate(shapes, 1):
        own = roi_mask(spark, [s], height, width).withColumn("label_id", F.lit(i).cast("long"))
        raster = own if raster is None else raster.union(own)
    raster = raster.groupBy("y", "x").agg(F.max("label_id").alias("label_id"))
    return raster, raster.groupBy(F.col("label_id").alias("id")).agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("y"), F.avg("x").alias("x"))


def register_positions(table: DataFrame, landmarks: DataFrame, reference: DataFrame, search: float = 500.0, tolerance: float = 25.0, model: str = "rigid", x: str = "x", y: str = "y", most: int = 2_000_000) -> DataFrame:
    """Rows of `table` moved so that its landmarks lie on the reference's: adds reg_y, reg_x.

    The shift with most vectors within tolerance wins (ties: the shortest) and is refined to their median;
    mutual nearest neighbours then give a shift or a rotation and shift, refitted twice.
    """
    a = landmarks.select(F.col("id"), F.col(y).alias("y"), F.col(x).alias("x"))
    b = reference.select(F.col("id"), F.col(y).alias("y"), F.col(x).alias("x"))
    vec = within(a, b, search).select((F.col("y_r") - F.col("y")).alias("y"), (F.col("x_r") - F.col("x")).alias("x"))
    vec = vec.withColumn("id", F.monotonically_increasing_id())
    rows = vec.select("y", "x").limit(most + 1).toPandas()
    if len(rows) > most:
        raise Refusal(f"more than {most} pairs of landmarks; search less far")
    if not len(rows):
        raise Refusal("no landmark of the reference is within the search distance")
    dy, dx = vote(rows["y"].to_numpy(), rows["x"].to_numpy(), tolerance)
    angle, c, s = 0.0, 1.0, 0.0
    for _ in range(3):
        moved = a.select("id", (F.lit(s) * F.col("x") + F.lit(c) * F.col("y") + dy).alias("y"), (F.lit(c) * F.col("x") - F.lit(s) * F.col("y") + dx).alias("x"), F.col("y").alias("oy"), F.col("x").alias("ox"))
        near = within(moved, b, tolerance)
        wa, wb = Window.partitionBy("id").orderBy("dist", "id_r"), Window.partitionBy("id_r").orderBy("dist", "id")
        mutual = near.withColumn("ra", F.row_number().over(wa)).withColumn("rb", F.row_number().over(wb)).where("ra = 1 and rb = 1 and dist < " + repr(float(tolerance)))
        m = mutual.agg(F.avg("oy"), F.avg("ox"), F.avg("y_r"), F.avg("x_r"), F.count(F.lit(1)), F.percentile(F.col("y_r") - F.col("oy"), 0.5), F.percentile(F.col("x_r") - F.col("ox"), 0.5)).first()
        if not m[4]:
            raise Refusal("no landmarks agree")
        if model == "shift" or m[4] < 2:
            dy, dx = float(m[5]), float(m[6])
            continue
        q = mutual.agg(
            F.sum((F.col("ox") - m[1]) * (F.col("y_r") - m[2]) - (F.col("oy") - m[0]) * (F.col("x_r") - m[3])), F.sum((F.col("ox") - m[1]) * (F.col("x_r") - m[3]) + (F.col("oy") - m[0]) * (F.col("y_r") - m[2]))
        ).first()
        angle = float(np.arctan2(q[0], q[1]))
        c, s = float(np.cos(angle)), float(np.sin(angle))
        dy, dx = m[2] - (s * m[1] + c * m[0]), m[3] - (c * m[1] - s * m[0])
    return table.withColumn("reg_y", F.lit(s) * F.col(x) + F.lit(c) * F.col(y) + dy).withColumn("reg_x", F.lit(c) * F.col(x) - F.lit(s) * F.col(y) + dx)


def vote(vy: np.ndarray, vx: np.ndarray, tolerance: float) -> tuple[float, float]:
    """The vector with most others within tolerance, ties to the shortest; the median of its neighbours."""
    cells: dict[tuple[int, int], list[int]] = {}
    cy, cx = np.floor(vy / tolerance).astype(int), np.floor(vx / tolerance).astype(int)
    for i, q in enumerate(zip(cy.tolist(), cx.tolist())):
        cells.setdefault(q, []).append(i)
    best, pick = (-1, 0.0), None
    for (qy, qx), own in cells.items():
        near = np.concatenate([cells[qy + i, qx + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (qy + i, qx + j) in cells])
        for i in own:
            d = (vy[near] - vy[i]) ** 2 + (vx[near] - vx[i]) ** 2 <= tolerance**2
            score = (int(d.sum()), -float(np.hypot(vy[i], vx[i])))
            if score > best:
                best, pick = score, near[d]
    return float(np.median(vy[pick])), float(np.median(vx[pick]))


def overlay(primary: DataFrame, secondary: DataFrame, blend: str = "add", opacity: float = 0.5, shift: int = 0, rate: float = 1.0, block: int = 8) -> DataFrame:
    """Pairs voxels by mapped time index (t2 = floor(t * rate) + shift) and place, and blends values."""
    keys = [k for k in ("m", "z", "c", "y", "x") if k in primary.columns and k in secondary.columns]
    s = secondary.select(*keys, F.col("t").alias("_t2"), F.col("value").alias("_s"))
    d = primary.withColumn("_t2", (F.floor(F.col("t") * F.lit(float(rate))) + shift).cast("long")).join(s, [*keys, "_t2"], "left")
    p, q = F.col("value"), F.coalesce("_s", F.lit(0.0))
    mixed = {
        "add": p + q * opacity, "over": p * (1 - opacity) + q * opacity, "difference": F.abs(p - q),
        "checkerboard": F.when((F.floor(F.col("y") / block) + F.floor(F.col("x") / block)) % 2 == 0, p).otherwise(q), "wipe": p, "flicker": F.when(F.col("t") % 2 == 0, p).otherwise(q),
    }[blend]
    return d.withColumn("value", mixed).drop("_t2", "_s")


def canvas(boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """The smallest box around all stage boxes."""
    return boxes.agg((F.min("y0") - margin).alias("y0"), (F.max("y1") + margin).alias("y1"), (F.min("x0") - margin).alias("x0"), (F.max("x1") + margin).alias("x1"))


def overlap_fraction(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of overlapping boxes and the share of the first that the second covers; boxes are fields of a few acquisitions."""
    r = b.select(*[F.col(c).alias(c + "_r") for c in b.columns])
    hit = a.join(F.broadcast(r), (F.col("y0") < F.col("y1_r")) & (F.col("y1") > F.col("y0_r")) & (F.col("x0") < F.col("x1_r")) & (F.col("x1") > F.col("x0_r")))
    area = (F.least("y1", "y1_r") - F.greatest("y0", "y0_r")) * (F.least("x1", "x1_r") - F.greatest("x0", "x0_r"))
    return hit.withColumn("overlap", area / ((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))))


