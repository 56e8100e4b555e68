"""Named queries of the image kernels, selections and sinks, with SQL written from each kernel's formula."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import AxisSizes, Dataset
from ..functions import fields as E
from ..operators import axes as A
from ..operators import compose as C
from ..operators import figure as G
from ..operators import image as I
from ..operators import spatial as S
from ..operators import transfer as D
from ..operators import windows as W
from ..sources import io as IO
from . import graph
from .queries import EMB, LAB, PTS, RASTER, STK, TRK, VOX, labels, plane, points, q, raster, read, stack, tracks, vectors, voxels

ONE = "one AS (SELECT m, y, x, value + 1 AS value FROM vox)"
#: A coordinate beyond an edge of an 8 x 8 plane, mirrored with the edge pixel repeated.
MIRROR = "CASE WHEN {0} < 0 THEN -({0}) - 1 WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END"


def up(spark, sf):
    return plane(spark, sf).withColumn("value", F.col("value") + 1)


def blur(source: str, out: str, sigma: float) -> str:
    """CTEs: a Gaussian of a plane by its two axes, cut at four sigmas."""
    r = int(4 * sigma + 0.5)
    kernel = f"{out}k AS (SELECT range AS d, exp(-range * range / (2.0 * {sigma} * {sigma})) / (SELECT sum(exp(-range * range / (2.0 * {sigma} * {sigma}))) FROM range({-r}, {r + 1})) AS w FROM range({-r}, {r + 1}))"
    y = f"{out}y AS (SELECT a.m, a.y, a.x, sum(k.w * b.value) AS value FROM {source} a CROSS JOIN {out}k k JOIN {source} b ON b.m = a.m AND b.x = a.x AND b.y = {MIRROR.format('a.y + k.d')} GROUP BY ALL)"
    x = f"{out} AS (SELECT a.m, a.y, a.x, sum(k.w * b.value) AS value FROM {out}y a CROSS JOIN {out}k k JOIN {out}y b ON b.m = a.m AND b.y = a.y AND b.x = {MIRROR.format('a.x + k.d')} GROUP BY ALL)"
    return f"{kernel}, {y}, {x}"


def near(source: str, out: str, value: str, reach: str) -> str:
    """CTE: an aggregate over the offsets (dy, dx) within reach of each pixel a, with values b."""
    return f"{out} AS (SELECT a.m, a.y, a.x, {value} AS value FROM {source} a CROSS JOIN (SELECT u.range AS dy, v.range AS dx FROM range(-8, 9) u, range(-8, 9) v WHERE {reach}) o JOIN {source} b ON b.m = a.m AND b.y = {MIRROR.format('a.y + o.dy')} AND b.x = {MIRROR.format('a.x + o.dx')} GROUP BY ALL)"


CROSS = "abs(u.range) + abs(v.range) <= 1"


def enhanced(name: str, sql: str, *ctes: str, digits: int = 6, **parameters):
    q(f"enhance_{name}", sql, VOX, ONE, *ctes, digits=digits)(lambda spark, sf: I.enhance(up(spark, sf), f"enhance.{name}", **parameters))


enhanced("gaussian", "SELECT m, y, x, round(value, 6) AS value FROM g", blur("one", "g", 1.0))
enhanced("unsharp", "SELECT m, y, x, round(2 * o.value - g.value, 6) AS value FROM one o JOIN g USING (m, y, x)", blur("one", "g", 1.0))
enhanced("dog", "SELECT m, y, x, round(g.value - h.value, 6) AS value FROM g JOIN h USING (m, y, x)", blur("one", "g", 1.0), blur("one", "h", 1.6))
enhanced("flatten_field", "SELECT m, y, x, round(o.value / greatest(g.value, 1) * avg(g.value) OVER (PARTITION BY m), 6) AS value FROM one o JOIN g USING (m, y, x)", blur("one", "g", 2.0), sigma=2.0)
enhanced("median", "SELECT m, y, x, round(value, 6) AS value FROM n", near("one", "n", "median(b.value)", CROSS))
enhanced("tophat", "SELECT m, y, x, round(o.value - t.value, 6) AS value FROM one o JOIN t USING (m, y, x)", near("one", "s", "min(b.value)", CROSS), near("s", "t", "max(b.value)", CROSS), radius=1)
enhanced(
    "bilateral", "SELECT m, y, x, round(value, 6) AS value FROM n", "sp AS (SELECT *, 0.1 * (max(value) OVER (PARTITION BY m) - min(value) OVER (PARTITION BY m)) AS s FROM one)",
    near("sp", "n", "sum(b.value * exp(-(dy * dy + dx * dx) / 2.0) * exp(-((b.value - a.value) ** 2) / (2 * a.s * a.s))) / sum(exp(-(dy * dy + dx * dx) / 2.0) * exp(-((b.value - a.value) ** 2) / (2 * a.s * a.s)))", "abs(u.range) <= 2 AND abs(v.range) <= 2"),
)
#: Squared differences to each shifted plane, their means over 3 x 3, and the mean of the shifted values weighted by likeness.
NLM = f"""off AS (SELECT u.range AS oy, v.range AS ox FROM range(-1, 2) u, range(-1, 2) v),
dif AS (SELECT a.m, a.y, a.x, oy, ox, b.value, (b.value - a.value) ** 2 AS d FROM one a CROSS JOIN off JOIN one b ON b.m = a.m AND b.y = {MIRROR.format('a.y + oy')} AND b.x = {MIRROR.format('a.x + ox')}),
box AS (SELECT a.m, a.y, a.x, a.oy, a.ox, any_value(a.value) AS value, sum(b.d) / 9 AS d FROM dif a CROSS JOIN (SELECT oy AS dy, ox AS dx FROM off) o JOIN dif b ON b.m = a.m AND b.oy = a.oy AND b.ox = a.ox AND b.y = {MIRROR.format('a.y + dy')} AND b.x = {MIRROR.format('a.x + dx')} GROUP BY ALL),
spn AS (SELECT m, max(value) - min(value) AS s FROM one GROUP BY m)"""
enhanced("nlm", "SELECT m, y, x, round(sum(value * exp(-d / (0.1 * s) ** 2)) / sum(exp(-d / (0.1 * s) ** 2)), 6) AS value FROM box JOIN spn USING (m) GROUP BY m, y, x", NLM, patch_distance=1)


def lucy(rounds: int) -> list[str]:
    out = ["x0 AS (SELECT m, y, x, avg(greatest(value, 0)) OVER (PARTITION BY m) AS value FROM one)"]
    for i in range(rounds):
        out += [blur(f"x{i}", f"p{i}", 1.5), f"r{i} AS (SELECT m, y, x, greatest(o.value, 0) / greatest(p.value, 1e-12) AS value FROM one o JOIN p{i} p USING (m, y, x))", blur(f"r{i}", f"c{i}", 1.5)]
        out.append(f"x{i + 1} AS (SELECT m, y, x, a.value * c.value AS value FROM x{i} a JOIN c{i} c USING (m, y, x))")
    return out


enhanced("deconvolve", "SELECT m, y, x, round(value, 5) AS value FROM x3", *lucy(3), digits=5, iterations=3)
for _op, _par in (("tv_denoise", {}), ("subtract_background", {"method": "polynomial"}), ("clahe", {"tile_grid": 2}), ("wavelet_denoise", {})):
    q(f"enhance_{_op}")(lambda spark, sf, op=_op, par=_par: I.enhance(up(spark, sf), f"enhance.{op}", **par))


@q("threshold_local", "SELECT m, y, x, CASE WHEN o.value > g.value - 0.01 THEN 1 ELSE 0 END::DOUBLE AS value FROM one o JOIN g USING (m, y, x)", VOX, ONE, blur("one", "g", 5.0 / 6))
def _(spark, sf):
    return I.enhance(up(spark, sf), "analysis.threshold_local", block=5.0, offset=0.01)


#: 256 even bins between a plane's least and greatest value.
BINS = """ends AS (SELECT m, min(value) AS lo, max(value) AS hi FROM one GROUP BY m),
bin AS (SELECT m, least(floor((value - lo) / (hi - lo) * 256), 255)::INT AS b, lo + (least(floor((value - lo) / (hi - lo) * 256), 255) + 0.5) * (hi - lo) / 256 AS c, count(*) AS n FROM one JOIN ends USING (m) GROUP BY ALL),
run AS (SELECT *, sum(n) OVER w AS n0, sum(n * c) OVER w AS s0, sum(n) OVER (PARTITION BY m) AS nn, sum(n * c) OVER (PARTITION BY m) AS ss, sum(n * n) OVER w AS q0, sum(n * n) OVER (PARTITION BY m) AS qq FROM bin WINDOW w AS (PARTITION BY m ORDER BY b))"""
CUT = "SELECT o.m, y, x, CASE WHEN value > cut THEN 1 ELSE 0 END::DOUBLE AS value FROM one o JOIN cut USING (m)"
CUTS = {
    "otsu": "cut AS (SELECT m, arg_max(c, (s, -b)) AS cut FROM (SELECT *, n0 * (nn - n0) * (s0 / n0 - (ss - s0) / (nn - n0)) ** 2 AS s FROM run WHERE n0 < nn) GROUP BY m)",
    "yen": "cut AS (SELECT m, arg_max(c, (s, -b)) AS cut FROM (SELECT *, -ln(q0 / (nn * nn) * ((qq - q0) / (nn * nn))) + 2 * ln(n0 / nn * (1 - n0 / nn)) AS s FROM (SELECT m, b, c, n0::DOUBLE AS n0, nn::DOUBLE AS nn, q0::DOUBLE AS q0, qq::DOUBLE AS qq FROM run) WHERE q0 < qq AND n0 < nn) GROUP BY m)",
    "triangle": "pk AS (SELECT m, arg_max(b, (n, -b)) AS p, max(n) AS h, min(b) AS l, max(b) AS r FROM bin GROUP BY m), cut AS (SELECT m, arg_max(c, (s, -b)) AS cut FROM (SELECT m, b, c, h * abs(b - far) - abs(far - p) * n AS s FROM (SELECT *, CASE WHEN p - l >= r - p THEN l ELSE r END AS far FROM bin JOIN pk USING (m)) WHERE CASE WHEN p - l >= r - p THEN b <= p ELSE b >= p END) GROUP BY m)",
    # the level at which it equals the logarithmic mean of the two sides' means, from the mean of all, sixty times over
    "li": "arr AS (SELECT m, min(c) AS c0, list({'v': c, 'n': n} ORDER BY b) AS h, sum(n * c) / sum(n) AS t0 FROM bin GROUP BY m), cut AS (SELECT m, c0 + list_reduce(list_concat([t0 - c0], list_transform(range(60), lambda i: 0.0::DOUBLE)), lambda t, i: coalesce((list_sum([e.n * (e.v - c0) FOR e IN h IF e.v - c0 > t]) / list_sum([e.n FOR e IN h IF e.v - c0 > t]) - list_sum([e.n * (e.v - c0) FOR e IN h IF e.v - c0 <= t]) / list_sum([e.n FOR e IN h IF e.v - c0 <= t])) / (ln(nullif(list_sum([e.n * (e.v - c0) FOR e IN h IF e.v - c0 > t]) / list_sum([e.n FOR e IN h IF e.v - c0 > t]), 0)) - ln(nullif(list_sum([e.n * (e.v - c0) FOR e IN h IF e.v - c0 <= t]) / list_sum([e.n FOR e IN h IF e.v - c0 <= t]), 0))), t)) AS cut FROM arr)",
}
for _mth, _cut in CUTS.items():
    q(f"threshold_{_mth}", CUT, VOX, ONE, BINS, _cut)(lambda spark, sf, m=_mth: I.threshold(up(spark, sf), m, "series"))


@q("multiotsu", """SELECT v.m, y, x, CASE WHEN b >= j THEN 2 WHEN b >= i THEN 1 ELSE 0 END::BIGINT AS class FROM (SELECT m, y, x, least(floor((value - lo) / (hi - lo) * 256), 255)::INT AS b FROM one JOIN ends USING (m)) v JOIN top USING (m)""", VOX, ONE, BINS,
   "top AS (SELECT a.m, arg_max(a.b, s) AS i, arg_max(z.b, s) AS j FROM (SELECT m, b, n0 - n AS n0, s0 - n * c AS s0, nn, ss FROM run) a JOIN (SELECT m, b, n0 - n AS n0, s0 - n * c AS s0 FROM run) z ON a.m = z.m AND a.b < z.b AND a.n0 > 0, LATERAL (SELECT a.s0 ** 2 / a.n0 + (z.s0 - a.s0) ** 2 / (z.n0 - a.n0) + (a.ss - z.s0) ** 2 / (a.nn - z.n0) AS s) GROUP BY a.m)")
def _(spark, sf):
    return I.multiotsu(up(spark, sf))


@q("label_components", "SELECT v.m, v.y, v.x, coalesce(n.k, 0) AS label_id FROM vox v LEFT JOIN (SELECT m, p, dense_rank() OVER (ORDER BY m, c) AS k FROM (SELECT m, p, min(r) AS c FROM reach GROUP BY m, p)) n ON n.m = v.m AND n.p = v.y * 8 + v.x", "RECURSIVE " + VOX, "fg AS (SELECT m, y, x, y * 8 + x AS p FROM vox WHERE value > 0.1), reach AS (SELECT m, p, p AS r, y, x FROM fg UNION SELECT s.m, s.p, f.p, f.y, f.x FROM reach s JOIN fg f ON f.m = s.m AND abs(f.y - s.y) + abs(f.x - s.x) = 1)")
def _(spark, sf):
    return I.label(plane(spark, sf).withColumn("value", (F.col("value") > 0.1).cast("double")), 1)


@q("edt", "SELECT a.m, a.y, a.x, round(coalesce(CASE WHEN a.value > 0 THEN sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) ELSE 0 END, -1), 6) AS value FROM vox a LEFT JOIN vox b ON a.m = b.m AND b.value <= 0 GROUP BY a.m, a.y, a.x, a.value", VOX)
def _(spark, sf):
    return I.enhance(plane(spark, sf).withColumn("value", (F.col("value") > 0).cast("double")), "analysis.edt").withColumn("value", F.when(F.col("value") < 1e9, F.col("value")).otherwise(-1.0))


@q("resample", "SELECT m, 1 + y // 2 AS y, x // 2 AS x, round(avg(value), 6) AS value FROM vox GROUP BY ALL", VOX)
def _(spark, sf):
    return I.resample(plane(spark, sf).withColumn("y", F.col("y") + 2), 0.5)


@q("align_shift", "SELECT a.m, a.t, a.y, a.x, round(coalesce(b.value, 0), 6) AS value FROM stk a LEFT JOIN stk b ON b.m = a.m AND b.t = a.t AND b.y = a.y - a.t % 3 AND b.x = a.x + 1", VOX, STK)
def _(spark, sf):
    s = stack(spark, sf)
    return I.shift(s, s.select("m", "t").distinct().select("m", "t", (F.col("t") % 3).cast("double").alias("drift_y"), F.lit(-1.0).alias("drift_x")))


@q("transform_rigid", "SELECT a.m, a.y, a.x, round(coalesce(b.value, 0) / 2 + coalesce(c.value, 0) / 2, 6) AS value FROM vox a LEFT JOIN vox b ON b.m = a.m AND b.y = a.y - 1 AND b.x = a.x LEFT JOIN vox c ON c.m = a.m AND c.y = a.y - 1 AND c.x = a.x - 1", VOX)
def _(spark, sf):
    return I.rigid(plane(spark, sf), 1.0, 0.5)


# --- selections ---------------------------------------------------------------------------------------


def cube(spark, sf):
    """Planes as channels (m = label, c = vec_id % 4, the mean where several meet)."""
    return voxels(spark, sf).groupBy(F.col("label").alias("m"), (F.col("m") % 4).alias("c"), "y", "x").agg(F.avg("value").alias("value"))


CUBE = "cub AS (SELECT label AS m, vox.m % 4 AS c, y, x, avg(value) AS value FROM vox GROUP BY ALL)"


@q("channel_select", "SELECT m, CASE c WHEN 2 THEN 0 ELSE 1 END::BIGINT AS c, y, x, round(value, 6) AS value FROM cub WHERE c IN (2, 0)", VOX, CUBE)
def _(spark, sf):
    return A.select_channels(cube(spark, sf), [2, 0])


def whole(parts: dict):
    """All parts of a split, with the name of each."""
    out = None
    for k, d in parts.items():
        d = d.withColumn("part", F.lit(k).cast("long"))
        out = d if out is None else out.unionByName(d)
    return out


for _key, _axis, _sql, _cte in (
    ("channel.split", "c", "SELECT m, 0::BIGINT AS c, y, x, round(value, 6) AS value, c AS part FROM cub", CUBE),
    ("util.split_positions", "m", "SELECT 0::BIGINT AS m, c, y, x, round(value, 6) AS value, m AS part FROM cub", CUBE),
    ("util.unbatch", "b", "SELECT 0::BIGINT AS b, m, y, x, round(value, 6) AS value, c AS part FROM cub", CUBE),
):

    def _split(spark, sf, key=_key, axis=_axis):
        from .registry import OPERATORS

        d = cube(spark, sf)
        return whole(OPERATORS[key](d.withColumnRenamed("c", "b") if axis == "b" else d, 10 if axis == "m" else 4))

    q(_key.replace(".", "_"), _sql, VOX, _cte)(_split)

for _key, _axis in (("util.split_z", "z"), ("util.split_t", "t")):

    def _ranges(spark, sf, key=_key, axis=_axis):
        from .registry import OPERATORS

        return whole(OPERATORS[key](cube(spark, sf).withColumnRenamed("c", axis), "0-1;3,2"))

    q(_key.replace(".", "_"), f"SELECT m, CASE c WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS {_axis}, y, x, round(value, 6) AS value, CASE WHEN c < 2 THEN 0 ELSE 1 END::BIGINT AS part FROM cub", VOX, CUBE)(_ranges)


@q("select_plane", "SELECT m, 0::BIGINT AS z, y, x, round(value, 6) AS value FROM cub WHERE c = 3", VOX, CUBE)
def _(spark, sf):
    return A.select_plane(cube(spark, sf).withColumnRenamed("c", "z"), 3)


@q("select_frame", "SELECT m, 0::BIGINT AS t, y, x, round(value, 6) AS value FROM stk WHERE t = 5", VOX, STK)
def _(spark, sf):
    return A.select_frame(stack(spark, sf), 5)


# --- bridges ------------------------------------------------------------------------------------------

HELD = "hld AS (SELECT p.id, p.m, p.v, r.label_id FROM (SELECT id, id AS m, v, greatest(0, least(7, round_even(abs(y) / 4, 0)))::BIGINT AS y, greatest(0, least(7, round_even(abs(x) / 4, 0)))::BIGINT AS x FROM emb) p JOIN ras r USING (m, y, x))"


def pins(spark, sf):
    return vectors(spark, sf).select("id", F.col("id").alias("m"), (F.abs("y") / 4).alias("y"), (F.abs("x") / 4).alias("x"), "v")


@q("bridge_point_label", "SELECT label_id AS id, round(avg(v), 6) AS v FROM hld WHERE label_id > 0 GROUP BY 1", EMB, VOX, RASTER, HELD)
def _(spark, sf):
    return D.point_to_label(pins(spark, sf), raster(spark, sf)[0], "v", AxisSizes(y=8, x=8))


@q("bridge_label_point", "SELECT id, CASE WHEN label_id > 0 THEN label_id * 0.25 ELSE 'nan'::DOUBLE END AS score FROM hld", EMB, VOX, RASTER, HELD)
def _(spark, sf):
    r = raster(spark, sf)[0]
    table = r.where("label_id > 0").select(F.col("label_id").alias("id")).distinct().withColumn("score", F.col("id") * 0.25)
    return D.label_to_point(pins(spark, sf), r, table, "score", AxisSizes(y=8, x=8)).select("id", "score")


@q("bridge_timepoint_track", "SELECT p.id AS member_id, p.track_id, p.t, round(s.v, 6) AS value FROM pts p JOIN (SELECT t, sum(value) AS v FROM pts GROUP BY t) s USING (t)", PTS)
def _(spark, sf):
    p = points(spark, sf)
    return D.timepoint_to_track(p.select("track_id", "t", F.col("id").alias("member_id")), p.groupBy("t").agg(F.sum("value").alias("value")), "value")


#: Border pixels, and each one's weight by its neighbours on the border of its own label.
BORDER = """lb AS (SELECT m, y, x, label_id FROM ras WHERE label_id > 0),
bd AS (SELECT * FROM lb a WHERE (SELECT count(*) FROM lb b WHERE b.m = a.m AND b.label_id = a.label_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1) < 4),
cd AS (SELECT a.label_id, 1 + 2 * count(*) FILTER (WHERE abs(a.y - b.y) + abs(a.x - b.x) = 1) + 10 * count(*) FILTER (WHERE abs(a.y - b.y) = 1 AND abs(a.x - b.x) = 1) AS c FROM bd a JOIN bd b ON b.m = a.m AND b.label_id = a.label_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.m, a.y, a.x, a.label_id)"""


@q("measure_perimeter", "SELECT label_id AS id, round(sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) AS perimeter FROM cd GROUP BY 1", VOX, RASTER, BORDER)
def _(spark, sf):
    return D.perimeters(raster(spark, sf)[0])


@q("measure_solidity")
def _(spark, sf):
    r, v = raster(spark, sf)
    return D.measure(r, v, (), True).select("id", "area", "perimeter", "solidity")


@q("field_expression", "SELECT v.m, v.t, v.y, v.x, round(CASE WHEN v.value > f.mean * 2 OR -v.value > g.top THEN v.value / f.mean ELSE sqrt(abs(v.value)) - 0.5 END, 5) AS field FROM stk v JOIN (SELECT m, t, avg(value) AS mean FROM stk GROUP BY m, t) f ON f.m = v.m AND f.t = v.t JOIN (SELECT m, max(value) AS top FROM stk GROUP BY m) g ON g.m = v.m", VOX, STK, digits=5)
def _(spark, sf):
    s = stack(spark, sf)
    frames = s.groupBy("m", "t").agg(F.avg("value").alias("mean"))
    data = Dataset(layers={("frame", ""): frames, ("voxel", ""): s})
    v, mean, top = E.Input("v"), E.Attr("frame", "mean"), E.Attr("voxel", "value", reducer="max")
    per_series = E.evaluate(top, data, s.select("m").distinct(), "multipoint", "top")
    data = Dataset(layers={**data.layers, ("multipoint", ""): per_series})
    f = E.Where((v > mean * 2) | (-v > E.Attr("multipoint", "top")), v / mean, E.UnaryOp("sqrt", E.UnaryOp("abs", v)) - 0.5)
    return E.evaluate(f, data, s, "voxel", inputs={"v": F.col("value")}).drop("value")


@q("object_field_density", "SELECT g.m, a.range * 10 AS y, b.range * 10 AS x, count(e.id) / 100.0::DOUBLE AS density FROM (SELECT DISTINCT m FROM emb) g CROSS JOIN range(5) a CROSS JOIN range(5) b LEFT JOIN emb e ON e.m = g.m AND greatest(0, least(4, trunc(abs(e.y) / 10))) = a.range AND greatest(0, least(4, trunc(abs(e.x) / 10))) = b.range GROUP BY ALL", EMB)
def _(spark, sf):
    d = vectors(spark, sf).select("id", "m", F.abs("y").alias("y"), F.abs("x").alias("x"))
    return W.object_field(d, 50, 50, "density", 10, 0.0)


@q("object_field_motion")
def _(spark, sf):
    d = tracks(spark, sf).withColumn("area", F.col("x") * 2)
    return W.object_field(d, 60, 30, "mean_area,velocity,speed,divergence,curl", 10, 5.0).where("not isnan(speed)")


@q("rasterize_linear")
def _(spark, sf):
    g = spark.range(40).select((F.col("id") - 20).alias("y")).crossJoin(spark.range(40).select((F.col("id") - 20).alias("x")))
    return C.rasterize_linear(vectors(spark, sf).select("id", "y", "x", "v"), g, "v")


# --- space, sequences, figures ------------------------------------------------------------------------


@q("unique_objects", """SELECT e.id, k.object_uid, dense_rank() OVER (PARTITION BY e.c ORDER BY e.t, e.m)::BIGINT AS sighting, k.n AS sightings FROM mem e JOIN (SELECT c, row_number() OVER (ORDER BY min((t, m, id))) AS object_uid, count(DISTINCT (t, m)) AS n FROM mem GROUP BY c) k ON k.c = e.c""",
   "RECURSIVE " + EMB, "lnk AS (SELECT a.id AS a, b.id AS b FROM emb a JOIN emb b ON a.id <> b.id AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 2.25), reach AS (SELECT id AS a, id AS b FROM emb UNION SELECT r.a, l.b FROM reach r JOIN lnk l ON r.b = l.a), mem AS (SELECT e.id, e.m, e.id % 5 AS t, c.c FROM emb e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = e.id)")
def _(spark, sf):
    v = vectors(spark, sf).withColumn("t", F.col("id") % 5)
    return S.unique_objects(v, 1.5, "x", "y", ("t", "m")).select("id", "object_uid", "sighting", "sightings")


#: Least-squares planes by Cramer's rule over the rows within 12, the row itself included.
PLANES = """nbr AS (SELECT a.id, b.y - a.y AS dy, b.x - a.x AS dx, b.v, b.w FROM emb a JOIN emb b ON a.m = b.m AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 144),
sm AS (SELECT id, count(*) AS n, var_pop(dy) AS yy, var_pop(dx) AS xx, covar_pop(dy, dx) AS yx, covar_pop(dy, v) AS yv, covar_pop(dx, v) AS xv, covar_pop(dy, w) AS yw, covar_pop(dx, w) AS xw FROM nbr GROUP BY id)"""


@q("local_gradient", "SELECT id, " + ", ".join(f"round(CASE WHEN n >= 3 AND yy * xx - yx * yx > 1e-9 * yy * xx THEN ({s}) / (yy * xx - yx * yx) ELSE 'nan'::DOUBLE END, 6) AS {n}" for n, s in (("grad_yy", "yv * xx - xv * yx"), ("grad_yx", "xv * yy - yv * yx"), ("grad_xy", "yw * xx - xw * yx"), ("grad_xx", "xw * yy - yw * yx"))) + " FROM sm", EMB, PLANES)
def _(spark, sf):
    v = vectors(spark, sf).select("id", "m", "y", "x", F.col("v").alias("disp_y"), F.col("w").alias("disp_x"))
    return W.local_gradient(v, 12.0).select("id", "grad_yy", "grad_yx", "grad_xy", "grad_xx")


#: Where a node has moved to, the increment of the nearest node of the frame: halves go to the lower one, which comes first.
MOVED = "fld AS (SELECT *, y * 8 + x AS id FROM stk), cum AS (SELECT m, t, y, x, value AS cy, value AS cx FROM fld WHERE t = 0 UNION ALL SELECT c.m, f.t, c.y, c.x, c.cy + f.value, c.cx + f.value FROM cum c JOIN fld f ON f.m = c.m AND f.t = c.t + 1 AND f.y = greatest(0, least(7, ceil(round(c.y + c.cy - 0.5, 9)))) AND f.x = greatest(0, least(7, ceil(round(c.x + c.cx - 0.5, 9)))))"


@q("accumulate_field", "SELECT m, t, y * 8 + x AS id, y::DOUBLE AS y, x::DOUBLE AS x, round(cy, 5) AS cum_y, round(cx, 5) AS cum_x FROM cum", "RECURSIVE " + VOX, STK, MOVED, digits=5)
def _(spark, sf):
    v = stack(spark, sf).select("m", "t", (F.col("y") * 8 + F.col("x")).alias("id"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("value").alias("disp_y"), F.col("value").alias("disp_x"))
    return W.accumulate_field(v).select("m", "t", "id", "y", "x", "cum_y", "cum_x")


@q("hexbin", "SELECT round(hx * 5, 6) AS x, round(hy * 5 * sqrt(3), 6) AS y, count(*) AS count FROM (SELECT CASE WHEN da < db THEN ax ELSE bx END AS hx, CASE WHEN da < db THEN ay ELSE by_ END AS hy FROM (SELECT *, (u - ax) ** 2 + 3 * (v - ay) ** 2 AS da, (u - bx) ** 2 + 3 * (v - by_) ** 2 AS db FROM (SELECT x / 5 AS u, y / (5 * sqrt(3)) AS v, round_even(x / 5, 0) AS ax, round_even(y / (5 * sqrt(3)), 0) AS ay, floor(x / 5) + 0.5 AS bx, floor(y / (5 * sqrt(3))) + 0.5 AS by_ FROM emb))) GROUP BY hx, hy", EMB)
def _(spark, sf):
    return G.hexbin_series(vectors(spark, sf), "x", "y", 5.0)


#: Scott's bandwidth; values counted in 1,024 cells; a Gaussian at each cell's middle.
KDE = """st AS (SELECT condition, min(value) AS lo, max(value) AS hi, stddev_samp(value) * count(*) ** -0.2 AS bw, count(*) AS n FROM pts GROUP BY 1),
ce AS (SELECT p.condition, lo, hi, bw, n, lo + (least(floor((value - lo) / ((hi - lo) / 1024)), 1023) + 0.5) * (hi - lo) / 1024 AS c, count(*) AS k FROM pts p JOIN st USING (condition) GROUP BY ALL),
gr AS (SELECT *, i.range AS i, lo - 3 * bw + i.range * (hi - lo + 6 * bw) / 127 AS x FROM st, range(128) i)"""


@q("kde", "SELECT g.condition, round(g.x, 5) AS x, round(sum(k * exp(-(((g.x - c) / g.bw) ** 2) / 2)) / (any_value(g.n) * any_value(g.bw) * sqrt(2 * pi())), 5) AS density FROM gr g JOIN ce ON ce.condition = g.condition GROUP BY g.condition, g.i, g.x", PTS, KDE, digits=5)
def _(spark, sf):
    return G.kde(points(spark, sf), "value", ["condition"])


@q("kruskal_h", "SELECT round(h, 6) AS statistic, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM (SELECT (12 / (any_value(nn) * (any_value(nn) + 1.0)) * sum(s * s / n) - 3 * (any_value(nn) + 1)) / (1 - (SELECT sum(k * k * k - k) FROM (SELECT count(*)::DOUBLE AS k FROM pts GROUP BY value)) / (any_value(nn)::DOUBLE ** 3 - any_value(nn))) AS h FROM (SELECT condition, count(*) AS n, sum(r) AS s, any_value(nn) AS nn FROM (SELECT condition, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r, count(*) OVER () AS nn FROM pts) GROUP BY condition))", PTS)
def _(spark, sf):
    return spark.createDataFrame([(float(r["statistic"]), float(r["p"])) for r in G.compare(points(spark, sf), "value", "condition", "kruskal")], "statistic double, p double")


@q("timeseries_mean", "SELECT condition, t AS x, round(avg(value), 6) AS mean, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(value) / sqrt(count(*)) END, 6) AS error, round(t * 0.5, 6) AS time FROM pts GROUP BY condition, t", PTS)
def _(spark, sf):
    return G.timeseries(points(spark, sf), "value", ["condition"], 0.5).select("condition", "x", "mean", "n", "error", "time")


@q("track_strain", "SELECT id, " + ", ".join(f"round({s}, 5) AS {n}" for n, s in (("strain_yy", "gyy + (gyy * gyy + gxy * gxy) / 2"), ("strain_yx", "(gyx + gxy + gyy * gyx + gxy * gxx) / 2"), ("strain_xx", "gxx + (gxx * gxx + gyx * gyx) / 2"))) + " FROM (SELECT id, " + ", ".join(f"CASE WHEN n >= 3 AND yy * xx - yx * yx > 1e-9 * yy * xx THEN ({s}) / (yy * xx - yx * yx) ELSE 'nan'::DOUBLE END AS {n}" for n, s in (("gyy", "yv * xx - xv * yx"), ("gyx", "xv * yy - yv * yx"), ("gxy", "yw * xx - xw * yx"), ("gxx", "xw * yy - yw * yx"))) + " FROM sm)",
   PTS, TRK, "emb AS (SELECT id, m, t, y, x, y - first_value(y) OVER w AS v, x - first_value(x) OVER w AS w FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS k FROM trk WHERE track_id > 0) WHERE k >= 2 WINDOW w AS (PARTITION BY track_id ORDER BY t))", PLANES.replace("a.m = b.m AND", "a.m = b.m AND a.t = b.t AND").replace("144", "25"), digits=5)
def _(spark, sf):
    return C.track_field(tracks(spark, sf), 5.0, strain_type="green_lagrange").select("id", "strain_yy", "strain_yx", "strain_xx")


# --- sources, sinks, control ----------------------------------------------------------------------------


def folder(spark) -> str:
    """A place for what a sink writes: the shared checkpoint folder."""
    import uuid

    S.checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/sink-{uuid.uuid4().hex}"


ROUND_TRIP = "SELECT id, m, area FROM lab"


@q("io_write_table", "SELECT 'label' AS domain, 'lines' AS layer, id, m, area FROM lab", LAB)
def _(spark, sf):
    path = folder(spark)
    IO.write_table(Dataset(layers={("label", "lines"): labels(spark, sf).select("id", "m", "area")}), path, layout="long")
    return IO.load(spark, path, "parquet")


@q("io_dock", ROUND_TRIP, LAB)
def _(spark, sf):
    return IO.dock(Dataset(layers={("label", "lines"): labels(spark, sf).select("id", "m", "area")}), folder(spark)).layer("label", "lines")


@q("io_load_analysis", ROUND_TRIP, LAB)
def _(spark, sf):
    path = folder(spark)
    IO.write_trial(Dataset(layers={("label", "lines"): labels(spark, sf).select("id", "m", "area")}), path)
    return IO.load_analysis(spark, path).layer("label", "lines").select("id", F.col("m").cast("long").alias("m"), "area")


@q("graph_run", "SELECT id, m, t, area, round(area * 2, 6) AS twice FROM lab WHERE area >= 10", LAB)
def _(spark, sf):
    from . import registry

    g = graph.Graph([{"id": "a", "op_key": "io.load", "params": {}}, {"id": "b", "op_key": "analysis.if_else", "params": {"conditions": [("area", ">=", 10.0)]}}, {"id": "c", "op_key": "math.values", "params": {"op": "add", "a": "area", "b": "area", "name": "twice"}}], [{"src": "a", "dst": "b", "src_socket": "out", "dst_socket": "in"}, {"src": "b", "dst": "c", "src_socket": "pass", "dst_socket": "in"}])
    run = graph.Engine(g, registry.OPERATORS | {"io.load": lambda: labels(spark, sf).select("id", "m", "t", "area")})
    return run.pull("c")
