"""Named queries of the operators over the driver's tables, each with the SQL that must give the same rows.

Acting tables: events are points and tracks (id, m = user, t = day, condition), lineitem rows are
labels, each embedding is an 8 x 8 plane (m = vec_id), orders and customers are lookup tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import AxisSizes
from ..operators import axes as A
from ..operators import compose as C
from ..operators import figure as G
from ..operators import fits as X
from ..operators import image as I
from ..operators import spatial as S
from ..operators import tables as T
from ..operators import tensor as N
from ..operators import transfer as D
from ..operators import windows as W
from ..ship import ship
from ..sources import io as IO
from ..streaming import zones as Z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PTS = "pts AS (SELECT event_id AS id, user_id AS m, date_diff('day', DATE '2024-01-01', ts::DATE) AS t, event_type AS condition, value, user_id AS track_id, ts FROM events)"
LAB = "lab AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS m, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS t, l_quantity AS area, l_extendedprice AS mean_intensity, l_returnflag AS grp, l_discount AS discount FROM lineitem)"
VOX = "vox AS (SELECT vec_id AS m, ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x, embedding[i]::DOUBLE AS value, label FROM embeddings, range(1, 65) r(i))"
EMB = "emb AS (SELECT vec_id AS id, label AS m, embedding[1]::DOUBLE * 100 AS y, embedding[2]::DOUBLE * 100 AS x, embedding[3]::DOUBLE AS v, embedding[4]::DOUBLE AS w FROM embeddings)"
STK = "stk AS (SELECT label AS m, vox.m % 7 AS t, y, x, avg(value) AS value FROM vox GROUP BY ALL)"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("m"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("t"), F.col("event_type").alias("condition"), "value", F.col("user_id").alias("track_id"), "ts")


def labels(spark, sf):
    d = read(spark, sf, "lineitem")
    return d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("m"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("t"), F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("mean_intensity"), F.col("l_returnflag").alias("grp"), F.col("l_discount").alias("discount"))


def voxels(spark, sf):
    d = read(spark, sf, "embeddings")
    return d.select(F.col("vec_id").alias("m"), "label", F.posexplode("embedding").alias("p", "v")).select("m", F.floor(F.col("p") / 8).cast("long").alias("y"), (F.col("p") % 8).cast("long").alias("x"), F.col("v").cast("double").alias("value"), "label")


def stack(spark, sf):
    return voxels(spark, sf).groupBy(F.col("label").alias("m"), (F.col("m") % 7).alias("t"), "y", "x").agg(F.avg("value").alias("value"))


def vectors(spark, sf):
    d = read(spark, sf, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return d.select(F.col("vec_id").alias("id"), F.col("label").alias("m"), (at(1) * 100).alias("y"), (at(2) * 100).alias("x"), at(3).alias("v"), at(4).alias("w"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c) + F.lit(0.0), digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def q(name: str, sql: str | None = None, *ctes: str, digits: int = 6):
    """Registers a query, whose doubles are rounded, and its SQL, which rounds alike."""

    def put(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return rounded(f(spark, sf), digits)

        QUERIES[name] = run
        if sql:
            inner = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
            ORACLES[name] = inner
        return f

    return put


# --- tables ---------------------------------------------------------------------------------------


@q("agg_mean_sem", "SELECT row_number() OVER (ORDER BY condition, t) AS id, 0::BIGINT AS m, t, 0::BIGINT AS c, 0.0::DOUBLE AS z, 0.0::DOUBLE AS y, 0.0::DOUBLE AS x, condition, count(*) AS n, round(avg(value), 6) AS value_mean, round(coalesce(CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) END, 'nan'::DOUBLE), 6) AS value_sem, count(value) AS value_count FROM pts GROUP BY condition, t", PTS)
def _(spark, sf):
    return T.aggregate(points(spark, sf), "condition,t", "value", "mean,sem,count")


@q("agg_median_std", "SELECT row_number() OVER (ORDER BY grp, m) AS id, m, 0::BIGINT AS t, 0::BIGINT AS c, 0.0::DOUBLE AS z, 0.0::DOUBLE AS y, 0.0::DOUBLE AS x, grp, count(*) AS n, round(median(mean_intensity), 6) AS mean_intensity_median, round(coalesce(stddev_samp(mean_intensity), 'nan'::DOUBLE), 4) AS mean_intensity_std, round(min(mean_intensity), 6) AS mean_intensity_min, round(max(mean_intensity), 6) AS mean_intensity_max, round(sum(mean_intensity), 2) AS mean_intensity_sum FROM lab GROUP BY grp, m", LAB)
def _(spark, sf):
    d = T.aggregate(labels(spark, sf), "grp,m", "mean_intensity", "median,std,min,max,sum")
    return d.withColumn("mean_intensity_std", F.round("mean_intensity_std", 4)).withColumn("mean_intensity_sum", F.round("mean_intensity_sum", 2))


@q("agg_global", "SELECT 1::BIGINT AS id, 0::BIGINT AS m, 0::BIGINT AS t, 0::BIGINT AS c, 0.0::DOUBLE AS z, 0.0::DOUBLE AS y, 0.0::DOUBLE AS x, count(*) AS n, round(avg(area), 6) AS area_mean, round(median(area), 6) AS area_median FROM lab", LAB)
def _(spark, sf):
    return T.aggregate(labels(spark, sf), "", "area", "mean,median")


@q("join_left_lookup", "SELECT o.o_orderkey AS key, o.o_custkey AS id, o.o_totalprice AS total, coalesce(c.c_acctbal, 'nan'::DOUBLE) AS cust_balance, coalesce(c.c_mktsegment, '') AS cust_segment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def _(spark, sf):
    left = read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("total"))
    right = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return T.join(left, right, on="id", prefix="cust_")


@q("join_inner_id", "SELECT l.id, l.area, o.o_totalprice AS ord_total FROM (SELECT l_orderkey AS id, l_quantity AS area FROM lineitem) l JOIN orders o ON l.id = o.o_orderkey")
def _(spark, sf):
    left = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("area"))
    right = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
    return T.join(left, right, on="id", how="inner", prefix="ord_")


@q("join_frame", "SELECT p.id, p.m, p.t, p.value, round(d.mean, 6) AS day_mean FROM pts p LEFT JOIN (SELECT m, t, avg(value) AS mean FROM pts GROUP BY m, t) d ON p.m = d.m AND p.t = d.t", PTS)
def _(spark, sf):
    p = points(spark, sf).select("id", "m", "t", "value")
    return T.join(p, p.groupBy("m", "t").agg(F.avg("value").alias("mean")), on="m_t", prefix="day_", check=False)


@q("join_track", "SELECT p.id, p.track_id, coalesce(s.n::DOUBLE, 'nan'::DOUBLE) AS track_n FROM pts p LEFT JOIN (SELECT track_id, count(*) AS n FROM pts GROUP BY 1) s ON p.track_id = s.track_id AND p.track_id > 0", PTS)
def _(spark, sf):
    p = points(spark, sf).select("id", "track_id")
    return T.join(p, p.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")), on="track", prefix="track_")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
NAMES = ("1", "2.5", "3", "4", "5")


@q("concat_conditions", "SELECT o_orderkey + coalesce((SELECT sum(top) FROM (SELECT o_orderpriority AS p, max(o_orderkey) AS top FROM orders GROUP BY 1) WHERE p < o_orderpriority), 0)::BIGINT AS id, o_totalprice AS value, CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{n}'" for p, n in zip(PRIORITIES, NAMES)) + " END AS condition, CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRIORITIES)) + " END::BIGINT AS input, CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN {n}" for p, n in zip(PRIORITIES, NAMES)) + " END::DOUBLE AS condition_value FROM orders")
def _(spark, sf):
    o = read(spark, sf, "orders")
    part = lambda p: o.where(F.col("o_orderpriority") == p).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return T.concat([part(p) for p in PRIORITIES], list(NAMES))


CONDITIONS = [("area", ">=", 10.0), ("mean_intensity", "<", 40000.0), ("grp", "!=", "A")]


@q("if_else_pass", "SELECT * FROM lab WHERE area >= 10 AND mean_intensity < 40000 AND grp <> 'A'", LAB)
def _(spark, sf):
    return T.if_else(labels(spark, sf), CONDITIONS)[0]


@q("if_else_fail", "SELECT * FROM lab WHERE NOT (area >= 10 AND mean_intensity < 40000 AND grp <> 'A')", LAB)
def _(spark, sf):
    return T.if_else(labels(spark, sf), CONDITIONS)[1]


@q("filter_percentile", "SELECT l.*, c.cut FROM lab l JOIN (SELECT m, quantile_cont(mean_intensity, 0.75) AS cut FROM lab GROUP BY m) c ON l.m = c.m WHERE mean_intensity >= cut", LAB)
def _(spark, sf):
    return T.filter_labels(labels(spark, sf), "mean_intensity", "percentile", "above", "series", percentile=75)


@q("filter_fixed_below", "SELECT *, 20.0::DOUBLE AS cut FROM lab WHERE area <= 20", LAB)
def _(spark, sf):
    return T.filter_labels(labels(spark, sf), "area", "fixed", "below", level=20)


@q("filter_mean", "SELECT l.*, round(c.cut, 6) AS cut FROM lab l JOIN (SELECT m, avg(area) AS cut FROM lab GROUP BY m HAVING min(area) < max(area)) c ON l.m = c.m WHERE area >= c.cut", LAB)
def _(spark, sf):
    return T.filter_labels(labels(spark, sf), "area", "mean", "above", "series")


OTSU = """ends AS (SELECT min(mean_intensity) AS lo, max(mean_intensity) AS hi FROM lab),
hist AS (SELECT least(floor((mean_intensity - lo) / (hi - lo) * 256), 255)::INT AS bin, lo, hi, count(*) AS n FROM lab, ends GROUP BY ALL),
cen AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 256 AS center FROM hist),
run AS (SELECT *, sum(n) OVER w AS n0, sum(n * center) OVER w AS s0, sum(n) OVER () AS nn, sum(n * center) OVER () AS ss FROM cen WINDOW w AS (ORDER BY bin)),
sc AS (SELECT bin, center, n0 * (nn - n0) * (s0 / n0 - (ss - s0) / (nn - n0)) ** 2 AS score FROM run WHERE n0 < nn),
cut AS (SELECT center AS cut FROM sc ORDER BY score DESC, bin LIMIT 1)"""


@q("filter_otsu", "SELECT lab.*, round(cut, 6) AS cut FROM lab, cut WHERE mean_intensity >= cut", LAB, OTSU)
def _(spark, sf):
    return T.filter_labels(labels(spark, sf).drop("c"), "mean_intensity", "otsu")


@q("curate_drop_merge", "SELECT CASE WHEN c_custkey IN (20, 21) THEN 19 ELSE c_custkey END AS id, c_acctbal AS balance, c_custkey AS id_before FROM customer WHERE c_custkey NOT BETWEEN 3 AND 9 AND c_custkey <> 30")
def _(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return T.curate_objects(c, "id", "3-9,30", "20>19,21>20")


for _r, _sql in (("mean", "round(avg(p_retailprice), 6)"), ("median", "median(p_retailprice)"), ("max", "max(p_retailprice)"), ("count", "count(p_retailprice)::DOUBLE"), ("sum", "round(sum(p_retailprice), 2)")):
    q(f"reduce_scalar_{_r}", f"SELECT {_sql} AS score FROM part", digits=2 if _r == "sum" else 6)(lambda spark, sf, r=_r: T.reduce_scalar(read(spark, sf, "part"), "p_retailprice", r))


@q("values_divide", "SELECT id, round(CASE WHEN area = 10 THEN 'nan'::DOUBLE ELSE mean_intensity / (area - 10) END, 9) AS ratio FROM lab", LAB, digits=9)
def _(spark, sf):
    d = T.values(labels(spark, sf), "subtract", "area", 10.0, "rest")
    return T.values(d, "divide", "mean_intensity", "rest", "ratio").select("id", "ratio")


@q("values_log10", "SELECT id, round(CASE WHEN discount > 0 THEN log10(discount) ELSE 'nan'::DOUBLE END, 6) AS lg FROM lab", LAB)
def _(spark, sf):
    return T.values(labels(spark, sf), "log10", "discount", name="lg").select("id", "lg")


@q("values_units", "SELECT id, round(area * 1000, 6) AS total FROM (SELECT id, area FROM lab)", LAB)
def _(spark, sf):
    d = T.values(labels(spark, sf).withColumn("zero", F.lit(0.0)), "add", "zero", "area", "total", a_unit="um", b_unit="mm")
    return d.select("id", "total")


@q("image_divide", "SELECT m, y, x, round(CASE WHEN ref.r = 0 THEN 'nan'::DOUBLE ELSE value / ref.r END, 4) AS value FROM vox JOIN (SELECT y, x, avg(value) AS r FROM vox GROUP BY y, x) ref USING (y, x)", VOX, digits=4)
def _(spark, sf):
    v = voxels(spark, sf)
    return T.image(v.select("m", "y", "x", "value"), v.groupBy("y", "x").agg(F.avg("value").alias("value")), "divide")


@q("image_difference", "SELECT m, y, x, round(abs(value - 0.05), 6) AS value FROM vox", VOX)
def _(spark, sf):
    return T.image(voxels(spark, sf), 0.05, "difference")


MASKS = "a AS (SELECT DISTINCT l_orderkey AS y, l_linenumber AS x FROM lineitem WHERE l_quantity > 25), b AS (SELECT DISTINCT l_orderkey AS y, l_linenumber AS x FROM lineitem WHERE l_discount > 0.05), f AS (SELECT DISTINCT l_orderkey AS y, l_linenumber AS x FROM lineitem)"


def masks(spark, sf):
    d = read(spark, sf, "lineitem")
    k = [F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x")]
    return d.where("l_quantity > 25").select(*k), d.where("l_discount > 0.05").select(*k), d.select(*k)


for _op, _sql in (("union", "SELECT * FROM a UNION SELECT * FROM b"), ("intersect", "SELECT * FROM a INTERSECT SELECT * FROM b"), ("subtract", "SELECT * FROM a EXCEPT SELECT * FROM b"), ("xor", "(SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)"), ("invert", "SELECT * FROM f EXCEPT SELECT * FROM a")):

    def _mask(spark, sf, op=_op):
        a, b, f = masks(spark, sf)
        return T.mask_math(a, b, op, f)

    q(f"mask_{_op}", _sql, MASKS)(_mask)


# --- axes -------------------------------------------------------------------------------------------


@q("crop_window", "SELECT m, y - 2 AS y, x - 1 AS x, value FROM vox WHERE y >= 2 AND y < 6 AND x >= 1 AND x < 5", VOX)
def _(spark, sf):
    return A.crop(voxels(spark, sf).select("m", "y", "x", "value"), (2, 6), (1, 5))


@q("select_planes_reordered", "SELECT m, CASE y WHEN 5 THEN 0 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS y, x, value FROM vox WHERE y IN (5, 0, 3)", VOX)
def _(spark, sf):
    return A.reindex(voxels(spark, sf).select("m", "y", "x", "value"), "y", [5, 0, 3])


@q("select_position", "SELECT 0::BIGINT AS m, y, x, value FROM vox WHERE m = 3", VOX)
def _(spark, sf):
    return A.select_position(voxels(spark, sf).select("m", "y", "x", "value"), 3)


@q("trim_span", "SELECT m, CASE t WHEN 0 THEN 0 WHEN 9 THEN 1 WHEN 19 THEN 2 ELSE 3 END::BIGINT AS t, id FROM pts WHERE t IN (0, 9, 19, 29)", PTS)
def _(spark, sf):
    return A.trim(points(spark, sf).select("m", "t", "id"), "t", 30, count=4)


@q("trim_stride", "SELECT m, t // 3 AS t, id FROM pts WHERE t % 3 = 0 AND t <= 27", PTS)
def _(spark, sf):
    return A.trim(points(spark, sf).select("m", "t", "id"), "t", 30, count=10, spacing="stride")


@q("time_shift_rows", "SELECT id, t + 3 AS t FROM pts WHERE t + 3 BETWEEN 0 AND 29", PTS)
def _(spark, sf):
    return A.time_shift_rows(points(spark, sf).select("id", "t"), 3, 30)


SPINE = "g AS (SELECT range AS t FROM range(7))"


@q("time_shift_hold", "SELECT s.m, g.t, s.y, s.x, round(s.value, 6) AS value FROM g JOIN stk s ON s.t = greatest(0, g.t - 2)", VOX, STK, SPINE)
def _(spark, sf):
    return A.time_shift_image(stack(spark, sf), 2, 7).select("m", "t", "y", "x", "value")


@q("time_shift_blank", "SELECT s.m, (s.t + 2) % 7 AS t, s.y, s.x, CASE WHEN s.t + 2 < 7 THEN round(s.value, 6) ELSE 0 END AS value FROM stk s", VOX, STK)
def _(spark, sf):
    return A.time_shift_image(stack(spark, sf), 2, 7, edges="blank").select("m", "t", "y", "x", "value")


@q("merge_time", "SELECT m, t, y, x, round(value, 6) AS value FROM stk UNION ALL SELECT m, t + 7, y, x, round(value, 6) FROM stk", VOX, STK)
def _(spark, sf):
    s = stack(spark, sf)
    return A.merge([s, s], "t", [7, 7])


@q("batch_select", "SELECT m, y, x, value, 0::BIGINT AS b FROM vox WHERE m % 2 = 1", VOX)
def _(spark, sf):
    v = voxels(spark, sf).select("m", "y", "x", "value")
    return A.select_batch(A.batch([v.where("m % 2 = 0"), v.where("m % 2 = 1")]), 1)


@q("timeseries_files", "SELECT m, CASE WHEN m % 2 = 0 THEN y + 8 ELSE y END AS y, x, value FROM vox", VOX)
def _(spark, sf):
    v = voxels(spark, sf).select("m", "y", "x", "value")
    return A.timeseries([v.where("m % 2 = 0"), v.where("m % 2 = 1")], [8, 8], ["run10.nd2", "run9.nd2"], "y")


@q("merge_frames", "SELECT file, t, clock, row_number() OVER (ORDER BY c, file, t) - 1 AS new_t FROM (SELECT *, max(clock) OVER (PARTITION BY file ORDER BY t) AS c FROM (SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS t, epoch(ts) AS clock FROM events))")
def _(spark, sf):
    from pyspark.sql import Window

    e = read(spark, sf, "events")
    return A.merge_frames(e.select(F.col("event_type").alias("file"), F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).cast("long").alias("t"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("clock")))


GROUPS = """stage AS (SELECT s_suppkey AS m, s_suppkey * 10.0 + (s_suppkey // 4) * 500 + s_nationkey * 0.01 AS x FROM supplier),
steps AS (SELECT *, x - lag(x) OVER (ORDER BY m) AS step FROM stage),
spec AS (SELECT m, coalesce(sum(CASE WHEN step > 3 * typical THEN 1 ELSE 0 END) OVER (ORDER BY m), 0)::BIGINT AS specimen FROM steps, (SELECT median(step) AS typical FROM steps))"""


def stage(spark, sf):
    s = read(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("m"), F.lit(0.0).alias("y"), (F.col("s_suppkey") * 10.0 + F.floor(F.col("s_suppkey") / 4) * 500 + F.col("s_nationkey") * 0.01).alias("x"))


@q("position_groups", "SELECT m, specimen FROM spec", GROUPS)
def _(spark, sf):
    return A.position_groups(stage(spark, sf)).select("m", F.col("specimen").cast("long").alias("specimen"))


@q("select_group", "SELECT l.id, n.k - 1 AS m, l.area FROM lab l JOIN (SELECT m, row_number() OVER (ORDER BY m) AS k FROM spec WHERE specimen IN (0, 2)) n ON l.m = n.m", LAB, GROUPS)
def _(spark, sf):
    return A.select_group(labels(spark, sf).select("id", "m", "area"), stage(spark, sf), [0, 2])


@q("crop_region_fit", "SELECT v.m, v.y - b.ly AS y, v.x - b.lx AS x, v.value FROM vox v JOIN (SELECT m, min(y) AS ly, max(y) AS hy, min(x) AS lx, max(x) AS hx FROM vox WHERE value > 0.2 GROUP BY m) b ON v.m = b.m WHERE v.y BETWEEN ly AND hy AND v.x BETWEEN lx AND hx", VOX)
def _(spark, sf):
    v = voxels(spark, sf).select("m", "y", "x", "value")
    return A.crop_region(v, v.where("value > 0.2").select("m", "y", "x"), extent="fit", unit=("m",))


@q("crop_region_blank", "SELECT m, y, x, CASE WHEN value > 0.1 THEN value ELSE 0 END AS value FROM vox", VOX)
def _(spark, sf):
    v = voxels(spark, sf).select("m", "y", "x", "value")
    return A.crop_region(v, v.where("value > 0.1").select("m", "y", "x"), fill=0.0)


@q("crop_objects", "SELECT v.m, v.y - b.ly AS y, v.x - b.lx AS x, v.value, v.m AS label_id FROM vox v JOIN (SELECT m, min(y) AS ly, min(x) AS lx FROM vox WHERE value > 0 GROUP BY m) b ON v.m = b.m WHERE value > 0 AND v.m > 0", VOX)
def _(spark, sf):
    v = voxels(spark, sf).select("m", "y", "x", "value")
    return A.crop_objects(v, v.where("value > 0").select("m", "y", "x", F.col("m").alias("label_id")), ("m", "y", "x")).select("m", "y", "x", "value", "label_id")


@q("crop_to_stage", "SELECT m, y, x, value FROM vox WHERE m * 10.0 + y * 0.5 BETWEEN 98 AND 151 AND x * 0.5 BETWEEN -1 AND 2", VOX)
def _(spark, sf):
    v = voxels(spark, sf).select("m", "y", "x", "value")
    stage = read(spark, sf, "embeddings").select(F.col("vec_id").alias("m"), (F.col("vec_id") * 10.0).alias("y_um"), F.lit(0.0).alias("x_um"))
    return A.crop_to(v, stage, (100, 149, 1, 0), 0.5, 2.0).select("m", "y", "x", "value")


for _mth, _sql in (("max", "max(value)"), ("mean", "avg(value)"), ("sum", "sum(value)"), ("min", "min(value)"), ("median", "median(value)")):
    q(f"zproject_{_mth}", f"SELECT label AS t, y, x, round({_sql}, 6) AS value FROM vox GROUP BY label, y, x", VOX)(lambda spark, sf, m=_mth: A.zproject(voxels(spark, sf).select(F.col("label").alias("t"), F.col("m").alias("z"), "y", "x", "value"), m))


@q("stack_trimmed", "SELECT m, y, x, round(CASE WHEN count(*) <= 2 THEN avg(value) ELSE (sum(value) - min(value) - max(value)) / (count(*) - 2) END, 6) AS value FROM stk GROUP BY m, y, x", VOX, STK)
def _(spark, sf):
    return A.stack(stack(spark, sf), "trimmed_mean")


CLIP = """clip0 AS (SELECT m, y, x, value FROM stk),
s1 AS (SELECT c.*, md, dev FROM clip0 c JOIN (SELECT m, y, x, any_value(md) AS md, median(abs(value - md)) AS dev FROM clip0 JOIN (SELECT m, y, x, median(value) AS md FROM clip0 GROUP BY ALL) USING (m, y, x) GROUP BY m, y, x) USING (m, y, x)),
clip1 AS (SELECT m, y, x, value FROM s1 WHERE abs(value - md) <= dev * 4.4478),
s2 AS (SELECT c.*, md, dev FROM clip1 c JOIN (SELECT m, y, x, any_value(md) AS md, median(abs(value - md)) AS dev FROM clip1 JOIN (SELECT m, y, x, median(value) AS md FROM clip1 GROUP BY ALL) USING (m, y, x) GROUP BY m, y, x) USING (m, y, x)),
clip2 AS (SELECT m, y, x, value FROM s2 WHERE abs(value - md) <= dev * 4.4478),
s3 AS (SELECT c.*, md, dev FROM clip2 c JOIN (SELECT m, y, x, any_value(md) AS md, median(abs(value - md)) AS dev FROM clip2 JOIN (SELECT m, y, x, median(value) AS md FROM clip2 GROUP BY ALL) USING (m, y, x) GROUP BY m, y, x) USING (m, y, x))"""


@q("stack_sigma_clip", "SELECT m, y, x, round(avg(value), 6) AS value FROM s3 WHERE abs(value - md) <= dev * 4.4478 GROUP BY m, y, x", VOX, STK, CLIP)
def _(spark, sf):
    return A.stack(stack(spark, sf), "sigma_clip")


@q("downsample", "SELECT m, y // 2 AS y, x // 2 AS x, round(avg(value), 6) AS value FROM vox GROUP BY ALL", VOX)
def _(spark, sf):
    return A.downsample(voxels(spark, sf).select("m", "y", "x", "value"), 0.5)


for _bl, _sql in (("mean", "avg(value)"), ("max", "max(value)"), ("overwrite", "max_by(value, m)"), ("feather", "sum(value * w) / sum(w)")):

    def _stitch(spark, sf, b=_bl):
        v = voxels(spark, sf).select("m", "y", "x", "value")
        tiles = read(spark, sf, "embeddings").select(F.col("vec_id").alias("m"), (F.floor(F.col("vec_id") / 40) * 6).alias("oy"), ((F.col("vec_id") % 40) * 6).alias("ox"))
        return A.stitch(v, tiles, b, (8, 8))

    q(f"stitch_{_bl}", f"SELECT y + (m // 40) * 6 AS y, x + (m % 40) * 6 AS x, round({_sql}, 6) AS value FROM (SELECT *, least(y + 1, 8 - y, x + 1, 8 - x)::DOUBLE AS w FROM vox) GROUP BY 1, 2", VOX)(_stitch)


# --- domain transfer --------------------------------------------------------------------------------


@q("transfer_voxel_frame", "SELECT m, t, round(avg(value), 6) AS value FROM stk GROUP BY m, t", VOX, STK)
def _(spark, sf):
    return D.lattice(stack(spark, sf), "voxel", "frame", "value", "mean")


@q("transfer_voxel_multipoint_first", "SELECT m, round(arg_min(value, (t, y, x)), 6) AS value FROM stk GROUP BY m", VOX, STK)
def _(spark, sf):
    return D.lattice(stack(spark, sf), "voxel", "multipoint", "value", "first")


@q("transfer_frame_voxel", "SELECT f.m, f.t, y.range AS y, x.range AS x, round(f.value, 6) AS value FROM (SELECT m, t, sum(value) AS value FROM stk GROUP BY m, t) f, range(4) y, range(3) x", VOX, STK)
def _(spark, sf):
    f = D.lattice(stack(spark, sf), "voxel", "frame", "value", "sum")
    return D.lattice(f, "frame", "voxel", "value", sizes=AxisSizes(y=4, x=3)).select("m", "t", "y", "x", "value")


@q("transfer_global_median", "SELECT round(median(value), 6) AS value FROM vox", VOX)
def _(spark, sf):
    return D.lattice(voxels(spark, sf), "voxel", "global", "value", "median")


RASTER = "ras AS (SELECT m, y, x, value, CASE WHEN value > 0.1 THEN m * 2 + 1 + (y // 4) ELSE 0 END AS label_id FROM vox)"


def raster(spark, sf):
    v = voxels(spark, sf)
    return v.select("m", "y", "x", F.when(F.col("value") > 0.1, F.col("m") * 2 + 1 + F.floor(F.col("y") / 4)).otherwise(0).alias("label_id")), v.select("m", "y", "x", "value")


@q("bridge_voxel_label", "SELECT label_id AS id, round(stddev_samp(value), 6) AS value FROM ras WHERE label_id > 0 GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT label_id, 'nan'::DOUBLE FROM ras WHERE label_id > 0 GROUP BY 1 HAVING count(*) = 1", VOX, RASTER)
def _(spark, sf):
    r, v = raster(spark, sf)
    return D.voxel_to_label(v, r, reducer="std")


@q("bridge_label_voxel", "SELECT m, y, x, CASE WHEN label_id > 0 AND label_id % 3 = 0 THEN label_id * 0.5 ELSE -1 END::DOUBLE AS score FROM ras", VOX, RASTER)
def _(spark, sf):
    r, _ = raster(spark, sf)
    t = r.where("label_id > 0 and label_id % 3 = 0").select(F.col("label_id").alias("id")).distinct().withColumn("score", F.col("id") * 0.5)
    return D.label_to_voxel(r, t, "score", -1.0)


@q("bridge_voxel_point", "SELECT p.id, p.m, round(v.value, 6) AS value FROM (SELECT id, m, greatest(0, least(7, round_even(abs(y) / 4, 0)))::BIGINT AS y, greatest(0, least(7, round_even(abs(x) / 4, 0)))::BIGINT AS x FROM (SELECT id, id AS m, y, x FROM emb)) p JOIN vox v ON p.m = v.m AND p.y = v.y AND p.x = v.x", EMB, VOX)
def _(spark, sf):
    p = vectors(spark, sf).select("id", F.col("id").alias("m"), (F.abs("y") / 4).alias("y"), (F.abs("x") / 4).alias("x"))
    return D.voxel_to_point(p, voxels(spark, sf), AxisSizes(y=8, x=8)).select("id", "m", "value")


@q("bridge_point_voxel", "SELECT m, 0::BIGINT AS z, greatest(0, least(7, round_even(abs(y) / 4, 0)))::BIGINT AS y, greatest(0, least(7, round_even(abs(x) / 4, 0)))::BIGINT AS x, round(max(v), 6) AS v FROM emb GROUP BY ALL", EMB)
def _(spark, sf):
    p = vectors(spark, sf).select("id", "m", (F.abs("y") / 4).alias("y"), (F.abs("x") / 4).alias("x"), "v")
    return D.point_to_voxel(p, "v", AxisSizes(y=8, x=8), "max")


@q("bridge_member_track", "SELECT track_id, round(avg(value), 6) AS value FROM pts WHERE track_id > 0 GROUP BY 1", PTS)
def _(spark, sf):
    p = points(spark, sf)
    return D.member_to_track(p, p.select("track_id", "t", F.col("id").alias("member_id")), "value")


@q("bridge_track_member", "SELECT p.id AS member_id, round(s.v, 6) AS value FROM pts p JOIN (SELECT track_id, max(value) AS v FROM pts GROUP BY 1) s USING (track_id)", PTS)
def _(spark, sf):
    p = points(spark, sf)
    return D.track_to_member(p.select("track_id", "t", F.col("id").alias("member_id")), p.groupBy("track_id").agg(F.max("value").alias("value")), "value")


@q("bridge_track_timepoint", "SELECT t, count(DISTINCT track_id) AS tracks FROM pts WHERE track_id > 0 GROUP BY t", PTS)
def _(spark, sf):
    return D.track_to_timepoint(points(spark, sf))


@q("bridge_point_frame", "SELECT m, t, round(median(value), 6) AS value FROM pts GROUP BY m, t", PTS)
def _(spark, sf):
    return D.member_to_frame(points(spark, sf), "value", "median")


@q("bridge_frame_point", "SELECT p.id, round(f.v, 6) AS value FROM pts p JOIN (SELECT m, t, sum(value) AS v FROM pts GROUP BY m, t) f USING (m, t)", PTS)
def _(spark, sf):
    p = points(spark, sf)
    return D.frame_to_member(p, D.member_to_frame(p, "value", "sum"), "value").select("id", "value")


@q("label_to_points", "SELECT m, label_id AS label, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM ras WHERE label_id > 0 GROUP BY m, label_id", VOX, RASTER)
def _(spark, sf):
    return D.label_to_points(raster(spark, sf)[0])


@q("label_to_points_weighted", "SELECT m, label_id AS label, round(sum(value * y) / sum(value), 6) AS y, round(sum(value * x) / sum(value), 6) AS x FROM ras WHERE label_id > 0 GROUP BY m, label_id", VOX, RASTER)
def _(spark, sf):
    r, v = raster(spark, sf)
    return D.label_to_points(r, v, "weighted")


@q("label_to_points_inside", "SELECT m, label, y::DOUBLE AS y, x::DOUBLE AS x FROM (SELECT r.m, r.label_id AS label, r.y, r.x, row_number() OVER (PARTITION BY r.m, r.label_id ORDER BY round((r.y - c.y) ** 2 + (r.x - c.x) ** 2, 9), r.y, r.x) AS k FROM ras r JOIN (SELECT label_id, avg(y) AS y, avg(x) AS x FROM ras WHERE label_id > 0 GROUP BY 1) c USING (label_id)) WHERE k = 1", VOX, RASTER)
def _(spark, sf):
    return D.label_to_points(raster(spark, sf)[0], position="inside")


@q("measure_label", "SELECT label_id AS id, count(*) AS area, round(avg(y), 6) AS y, round(avg(x), 6) AS x, round(avg(value), 6) AS mean_intensity, round(max(value), 6) AS max_intensity, round(min(value), 6) AS min_intensity, round(sum(value), 6) AS total_intensity, round(median(value), 6) AS median_intensity FROM ras WHERE label_id > 0 GROUP BY 1", VOX, RASTER)
def _(spark, sf):
    r, v = raster(spark, sf)
    return D.measure(r, v, ("mean", "max", "min", "sum", "median"))


SHAPE = "shp AS (SELECT label_id AS id, count(*) AS area, avg(y) AS y, avg(x) AS x, avg(value) AS v, var_pop(y) + 1/12.0 AS yy, var_pop(x) + 1/12.0 AS xx, covar_pop(y, x) AS yx, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS box FROM ras WHERE label_id > 0 GROUP BY 1), axs AS (SELECT *, (yy + xx) / 2 + sqrt(((yy - xx) / 2) ** 2 + yx ** 2) AS l1, greatest((yy + xx) / 2 - sqrt(((yy - xx) / 2) ** 2 + yx ** 2), 0) AS l2 FROM shp)"


@q("measure_shape", "SELECT id, area, round(y, 5) AS y, round(x, 5) AS x, round(4 * sqrt(l1), 5) AS axis_major, round(4 * sqrt(l2), 5) AS axis_minor, round(sqrt(greatest(1 - l2 / l1, 0)), 5) AS eccentricity, round(atan2(2 * CASE WHEN abs(yx) > 1e-12 THEN yx ELSE 0 END, yy - xx) / 2, 5) AS orientation, round(area / box::DOUBLE, 5) AS extent FROM axs", VOX, RASTER, SHAPE, digits=5)
def _(spark, sf):
    r, v = raster(spark, sf)
    return D.measure(r, v, (), True).select("id", "area", "y", "x", "axis_major", "axis_minor", "eccentricity", "orientation", "extent")


@q("measure_pixels", "SELECT r.m, r.y, r.x, r.label_id, r.value AS intensity, round(sqrt((r.y - c.y) ** 2 + (r.x - c.x) ** 2), 6) AS centroid_dist FROM ras r JOIN (SELECT label_id, avg(y) AS y, avg(x) AS x FROM ras GROUP BY 1) c USING (label_id) WHERE label_id > 0", VOX, RASTER)
def _(spark, sf):
    r, v = raster(spark, sf)
    return D.measure_pixels(r, v).select("m", "y", "x", "label_id", "intensity", "centroid_dist")


# --- sequences --------------------------------------------------------------------------------------

TRK = "trk AS (SELECT m AS track_id, t, avg(value) AS y, count(*)::DOUBLE AS x, min(id) AS id, 0::BIGINT AS m FROM pts GROUP BY m, t)"


def tracks(spark, sf):
    p = points(spark, sf).groupBy(F.col("m").alias("track_id"), "t").agg(F.avg("value").alias("y"), F.count(F.lit(1)).cast("double").alias("x"), F.min("id").alias("id"))
    return p.withColumn("m", F.lit(0).cast("long"))


@q("tracks_speed", "SELECT id, track_id, t, round(coalesce(vy, 'nan'::DOUBLE), 6) AS vy, round(coalesce(vx, 'nan'::DOUBLE), 6) AS vx, round(coalesce(sqrt(vy * vy + vx * vx), 'nan'::DOUBLE), 6) AS speed FROM (SELECT id, track_id, t, CASE WHEN track_id > 0 THEN (y - lag(y) OVER w) / ((t - lag(t) OVER w) * 30.0) END AS vy, CASE WHEN track_id > 0 THEN (x - lag(x) OVER w) / ((t - lag(t) OVER w) * 30.0) END AS vx FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY t))", PTS, TRK)
def _(spark, sf):
    return W.velocity(tracks(spark, sf), 30.0).select("id", "track_id", "t", "vy", "vx", "speed")


@q("frame_fold", "SELECT id, round(value / avg(value) OVER (PARTITION BY m, t), 6) AS frame_fold FROM pts", PTS)
def _(spark, sf):
    return W.frame_fold(points(spark, sf), "value").select("id", "frame_fold")


@q("self_fold", "SELECT id, round(CASE WHEN track_id > 0 THEN value / avg(value) OVER (PARTITION BY track_id) ELSE 'nan'::DOUBLE END, 6) AS self_fold FROM pts", PTS)
def _(spark, sf):
    return W.self_fold(points(spark, sf), "value").select("id", "self_fold")


@q("track_displacement", "SELECT id, round(y - first_value(y) OVER w, 6) AS disp_y, round(x - first_value(x) OVER w, 6) AS disp_x FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM trk WHERE track_id > 0) WHERE n >= 2 WINDOW w AS (PARTITION BY track_id ORDER BY t)", PTS, TRK)
def _(spark, sf):
    return W.track_displacement(tracks(spark, sf)).select("id", "disp_y", "disp_x")


FRM = "frm AS (SELECT 0::BIGINT AS m, t, avg(value) AS value FROM pts GROUP BY t)"


def frames(spark, sf):
    return points(spark, sf).groupBy("t").agg(F.avg("value").alias("value")).withColumn("m", F.lit(0).cast("long"))


@q("temporal_gain_mean", "SELECT t, round(avg(value) OVER () / value, 6) AS gain FROM frm", PTS, FRM)
def _(spark, sf):
    return W.temporal_gain(frames(spark, sf)).select("t", "gain")


@q("temporal_gain_rolling", "SELECT a.t, round(CASE WHEN abs(s / 7 / v - 1) <= 0.02 THEN 1 ELSE s / 7 / v END, 6) AS gain FROM (SELECT f.t, any_value(f.value) AS v, sum(h.value) AS s FROM frm f, range(-3, 4) k JOIN frm h ON h.t = greatest(0, least((SELECT max(t) FROM frm), f.t + k.range)) GROUP BY f.t) a", PTS, FRM)
def _(spark, sf):
    return W.temporal_gain(frames(spark, sf), "rolling_mean", 7, 0.02).select("t", "gain")


@q("temporal_gain_exponential", "SELECT t, round(avg(fit) OVER () / fit, 6) AS gain FROM (SELECT t, exp(a + k * t) AS fit FROM frm, (SELECT regr_slope(ln(value), t) AS k, regr_intercept(ln(value), t) AS a FROM frm))", PTS, FRM)
def _(spark, sf):
    return W.temporal_gain(frames(spark, sf), "exponential_fit").select("t", "gain")


@q("normalize_percentile", "SELECT v.m, y, x, round(greatest(0, least(1, (value - lo) / (hi - lo))), 6) AS value FROM vox v JOIN (SELECT m, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM vox GROUP BY m) p ON v.m = p.m", VOX)
def _(spark, sf):
    return W.normalize(voxels(spark, sf).select("m", "y", "x", "value"), 5, 95)


@q("gamma_plane_max", "SELECT m, y, x, round(CASE WHEN s > 0 THEN pow(greatest(value, 0) / s, 0.5) * s ELSE 0 END, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY m) AS s FROM vox)", VOX)
def _(spark, sf):
    return W.gamma(voxels(spark, sf).select("m", "y", "x", "value"), 0.5)


@q("density_grid", "SELECT m, floor(y / 5)::BIGINT AS gy, floor(x / 5)::BIGINT AS gx, count(*) AS n, count(*) / 25.0::DOUBLE AS density FROM emb GROUP BY ALL", EMB)
def _(spark, sf):
    return W.density_grid(vectors(spark, sf), 5.0)


PIV = "pv AS (SELECT m, y AS gy, x AS gx, value * 10 AS u, value * value * 40 AS v, 1 + abs(value) * 5 AS s2n FROM vox)"


def pivs(spark, sf):
    return voxels(spark, sf).select("m", F.col("y").alias("gy"), F.col("x").alias("gx"), (F.col("value") * 10).alias("u"), (F.col("value") * F.col("value") * 40).alias("v"), (1 + F.abs("value") * 5).alias("s2n"))


PIVM = """
f AS (SELECT *, s2n < 1.1 OR sqrt(u * u + v * v) > 4 AS bad FROM pv),
nb AS (SELECT p.m, p.gy, p.gx, n.u, n.v FROM pv p JOIN f n ON n.m = p.m AND abs(n.gy - p.gy) <= 1 AND abs(n.gx - p.gx) <= 1 AND (n.gy <> p.gy OR n.gx <> p.gx) WHERE NOT n.bad),
md AS (SELECT m, gy, gx, median(u) AS mu, median(v) AS mv FROM nb GROUP BY ALL),
sp AS (SELECT nb.m, nb.gy, nb.gx, any_value(mu) AS mu, any_value(mv) AS mv, median(abs(u - mu)) AS ru, median(abs(v - mv)) AS rv FROM nb JOIN md USING (m, gy, gx) GROUP BY ALL)"""


@q("piv_validate", "SELECT f.m, f.gy, f.gx, bad OR coalesce(abs(u - mu) / (ru + 0.1) > 2 OR abs(v - mv) / (rv + 0.1) > 2, false) AS flag FROM f LEFT JOIN sp USING (m, gy, gx)", VOX, PIV, PIVM)
def _(spark, sf):
    return W.piv_validate(pivs(spark, sf), 1.1, 4.0, 1e9).select("m", "gy", "gx", "flag")


# --- space ------------------------------------------------------------------------------------------


@q("range_pairs", "SELECT a.id AS a, b.id AS b, round(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2), 6) AS dist FROM emb a JOIN emb b ON a.m = b.m AND a.id < b.id AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 9", EMB)
def _(spark, sf):
    v = vectors(spark, sf)
    return S.within(v, v, 3.0, on=["m"]).where("id < id_r").select(F.col("id").alias("a"), F.col("id_r").alias("b"), "dist")


@q("knn_distance", "SELECT id, round(coalesce(avg(d), 'nan'::DOUBLE), 6) AS nn_dist_mean, round(coalesce(stddev_pop(d), 'nan'::DOUBLE), 6) AS nn_dist_std FROM (SELECT a.id, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.y - b.y) ** 2 + (a.x - b.x) ** 2, b.id) AS k FROM emb a LEFT JOIN emb b ON a.m = b.m AND a.id <> b.id) WHERE k <= 6 GROUP BY id", EMB)
def _(spark, sf):
    return W.neighbour_metrics(vectors(spark, sf).select("id", "m", "y", "x"), 6).select("id", "nn_dist_mean", "nn_dist_std")


@q("knn_flow", "SELECT id, round(coalesce(CASE WHEN count(*) >= 2 THEN avg((dy * dvy + dx * dvx) / r2) END, 'nan'::DOUBLE), 6) AS divergence, round(coalesce(CASE WHEN count(*) >= 2 THEN avg((dy * dvx - dx * dvy) / r2) END, 'nan'::DOUBLE), 6) AS curl FROM (SELECT a.id, b.y - a.y AS dy, b.x - a.x AS dx, b.v - a.v AS dvy, b.w - a.w AS dvx, greatest((a.y - b.y) ** 2 + (a.x - b.x) ** 2, 1) AS r2, row_number() OVER (PARTITION BY a.id ORDER BY (a.y - b.y) ** 2 + (a.x - b.x) ** 2, b.id) AS k FROM emb a JOIN emb b ON a.m = b.m AND a.id <> b.id) WHERE k <= 6 GROUP BY id", EMB)
def _(spark, sf):
    d = vectors(spark, sf).withColumnRenamed("v", "vy").withColumnRenamed("w", "vx")
    return W.neighbour_metrics(d, 6).select("id", "divergence", "curl")


@q("voronoi_nearest", "SELECT v.y, v.x, coalesce(arg_min(e.id, (round((v.y - e.y) ** 2 + (v.x - e.x) ** 2, 9), e.id)), 0) AS seed FROM (SELECT a.range - 20 AS y, b.range - 20 AS x FROM range(40) a, range(40) b) v LEFT JOIN emb e ON (v.y - e.y) ** 2 + (v.x - e.x) ** 2 <= 16 GROUP BY v.y, v.x", EMB)
def _(spark, sf):
    g = spark.range(40).select((F.col("id") - 20).alias("y")).crossJoin(spark.range(40).select((F.col("id") - 20).alias("x")))
    return S.voronoi(vectors(spark, sf).select("id", "y", "x"), g, 4.0)


@q("grow_points", "SELECT v.y, v.x, arg_min(e.id, (round((v.y - e.y) ** 2 + (v.x - e.x) ** 2, 9), e.id)) AS label_id FROM (SELECT a.range - 20 AS y, b.range - 20 AS x FROM range(40) a, range(40) b) v JOIN emb e ON (v.y - e.y) ** 2 + (v.x - e.x) ** 2 <= 4 GROUP BY v.y, v.x", EMB)
def _(spark, sf):
    g = spark.range(40).select((F.col("id") - 20).alias("y")).crossJoin(spark.range(40).select((F.col("id") - 20).alias("x")))
    return S.grow_points(vectors(spark, sf).select("id", "y", "x"), g, 2.0)


@q("link_points")
def _(spark, sf):
    return S.link_points(tracks(spark, sf).select("id", "m", "t", "y", "x"), 3.0)


@q("link_labels")
def _(spark, sf):
    return S.link_labels(stack(spark, sf).select("m", "t", "y", "x", F.when(F.col("value") > 0.02, F.col("m") * 100 + F.col("t") * 10 + 1 + F.floor(F.col("y") / 4)).otherwise(0).alias("label_id")))


@q("register_shift", "SELECT id, round(y + 7.5, 4) AS reg_y, round(x - 3.25, 4) AS reg_x FROM emb", EMB, digits=4)
def _(spark, sf):
    v = vectors(spark, sf).select("id", "y", "x")
    marks = v
    moved = marks.select("id", (F.col("y") + 7.5).alias("y"), (F.col("x") - 3.25).alias("x"))
    return S.register_positions(v, marks, moved, 12.0, 2.0, "shift").select("id", "reg_y", "reg_x")


EDGE = "ed AS (SELECT m, y, x, label_id FROM ras WHERE label_id > 0)"


@q("extract_boundary", "SELECT m, y, x, label_id FROM ed a WHERE (SELECT count(*) FROM ed b WHERE b.m = a.m AND b.label_id = a.label_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1) < 4", VOX, RASTER, EDGE)
def _(spark, sf):
    return S.extract_boundary(raster(spark, sf)[0])


@q("boundary_band", "SELECT r.m, r.y, r.x, min(b.label_id) AS label_id FROM ras r JOIN ed b ON b.m = r.m AND abs(r.y - b.y) + abs(r.x - b.x) = 1 WHERE r.label_id = 0 GROUP BY ALL", VOX, RASTER, EDGE)
def _(spark, sf):
    return S.boundary_band(raster(spark, sf)[0], 1)


@q("roi_mask", "SELECT y.range AS y, x.range AS x FROM range(40) y, range(50) x WHERE ((y.range BETWEEN 5 AND 20 AND x.range BETWEEN 5 AND 30) AND NOT ((y.range - 12) / 5.0) ** 2 + ((x.range - 15) / 5.0) ** 2 <= 1) OR (y.range - 30) ** 2 + (x.range - 40) ** 2 <= 16")
def _(spark, sf):
    shapes = [{"kind": "rect", "y0": 5, "y1": 20, "x0": 5, "x1": 30}, {"kind": "circle", "cy": 12.0, "cx": 15.0, "r": 5.0, "op": "clear"}, {"kind": "brush", "points": [(30, 40)], "r": 4}]
    return S.roi_mask(spark, shapes, 40, 50)


@q("draw_regions", "SELECT CASE WHEN y.range >= 10 AND x.range >= 10 THEN 2 ELSE 1 END::BIGINT AS id, count(*) AS area, round(avg(y.range), 6) AS y, round(avg(x.range), 6) AS x FROM range(40) y, range(40) x WHERE (y.range <= 15 AND x.range <= 15) OR (y.range BETWEEN 10 AND 30 AND x.range BETWEEN 10 AND 30) GROUP BY 1")
def _(spark, sf):
    return S.draw_regions(spark, [{"kind": "rect", "y0": 0, "y1": 15, "x0": 0, "x1": 15}, {"kind": "rect", "y0": 10, "y1": 30, "x0": 10, "x1": 30}], 40, 40)[1]


@q("overlay_blend", "SELECT a.m, a.t, a.y, a.x, round(a.value + coalesce(b.value, 0) * 0.5, 6) AS value FROM stk a LEFT JOIN stk b ON a.m = b.m AND a.y = b.y AND a.x = b.x AND b.t = a.t + 1", VOX, STK)
def _(spark, sf):
    s = stack(spark, sf)
    return S.overlay(s, s, "add", 0.5, 1)


@q("canvas_box", "SELECT min(y) - 1 AS y0, max(y) + 2 AS y1, min(x) - 1 AS x0, max(x) + 2 AS x1 FROM (SELECT round(y, 6) AS y, round(x, 6) AS x FROM emb)", EMB)
def _(spark, sf):
    return S.canvas(vectors(spark, sf).select(F.round("y", 6).alias("y0"), (F.round("y", 6) + 1).alias("y1"), F.round("x", 6).alias("x0"), (F.round("x", 6) + 1).alias("x1")), 1.0)


@q("dic_grid", "SELECT t.range AS t, (8 + 16 * a.range)::INT AS y, (8 + 16 * b.range)::INT AS x, a.range * 3 + b.range AS id, 0.0::DOUBLE AS disp_y, 0.0::DOUBLE AS disp_x FROM range(2) t, range(3) a, range(3) b")
def _(spark, sf):
    return N.grid(spark, 64, 50, 16, 2)


# --- tensors ----------------------------------------------------------------------------------------

GRD = "grd AS (SELECT id, y / 100 AS gyy, x / 100 AS gyx, v AS gxy, w AS gxx FROM emb)"


def grads(spark, sf):
    return vectors(spark, sf).select("id", (F.col("y") / 100).alias("grad_yy"), (F.col("x") / 100).alias("grad_yx"), F.col("v").alias("grad_xy"), F.col("w").alias("grad_xx"))


@q("strain_2d", "SELECT id, round(gyy, 6) AS strain_yy, round((gyx + gxy) / 2, 6) AS strain_yx, round(gxx, 6) AS strain_xx, round((gyy + gxx) / 2 + sqrt(((gyy - gxx) / 2) ** 2 + ((gyx + gxy) / 2) ** 2), 6) AS principal_1, round((gyy + gxx) / 2 - sqrt(((gyy - gxx) / 2) ** 2 + ((gyx + gxy) / 2) ** 2), 6) AS principal_2, round(sqrt(((gyy - gxx) / 2) ** 2 + ((gyx + gxy) / 2) ** 2), 6) AS max_shear, round(gyy + gxx, 6) AS volumetric FROM grd", EMB, GRD)
def _(spark, sf):
    return N.strain(grads(spark, sf)).select("id", "strain_yy", "strain_yx", "strain_xx", "principal_1", "principal_2", "max_shear", "volumetric")


@q("strain_green_lagrange", "SELECT id, round(gyy + (gyy * gyy + gxy * gxy) / 2, 6) AS strain_yy, round((gyx + gxy + gyy * gyx + gxy * gxx) / 2, 6) AS strain_yx, round(gxx + (gxx * gxx + gyx * gyx) / 2, 6) AS strain_xx FROM grd", EMB, GRD)
def _(spark, sf):
    return N.strain(grads(spark, sf), "green_lagrange").select("id", "strain_yy", "strain_yx", "strain_xx")


#: Half the logarithm of C = F'F by its principal directions.
HENCKY = "hen AS (SELECT *, ln(c1) / 2 AS h1, ln(c2) / 2 AS h2, atan2(2 * cyx, cyy - cxx) / 2 AS a FROM (SELECT *, (cyy + cxx) / 2 + sqrt(((cyy - cxx) / 2) ** 2 + cyx ** 2) AS c1, (cyy + cxx) / 2 - sqrt(((cyy - cxx) / 2) ** 2 + cyx ** 2) AS c2 FROM (SELECT id, (1 + gyy) ** 2 + gxy ** 2 AS cyy, gyx ** 2 + (1 + gxx) ** 2 AS cxx, (1 + gyy) * gyx + gxy * (1 + gxx) AS cyx FROM grd)))"


@q("strain_hencky", "SELECT id, round(h1 * cos(a) ** 2 + h2 * sin(a) ** 2, 5) AS strain_yy, round((h1 - h2) * sin(a) * cos(a), 5) AS strain_yx, round(h1 * sin(a) ** 2 + h2 * cos(a) ** 2, 5) AS strain_xx, round(h1, 5) AS principal_1, round(h2, 5) AS principal_2, round((h1 - h2) / 2, 5) AS max_shear, round(h1 + h2, 5) AS volumetric FROM hen", EMB, GRD, HENCKY, digits=5)
def _(spark, sf):
    return N.strain(grads(spark, sf), "hencky").select("id", "strain_yy", "strain_yx", "strain_xx", "principal_1", "principal_2", "max_shear", "volumetric")


@q("strain_euler_almansi", "SELECT id, round((1 - (ixy ** 2 + iyy ** 2)) / 2, 5) AS strain_yy, round(-(iyy * iyx + ixy * ixx) / 2, 5) AS strain_yx, round((1 - (ixx ** 2 + iyx ** 2)) / 2, 5) AS strain_xx FROM (SELECT id, (1 + gxx) / j AS iyy, -gyx / j AS iyx, -gxy / j AS ixy, (1 + gyy) / j AS ixx FROM (SELECT *, (1 + gyy) * (1 + gxx) - gyx * gxy AS j FROM grd))", EMB, GRD, digits=5)
def _(spark, sf):
    return N.strain(grads(spark, sf), "euler_almansi").select("id", "strain_yy", "strain_yx", "strain_xx")


@q("rotation_2d", "SELECT id, round(gxy - gyx, 6) AS curl, round(degrees(atan2(gxy - gyx, 2 + gyy + gxx)), 6) AS rotation FROM grd", EMB, GRD)
def _(spark, sf):
    return N.rotation(grads(spark, sf)).select("id", "curl", "rotation")


@q("volume_change", "SELECT id, round((1 + gyy) * (1 + gxx) - gyx * gxy, 6) AS jacobian, round((1 + gyy) * (1 + gxx) - gyx * gxy - 1, 6) AS dilatation, round(gyy + gxx, 6) AS divergence FROM grd", EMB, GRD)
def _(spark, sf):
    return N.volume_change(grads(spark, sf)).select("id", "jacobian", "dilatation", "divergence")


LAME = "(SELECT 1000 / (2 * 1.3) AS mu, 1000 * 0.3 / (1.3 * 0.4) AS lam)"
#: From the tensor in space, s with a free or a held third axis: the invariants that every model reports.
STRESS = """SELECT id, round(zz, 3) AS stress_zz, round(yy, 3) AS stress_yy, round(yx, 3) AS stress_yx, round(xx, 3) AS stress_xx, round(-(yy + xx + zz) / 3, 3) AS pressure,
round(sqrt(((yy - xx) ** 2 + (xx - zz) ** 2 + (zz - yy) ** 2) / 2 + 3 * yx * yx), 3) AS von_mises, round(greatest(p1, zz), 3) AS stress_p1, round(least(p2, zz), 3) AS stress_p3, round(p1 + p2 + zz - greatest(p1, zz) - least(p2, zz), 3) AS stress_p2,
round((greatest(p1, zz) - least(p2, zz)) / 2, 3) AS max_shear, round(energy, 3) AS energy
FROM (SELECT *, (yy + xx) / 2 + sqrt(((yy - xx) / 2) ** 2 + yx * yx) AS p1, (yy + xx) / 2 - sqrt(((yy - xx) / 2) ** 2 + yx * yx) AS p2 FROM ({})) q"""
LINEAR = "SELECT id, 2 * mu * gyy + l * (gyy + gxx) AS yy, 2 * mu * gxx + l * (gyy + gxx) AS xx, mu * (gyx + gxy) AS yx, {zz} AS zz, ((2 * mu * gyy + l * (gyy + gxx)) * gyy + (2 * mu * gxx + l * (gyy + gxx)) * gxx + mu * (gyx + gxy) ** 2) / 2 AS energy FROM grd, (SELECT mu, lam, {l} AS l FROM " + LAME + ")"
#: Left Cauchy-Green tensor b and determinant of I + G in a plane.
FINITE = "fin AS (SELECT id, (1 + gyy) ** 2 + gyx ** 2 AS byy, gxy ** 2 + (1 + gxx) ** 2 AS bxx, (1 + gyy) * gxy + gyx * (1 + gxx) AS byx, (1 + gyy) * (1 + gxx) - gyx * gxy AS j2, (1 + gyy) ** 2 + gxy ** 2 AS cyy, gyx ** 2 + (1 + gxx) ** 2 AS cxx, (1 + gyy) * gyx + gxy * (1 + gxx) AS cyx, mu, lam FROM grd, " + LAME + ")"
#: Stretch across a free sheet, by halving an interval forty-five times.
SHEET = "sht AS (SELECT *, exp(list_reduce(list_concat([0.0::DOUBLE], list_transform(range(45), lambda k: 16.0 / 2 ** k)), lambda u, w: u + CASE WHEN mu * (exp(2 * u) - 1) + lam * (ln(j2) + u) < 0 THEN w ELSE -w END)) AS s FROM fin)"
HOOKEAN = "SELECT id, (mu * (byy - 1) + lam * ln(j)) / j AS yy, (mu * (bxx - 1) + lam * ln(j)) / j AS xx, mu * byx / j AS yx, (mu * (s * s - 1) + lam * ln(j)) / j AS zz, mu / 2 * (byy + bxx + s * s - 3) - mu * ln(j) + lam / 2 * ln(j) ** 2 AS energy FROM (SELECT *, j2 * s AS j FROM {})"
#: Second Piola-Kirchhoff stress pushed forward: F S F' = lam tr(E) b + mu (b b - b) in the plane.
KIRCHHOFF = "SELECT id, (lam * te * byy + mu * (byy ** 2 + byx ** 2 - byy)) / j AS yy, (lam * te * bxx + mu * (bxx ** 2 + byx ** 2 - bxx)) / j AS xx, (lam * te * byx + mu * (byx * (byy + bxx) - byx)) / j AS yx, s * s * (lam * te + mu * (s * s - 1)) / j AS zz, lam / 2 * te ** 2 + mu * (((cyy - 1) / 2) ** 2 + ((cxx - 1) / 2) ** 2 + cyx ** 2 / 2 + ((s * s - 1) / 2) ** 2) AS energy FROM (SELECT *, j2 * s AS j, (cyy + cxx + s * s - 3) / 2 AS te FROM (SELECT *, {} AS s FROM fin))"

for _model, _plane, _sql, _ctes in (
    ("linear_elastic", "strain", LINEAR.format(l="lam", zz="lam * (gyy + gxx)"), ()),
    ("linear_elastic", "stress", LINEAR.format(l="2 * lam * mu / (lam + 2 * mu)", zz="0.0"), ()),
    ("neo_hookean", "strain", HOOKEAN.format("(SELECT *, 1.0 AS s FROM fin)"), (FINITE,)),
    ("neo_hookean", "stress", HOOKEAN.format("sht"), (FINITE, SHEET)),
    ("saint_venant_kirchhoff", "strain", KIRCHHOFF.format("1.0"), (FINITE,)),
    ("saint_venant_kirchhoff", "stress", KIRCHHOFF.format("sqrt(1 - lam / (lam + 2 * mu) * (cyy + cxx - 2))"), (FINITE,)),
):
    q(f"stress_{_model}_{_plane}", STRESS.format(_sql), EMB, GRD, *_ctes, digits=3)(lambda spark, sf, m=_model, p=_plane: N.stress(grads(spark, sf), m, poisson=0.3, plane=p).drop("grad_yy", "grad_yx", "grad_xy", "grad_xx"))


@q("lattice_gradient", "SELECT m, gy, gx, round(CASE WHEN gy = 0 THEN lead(u) OVER wy - u WHEN gy = 7 THEN u - lag(u) OVER wy ELSE (lead(u) OVER wy - lag(u) OVER wy) / 2 END, 6) AS grad_uy, round(CASE WHEN gx = 0 THEN lead(u) OVER wx - u WHEN gx = 7 THEN u - lag(u) OVER wx ELSE (lead(u) OVER wx - lag(u) OVER wx) / 2 END, 6) AS grad_ux FROM pv WINDOW wy AS (PARTITION BY m, gx ORDER BY gy), wx AS (PARTITION BY m, gy ORDER BY gx)", VOX, PIV)
def _(spark, sf):
    return N.lattice_gradient(pivs(spark, sf), ["u"], ["m"]).select("m", "gy", "gx", "grad_uy", "grad_ux")


@q("track_field", "SELECT id, round(y - first_value(y) OVER w, 6) AS disp_y FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM trk WHERE track_id > 0) WHERE n >= 3 WINDOW w AS (PARTITION BY track_id ORDER BY t)", PTS, TRK)
def _(spark, sf):
    return W.track_displacement(tracks(spark, sf), min_length=3).select("id", "disp_y")


# --- figures ----------------------------------------------------------------------------------------


@q("xy_mean_ci95", "SELECT grp, area AS x, round(avg(mean_intensity), 9) AS mean, count(*) AS n FROM lab GROUP BY grp, area", LAB, digits=9)
def _(spark, sf):
    return G.xy(labels(spark, sf), "area", "mean_intensity", ["grp"], "ci95").select("grp", "x", "mean", "n")


@q("xy_sem", "SELECT grp, t AS x, round(avg(area), 6) AS mean, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(area) / sqrt(count(*)) END, 6) AS error FROM lab GROUP BY grp, t", LAB)
def _(spark, sf):
    return G.xy(labels(spark, sf), "t", "area", ["grp"]).select("grp", "x", "mean", "n", "error")


@q("linear_fit", "SELECT grp, round(regr_slope(mean_intensity, area), 4) AS slope, round(regr_intercept(mean_intensity, area), 4) AS intercept, round(regr_r2(mean_intensity, area), 6) AS r2, count(*) AS n FROM lab GROUP BY grp", LAB)
def _(spark, sf):
    return G.linear_fit(labels(spark, sf), "area", "mean_intensity", ["grp"]).select("grp", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "r2", "n")


@q("exponential_fit", "SELECT grp, round(regr_slope(ln(mean_intensity), area), 6) AS rate, count(*) AS n, round(exp(regr_intercept(ln(mean_intensity), area)), 4) AS amplitude FROM lab WHERE mean_intensity > 0 GROUP BY grp", LAB)
def _(spark, sf):
    return G.exponential_fit(labels(spark, sf), "area", "mean_intensity", ["grp"]).select("grp", "rate", "n", F.round("amplitude", 4).alias("amplitude"))


HIST = "e AS (SELECT min(value) AS lo, max(value) AS hi FROM pts), b AS (SELECT condition, least(floor((value - lo) / ((hi - lo) / 30)), 29)::INT AS bin, lo, (hi - lo) / 30 AS w FROM pts, e)"


@q("histogram_density", "SELECT condition, bin, round(any_value(lo) + bin * any_value(w), 6) AS \"left\", round(any_value(lo) + (bin + 1) * any_value(w), 6) AS \"right\", round(count(*) / (sum(count(*)) OVER (PARTITION BY condition) * any_value(w)), 6) AS value FROM b GROUP BY condition, bin", PTS, HIST)
def _(spark, sf):
    return G.histogram(points(spark, sf), "value", ["condition"], 30, "density")


@q("ecdf", "SELECT condition, x, round(sum(n) OVER (PARTITION BY condition ORDER BY x) / sum(n) OVER (PARTITION BY condition), 6) AS share FROM (SELECT condition, value AS x, count(*) AS n FROM pts GROUP BY ALL)", PTS)
def _(spark, sf):
    return G.ecdf(points(spark, sf), "value", ["condition"])


@q("box_stats", "SELECT p.condition, q1, median, q3, n, min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (WHERE value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM pts p JOIN (SELECT condition, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, count(*) AS n FROM pts GROUP BY 1) q USING (condition) GROUP BY ALL", PTS)
def _(spark, sf):
    return G.box(points(spark, sf), "value", ["condition"])


@q("heatmap", "SELECT t AS row, condition AS \"column\", round(coalesce(stddev_samp(value), 0), 6) AS value, count(*) AS n FROM pts GROUP BY t, condition", PTS)
def _(spark, sf):
    return G.heatmap(points(spark, sf), "t", "condition", "value", "std")


@q("heatmap_pivot", "SELECT m AS row, round(avg(mean_intensity) FILTER (WHERE grp = 'A'), 4) AS \"A\", round(avg(mean_intensity) FILTER (WHERE grp = 'N'), 4) AS \"N\", round(avg(mean_intensity) FILTER (WHERE grp = 'R'), 4) AS \"R\" FROM lab GROUP BY m", LAB, digits=4)
def _(spark, sf):
    return G.heatmap_pivot(labels(spark, sf), "m", "grp", "mean_intensity", ["A", "N", "R"])


@q("superplot", "SELECT condition, m, round(v, 6) AS replicate_mean, round(avg(v) OVER w, 6) AS mean, count(*) OVER w AS replicates, round(coalesce(stddev_samp(v) OVER w / sqrt(count(*) OVER w), 0), 6) AS sem FROM (SELECT condition, m, avg(value) AS v FROM pts GROUP BY ALL) WINDOW w AS (PARTITION BY condition)", PTS)
def _(spark, sf):
    return G.superplot_series(points(spark, sf), "condition", "m", "value")


@q("rose", "SELECT floor(((y * 10) % 360 + 360) % 360 / 30)::INT AS sector, round(sum(abs(v)), 6) AS weight FROM emb GROUP BY 1", EMB)
def _(spark, sf):
    return G.rose_series(vectors(spark, sf).select((F.col("y") * 10).alias("a"), F.abs("v").alias("w")), "a", 12, "w")


@q("normalize_series", "SELECT condition, t, round(v / max(v) OVER (PARTITION BY condition), 6) AS v FROM (SELECT condition, t, sum(value) AS v FROM pts GROUP BY ALL)", PTS)
def _(spark, sf):
    d = points(spark, sf).groupBy("condition", "t").agg(F.sum("value").alias("v"))
    return G.normalize_series(d, "v", "t", ["condition"])


@q("kaplan_meier", "SELECT condition, time, events, at_risk, round(CASE WHEN min(at_risk - events) OVER w = 0 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk::DOUBLE) END) OVER w) END, 6) AS survival FROM (SELECT condition, time, events, sum(n) OVER (PARTITION BY condition ORDER BY time DESC)::BIGINT AS at_risk FROM (SELECT condition, round(value) AS time, count(*) AS n, count(*) FILTER (WHERE id % 4 <> 0) AS events FROM pts GROUP BY ALL)) WHERE events > 0 WINDOW w AS (PARTITION BY condition ORDER BY time)", PTS)
def _(spark, sf):
    d = points(spark, sf).withColumn("life", F.round("value")).withColumn("hit", F.col("id") % 4 != 0)
    return G.survival(d, "life", "hit", ["condition"]).select("condition", "time", "events", "at_risk", "survival")


@q("msd_lag", "SELECT (b.t - a.t)::INT AS lag, round(avg((b.y - a.y) ** 2 + (b.x - a.x) ** 2), 6) AS msd, count(*) AS n FROM trk a JOIN trk b ON a.track_id = b.track_id AND b.t - a.t BETWEEN 1 AND 6 WHERE a.track_id > 0 GROUP BY 1", PTS, TRK)
def _(spark, sf):
    return G.msd(tracks(spark, sf), 6)


@q("pearson", "SELECT grp, round(corr(area, mean_intensity), 6) AS r, count(*) AS n FROM lab GROUP BY grp", LAB)
def _(spark, sf):
    return G.correlation(labels(spark, sf), "area", "mean_intensity", group_by=["grp"])


@q("spearman", "SELECT grp, round(corr(ra, rb), 6) AS r, count(*) AS n FROM (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY area) + (count(*) OVER (PARTITION BY grp, area) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY grp ORDER BY mean_intensity) + (count(*) OVER (PARTITION BY grp, mean_intensity) - 1) / 2.0 AS rb FROM lab) GROUP BY grp", LAB)
def _(spark, sf):
    return G.correlation(labels(spark, sf), "area", "mean_intensity", "spearman", ["grp"])


WEL = "s AS (SELECT condition AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM pts GROUP BY 1)"


@q("welch_t", "SELECT a.g AS a, b.g AS b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS statistic FROM s a JOIN s b ON a.g < b.g", PTS, WEL)
def _(spark, sf):
    rows = G.compare(points(spark, sf), "value", "condition", "welch")
    return spark.createDataFrame([(r["a"], r["b"], float(r["statistic"])) for r in rows], "a string, b string, statistic double")


@q("anova_f", "SELECT round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS statistic FROM s, (SELECT sum(n * m) / sum(n) AS gm FROM s)", PTS, WEL)
def _(spark, sf):
    return spark.createDataFrame([(float(G.compare(points(spark, sf), "value", "condition", "anova")[0]["statistic"]),)], "statistic double")


@q("coded_projection", "SELECT t, y, x, max(value) AS value, arg_min(m, (-value, m)) AS z FROM (SELECT label AS t, m, y, x, round(value, 6) AS value FROM vox) GROUP BY ALL", VOX)
def _(spark, sf):
    v = voxels(spark, sf).select(F.col("label").cast("int").alias("t"), F.col("m").alias("z"), "y", "x", F.round("value", 6).alias("value"))
    return G.coded_projection(v)


@q("reslice", "SELECT m, x, value FROM vox WHERE y = 3", VOX)
def _(spark, sf):
    return G.reslice(voxels(spark, sf).select("m", "y", "x", "value"), "y", 3)


@q("profile_line", "SELECT y, x, m, value, y::INT AS place FROM vox WHERE x = y", VOX)
def _(spark, sf):
    return G.profile(voxels(spark, sf).select("m", "y", "x", "value"), 0, 0, 7, 7, 8).select("y", "x", "m", "value", "place")


@q("coloc", "SELECT round(corr(a.value, b.value), 6) AS pearson, round(sum(a.value) FILTER (WHERE b.value > 0.1) / sum(a.value), 6) AS m1, round(sum(b.value) FILTER (WHERE a.value > 0.05) / sum(b.value), 6) AS m2 FROM (SELECT m, y, x, abs(value) AS value FROM vox) a JOIN (SELECT m - 1 AS m, y, x, abs(value) AS value FROM vox) b USING (m, y, x)", VOX)
def _(spark, sf):
    v = voxels(spark, sf).select("m", "y", "x", F.abs("value").alias("value"))
    return G.coloc(v, v.withColumn("m", F.col("m") - 1), 0.05, 0.1)


@q("field_limits", "SELECT m, round(quantile_cont(value, 0.02), 6) AS low, round(quantile_cont(value, 0.98), 6) AS high FROM vox GROUP BY m", VOX)
def _(spark, sf):
    return G.field_limits(voxels(spark, sf), "value", keys=["m"])


# --- fits -------------------------------------------------------------------------------------------


@q("standard_points", "SELECT CASE WHEN p_size > 5 THEN p_size - 5 ELSE 0 END::DOUBLE AS x, round(sum(p_retailprice * p_size) / sum(p_size), 4) AS y, round(stddev_samp(p_retailprice), 4) AS sd, count(*) AS n FROM part GROUP BY 1", digits=4)
def _(spark, sf):
    p = read(spark, sf, "part").select((F.col("p_size") - 5).alias("x"), F.col("p_retailprice").alias("y"), F.col("p_size").alias("w"))
    return X.standard_points(p, "x", "y", "w")


@q("standard_curve_typed", "SELECT id, round(CASE WHEN area < 60 AND area >= 0 THEN 12 * area / (60 - area) ELSE 'nan'::DOUBLE END, 6) AS concentration FROM lab", LAB)
def _(spark, sf):
    return X.standard_curve(labels(spark, sf), "area", typed={"bmax": 60.0, "kd": 12.0}).select("id", "concentration")


@q("standard_curve_fit")
def _(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return X.standard_curve(labels(spark, sf).withColumn("s", F.col("area") * 40), "s", p, model="linear", draws=50).select("id", "concentration", "concentration_flag", "concentration_sd")


@q("point_source_fit")
def _(spark, sf):
    d = vectors(spark, sf).select("m", (F.abs("y") + 1).alias("distance_um"), (F.abs("x") * 100 + 60).alias("t"), F.exp("v").alias("c"))
    return X.point_source_fit(d, "c", group=["m"], bootstrap=20)


@q("idw_map", "SELECT gy, gx, gy * 5.0::DOUBLE AS y, gx * 5.0::DOUBLE AS x, round(exp(CASE WHEN min(d) < 1e-9 THEN arg_min(lv, d) ELSE sum(lv / (d * d)) / sum(1 / (d * d)) END), 5) AS value, count(*) AS n FROM (SELECT g.gy, g.gx, greatest(sqrt((g.gy * 5 - e.y) ** 2 + (g.gx * 5 - e.x) ** 2), 1e-9) AS d, e.v AS lv FROM (SELECT a.range AS gy, b.range AS gx FROM range(-20, 21) a, range(-20, 21) b) g JOIN emb e ON (g.gy * 5 - e.y) ** 2 + (g.gx * 5 - e.x) ** 2 <= 36 WHERE gy BETWEEN (SELECT floor(min(y) / 5) FROM emb) AND (SELECT ceil(max(y) / 5) FROM emb) AND gx BETWEEN (SELECT floor(min(x) / 5) FROM emb) AND (SELECT ceil(max(x) / 5) FROM emb)) GROUP BY gy, gx", EMB, digits=5)
def _(spark, sf):
    return X.idw_map(vectors(spark, sf).select("y", "x", F.exp("v").alias("c")), "c", 5.0, 6.0, keys=[])


@q("cluster_points")
def _(spark, sf):
    return X.cluster_points(vectors(spark, sf).select("id", "m", "y", "x"), 3, method="kmeans")


# --- image kernels ----------------------------------------------------------------------------------


def plane(spark, sf):
    return voxels(spark, sf).select("m", "y", "x", "value")


CROSS = "SELECT a.m, a.y, a.x, {} AS value FROM vox a JOIN vox b ON a.m = b.m AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.m, a.y, a.x"


@q("morphology_dilate", CROSS.format("round(max(b.value), 6)"), VOX)
def _(spark, sf):
    return I.enhance(plane(spark, sf), "enhance.morphology", radius=1, op="dilate")


@q("morphology_erode", CROSS.format("round(min(b.value), 6)"), VOX)
def _(spark, sf):
    return I.enhance(plane(spark, sf), "enhance.morphology", radius=1)


@q("morphological_gradient", CROSS.format("round(max(b.value) - min(b.value), 6)"), VOX)
def _(spark, sf):
    return I.enhance(plane(spark, sf), "enhance.morphological_gradient", radius=1)


@q("threshold_fixed", "SELECT m, y, x, CASE WHEN value > 0.1 THEN 1 ELSE 0 END::DOUBLE AS value FROM vox", VOX)
def _(spark, sf):
    return I.threshold(plane(spark, sf), "fixed", level=0.1)


@q("threshold_mean", "SELECT m, y, x, CASE WHEN value > avg(value) OVER (PARTITION BY m) THEN 1 ELSE 0 END::DOUBLE AS value FROM vox", VOX)
def _(spark, sf):
    return I.threshold(plane(spark, sf), "mean", "series")


@q("histogram_threshold", "SELECT v.m, y, x, CASE WHEN value > lo THEN 1 ELSE 0 END::DOUBLE AS value FROM vox v JOIN (SELECT m, quantile_cont(value, 0.9) AS lo FROM vox GROUP BY m) p ON v.m = p.m", VOX)
def _(spark, sf):
    return I.histogram_threshold(plane(spark, sf), "percentile", "above", 90, 100, "series")


@q("segment_watershed")
def _(spark, sf):
    return I.segment(plane(spark, sf), "watershed", min_distance=1)


@q("spots")
def _(spark, sf):
    return I.spots(plane(spark, sf), 1.0, 2.0, 0.1)


@q("particles")
def _(spark, sf):
    return I.particles(plane(spark, sf), 2.0, 0.05)


@q("drift")
def _(spark, sf):
    return I.drift(stack(spark, sf))


@q("piv")
def _(spark, sf):
    return I.piv(stack(spark, sf), 8, 1)


@q("optical_flow")
def _(spark, sf):
    return I.optical_flow(stack(spark, sf), "ilk", 3, 2)


@q("tessellate")
def _(spark, sf):
    return I.tessellate(vectors(spark, sf).withColumn("cluster", F.col("m")).withColumn("t", F.lit(0)))


@q("rasterize_mesh", "SELECT y.range AS y, x.range AS x, 0::BIGINT AS m, 1::BIGINT AS label_id FROM range(20) y, range(20) x WHERE y.range >= 3 AND y.range < 12 AND x.range >= 4 AND x.range < 15")
def _(spark, sf):
    corners = [(3.0, 3.5), (3.0, 14.5), (12.0, 14.5), (12.0, 3.5)]
    v = spark.createDataFrame([(0, 1, i, y, x) for i, (y, x) in enumerate(corners)], "m long, cluster long, corner long, y double, x double")
    g = spark.range(20).select(F.col("id").alias("y")).crossJoin(spark.range(20).select(F.col("id").alias("x"))).withColumn("m", F.lit(0).cast("long"))
    return I.rasterize_mesh(v, g)


# --- compositions -----------------------------------------------------------------------------------


@q("rasterize_nearest", "SELECT v.y, v.x, round(coalesce(arg_min(e.v, (round((v.y - e.y) ** 2 + (v.x - e.x) ** 2, 9), e.id)), 'nan'::DOUBLE), 6) AS v FROM (SELECT a.range - 20 AS y, b.range - 20 AS x FROM range(40) a, range(40) b) v LEFT JOIN emb e ON (v.y - e.y) ** 2 + (v.x - e.x) ** 2 <= 9 GROUP BY v.y, v.x", EMB)
def _(spark, sf):
    g = spark.range(40).select((F.col("id") - 20).alias("y")).crossJoin(spark.range(40).select((F.col("id") - 20).alias("x")))
    return C.rasterize_nearest(vectors(spark, sf).select("id", "y", "x", "v"), g, "v", 3.0)


@q("align_to")
def _(spark, sf):
    s = stack(spark, sf)
    return C.align_to(s, s, highpass=0.0)


@q("langmuir_fit")
def _(spark, sf):
    return C.xy(labels(spark, sf), "area", "mean_intensity", ["grp"], fit="langmuir")


@q("field_strain_fd", "SELECT m, gy, gx, round(CASE WHEN gy = 0 THEN lead(u) OVER wy - u WHEN gy = 7 THEN u - lag(u) OVER wy ELSE (lead(u) OVER wy - lag(u) OVER wy) / 2 END, 6) AS strain_yy FROM pv WINDOW wy AS (PARTITION BY m, gx ORDER BY gy)", VOX, PIV)
def _(spark, sf):
    d = pivs(spark, sf).withColumnRenamed("u", "disp_y").withColumnRenamed("v", "disp_x")
    return C.field_strain(d, "fd", keys=["m"]).select("m", "gy", "gx", "strain_yy")


# --- sources and streams ----------------------------------------------------------------------------


@q("long_form", "SELECT 'label' AS domain, 'lines' AS layer, id, m, area, NULL::VARCHAR AS condition FROM lab UNION ALL SELECT 'point', 'events', id, m, NULL, condition FROM pts", LAB, PTS)
def _(spark, sf):
    return IO.long_form({("label", "lines"): labels(spark, sf).select("id", "m", "area"), ("point", "events"): points(spark, sf).select("id", "m", "condition")})


@q("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2, 3")
def _(spark, sf):
    return Z.windowed(read(spark, sf, "events")).withColumn("total", F.round("total", 4))


@q("event_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def _(spark, sf):
    return Z.sessions(read(spark, sf, "events"))


@q("simulation_zone", "SELECT m, t, round(sum(v) OVER (PARTITION BY m ORDER BY t), 4) AS total FROM (SELECT m, t, sum(value) AS v FROM pts GROUP BY m, t)", PTS, digits=4)
def _(spark, sf):
    import pandas as pd

    def step(f: pd.DataFrame, state: dict) -> pd.DataFrame:
        state["total"] = state.get("total", 0.0) + float(f["v"].sum())
        return pd.DataFrame({"m": f["m"].iloc[:1], "t": f["t"].iloc[:1], "total": [state["total"]]})

    d = points(spark, sf).groupBy("m", "t").agg(F.sum("value").alias("v"))
    return Z.simulate(d, step, "m long, t long, total double")
