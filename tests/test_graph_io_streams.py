import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.core import AxisSizes, Dataset, Refusal
from quadrille.operators import image as I
from quadrille.operators import spatial as S
from quadrille.operators import tensor as N
from quadrille.operators import transfer as D
from quadrille.plans import graph as P
from quadrille.plans.registry import OPERATORS, hook
from quadrille.sources import io as IO
from quadrille.streaming import zones as Z


PLANE = [(0, t, y, x, float((3 * y + x * x + t) % 5)) for t in range(2) for y in range(16) for x in range(16)]


def test_modes_that_are_not_covered_refuse_by_name(spark):
    plane = spark.createDataFrame(PLANE, "m long, t long, y long, x long, value double")
    with pytest.raises(Refusal, match="euclidean"):
        OPERATORS["registration.stabilize"](plane, model="euclidean")
    assert OPERATORS["registration.stabilize"](plane)["image"].count() == len(PLANE)


@pytest.mark.parametrize(("key", "modes"), [("analysis.optical_flow", ({}, {"method": "tvl1"}, {"method": "ilk"})), ("transform.rasterize_field", ({}, {"method": "linear"}, {"method": "nearest", "reach": 2.0}))])
def test_modes_run_and_others_are_refused(spark, key, modes):
    plane = spark.createDataFrame(PLANE, "m long, t long, y long, x long, value double")
    points = plane.where("y = 3 and x = 3").select("m", "t", F.lit(1).cast("long").alias("id"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("value").alias("v"))
    tables, more = ((points, plane.select("m", "t", "y", "x")), {"value": "v"}) if "rasterize" in key else ((plane,), {})
    for asked in modes:
        assert OPERATORS[key](*tables, **asked, **more).count() > 0
    with pytest.raises(Refusal, match="other"):
        OPERATORS[key](*tables, method="other", **more)


def test_accumulate_field_takes_every_position(spark, sf001):
    from quadrille.catalog import QUERIES
    from quadrille.plans.queries import stack

    keys = ["m", "t", "y", "x"]
    got = QUERIES["accumulate_field"](spark, sf001)
    want = stack(spark, sf001).select("m", "t", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    assert got.count() == want.count() > 0 and got.select(keys).exceptAll(want.select(keys)).count() == 0
    assert got.groupBy("m", "t").agg(F.count("id").alias("n"), F.countDistinct("id").alias("k")).where("n <> 64 or k <> 64").count() == 0


def test_graph_pulls_only_what_changed(spark):
    d = spark.createDataFrame([(i, i % 3, float(i)) for i in range(12)], "id long, t long, v double")
    ops = OPERATORS | {"src": lambda: d}
    g = P.Graph().add("a", "src").add("f", "util.time_shift", "a", delta=0, n=3)
    g = P.Graph().add("a", "src").add("agg", "table.aggregate", "a", group_by="t", value="v", reducers="mean").add("r", "rr.reroute", "agg").add("s", "analysis.reduce_scalar", "r", source="v_mean", reducer="max")
    e = P.Engine(P.Graph.from_json(g.to_json()), ops)
    assert e.pull("s").first()[0] == 6.5 and e.built == 3
    e.pull("s")
    assert e.built == 3
    e.graph.nodes["s"]["params"]["reducer"] = "min"
    assert e.pull("s").first()[0] == 4.5 and e.built == 4


def test_groups_circles_and_sockets(spark):
    inner = {"nodes": [{"id": "i", "op_key": "group.input"}, {"id": "d", "op_key": "twice"}, {"id": "o", "op_key": "group.output"}], "edges": [{"src": "i", "dst": "d"}, {"src": "d", "dst": "o"}]}
    g = P.Graph([{"id": "a", "op_key": "one"}, {"id": "g", "op_key": "group.instance", "params": {"graph": inner}}, {"id": "z", "op_key": "twice"}], [{"src": "a", "dst": "g"}, {"src": "g", "dst": "z"}])
    assert P.Engine(g, {"one": lambda: 1, "twice": lambda x: 2 * x}).pull("z") == 4
    with pytest.raises(Refusal):
        P.Graph([{"id": "a", "op_key": "x"}, {"id": "b", "op_key": "x"}], [{"src": "a", "dst": "b"}, {"src": "b", "dst": "a"}]).order("a")
    with pytest.raises(Refusal):
        P.Graph([{"id": n, "op_key": "x"} for n in "abc"], [{"src": "a", "dst": "c"}, {"src": "b", "dst": "c"}]).order("c")
    with pytest.raises(Refusal):
        OPERATORS["analysis.dvc_field"](None)
    hook("analysis.dvc_field", lambda df: df)
    with pytest.raises(Refusal):
        hook("table.join", lambda df: df)


def test_iteration():
    assert P.sweep(lambda a, b: a * b, metric=float, a=[1, 2], b=[3, 5]) == ({"a": 2, "b": 5}, 10)
    assert P.repeat(lambda v, i: v + i, 0, 4) == 6
    tried = []
    for _ in range(30):
        x = P.advance(tried, 0.0, 4.0)
        tried.append((x, (x - 1.3) ** 2))
    assert abs(min(tried, key=lambda p: p[1])[0] - 1.3) < 1e-2
    root = []
    for _ in range(12):
        x = P.advance(root, 0.0, 4.0, "secant", 2.0)
        root.append((x, x * x))
    assert abs(root[-1][0] - math.sqrt(2)) < 1e-6


def test_tables_and_trials(spark, tmp_path):
    pts = spark.createDataFrame([(1, 0, 0.5), (2, 1, 1.5)], "id long, m long, v double")
    data = Dataset().put("point", "spots", pts).put("label", "cells", pts.withColumnRenamed("v", "area"))
    IO.write_table(data, str(tmp_path / "long"), "parquet")
    assert spark.read.parquet(str(tmp_path / "long")).count() == 4
    with pytest.raises(Exception):
        IO.write_table(data, str(tmp_path / "long"), "parquet", existing="refuse")
    IO.write_trial(data, str(tmp_path / "trial"))
    back = IO.load_analysis(spark, str(tmp_path / "trial"))
    assert back.layer("point", "spots").count() == 2 and set(back.layer("label").columns) == {"id", "m", "area"}
    IO.write_table(data, str(tmp_path / "csv"), "csv", "per_table")
    assert IO.load(spark, str(tmp_path / "csv/point/spots"), "csv").count() == 2
    assert IO.dock(data, str(tmp_path / "dock")).layer("label").count() == 2


def test_files_of_a_trial_go_with_its_rows_not_its_units(spark, tmp_path):
    d = spark.range(300, numPartitions=3).select("id", F.when(F.col("id") != 7, F.format_string("%03d", "id")).alias("m"))
    IO.write_trial(Dataset().put("label", "cells", d), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 8
    back = IO.load_analysis(spark, str(tmp_path / "t")).layer("label", "cells")
    assert sorted(map(tuple, back.select("id", "m").collect())) == [(i, None if i == 7 else f"{i:03d}") for i in range(300)]


def test_images(spark, tmp_path):
    planes = [np.arange(12, dtype=np.uint16).reshape(3, 4) + i for i in range(3)]
    for c in (False, True):
        assert all((a == b).all() for a, b in zip(IO.read_tiff(IO.tiff_bytes(planes, "x", c)), planes))
    data = IO.synthetic(spark, AxisSizes(t=2, y=24, x=20), 3)
    v = data.layer("voxel").select("m", "t", "y", "x", "value")
    (row,) = IO.write_tiff(v, "unused").collect()
    back = IO.read_tiff(bytes(row.content))
    assert len(back) == 2 and back[0].shape == (24, 20)
    assert IO.write_html(v, str(tmp_path / "p.html"), "A & B") > 500 and IO.write_movie(v, str(tmp_path / "mov")) == 2
    IO.write_figure(v.groupBy("t").agg(F.avg("value").alias("v")), str(tmp_path / "f.svg"), "t", "v")
    with pytest.raises(Refusal):
        IO.write_movie(v, str(tmp_path / "m.mp4"))


def test_pipeline_on_moving_cells(spark):
    data = IO.synthetic(spark, AxisSizes(t=3, y=48, x=48), 4, seed=3)
    v = data.layer("voxel").select("m", "t", "c", "y", "x", "value")
    lab = I.segment(v, min_area=5)
    table = D.measure(lab, v)
    assert table.where("mean_intensity > 200").count() == table.count() > 3
    pts = D.label_to_points(lab, unit=("m", "t", "c")).withColumnRenamed("label", "id")
    tracks = S.link_points(pts, 4.0)
    assert tracks.groupBy("track_id").count().agg(F.max("count")).first()[0] == 3


def test_known_gradients(spark):
    d = spark.createDataFrame([(i * 5 + j, 0, i, j, 0.1 * i + 0.02 * j, -0.03 * i + 0.05 * j) for i in range(5) for j in range(5)], "id long, m long, gy long, gx long, disp_y double, disp_x double")
    g = N.lattice_gradient(d, keys=["m"])
    r = N.strain(N.rotation(N.volume_change(g))).where("gy = 2 and gx = 2").first()
    assert np.allclose([r.grad_yy, r.grad_yx, r.grad_xy, r.grad_xx], [0.1, 0.02, -0.03, 0.05])
    e = np.array([[0.1, -0.005], [-0.005, 0.05]])
    assert np.allclose([r.principal_1, r.principal_2], np.linalg.eigvalsh(e)[::-1]) and math.isclose(r.jacobian, 1.1 * 1.05 + 0.0006)
    f = np.eye(2) + [[0.1, 0.02], [-0.03, 0.05]]
    h = N.strain(g, "hencky").where("gy = 2 and gx = 2").first()
    w, q = np.linalg.eigh(f.T @ f)
    want = q @ np.diag(0.5 * np.log(w)) @ q.T
    assert np.allclose([h.strain_yy, h.strain_yx, h.strain_xx], [want[0, 0], want[0, 1], want[1, 1]])
    m = S.within(d.select("id", F.col("gy").alias("y"), F.col("gx").alias("x")), d.select("id", F.col("gy").alias("y"), F.col("gx").alias("x")), 1.0).count()
    assert m == 25 + 2 * 40


def test_grid_eigen_3d(spark):
    a = np.random.default_rng(0).normal(size=(3, 3)) * 0.1
    names = [f"grad_{i}{j}" for i in "zyx" for j in "zyx"]
    d = spark.createDataFrame([tuple(float(v) for v in a.ravel())], ", ".join(f"{n} double" for n in names))
    r = N.strain(d).first()
    assert np.allclose([r.principal_1, r.principal_2, r.principal_3], np.linalg.eigvalsh((a + a.T) / 2)[::-1])


def test_unique_objects_and_registration(spark):
    rows = [(1, 0, 0.0, 0.0), (2, 1, 0.5, 0.0), (3, 2, 1.0, 0.0), (4, 0, 50.0, 50.0), (5, 0, float("nan"), 0.0)]
    d = spark.createDataFrame(rows, "id long, t long, stage_x_um double, stage_y_um double").withColumn("m", F.lit(0))
    got = {r.id: (r.object_uid, r.sighting, r.sightings) for r in S.unique_objects(d, 0.6).collect()}
    assert got[1] == (1, 1, 3) and got[3] == (1, 3, 3) and got[4][1:] == (1, 1) and len({v[0] for v in got.values()}) == 3
    p = np.random.default_rng(1).uniform(0, 200, (25, 2))
    t = 0.02
    moved = p @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]).T + [6.0, -4.0]
    frame = lambda a: spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(a)], "id long, y double, x double")
    out = S.register_positions(frame(p), frame(p), frame(moved), 20.0, 6.0, "rigid").orderBy("id").toPandas()
    assert np.allclose(out[["reg_y", "reg_x"]].to_numpy(), moved, atol=0.05)


def test_streams(spark, sf001, tmp_path):
    events = spark.read.parquet(f"{sf001}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = Z.read_events(spark, str(tmp_path / "in"), events.schema)
    q = Z.windowed(stream, late="40 days").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.start, r.event_type): r.n for r in Z.windowed(events).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("win").collect()} == want
    q = Z.running_track(stream).writeStream.format("memory").queryName("run").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("run").groupBy("user_id").agg(F.max("n").alias("n"))
    assert {r.user_id: r.n for r in last.collect()} == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}


def test_json_is_plain():
    assert json.loads(P.Graph().add("a", "io.load", path="x").to_json())["nodes"][0]["params"] == {"path": "x"}


def test_alignment_finds_a_known_shift(spark):
    from test_kernels import scene

    from quadrille.operators import compose as C

    frame = lambda a: spark.createDataFrame([(0, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "m long, y long, x long, value double")
    r = C.align_to(frame(scene(2.0, -1.5, 64)), frame(scene(0, 0, 64)), highpass=0.0).first()
    assert abs(r.shift_y - 2.0) < 0.2 and abs(r.shift_x + 1.5) < 0.2 and r.ncc > 0.9
