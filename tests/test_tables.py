import math

import pytest
from pyspark.sql import functions as F

from quadrille.core import AxisSizes, Dataset, Refusal, dropped_axes, is_finer, join, meet
from quadrille.functions.units import Unit, UnitError
from quadrille.operators import tables as T

NAN = float("nan")


def test_lattice():
    assert meet("plane", "channel") == () and join("multipoint", "timepoint") == "frame" and join("plane", "channel") is None
    assert is_finer("voxel", "frame") and dropped_axes("frame", "timepoint") == ("m",)


def test_missing_keys_and_values(spark):
    rows = [(1.0, 1.0, "a"), (1.0, NAN, "a"), (NAN, 3.0, "b"), (None, 4.0, "b"), (float("inf"), float("-inf"), "c"), (2.0, NAN, "d")]
    d = spark.createDataFrame(rows, "k double, v double, file string")
    out = T.aggregate(d, "k", "v", "mean,std,sem,sum,count,min").collect()
    assert [r.id for r in out] == [1, 2, 3] and [r.n for r in out] == [2, 1, 3]
    assert out[0].v_mean == 1.0 and math.isnan(out[0].v_std) and math.isnan(out[0].v_sem) and out[0].v_count == 1
    assert math.isnan(out[1].v_mean) and out[1].v_sum == 0.0 and math.isnan(out[1].v_min) and out[1].v_count == 0
    assert math.isnan(out[2].k) and out[2].v_mean == 3.5 and out[2].file == "" and out[1].file == "d"


def test_aggregate_refusals(spark):
    d = spark.createDataFrame([("x", 1)], "v string, t long")
    with pytest.raises(Refusal):
        T.aggregate(d, "t", "v")
    with pytest.raises(Refusal):
        T.aggregate(d, "nope", "t")
    with pytest.raises(ValueError):
        T.aggregate(d, "t", "t", "mode")
    assert T.aggregate(d.where("t > 5"), "", "t").count() == 0


def test_join_rules(spark):
    left = spark.createDataFrame([(1, 1.0), (0, 2.0), (7, NAN)], "track_id long, v double")
    right = spark.createDataFrame([(1, "a", 5), (0, "b", 6)], "track_id long, name string, w int")
    got = {r.track_id: (r.o_name, r.o_w) for r in T.join(left, right, "track", prefix="o_").collect()}
    assert got[1] == ("a", 5.0) and got[0][0] == "" and math.isnan(got[0][1]) and got[7][0] == ""
    with pytest.raises(Refusal):
        T.join(left, right.union(right), "track")
    with pytest.raises(Refusal):
        T.join(left.withColumn("o_w", F.lit(1)), right, "track", prefix="o_")
    nan = spark.createDataFrame([(NAN, 1.0)], "k double, v double")
    assert T.join(nan, nan, "k", "inner").count() == 0


def test_conditions(spark):
    d = spark.createDataFrame([(1, 1.0), (2, NAN), (3, None), (4, float("inf"))], "id long, v double")
    ids = lambda x: sorted(r.id for r in x.collect())
    ok, bad = T.if_else(d, [("v", "!=", 5.0)])
    assert ids(ok) == [1] and ids(bad) == [2, 3, 4]
    assert ids(T.if_else(d, [("v", "is_nan")])[0]) == [2, 3, 4]
    assert ids(T.if_else(d, [("v", ">", 0.5), ("id", "==", 3)], "any")[0]) == [1, 3]


def test_filter_without_spread_and_curation(spark):
    d = spark.createDataFrame([(1, 0, 5.0), (2, 0, 5.0), (3, 1, 1.0), (4, 1, 9.0)], "id long, c long, v double")
    assert [r.id for r in T.filter_labels(d, "v", "otsu").collect()] == [4]
    assert T.parse_merges("5>3,6>5") == {5: 3, 6: 3} and T.parse_ids("1,3-5") == [1, 3, 4, 5]
    for bad in ("1>2,2>1", "x"):
        with pytest.raises(Refusal):
            T.parse_merges(bad)
    with pytest.raises(Refusal):
        T.curate_objects(d, "id", "2", "1>2")


def test_concat(spark):
    a = spark.createDataFrame([(1, 2.0)], "id long, v double")
    b = spark.createDataFrame([(1, "q")], "id long, s string")
    rows = T.concat([a, b], ["x", "2"]).collect()
    assert [r.id for r in rows] == [1, 2] and rows[0].s == "" and math.isnan(rows[1].v) and "condition_value" not in rows[0].asDict()


def test_units(spark):
    assert str(Unit.parse("um").times(Unit.parse("s"), -1)) == "um/s" and Unit.parse("mm2").to(Unit.parse("um2")) == 1e6
    d = spark.createDataFrame([(4.0, 2.0)], "a double, b double")
    with pytest.raises(UnitError):
        T.values(d, "add", "a", "b", a_unit="um", b_unit="s")
    with pytest.raises(UnitError):
        T.values(d, "log10", "a", a_unit="um")
    r = T.values(d, "divide", "a", "b", "q", a_unit="um", b_unit="s")
    assert r.first().q == 2.0 and r.schema["q"].metadata == {"unit": "um/s"}
    assert math.isnan(T.values(d, "divide", "a", 0.0, "q").first().q) and T.values(d, "sqrt", "a", name="q").first().q == 2.0


def test_dataset(spark):
    d = spark.createDataFrame([(1,)], "id long")
    data = Dataset().put("label", "a", d)
    assert data.layer("label") is d
    with pytest.raises(Refusal):
        data.put("label", "b", d).layer("label")
    with pytest.raises(Refusal):
        Dataset(AxisSizes(b=2)).put("label", "a", d)


def test_masks_meet_in_one_shuffle(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (3, 3)], "y long, x long")
    b = spark.createDataFrame([(3, 3), (3, 3), (4, None)], "y long, x long")
    for op, want in (("union", {(1, 1), (None, 2), (3, 3), (4, None)}), ("xor", {(1, 1), (None, 2), (4, None)})):
        d = T.mask_math(a, b, op)
        rows = [tuple(r) for r in d.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
