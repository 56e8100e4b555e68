"""Queries that SQL can't express, and kernels, against slow versions written from the definition."""

import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.catalog import QUERIES
from quadrille.functions import kernels as K
from quadrille.operators import compose as C
from quadrille.operators import image as I
from quadrille.operators import ordered as O
from quadrille.operators import spatial as S
from quadrille.operators import tensor as N
from quadrille.operators import transfer as D
from quadrille.plans.queries import plane, raster, stack, tracks, vectors


def planes(df, value="value"):
    out = {}
    for r in df.collect():
        out.setdefault(r.m, np.full((8, 8), np.nan))[r.y, r.x] = r[value]
    return out


# --- linking: greedy pairs by distance or overlap, then chains ------------------------------------------


def numbered(chains, key):
    return {x: n for n, c in enumerate(sorted(chains, key=lambda c: min(key(x) for x in c)), 1) for x in c}


def chained(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    out = {}
    for n in nodes:
        out.setdefault(root(n), []).append(n)
    return list(out.values())


def test_link_points(spark, sf001):
    rows = {r.id: r for r in tracks(spark, sf001).collect()}
    times = sorted({r.t for r in rows.values()})
    links = []
    for t0, t1 in zip(times, times[1:]):
        pairs = sorted((math.hypot(a.y - b.y, a.x - b.x), a.id, b.id) for a in rows.values() if a.t == t0 for b in rows.values() if b.t == t1 if math.hypot(a.y - b.y, a.x - b.x) <= 3)
        used = set()
        for _, a, b in pairs:
            if ("a", a) not in used and ("b", b) not in used:
                used |= {("a", a), ("b", b)}
                links.append((a, b))
    want = numbered(chained(rows, links), lambda i: (rows[i].t, i))
    assert {r.member_id: r.track_id for r in QUERIES["link_points"](spark, sf001).collect()} == want


def test_link_labels(spark, sf001):
    px = {}
    for r in stack(spark, sf001).where("value > 0.02").collect():
        px.setdefault(r.m * 100 + r.t * 10 + 1 + r.y // 4, set()).add((r.y, r.x))
    links = []
    for m in range(10):
        for t in range(6):
            over = []
            for a in (0, 1):
                for b in (0, 1):
                    la, lb = m * 100 + t * 10 + 1 + a, m * 100 + (t + 1) * 10 + 1 + b
                    both = len(px.get(la, set()) & px.get(lb, set()))
                    if both:
                        over.append((-both / len(px[la] | px[lb]), la, lb))
            used = set()
            for _, a, b in sorted(over):
                if a not in used and b not in used:
                    used |= {a, b}
                    links.append((a, b))
    want = numbered(chained(px, links), lambda i: (i % 100 // 10, i))
    assert {r.member_id: r.track_id for r in QUERIES["link_labels"](spark, sf001).collect()} == want


# --- each plane by itself, with kernels that have tests of their own -------------------------------------


@pytest.mark.parametrize(
    "name,kernel",
    [("tv_denoise", K.tv_denoise), ("subtract_background", lambda a: K.subtract_background(a, method="polynomial")), ("clahe", lambda a: K.clahe(a, tiles=2)), ("wavelet_denoise", K.wavelet_denoise)],
)
def test_planes_are_filtered_one_by_one(spark, sf001, name, kernel):
    src, got = planes(plane(spark, sf001)), planes(QUERIES[f"enhance_{name}"](spark, sf001))
    assert set(src) == set(got)
    for m, a in src.items():
        assert np.allclose(got[m], kernel(a + 1), atol=1e-6), m


def test_segment_watershed(spark, sf001):
    src, got, first = planes(plane(spark, sf001)), planes(QUERIES["segment_watershed"](spark, sf001), "label_id"), 0
    for m in sorted(src):
        mask = src[m] > K.otsu(src[m])
        lab = got[m].astype(int)
        assert ((lab > 0) == mask).all()
        own = sorted(set(lab[mask]))
        assert own == list(range(first + 1, first + 1 + len(own)))
        for k in own:  # a label is in one piece
            assert len(set(K.label(lab == k, 1)[lab == k])) == 1 or len(set(K.label(lab == k, 2)[lab == k])) == 1
        first += len(own)


def test_spots_and_particles(spark, sf001):
    src = planes(plane(spark, sf001))
    for name, find in (("spots", lambda a: K.spots(a, 1.0, 2.0, 0.1)), ("particles", lambda a: K.particles(a, 2.0, 0.05))):
        want = sorted((m, float(r[0]), float(r[1])) for m, a in src.items() for r in find(a))
        got = sorted((r.m, r.y, r.x) for r in QUERIES[name](spark, sf001).collect())
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-5)


def test_tessellate(spark, sf001):
    rows = {}
    for r in vectors(spark, sf001).collect():
        rows.setdefault(r.m, []).append((r.y, r.x))
    got = {}
    for r in QUERIES["tessellate"](spark, sf001).collect():
        got.setdefault(r.m, set()).add((r.y, r.x))
    for m, p in rows.items():
        cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        corner = set()
        for a in p:  # a corner has a line through it with all others on one side
            for b in p:
                if a != b and all(cross(a, b, c) <= 0 for c in p):
                    corner |= {a, b}
        assert {(round(y, 6), round(x, 6)) for y, x in corner} == got[m]


# --- kernels ------------------------------------------------------------------------------------------


def test_delaunay_circles_are_empty_and_cover_the_hull():
    p = np.random.default_rng(4).uniform(0, 10, (80, 2))
    tri = K.delaunay(p)
    area = 0.0
    for t in tri:
        a, b, c = p[t]
        d = 2 * ((b - a)[0] * (c - a)[1] - (b - a)[1] * (c - a)[0])
        bb, cc = ((b - a) ** 2).sum(), ((c - a) ** 2).sum()
        o = a + np.array([(c - a)[1] * bb - (b - a)[1] * cc, (b - a)[0] * cc - (c - a)[0] * bb]) / d
        assert (((p - o) ** 2).sum(1) >= ((a - o) ** 2).sum() - 1e-9).all()
        area += abs(d) / 4
    h = p[K.convex_hull(p)]
    y, x = h[:, 0], h[:, 1]
    assert math.isclose(area, abs((y * np.roll(x, -1) - x * np.roll(y, -1)).sum()) / 2, rel_tol=1e-6)
    assert not len(K.delaunay(np.array([[0, 0], [1, 1], [2, 2], [0, 0]])))


def test_scatter_linear_reproduces_planes_and_fills_outside():
    r = np.random.default_rng(5)
    p, at = r.uniform(0, 10, (60, 2)), r.uniform(2, 8, (200, 2))
    assert np.allclose(K.scatter_linear(p, 3 + 2 * p[:, 0] - p[:, 1], at), 3 + 2 * at[:, 0] - at[:, 1])
    far = np.array([[50.0, 50.0]])
    near = ((p - far) ** 2).sum(1).argmin()
    assert K.scatter_linear(p, p[:, 0], far)[0] == p[near, 0] and np.isclose(K.scatter_linear(p, p[:, 0], far, "mean")[0], p[:, 0].mean())
    assert np.isnan(K.scatter_linear(np.empty((0, 2)), np.empty(0), far)).all()


def test_orientation_of_an_object_as_wide_as_high(spark):
    px = [(0, 6), (1, 4), (2, 7), (3, 5)]
    for rows in (px, px[::-1], px[2:] + px[:2]):  # in any order and number of partitions
        for parts in (1, 2, 4):
            d = spark.createDataFrame([(1, y, x, 9, 1.0) for y, x in rows], "m long, y long, x long, label_id long, value double").repartition(parts).localCheckpoint()
            assert D.measure(d.drop("value"), d.drop("label_id"), (), True).first().orientation == 0


def test_rasterize_linear_of_many_points(spark):
    u = lambda i: F.rand(i) * 40 - 20
    p = spark.range(100_000).select("id", u(1).alias("y"), u(2).alias("x")).withColumn("v", F.col("y") * 3 - F.col("x"))
    g = spark.range(-19, 20).select(F.col("id").alias("y")).crossJoin(spark.range(-19, 20).select(F.col("id").alias("x")))
    got = C.rasterize_linear(p, g, "v").collect()
    assert len(got) == 39 * 39 and all(abs(r.v - (3 * r.y - r.x)) < 1e-6 for r in got)  # a plane is its own interpolation


def test_rasterize_linear(spark):
    r = np.random.default_rng(6)
    p = spark.createDataFrame([(i, m, float(y), float(x), float(1 + y - 2 * x)) for m in (0, 1) for i, (y, x) in enumerate(r.uniform(-5, 25, (40, 2)))], "id long, m long, y double, x double, v double")
    g = spark.range(3).select(F.col("id").alias("m")).crossJoin(spark.range(5, 12).select(F.col("id").alias("y"))).crossJoin(spark.range(5, 12).select(F.col("id").alias("x")))
    rows = C.rasterize_field(p, g, "v").collect()
    assert len(rows) == 147 and all(math.isnan(x.v) if x.m == 2 else abs(x.v - (1 + x.y - 2 * x.x)) < 1e-6 for x in rows)


def test_haar_is_exact_and_denoising_helps():
    r = np.random.default_rng(7)
    for shape in ((8, 8), (7, 10), (5, 6, 9)):
        a = r.random(shape)
        assert np.allclose(K.unhaar(*K.haar(a), shape), a)
    y, x = np.mgrid[:64, :64]
    clean = ((y // 16 + x // 16) % 2).astype(float)
    noisy = clean + r.normal(0, 0.2, clean.shape)
    assert np.abs(K.wavelet_denoise(noisy) - clean).mean() < 0.6 * np.abs(noisy - clean).mean()
    assert np.allclose(K.wavelet_denoise(np.full((8, 8), 3.0)), 3)


def test_solidity_and_perimeter(spark, sf001):
    square = [(y, x) for y in range(6) for x in range(8)]
    ell = [(y, x) for y in range(6) for x in range(8) if y >= 3 or x < 3]
    d = spark.createDataFrame([(0, y, x, k) for k, own in ((1, square), (2, [(y + 20, x) for y, x in ell])) for y, x in own], "m long, y long, x long, label_id long")
    got = {r.id: r for r in D.measure(d, d.withColumn("value", F.lit(1.0)), (), True).collect()}
    assert got[1].perimeter == 24 and got[1].solidity == 1.0  # the border pixels of a 6 x 8 block
    assert 33 / 48 < got[2].solidity < 1
    px = {}
    for r in raster(spark, sf001)[0].where("label_id > 0").collect():
        px.setdefault(r.label_id, []).append((r.y, r.x))
    for r in QUERIES["measure_solidity"](spark, sf001).limit(60).collect():
        p = np.array([(2 * y + a, 2 * x + b) for y, x in px[r.id] for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
        h = p[K.convex_hull(p.astype(float))]
        inside = 0
        for y in range(8):
            for x in range(8):
                s = [(b[0] - a[0]) * (2 * x - a[1]) - (b[1] - a[1]) * (2 * y - a[0]) for a, b in zip(h, np.roll(h, -1, 0))]
                inside += all(v >= 0 for v in s) or all(v <= 0 for v in s)
        assert abs(r.solidity - len(px[r.id]) / inside) < 1e-6


@functools.lru_cache
def scene(dy, dx, seed=0):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:48, :48]
    return sum(np.exp(-((y - a - dy) ** 2 + (x - b - dx) ** 2) / 6) for a, b in r.uniform(6, 42, (40, 2)))


def test_drift_is_measured_on_the_middle_plane_and_every_plane_moved(spark):
    rows = []
    for t, s in ((0, (0, 0)), (2, (3, -2)), (3, (5, 1))):  # frame 1 is missing
        for z in range(2):
            a = scene(*s) if z == 1 else np.roll(np.eye(48), s, (0, 1))
            rows += [(0, t, z, int(y), int(x), float(a[y, x])) for y in range(48) for x in range(48)]
    d = spark.createDataFrame(rows, "m long, t long, z long, y long, x long, value double")
    out = I.align_drift(d, interp="nearest")
    shifts = {r.t: (r.drift_y, r.drift_x) for r in out["drift"].collect()}
    assert set(shifts) == {0, 2, 3} and np.allclose(shifts[2], (-3, 2), atol=0.25) and np.allclose(shifts[3], (-5, -1), atol=0.25)
    got = {}
    for r in out["image"].where("z = 0").collect():
        got.setdefault(r.t, np.zeros((48, 48)))[r.y, r.x] = r.value
    for t in (2, 3):
        assert np.array_equal(got[t][8:40, 8:40], np.eye(48)[8:40, 8:40])


def test_align_to_moves_the_image(spark):
    rows = [[(m, int(y), int(x), float(scene(*s)[y, x])) for m, s in ((0, a), (1, b)) for y in range(48) for x in range(48)] for a, b in (((0, 0), (0, 0)), ((2, -3), (-1, 4)))]
    schema = "m long, y long, x long, value double"
    fixed, moved = (spark.createDataFrame(r, schema) for r in rows)
    out = C.align_image(moved, fixed, interp="nearest", highpass=0.0)["image"]
    for r in out.collect():
        if 10 <= r.y < 38 and 10 <= r.x < 38:
            assert abs(r.value - scene(0, 0)[r.y, r.x]) < 1e-6


# --- tensors in space ------------------------------------------------------------------------------------


def fields(spark, n=40):
    g = np.random.default_rng(8).normal(0, 0.12, (n, 3, 3))
    names = [f"grad_{i}{j}" for i in "zyx" for j in "zyx"]
    return g, spark.createDataFrame([(k, *map(float, x.ravel())) for k, x in enumerate(g)], "id long, " + ", ".join(f"{c} double" for c in names))


def of(row, prefix):
    return np.array([[row[f"{prefix}_{'zyx'[min(i, j)]}{'zyx'[max(i, j)]}"] for j in range(3)] for i in range(3)])


@pytest.mark.parametrize("measure", ["infinitesimal", "green_lagrange", "euler_almansi", "hencky"])
def test_strain_in_space(spark, measure):
    g, d = fields(spark)
    for r in N.strain(d, measure).collect():
        f = np.eye(3) + g[r.id]
        c = f.T @ f
        w, v = np.linalg.eigh(c)
        inv = np.linalg.inv(f)
        e = {"infinitesimal": (g[r.id] + g[r.id].T) / 2, "green_lagrange": (c - np.eye(3)) / 2, "euler_almansi": (np.eye(3) - inv.T @ inv) / 2, "hencky": v @ np.diag(np.log(w) / 2) @ v.T}[measure]
        assert np.allclose(of(r, "strain"), e, atol=1e-9)


@pytest.mark.parametrize("model", ["linear_elastic", "saint_venant_kirchhoff", "neo_hookean", "newtonian_fluid"])
def test_stress_in_space(spark, model):
    g, d = fields(spark)
    mu, lam = 1000 / 2.6, 1000 * 0.3 / (1.3 * 0.4)
    for r in N.stress(d, model, poisson=0.3, viscosity=2.0).collect():
        f, e = np.eye(3) + g[r.id], (g[r.id] + g[r.id].T) / 2
        j, b = np.linalg.det(f), f @ f.T
        green = (f.T @ f - np.eye(3)) / 2
        s = {
            "linear_elastic": lam * np.trace(e) * np.eye(3) + 2 * mu * e,
            "saint_venant_kirchhoff": f @ (lam * np.trace(green) * np.eye(3) + 2 * mu * green) @ f.T / j,
            "neo_hookean": (mu * (b - np.eye(3)) + lam * np.log(j) * np.eye(3)) / j,
            "newtonian_fluid": 4.0 * (e - np.trace(e) / 3 * np.eye(3)),
        }[model]
        dev = s - np.trace(s) / 3 * np.eye(3)
        assert np.allclose(of(r, "stress"), s) and np.isclose(r.von_mises, math.sqrt(1.5 * (dev * dev).sum())) and np.isclose(r.pressure, -np.trace(s) / 3)
        assert np.allclose([r.stress_p1, r.stress_p2, r.stress_p3], np.linalg.eigvalsh(s)[::-1])
        assert math.isnan(r.energy) == (model == "newtonian_fluid")


# --- order ------------------------------------------------------------------------------------------------


def test_order_without_one_sorting_task(spark):
    r = np.random.default_rng(9)
    values = [*map(float, r.lognormal(0, 6, 300)), *map(float, r.integers(1_700_000_000, 1_700_000_050, 100)), 0.0, -1e9, None]
    d = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(values)], "id long, v double, g long")
    want = [i for i, _ in sorted(enumerate(values), key=lambda x: (x[1] is None, x[1] or 0.0, x[0]))]
    assert [x.id for x in O.numbered(d, ["v", "id"], "n").orderBy("n").collect()] == want
    s = spark.createDataFrame([(f"k{v % 37}", v) for v in range(500)] + [(None, 1000), ("", 1001)], "k string, v long")
    got = [(x.k, x.v) for x in O.numbered(s, ["k", "v"], "n").orderBy("n").collect()]
    assert got == sorted(((x.k, x.v) for x in s.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))
    p = {x.g: (x.a, x.b) for x in O.percentiles(d, ["g"], "v", {"a": 0.1, "b": 0.5}).collect()}
    for g in range(3):
        own = np.array([v for i, v in enumerate(values) if v is not None and i % 3 == g])
        assert np.allclose(p[g], np.percentile(own, [10, 50]))
    plan = O.numbered(d, ["v", "id"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "[_cell#" in plan.split("Window [sum(1)")[1].split("\n")[0]


def test_neighbours_of_sparse_and_crowded_objects(spark):
    r = np.random.default_rng(10)
    p = [*map(tuple, r.normal(0, 0.01, (150, 2))), (1000.0, 0.0), (0.0, 5000.0), (0.0, 0.0), (0.0, 0.0)]
    rows = [(i, 0, float(y), float(x)) for i, (y, x) in enumerate(p)] + [(900, 1, 0.0, 0.0), (901, 1, 3.0, 4.0), (902, 2, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "id long, m long, y double, x double")
    got = {}
    for x in S.knn(d, 4).collect():
        got.setdefault(x.id, []).append((x.rank, x.id_r))
    for i, m, y, x in rows:
        near = sorted((math.hypot(y - b, x - c), j) for j, n, b, c in rows if n == m and j != i)[:4]
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in near], i
