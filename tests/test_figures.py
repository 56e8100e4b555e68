import math

import numpy as np

from quadrille.functions import special
from quadrille.operators import figure as G


def test_distribution_tails():
    assert math.isclose(special.t_quantile(0.975, 10), 2.2281388519649385, rel_tol=1e-6)
    assert math.isclose(special.f_tail(3.0, 2, 20), 0.0725, abs_tol=2e-4)
    assert math.isclose(special.chi2_tail(5.991464547, 2), 0.05, rel_tol=1e-6)
    assert math.isclose(special.studentized_range_tail(3.578, 3, 20), 0.05, abs_tol=2e-3)
    assert math.isclose(special.t_two_sided(2.0, 1e6), special.normal_two_sided(2.0), rel_tol=1e-4)


def test_tests(spark):
    rng = np.random.default_rng(0)
    rows = [("a", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 40))] + [("b", i, float(v)) for i, v in enumerate(rng.normal(1.2, 1, 40))]
    d = spark.createDataFrame(rows, "g string, k long, v double")
    for test in ("welch", "student", "mann_whitney", "tukey"):
        (r,) = G.compare(d, "v", "g", test)
        assert r["p"] < 0.01, test
    for test in ("paired", "wilcoxon"):
        assert G.compare(d, "v", "g", test, "k")[0]["p"] < 0.01
    for test in ("kruskal", "anova"):
        assert G.compare(d, "v", "g", test)[0]["p"] < 0.01
    few = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    assert math.isnan(G.compare(few, "v", "g")[0]["p"])
    assert G.stars(0.0005) == "***" and G.stars(0.2) == "ns"
    assert G.bracket_levels([(0, 1), (1, 2), (0, 2)]) == [0, 0, 1]


def test_ci95_and_survival(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "x long, y double")
    got = {r.x: r for r in G.xy(d, "x", "y", error="ci95").collect()}
    assert math.isclose(got[1].error, 12.706204736 * math.sqrt(2) / math.sqrt(2), rel_tol=1e-6) and got[2].error == 0.0
    s = spark.createDataFrame([(1.0, True), (2.0, False), (3.0, True)], "t double, e boolean")
    curve = sorted((r.time, r.at_risk, round(r.survival, 6)) for r in G.survival(s, "t", "e").collect())
    assert curve == [(1.0, 3, 0.666667), (3.0, 1, 0.0)] and G.median_survival(G.survival(s, "t", "e")).first()[0] == 3.0


def test_pooled(spark):
    x = np.arange(10.0)
    parts = [x[:4], x[4:]]
    d = spark.createDataFrame([(1, len(p), float(p.mean()), float(p.std(ddof=1))) for p in parts], "k long, n long, mean double, sd double")
    r = G.pooled(d, ["k"]).first()
    assert math.isclose(r["mean"], x.mean()) and math.isclose(r.sd, x.std(ddof=1))
