"""Isotonic steps against the min-max formula, in many ranges, and their application."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.operators import calibration as c


def min_max(p, y):
    """Value at each distinct p: the largest over starts of the smallest mean over ends."""
    xs = np.unique(p)
    w = np.array([(p == x).sum() for x in xs], float)
    s = np.array([y[p == x].sum() for x in xs], float)
    cw, cs = np.r_[0, w.cumsum()], np.r_[0, s.cumsum()]
    mean = lambda j, k: (cs[k + 1] - cs[j]) / (cw[k + 1] - cw[j])
    n = len(xs)
    return {x: max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("kind", ["noisy", "falling", "rising", "ties", "one"])
def test_steps_equal_min_max(spark, kind):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400), 2 if kind == "ties" else 6)
    chance = {"falling": 1 - p, "rising": (p > 0.5) * 1.0}.get(kind, p)
    y = (rng.random(400) < chance).astype(int)
    if kind == "one":
        p, y = p[:1], y[:1]
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int").repartition(7)
    want = min_max(p, y)
    got = {r["p"]: r["q"] for r in c.fit_isotonic(df).apply(df, "p", "q").collect()}
    assert set(got) == set(want)
    assert all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)


def test_between_and_outside_the_steps(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.5, 0), (0.9, 1), (None, 1), (0.3, None)], "p double, y int")
    fitted = c.fit_isotonic(df)
    asked = spark.createDataFrame([(1, 0.0), (2, 0.3), (3, 0.45), (4, 0.7), (5, 2.0), (6, None)], "id int, p double")
    got = {r["id"]: r["p"] for r in fitted.apply(asked, "p", "p").collect()}
    assert fitted.params["steps"] == 3
    assert got[6] is None
    assert [got[i] for i in range(1, 6)] == pytest.approx([0.0, 0.25, 0.5, 0.75, 1.0])


def test_nothing_to_fit(spark):
    with pytest.raises(ValueError):
        c.fit_isotonic(spark.createDataFrame([], "p double, y int"))


def test_weighted_points_fit_as_rows(spark):
    rows = [(0.1, 0), (0.1, 0), (0.1, 1), (0.6, 1), (0.6, 0), (0.6, 1), (0.8, 0)]
    df = spark.createDataFrame(rows, "p double, y int")
    points = df.groupBy("p", "y").agg(F.count("*").alias("n"))
    for method in ("platt", "beta", "isotonic"):
        one = c.FITTERS[method](df).params
        other = c.FITTERS[method](points, rows=F.col("n")).params
        assert other == pytest.approx(one, rel=1e-6)  # three points hardly hold the three figures of beta
