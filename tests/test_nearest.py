"""The nearest-record join against brute force."""

import numpy as np
import pandas as pd
import pytest

from portolan.operators import nearest
from portolan.operators import privacy as p
from portolan.operators.outliers import Regions


def _brute(asking: np.ndarray, given: np.ndarray) -> np.ndarray:
    squared = np.zeros((len(asking), len(given)))
    for j in range(asking.shape[1]):
        squared += (asking[:, j, None] - given[None, :, j]) ** 2
    return np.sqrt(squared.min(axis=1))


def _frame(spark, rows: np.ndarray):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"c{i} double" for i in range(rows.shape[1])))


@pytest.mark.parametrize("width", [1, 2, 6])
def test_equals_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(nearest, "ASKING", 50)  # so that a cell is dealt to several tasks
    rng = np.random.default_rng(width)
    given = np.r_[rng.normal(size=(700, width)), np.round(rng.normal(size=(300, width)), 1), np.zeros((400, width))]
    asking = np.r_[rng.normal(size=(300, width)), given[:20], 50 + rng.normal(size=(30, width)), np.ones((200, width))]
    columns = [f"c{i}" for i in range(width)]
    out = nearest.nearest_distances(_frame(spark, asking), _frame(spark, given), columns, cell_points=40).collect()
    points, copies = np.unique(asking, axis=0, return_counts=True)
    got = {tuple(r[c] for c in columns): (r["copies"], r["distance"]) for r in out}
    want = _brute(points, given)
    assert len(out) == len(points)
    for point, n, distance in zip(points, copies, want):
        assert got[tuple(point)] == (n, distance)


def test_odd_rows_and_empty_tables(spark):
    ddl = "a double, b double"
    odd = [(None, 1.0), (float("nan"), 1.0), (float("inf"), 0.0), (3.0, 4.0), (3.0, 4.0), (-0.0, 0.0)]
    given = spark.createDataFrame([(0.0, 0.0), (None, None), (0.0, float("-inf"))], ddl)
    rows = nearest.nearest_distances(spark.createDataFrame(odd, ddl), given, ["a", "b"]).collect()
    assert sorted((r["a"], r["copies"], r["distance"]) for r in rows) == [(0.0, 1, 0.0), (3.0, 2, 5.0)]
    none = spark.createDataFrame([], ddl)
    assert nearest.nearest_distances(none, given, ["a", "b"]).count() == 0
    assert [r["distance"] for r in nearest.nearest_distances(given, none, ["a", "b"]).collect()] == [None]


def test_a_single_copied_record_is_found(spark):
    rng = np.random.default_rng(3)
    original, synthetic = rng.normal(size=(6000, 2)), rng.normal(size=(3000, 2))
    assert _brute(synthetic, original).min() > 0
    row = p.closest_record_distance(_frame(spark, original), _frame(spark, synthetic), ["c0", "c1"]).first()
    scale = original.std(axis=0) + 1e-9
    want = _brute(synthetic / scale, original / scale)
    assert row["dcr_min"] == pytest.approx(want.min(), rel=1e-9)
    assert row["dcr_med"] == pytest.approx(np.median(want), rel=1e-9)
    assert row["dcr_p05"] == pytest.approx(np.percentile(want, 5), rel=1e-9)
    synthetic[1234] = original[4321]
    row = p.closest_record_distance(_frame(spark, original), _frame(spark, synthetic), ["c0", "c1"]).first()
    assert row["dcr_min"] == 0.0


def test_a_sample_needs_its_key(spark):
    table = _frame(spark, np.arange(20.0).reshape(10, 2))
    with pytest.raises(ValueError):
        p.closest_record_distance(table, table, ["c0"], sample=5)
    assert p.closest_record_distance(table, table, ["c0"], ["c1"], sample=5).first()["dcr_min"] == 0.0


def test_work_of_a_point_does_not_follow_the_size_of_its_cell(monkeypatch):
    met, least = [], nearest.Leaves._least
    monkeypatch.setattr(nearest.Leaves, "_least", lambda self, x, leaf: met.append(len(leaf) * self.held.shape[2]) or least(self, x, leaf))
    rng = np.random.default_rng(5)
    names = ["c0", "c1"]
    per_point = []
    for n in (2000, 32_000):
        met.clear()
        given, asking = (rng.uniform(size=(n, 2)) for _ in range(2))
        asked = pd.DataFrame(asking, columns=names).assign(copies=1, cell=0, bound=np.inf)
        out = nearest.closest(asked, pd.DataFrame(given, columns=names), names)
        assert (np.sqrt(out["bound"][:300]) == _brute(asking[:300], given)).all()
        per_point.append(sum(met) / n)
    assert max(per_point) < 100


def test_points_that_share_a_value_lie_on_no_border():
    rng = np.random.default_rng(6)
    points = np.c_[rng.uniform(size=4000), rng.integers(0, 5, 4000)]
    cells = Regions(points, 6)
    low, high = nearest.cell_boxes(cells, 2)
    home = cells.home(points)
    assert (points > low[home]).all() and (points < high[home]).all()
    assert np.bincount(home, minlength=64).min() > 0
    # A ball inside the box of its cell reaches no other; one that leaves it does.
    edge = np.minimum(points - low[home], high[home] - points).min(axis=1) ** 2
    assert np.array_equal(cells.within(points, edge * 0.99)[0], np.arange(4000))
    row, _ = cells.within(points, edge * 1.01)
    assert (np.bincount(row, minlength=4000) > 1).all()
