"""The outlier KPI of the risk plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.operators.outliers import lof_scores, lof_scores_of_block
from portolan.plans.risk import kpi_outlier, outlier_inputs


def test_inputs_are_value_weight_capital_features_and_kpis():
    columns = ["KPI_Outlier", "KPI_B", "chave_item", "FE_A", "peso_liquido", "ext_capital", "KPI_A", "vmle_dolar"]
    assert outlier_inputs(columns) == ["vmle_dolar", "peso_liquido", "ext_capital", "FE_A", "KPI_A", "KPI_B"]
    assert outlier_inputs(["chave_item"]) == []


def test_scope_of_two_columns_is_scored_group_by_group(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "AB"[i % 2], None if i % 3 else "x", *map(float, rng.normal(size=2))) for i in range(240)]
    df = spark.createDataFrame(rows, "i int, c string, s string, vmle_dolar double, KPI_A double")
    out = {r["i"]: r["KPI_Outlier"] for r in kpi_outlier(df, scope=["c", "s"]).collect()}
    assert len(out) == 240
    for group in {(r[1], r[2]) for r in rows}:
        part = [r for r in rows if (r[1], r[2]) == group]
        points = np.array([(r[3], round(r[4], 6)) for r in part])
        want = lof_scores_of_block(points, np.ones(len(part), int))
        assert [out[r[0]] for r in part] == pytest.approx(list(want), abs=1e-6)


def test_what_is_no_number_counts_as_zero_and_columns_stay(spark):
    df = spark.createDataFrame([(i, "n/d" if i % 2 else str(i), 1.0) for i in range(30)], "i int, vmle_dolar string, KPI_A double")
    out = kpi_outlier(df)
    assert out.columns == ["i", "vmle_dolar", "KPI_A", "KPI_Outlier"] and out.where(F.col("KPI_Outlier").isNull()).count() == 0
    assert out.where("vmle_dolar = 'n/d'").count() == 15


def test_a_row_on_the_limit_is_not_flagged(spark):
    """71 evenly spread points: the limit is one of their factors, and mirrored points have equal ones."""
    points = np.arange(71.0).reshape(-1, 1)
    scores = lof_scores_of_block(points, np.ones(71, int))
    assert scores == pytest.approx(scores[::-1], abs=1e-9)
    df = spark.createDataFrame([(float(x),) for x in range(71)], "x double")
    got = {r["x"]: r["KPI_Outlier"] for r in lof_scores(df, ["x"], block_points=16).collect()}
    assert [got[float(x)] for x in range(71)] == pytest.approx(list(scores), abs=1e-9)


def test_the_search_in_a_cell_grows_with_its_points_not_with_their_square(monkeypatch):
    """One cell of 6,000 points meets about as many pairs a point as one of 1,500, and finds what all pairs give."""
    from portolan.operators import outliers as o

    met = []
    real = o.squared_distances
    monkeypatch.setattr(o, "squared_distances", lambda here, there: met.append(len(here) * len(there)) or real(here, there))

    def pairs(n):
        rng = np.random.default_rng(n)
        x = np.unique(np.column_stack([rng.uniform(0, 1e4, n).round(1), rng.integers(1, 50, n), rng.integers(0, 3, n) / 2]), axis=0)
        ids, copies, k = np.arange(len(x)), rng.integers(1, 4, len(x)), np.full(len(x), 20)
        cell = o.Cell(ids, copies, x)
        assert cell.search(x[:1] + 1e9, ids[:1] - 1, k[:1], np.zeros(1))[0].size == 0
        met.clear()
        row, near, squared, rows, bound = cell.search(x, ids, k, np.full(len(x), np.inf))
        for i in range(0, len(x), 97):
            want = ((x[i] - x) ** 2).sum(axis=1)
            order = [j for j in np.lexsort((ids, want)) if copies[j] - (j == i) > 0]
            reached = np.cumsum([copies[j] - (j == i) for j in order])
            order = order[: int(np.argmax(reached >= 20)) + 1]
            assert sorted(near[row == i]) == sorted(order)
            assert bound[i] == pytest.approx(want[order[-1]])
        return sum(met) / len(x)

    few, many = pairs(1500), pairs(6000)
    assert many < 1.5 * few and many < 600


def test_rows_of_a_scope_pass_one_shuffle_and_are_not_joined_back(spark, small):
    """Texts end where the KPIs are made, nothing is stored for the outlier score, and no join has its inputs as keys."""
    from pathlib import Path

    import workload
    from portolan.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("lof_*"))
    out = workload.queries()["risk_levels"](spark, small)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not [line for line in joins if "lof_" in line]
    assert {p.name.split("-")[0] for p in set(folder.glob("lof_*")) - before} <= {"lof_wide"}
    scored = next(line for line in plan.splitlines() if "FlatMapGroupsInArrow" in line)
    assert "KPI_Completude" in scored and "descricao" not in scored and "razao_social" not in scored
    assert out.agg(F.sum("n")).first()[0] == 6000


def test_a_scope_of_many_rows_is_one_task_with_the_factor_of_all_pairs(spark, monkeypatch):
    """3,000 points of a scope with copies, and rows that miss a number: rounded and compared as by all pairs."""
    from portolan.operators import outliers as o

    rng = np.random.default_rng(11)
    x = np.column_stack([rng.uniform(0, 1e4, 3000).round(2), rng.integers(0, 50, 3000), rng.normal(size=3000)])
    rows = [(i, float(a), float(b) if b else None, float(c), "s") for i, (a, b, c) in enumerate(np.vstack([x, x[:90]]))]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, s string")
    scored = lof_scores(df, ["a", "b", "c"], scope="s", digits={"c": 3}, keep=["i", "c"], sizes=df.select("s"))
    assert scored.columns == ["i", "c", "KPI_Outlier"]
    got = {r["i"]: r["KPI_Outlier"] for r in scored.collect()}
    monkeypatch.setattr(o, "ALL_PAIRS", 10**6)
    points = np.array([(r[1], r[2] or 0.0, round(r[3], 3)) for r in rows])
    distinct, place, copies = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    want = o.lof_scores_of_block(distinct, copies)[place.ravel()]
    assert [got[i] for i in range(len(rows))] == pytest.approx(list(want), abs=1e-9)


def test_a_large_scope_stores_lists_of_points_near_a_border_only(spark):
    """Eight cells of 20,000 points with copies: most points end in their cell, and scores are those of one cell."""
    from pathlib import Path

    from portolan.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    rng = np.random.default_rng(5)
    x = np.vstack([np.column_stack([rng.uniform(0, 1e4, 20000).round(2), rng.integers(1, 6, 20000) / 4]), np.zeros((9000, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double").repartition(8)
    before = set(folder.glob("lof_inside-*"))
    run = lambda size: {r["i"]: r["KPI_Outlier"] for r in lof_scores(df, ["a", "b"], block_points=size).collect()}
    cells = run(4000)
    (made,) = set(folder.glob("lof_inside-*")) - before
    stored = spark.read.parquet(f"file://{made}")
    assert stored.select("home").distinct().count() >= 4 and stored.agg(F.sum("copies")).first()[0] == len(x)
    assert 0 < stored.where("near IS NOT NULL").count() < 0.2 * stored.count()
    assert stored.where("(near IS NULL) <> (factor IS NOT NULL) OR crosses AND coordinates IS NULL").count() == 0
    one = run(10**6)
    assert [cells[i] for i in range(len(x))] == pytest.approx([one[i] for i in range(len(x))], abs=1e-9)
