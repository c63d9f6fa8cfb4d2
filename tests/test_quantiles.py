"""Quantiles of a whole table by two-pass selection."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from portolan.operators.ml import standardised
from portolan.operators.quantiles import SKETCH_ACCURACY, _brackets, selected_values, whole_quantiles

WANTED = {"low": 0.0, "p01": 0.01, "q1": 0.25, "med": 0.5, "q3": 0.75, "p999": 0.999, "top": 1.0}


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "sorted", "small", "two"])
def test_selection_equals_sorting(spark, kind):
    rng = np.random.default_rng(5)
    n = {"small": 60, "two": 2}.get(kind, 60_000)
    x = {
        "normal": lambda: rng.normal(size=n),
        "ties": lambda: rng.integers(0, 50, n).astype(float),
        "heavy": lambda: np.where(rng.random(n) < 0.4, 7.0, rng.pareto(0.7, n)),
        "sorted": lambda: np.arange(n) * 1.5,
    }.get(kind, lambda: rng.random(n))()
    df = spark.createDataFrame(pd.DataFrame({"v": x})).repartition(5)
    row = whole_quantiles(df, F.col("v"), WANTED).first()
    for name, q in WANTED.items():
        assert row[name] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-12)


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,), (None,)], "v double")
    assert whole_quantiles(df, F.col("v"), {"m": 0.5}).first()["m"] == 2.0
    assert whole_quantiles(df.where("v is null"), F.col("v"), {"m": 0.5}).first()["m"] is None


def test_few_values_are_shuffled(spark):
    n = 400_000
    values = spark.range(n).select(F.xxhash64("id").alias("value"))
    kept = selected_values(values, _brackets(values, [0.25, 0.75]), 2)
    assert kept.count() <= 2 * n * 10 / SKETCH_ACCURACY + 3
    assert kept.agg(F.sum("copies")).first()[0] == n


def test_standardised_columns(spark):
    rows = [(1.0, 5.0, None), (None, 5.0, None), (4.0, None, None), (10.0, 5.0, None)]
    out = standardised(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()
    filled = np.array([1.0, 4.0, 4.0, 10.0])
    want = (filled - filled.mean()) / filled.std()
    assert sorted(r["a_std"] for r in out) == pytest.approx(sorted(want))
    assert {r["b_std"] for r in out} == {0.0} and {r["c_std"] for r in out} == {None}
    assert set(out[0].asDict()) == {"a", "b", "c", "a_std", "b_std", "c_std"}
