import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.functions.ids import cnpj_is_valid, cnpj_mask, ids_in_text, normalize_cnpj, with_check_digits
from portolan.functions.numeric import clip01, half_even, lenient_double, normal_quantile
from portolan.functions.scoring import entropy, is_active, margin, risk_level, signature
from portolan.functions.text import legal_form, word_bounded_ngrams, word_count, word_ngrams
from portolan.operators.quantiles import average_rank, exact_quantiles


def values(spark, rows, column, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_check_digits(spark):
    ids = ["00000000000191", "33000167000101", "11.222.333/0001-81", "11222333000182", "1" * 14, "12", "1" * 15, None]
    assert values(spark, ids, cnpj_is_valid(F.col("v"))) == [True, True, True, False, False, False, False, False]
    assert values(spark, ["00000000000191"], cnpj_is_valid(F.col("v"), "reference")) == [False]
    made = values(spark, ["112223330001"], with_check_digits(F.col("v")))
    assert made == ["11222333000181"]


def test_padding_never_cuts(spark):
    assert values(spark, ["1-2", "123456789012345", None], normalize_cnpj(F.col("v"))) == [
        "00000000000012", "123456789012345", None,
    ]
    assert values(spark, ["11222333000181", "12"], cnpj_mask(F.col("v"))) == ["11.222.333/0001-81", "12"]


def test_ids_in_text(spark):
    text = "a 11222333000181 b 11.222.333/0001-81 c 00000000000191 x"
    assert values(spark, [text, ""], ids_in_text(F.col("v"))) == [["11222333000181", "00000000000191"], []]
    assert values(spark, ["11.222.333/0001-81"], ids_in_text(F.col("v"), "capture_v3")) == [["11222333000181"]]
    assert values(spark, [text], ids_in_text(F.col("v"), "txt_v2")) == [["11222333000181", "00000000000191"]]


def test_numbers(spark):
    assert values(spark, ["1.5", "n/d", "NaN", None], lenient_double("v")) == [1.5, None, None, None]
    assert values(spark, [0.125, 0.135], half_even(F.col("v"), 2), "v double") == [0.12, 0.14]
    assert values(spark, [None, -1.0, 2.0], clip01(F.col("v"), 0.5), "v double") == [0.5, 0.0, 1.0]


def test_normal_quantile(spark):
    ps = [1e-6, 1e-3, 0.02, 0.07, 0.3, 0.5, 0.8, 0.95, 0.999, 1 - 1e-6]
    got = values(spark, ps, normal_quantile(F.col("v")), "v double")
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-9)


def test_text(spark):
    assert values(spark, ["ROSA", "COMERCIO", "X LTDA ME", None], legal_form(F.col("v"))) == ["S/A", "ME", "Ltda", "DESCONHECIDO"]
    assert values(spark, ["ROSA", "COMERCIO", "X ME"], legal_form(F.col("v"), "word")) == ["DESCONHECIDO", "DESCONHECIDO", "ME"]
    assert values(spark, ["  a  b ", "", None], word_count(F.col("v"))) == [2, 0, 0]
    assert values(spark, [["a", "b", "c"], ["a"], []], word_ngrams(F.col("v"), 3), "v array<string>") == [
        ["a", "b", "c", "a b", "b c", "a b c"], ["a"], [],
    ]
    assert values(spark, ["ab c"], word_bounded_ngrams(F.col("v"), 3, 4)) == [[" ab", "ab ", " c ", " ab "]]


def test_scores(spark):
    assert values(spark, ["INATIVA", "ATIVA", None], is_active(F.col("v"))) == [True, True, False]
    assert values(spark, ["INATIVA", "ATIVA"], is_active(F.col("v"), "word")) == [False, True]
    assert values(spark, [0.0, 25.0, 74.99, 100.0, None], risk_level(F.col("v")), "v double") == [
        "BAIXO", "MEDIO", "ALTO", "CRITICO", None,
    ]
    assert values(spark, [[0.5, 0.5], [1.0]], margin(F.col("v")), "v array<double>") == [0.0, 0.0]
    assert values(spark, [[0.5, 0.5]], entropy(F.col("v")), "v array<double>")[0] == pytest.approx(math.log(2))
    assert len(values(spark, [["b", "a"]], signature(F.col("v")), "v array<string>")[0]) == 12


def test_quantiles_equal_numpy_with_hot_values_and_groups(spark):
    rng = np.random.default_rng(1)
    data = [("a", float(x)) for x in rng.lognormal(size=500)] + [("a", 1.0)] * 300 + [("b", 7.0), (None, 1.0), (None, 2.0), ("a", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: (r["q"], r["m"]) for r in exact_quantiles(df, F.col("v"), {"q": 0.9, "m": 0.5}, ["g"]).collect()}
    a = [v for g, v in data if g == "a" and v is not None]
    assert got["a"] == pytest.approx((np.quantile(a, 0.9), np.median(a)))
    assert got["b"] == (7.0, 7.0) and got[None] == pytest.approx((1.9, 1.5))
    whole = exact_quantiles(df, F.col("v"), {"q": 0.25}).first()["q"]
    assert whole == pytest.approx(np.quantile([v for _, v in data if v is not None], 0.25))
    assert exact_quantiles(df.where("g = 'zz'"), F.col("v"), {"q": 0.5}).first()["q"] is None


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    assert {r["value"]: r["pct_rank"] for r in average_rank(df, F.col("v")).collect()} == {1.0: 0.25, 2.0: 0.625, 3.0: 1.0}
