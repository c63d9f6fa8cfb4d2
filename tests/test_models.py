"""Calibration, privacy, outliers and attribution against brute force and known properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.functions.text import word_tokens
from portolan.operators import attribution as a
from portolan.operators import calibration as c
from portolan.operators import privacy as p
from portolan.operators.kpis import kpi_undervaluation
from portolan.operators.ngrams import top_grams
from portolan.operators.outliers import lof_scores, lof_scores_of_block


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(42)
    y = rng.integers(0, 2, 3000)
    q = np.clip(0.5 + 0.5 * (y - 0.5) + rng.normal(0, 0.3, 3000), 0.01, 0.99)
    return spark.createDataFrame([(int(i), float(j)) for i, j in zip(y, q)], "y int, p double").cache()


def test_metrics_of_four_points(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (1, 0.8), (0, 0.2)], "y int, p double")
    row = c.calibration_errors(df).first()
    assert row["brier"] == pytest.approx(0.025) and row["ece"] == pytest.approx(0.15) and row["mce"] == pytest.approx(0.2)


def test_certain_rows_are_in_no_bin(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0)], "y int, p double")
    assert c.calibration_errors(df).first()["ece"] == 0.0
    assert c.reliability(df).count() == 0


def nll(df, column):
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col(column)))
    return df.agg(F.avg(-F.when(F.col("y") == 1, F.ln(q)).otherwise(F.ln(1 - q)))).first()[0]


@pytest.mark.parametrize("method", c.METHODS)
def test_calibrators(points, method):
    out = c.FITTERS[method](points).apply(points, "p", "q")
    low, high, n = out.agg(F.min("q"), F.max("q"), F.count("q")).first()
    assert 0 <= low <= high <= 1 and n == 3000
    if method in ("platt", "beta"):
        assert nll(out, "q") <= nll(out, "p") + 1e-9
    if method == "isotonic":
        q = [r["q"] for r in out.orderBy("p").collect()]
        assert all(x <= y + 1e-12 for x, y in zip(q, q[1:]))


def test_auto_calibration_lowers_error(points):
    report = c.fit_auto(points).report.first()
    assert report["ece_after"] < report["ece_before"]


def test_temperature_of_a_worthless_score(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.1), (0, 0.8), (1, 0.2)], "y int, p double")
    assert c.fit_temperature(df).params["T"] == c.NO_TEMPERATURE


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = [
        (str(rng.integers(1, 4)), "ABC"[rng.integers(0, 3)], float(rng.normal(5000, 1500)), float(rng.gamma(2, 100)))
        for _ in range(2000)
    ]
    return spark.createDataFrame(rows, "ncm string, pais_origem string, vmle_dolar double, peso_liquido double").cache()


def test_synthetic_table(spark, table):
    model = p.fit_copula(table)
    sample = p.sample_copula(spark, model)
    assert sample.count() == 2000 and set(sample.columns) == set(table.columns)
    mean = lambda df: df.agg(F.avg("vmle_dolar")).first()[0]
    assert abs(mean(sample) - mean(table)) < 500
    assert {r[0] for r in sample.select("ncm").distinct().collect()} <= {"1", "2", "3"}
    assert sample.exceptAll(p.sample_copula(spark, model)).count() == 0


def test_sampled_correlation(spark):
    model = p.Copula(["x", "y"], {"x": 0.0, "y": 1.0}, {"x": 1.0, "y": 2.0}, np.array([[1.0, 0.8], [0.8, 1.0]]))
    sample = p.sample_copula(spark, model, n=20000)
    assert sample.agg(F.corr("x", "y")).first()[0] == pytest.approx(0.8, abs=0.02)


def test_category_shares(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "category string, n long")
    model = p.Copula([], {}, {}, np.zeros((0, 0)), {"k": p.category_ranges(counts)})
    share = {r["k"]: r["count"] / 8000 for r in p.sample_copula(spark, model, n=8000).groupBy("k").count().collect()}
    assert share["a"] == pytest.approx(0.5, abs=0.03) and share["b"] == pytest.approx(0.25, abs=0.03)


def test_ranges_cover_every_category_once(spark):
    n = {f"c{i}": 1 + (5000 if i == 7 else i % 3) for i in range(3000)}
    ranges = p.category_ranges(spark.createDataFrame(list(n.items()), "category string, n long")).orderBy("low").collect()
    assert [r["low"] for r in ranges] == [0] + [r["high"] for r in ranges][:-1]
    assert {r["category"]: r["high"] - r["low"] for r in ranges} == n
    assert {r["total"] for r in ranges} == {sum(n.values())} and ranges[-1]["high"] == sum(n.values())


def test_synthetic_rows_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, x double, day date")
    model = p.fit_copula(empty)
    assert p.sample_copula(spark, model).count() == 0
    row = p.sample_copula(spark, model, n=2).first()
    assert row["k"] is None and row["day"] is None


def test_rare_categories_are_drawn_and_hot_ones_keep_their_share(spark):
    """No category is pooled: 3,000 rare ones beside one that holds half of all rows, in rows whatever the partitions."""
    table = spark.range(6000).selectExpr("CASE WHEN id < 3000 THEN 'hot' ELSE concat('c', id) END AS k", "id % 2 = 0 AS flag")
    model = p.fit_copula(table)
    sample = p.sample_copula(spark, model)
    assert sample.count() == 6000 and sample.columns == ["k", "flag"]
    counts = {r["k"]: r["count"] for r in sample.groupBy("k").count().collect()}
    assert counts["hot"] == pytest.approx(3000, abs=200) and len(counts) > 1500 and "__OUTROS__" not in counts
    few = p.sample_copula(spark, model, n=100)
    assert few.exceptAll(sample).count() == 0  # row i of a table is the same however many rows follow
    assert {r[0] for r in p.sample_copula(spark, p.fit_copula(table, 1)).select("k").distinct().collect()} == {"hot", "__OUTROS__"}


def test_disclosure_and_distance(spark, table):
    original = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "ncm string")
    synthetic = spark.createDataFrame([("1",), ("2",)], "ncm string")
    assert p.disclosure_rate(original, synthetic, ["ncm"]).first()[0] == 100.0
    assert p.disclosure_rate(original, synthetic, []).first()[0] == 0.0
    numbers = ["vmle_dolar", "peso_liquido"]
    assert p.closest_record_distance(table, table, numbers, numbers).first()["dcr_min"] < 1e-6
    assert p.closest_record_distance(table, table, [], ["ncm"]).first()["dcr_min"] is None


def test_k_anonymity_edges(spark, table):
    assert p.k_stats(table, []).first()["k_min"] == 2000
    nulls = spark.createDataFrame([(None,), (None,), ("a",)], "q string")
    row = p.k_stats(nulls, ["q"], 2).first()
    assert (row["k_min"], row["registros_violados"], row["grupos_violados"]) == (1, 1, 1)
    assert p.k_anonymity(table, table, ["ncm", "pais_origem"]).first()["passa_k"]


def brute_lof(x, k=20):
    n = len(x)
    k = min(k, n - 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = []
    for i in range(n):
        order = sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], *x[j]))
        near.append(order[:k])
    kd = [max(d[i, j] for j in near[i]) for i in range(n)]
    lrd = [1 / (np.mean([max(kd[j], d[i, j]) for j in near[i]]) + 1e-10) for i in range(n)]
    f = np.array([np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(n)])
    s = (f - f.min()) / (f.max() - f.min() + 1e-9)
    return np.where(-f < np.percentile(-f, 10), s, s * 0.3)


def test_lof_equals_brute_force_with_copies(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(60, 2)).round(2), np.zeros((30, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, float(u), float(v)) for i, (u, v) in enumerate(x)], "i int, u double, v double")
    got = {r["i"]: r["KPI_Outlier"] for r in lof_scores(df, ["u", "v"]).collect()}
    assert np.allclose([got[i] for i in range(len(x))], brute_lof(x), atol=1e-9)


def test_lof_small_and_blocked(spark):
    assert lof_scores_of_block(np.zeros((3, 1)), np.array([1, 1, 1])).tolist() == [0, 0, 0]
    df = spark.range(3000).select("id", (F.col("id") % 997).cast("double").alias("x"), F.rand(1).alias("y"))
    out = lof_scores(df, ["x", "y"], block_points=200)
    assert out.count() == 3000 and out.agg(F.max("KPI_Outlier")).first()[0] <= 1.0


def test_lof_over_many_cells_equals_one_block(spark):
    """Several scopes, repeated values and rows, far points: the size of a cell changes no score."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(700, 3)).round(1), rng.normal(size=(500, 3)), np.zeros((15, 3)), [[50.0, 0.0, 0.0]]])
    x[:200, 2] = 0.5
    rows = [(i, "a" if i % 3 else "b", *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, s string, u double, v double, w double")
    run = lambda size: {r["i"]: r["KPI_Outlier"] for r in lof_scores(df, ["u", "v", "w"], scope="s", block_points=size).collect()}
    many, one = run(60), run(5000)
    assert np.allclose([many[i] for i in range(len(x))], [one[i] for i in range(len(x))], rtol=1e-6, atol=1e-9)


def test_complement_bayes_equals_brute_force(spark):
    texts = [
        ("c1", "red blue blue"), ("c1", "red green"), ("c2", "green green sky"), ("c3", "sky blue"), ("c4", "moss"),
        ("c5", "red red"), ("c6", "blue"), ("c6", "moss sky green"),
    ]
    train = a.with_bag(spark.createDataFrame(texts, "label string, text string"), word_tokens(F.col("text")))
    asked = [(0, "red blue"), (1, "moss moss"), (2, "unknown words"), (3, "")]
    rows = a.with_bag(spark.createDataFrame(asked, "id int, text string"), word_tokens(F.col("text")))
    model = a.complement_model(a.complement_counts(train, "label"))
    got = {r["id"]: r for r in a.attribute(rows, model, 3).collect()}

    words = sorted({w for _, t in texts for w in t.split()})
    classes = sorted({k for k, _ in texts})
    n = np.array([[sum(t.split().count(w) for k, t in texts if k == q) for w in words] for q in classes], float)
    comp = n.sum(0) + 0.3 - n
    weight = -np.log(comp / comp.sum(1, keepdims=True))
    for i, text in asked:
        x = np.array([text.split().count(w) for w in words], float)
        jll = weight @ x
        prob = np.exp(jll - jll.max())
        prob /= prob.sum()
        order = sorted(range(len(classes)), key=lambda q: (-round(jll[q], 9), classes[q]))
        assert [got[i][f"RES_Top{r}"] for r in (1, 2, 3)] == [classes[q] for q in order[:3]]
        assert got[i]["RES_Confianca"] == pytest.approx(prob.max(), abs=6e-5)
        assert got[i]["RES_Entropia"] == pytest.approx(-(prob * np.log(prob)).sum(), abs=6e-5)


def test_class_blocks_change_no_result(spark):
    """Many small blocks and parts against one of each: ties, a word that every class uses, long and unknown texts."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    train = [(f"c{i:03d}", " ".join(["all", *rng.choice(words, rng.integers(0, 6))])) for i in range(120)]
    asked = [(i, " ".join(rng.choice([*words, "all", "none"], rng.integers(0, 9)))) for i in range(80)]
    asked += [(100, "all"), (101, "all " * 400 + "w1 " * 300), (102, None), (103, "")]
    rows = a.with_bag(spark.createDataFrame(asked, "id int, text string"), word_tokens(F.col("text")))
    model = a.complement_model(a.complement_counts(a.with_bag(spark.createDataFrame(train, "label string, text string"), word_tokens(F.col("text"))), "label"))
    one = {r["id"]: r for r in a.attribute(rows, model).collect()}
    many = {r["id"]: r for r in a.attribute(rows, model, block_classes=7, bag_part=5).collect()}
    assert one.keys() == many.keys() == {i for i, _ in asked}
    for i, r in one.items():
        assert [r[f"RES_Top{k}"] for k in range(1, 6)] == [many[i][f"RES_Top{k}"] for k in range(1, 6)]
        assert all(abs(r[c] - many[i][c]) <= 1.01e-4 for c in ("RES_Confianca", "RES_Entropia", "RES_Margem") if i != 102)
    assert one[102]["RES_Confianca"] is many[102]["RES_Confianca"] is None  # a row without text has no bag
    assert math.isfinite(one[101]["RES_Entropia"])
    # Classes of one word only, all alike: every class is first by its name alone.
    same = a.with_bag(spark.createDataFrame([(f"k{i:04d}", "all") for i in range(500)], "label string, text string"), word_tokens(F.col("text")))
    flat = a.complement_model(a.complement_counts(same, "label"))
    r = a.attribute(rows.where("id = 100"), flat, block_classes=16).first()
    assert [r[f"RES_Top{k}"] for k in range(1, 6)] == [f"k{i:04d}" for i in range(5)]
    assert r["RES_Confianca"] == 0.002 and r["RES_Entropia"] == pytest.approx(math.log(500), abs=6e-5)


def test_attribution_shuffles_no_scores(spark):
    """Rows that leave the blocks: k + 1 for each bag and block at most, though every bag shares a word with every class."""
    train = a.with_bag(spark.createDataFrame([(f"c{i:03d}", f"all w{i % 9}") for i in range(300)], "label string, text string"), word_tokens(F.col("text")))
    model = a.complement_model(a.complement_counts(train, "label"))
    tokens = a.bag_tokens(train)
    lengths = a.bag_lengths(tokens, model)
    units = a.block_scores(tokens, lengths, model, blocks=10, parts=2, k=3).collect()
    assert len(units) == 9 * 10 * 4


def test_model_reload_gives_equal_scores(spark, tmp_path):
    train = a.with_bag(
        spark.createDataFrame([("x", "aa bb"), ("y", "bb cc"), ("z", "cc")], "label string, text string"), word_tokens(F.col("text"))
    )
    model = a.complement_model(a.complement_counts(train, "label"))
    model.save(str(tmp_path / "m"))
    loaded = a.ComplementModel.load(spark, str(tmp_path / "m"))
    assert sorted(a.attribute(train, model, 2).collect()) == sorted(a.attribute(train, loaded, 2).collect())


def test_ngrams_equal_brute_force(spark):
    from collections import Counter

    texts = ["abcabc", "abcabc", "bcd", "z", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for padded in (False, True):
        freq, docs = Counter(), Counter()
        for t in texts:
            b = f" {t} " if padded and t else (t or "")
            grams = [b[i : i + n] for n in range(2, 6) for i in range(len(b) - n + 1)]
            freq.update(grams)
            docs.update(set(grams))
        want = sorted(((g, f) for g, f in freq.items() if docs[g] >= 2 and f > 1), key=lambda r: (-r[1], r[0]))[:50]
        assert [tuple(r) for r in top_grams(df, ["t"], padded=padded).orderBy(F.desc("freq"), "gram").collect()] == want


def test_zero_weight_and_absent_columns(spark):
    df = spark.createDataFrame([("1", 0.0), ("4", 2.0), ("x", 1.0)], "vmle_dolar string, peso_liquido double")
    assert [r["KPI_Subvalorizacao"] for r in kpi_undervaluation(df).collect()] == [0.0, 0.0, 0.0]
    assert kpi_undervaluation(df.drop("peso_liquido")).first()["FE_ValorPorKg"] == 0.0


def test_bundle_reload_gives_equal_scores(spark, table, tmp_path):
    from pyspark.ml import PipelineModel

    from portolan.operators.ml import fit_logistic, fit_preprocessor, pooled_category
    from portolan.sinks.models import load_bundle, save_bundle

    df = pooled_category(table.withColumn("label", (F.col("vmle_dolar") > 5000).cast("double")), "ncm")
    pre = fit_preprocessor(df, ["ncm"], ["vmle_dolar", "peso_liquido"])
    model = PipelineModel(stages=[*pre.stages, fit_logistic(pre.transform(df))])
    save_bundle(model, spark.createDataFrame([("columns", "ncm")], "k string, v string"), str(tmp_path / "b"))
    again, metadata = load_bundle(spark, str(tmp_path / "b"))
    scores = lambda m: [r[0] for r in m.transform(df).orderBy("vmle_dolar").select("probability").collect()]
    assert scores(model) == scores(again) and metadata.first()["v"] == "ncm"


def test_regions_in_reach_are_all_found():
    """Ten correlated columns with ties: a ball meets every region that holds one of its points."""
    from portolan.operators.outliers import Regions

    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, 2)) @ rng.normal(size=(2, 10)) + rng.normal(size=(800, 10)) * 0.05
    x[:, 3] = np.round(x[:, 3])
    x[:500, 4] = 0.0
    regions = Regions(x[:300], 5)
    home = regions.home(x)
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    bound = np.sort(apart, axis=1)[:, 20]
    row, cell = regions.within(x, bound)
    reached = set(zip(row.tolist(), cell.tolist(), strict=True))
    assert len(reached) == len(row)
    assert all((i, home[j]) in reached for i, j in zip(*np.nonzero(apart <= bound[:, None]), strict=True))
    assert len(row) < 16 * len(x)
