"""Cases that gave wrong answers before."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from portolan.functions.numeric import hash52, normal_quantile
from portolan.operators import attribution, topk
from portolan.operators.candidates import delivery, select_candidates
from portolan.operators.metrics import log_loss, topk_accuracy
from portolan.operators.ml import balanced_weights
from portolan.operators.registry import missing_keys, upsert


def test_upsert_takes_the_new_row(spark):
    old = spark.createDataFrame([("a", "old", 5), ("b", "kept", 2)], "cnpj string, v string, load_seq long")
    new = spark.createDataFrame([("a", "new")], "cnpj string, v string")
    assert sorted(map(tuple, upsert(old, new).select("cnpj", "v", "load_seq").collect())) == [("a", "new", 6), ("b", "kept", 2)]
    assert sorted(map(tuple, upsert(old.drop("load_seq"), new).collect())) == [("a", "new"), ("b", "kept")]


def test_upsert_ties_and_missing_ids(spark):
    old = spark.createDataFrame([(None, "x"), (None, "y"), ("a", "1"), ("a", "2")], "cnpj string, v string")
    got = sorted(map(str, map(tuple, upsert(old, old.limit(0)).collect())))
    assert got == ["('a', '2')", "(None, 'x')", "(None, 'y')"]


def test_missing_keys_gives_all(spark):
    df = spark.range(1200).selectExpr("CAST(id AS STRING) AS cnpj")
    assert missing_keys(df, df.limit(0)).count() == 1200
    assert missing_keys(df, df.limit(0), budget=7).count() == 7


def test_log_loss_counts_rows_without_a_score_of_the_truth(spark):
    df = spark.createDataFrame([(1, "a", "a", 0.5), (2, "z", "a", 0.9)], "i long, y string, class string, p double")
    assert log_loss(df).first()[0] == round(-math.log(0.5), 4)
    assert log_loss(df, row="i").first()[0] > 10


def test_selection_without_score_columns(spark):
    df = spark.createDataFrame([("k", "2", True), ("k", "1", True)], "chave_item string, CNPJ_Previsto string, Candidato_Valido boolean")
    assert delivery(select_candidates(df)).first() == ("k", "1")
    with pytest.raises(ValueError):
        delivery(df.drop("CNPJ_Previsto"))


def test_topk_counts_ties_unscored_truth_and_gathers_nothing(spark):
    rows = [(1, "b", "a", 0.4), (1, "b", "b", 0.4), (1, "b", "c", 0.2), (2, "z", "a", 0.9), (2, "z", "b", 0.1), (None, "a", "a", 0.7), (None, "a", "b", 0.3)]
    df = spark.createDataFrame(rows, "row long, y string, class string, p double")
    got = topk_accuracy(df, ks=(1, 2, 3))
    assert sorted(map(tuple, got.collect())) == [(1, 0.3333), (2, 0.6667)]
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_newton_fit_meets_its_conditions(spark):
    from portolan.operators import calibration as c

    rows = [(i / 50, int((i * 7919) % 50 < i)) for i in range(1, 50)]
    slope, intercept = (c.fit_platt(spark.createDataFrame(rows, "p double, y int")).params[k] for k in ("slope", "intercept"))
    off = [1 / (1 + math.exp(-(slope * p + intercept))) - y for p, y in rows]
    assert abs(sum(off)) < 1e-6 and abs(sum(o * p for o, (p, _) in zip(off, rows, strict=True))) < 1e-6
    with pytest.raises(ValueError):
        c.fit_platt(spark.createDataFrame([], "p double, y int"))


def test_tfidf_moves_texts_not_pairs(spark):
    """(key, token) pairs lie where their text was dealt; repeated and NULL keys still count as one text."""
    from portolan.operators.ml import tfidf

    df = spark.createDataFrame([(1, "aa bb"), (1, "bb cc"), (None, "aa dd"), (2, "bb bb")], "i long, t string")
    got = tfidf(df, "i", ["t"], most=3, n_max=1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(i#" in line and "token#" in line.split("ENSURE")[0].split("hashpartitioning")[1]]
    weights = {(r["i"], r["token"]): r["w"] for r in got.collect()}
    idf = {"aa": math.log(5 / 3) + 1, "bb": math.log(5 / 3) + 1, "cc": math.log(5 / 2) + 1}
    raw = {"aa": idf["aa"], "bb": (1 + math.log(2)) * idf["bb"], "cc": idf["cc"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert set(weights) == {(1, "aa"), (1, "bb"), (1, "cc"), (None, "aa"), (2, "bb")}
    assert all(weights[(1, t)] == pytest.approx(v / norm) for t, v in raw.items())


def test_table_kpis_read_their_input_once(spark):
    """The joins that give the table run once, not once for each figure."""
    from portolan.operators.business import business_kpis

    left = spark.createDataFrame([(i, f"c{i % 3}", str(i % 7), float(i)) for i in range(50)], "i long, cnpj string, ncm string, vmle_dolar double")
    right = spark.createDataFrame([(i, "BR" if i % 2 else None, 1.5) for i in range(50)], "i long, pais_origem string, peso_liquido double")
    got = business_kpis(left.join(right, "i"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" not in plan
    assert tuple(got.first())[:7] == (50, 3, 7, 1, 24.5, 1225.0, 1.5)


def test_quality_kpis_shuffle_hashes_and_compare_repeats_whole(spark):
    """NULLs leave no trace in a row's hash: rows of one hash are told apart, real copies are counted."""
    from portolan.operators.business import quality_kpis

    rows = [("x", None), (None, "x"), (None, "x"), (None, None), ("y", "z"), ("y", "z"), ("y", "z")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert tuple(quality_kpis(df, "a").first()) == (7, 2, round(9 / 14, 4), 3, 2, 0.5714)
    unlike = spark.createDataFrame([("x", "1"), ("y", "2")], "a string, b string")
    got = quality_kpis(unlike, "a")
    assert "hashpartitioning(a#" not in got._jdf.queryExecution().executedPlan().toString()
    assert tuple(got.first()) == (2, 2, 1.0, 0, 2, 0.0)
    assert tuple(quality_kpis(df.limit(0), "a").first())[:4] == (0, 2, None, 0)


def test_feature_vectors_are_stored_in_small_row_groups(spark, small):
    """Spark decodes up to 4,096 rows of a row group at once: groups of wide vectors stay far below that."""
    from pathlib import Path

    import pyarrow.parquet as pq

    import workload
    from portolan.session import shared_dir

    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("text-features-*"))
    assert workload.queries()["linear_text_model"](spark, small).count() == 1
    (made,) = set(Path(shared_dir(spark).removeprefix("file:")).glob("text-features-*")) - before
    wide = spark.range(2000).selectExpr("id", "transform(sequence(1, 3000), i -> (id * 7919 + i * 104729) % 1000003 / 7D) AS v")
    from portolan.operators.ml import VECTOR_GROUP
    from portolan.session import stored

    kept = stored(wide.coalesce(1), "wide", VECTOR_GROUP)
    assert kept.count() == 2000
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept.inputFiles()]
    rows = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert sum(rows) == 2000 and max(rows) <= 400
    assert list(made.glob("*.parquet"))


def _counted(spark, n=60):
    """Rows whose making is counted, as joins that give a table would be repeated."""
    made = spark.sparkContext.accumulator(0)

    def count(i):
        made.add(1)
        return i

    rows = spark.range(n, numPartitions=1).withColumn("i", F.udf(count, "long")("id"))
    return rows, made


def test_copula_reads_its_input_once_and_moves_only_draws(spark):
    from portolan.operators.privacy import fit_copula, generate_and_validate, sample_copula

    rows, made = _counted(spark)
    df = rows.selectExpr("i % 7 * 1D AS v", "i % 5 * 2D AS x", "'c' || i % 11 AS c", "'d' || i % 3 AS d", "timestamp_seconds(i) AS t")
    copula = fit_copula(df)
    assert made.value == 60 and copula.rows == 60
    plan = sample_copula(spark, copula)._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp" not in plan[plan.index("Join") :]
    rows, made = _counted(spark)
    df = rows.selectExpr("i % 7 * 1D AS v", "'c' || i % 11 AS c", "'d' || i % 3 AS d")
    assert generate_and_validate(spark, df, ["c", "d"])[1].first()["n_original"] == 60
    assert made.value == 60


def test_company_report_reads_its_input_once(spark):
    from portolan.plans.company import company_report

    rows, made = _counted(spark)
    df = rows.selectExpr(
        "lpad(i % 3, 14, '0') AS cnpj", "'N' || i % 3 AS razao_social", "'n' || i % 4 AS ncm", "if(i % 5 = 0, null, 'BR') AS pais_origem", "'SP' AS uf",
        "if(i = 3, '9999', if(i = 4, 'n/d', cast(i % 10 AS string))) AS vmle_dolar", "0.5D AS score", "cast(i % 2 AS int) AS suspeito",
    )
    got = {r["cnpj"][-1]: r for r in company_report(df).collect()}
    assert made.value == 60
    assert [got[c]["total_registros"] for c in "012"] == [20, 20, 20] and got["0"]["paises_distintos"] == 1
    assert [got[c]["outliers_encontrados"] for c in "012"] == [1, 0, 0] and got["1"]["ncms_distintos"] == 4


@pytest.mark.parametrize("padded", [False, True])
def test_windows_are_counted_before_they_leave_python(spark, padded):
    """Grams of short, empty and repeated texts equal a plain count, and no row is made for each place of a text."""
    from collections import Counter

    from portolan.operators.ngrams import gram_counts

    texts = ["Abc abc-9", "abcab", "abcab", "z", "", None, "a b c a b d 0"]
    got = gram_counts(spark.createDataFrame([(t,) for t in texts], "t string"), ["t"], padded)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "regexp_extract_all" not in plan
    freq, held = Counter(), Counter()
    for t in texts:
        blob = "".join(c for c in (t or "").lower() if c.isascii() and c.isalnum())
        blob = f" {blob} " if padded and blob else blob
        grams = Counter(blob[i : i + n] for n in (2, 3, 4, 5) for i in range(len(blob) - n + 1))
        freq.update(grams)
        held.update(grams.keys())
    assert {r["gram"]: (r["freq"], r["shared"]) for r in got.collect()} == {g: (n, held[g] > 1) for g, n in freq.items()}


def test_split_cuts_by_prefix(spark):
    """cuts equal ranks taken by a window; no row is shuffled, ranked or sorted for the split itself."""
    rows = spark.range(3000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("y")  # NULL is a label
    ).unionByName(spark.createDataFrame([(9001, 50), (9001, 60), (9001, 60)], "k long, y long"))
    done = topk.stratified_split(rows, "y", ["k"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    order = Window.partitionBy("y").orderBy(hash52(F.col("k")))
    n = F.count(F.lit(1)).over(Window.partitionBy("y"))
    test = (F.rank().over(order) <= F.ceil(F.lit(0.2) * n)) & (n >= 2)
    want = rows.select("k", "y", F.when(test, "test").otherwise("train").alias("split"))
    assert sorted(map(repr, done.collect())) == sorted(map(repr, want.collect()))
    assert {r[0] for r in topk.stratified_split(rows, "y", ["k"], 0.0).select("split").collect()} == {"train"}
    topk.SENT_LABELS, kept = 1, topk.SENT_LABELS  # labels too many to be sent
    try:
        assert sorted(map(repr, topk.stratified_split(rows, "y", ["k"]).collect())) == sorted(map(repr, want.collect()))
    finally:
        topk.SENT_LABELS = kept


def _largest_method(df):
    parts = df._jdf.queryExecution().debug().codegenToSeq()
    return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))


def test_normal_quantile_is_small_code(spark):
    """three draws behind a join were one generated method of 44 KB, which the JVM does not compile."""
    rows = spark.range(10).withColumns({f"u{i}": F.rand(i) for i in range(3)})
    scored = rows.withColumns({f"z{i}": normal_quantile(F.col(f"u{i}")) for i in range(3)})
    assert _largest_method(scored) < 8000


def test_class_weights_do_not_move_rows(spark):
    """a fit reads its weighted table again in each pass; the features were shuffled by label each time."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weighted = balanced_weights(spark.range(100).selectExpr("id % 4 = 0 AS label", "id"), "label")
        weighted.collect()
        assert "SortMergeJoin" not in weighted._jdf.queryExecution().executedPlan().toString()
        assert {(r["label"], round(r["class_weight"], 9)) for r in weighted.collect()} == {(True, 2.0), (False, round(100 / 150, 9))}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_take_one_shuffle(spark):
    """F25 F26 F27: counts came from two scans, one of them sorted by bag, and a join by bag of all rows."""
    rows = spark.createDataFrame(
        [("x", "b a"), ("x", "b a"), ("y", "a a"), ("y", ""), (None, "c"), ("z", None)], "cnpj string, t string"
    )
    bags = attribution.with_bag(rows, F.split("t", " "))
    counts = attribution.complement_counts(bags, "cnpj")
    assert {tuple(r) for r in counts.collect()} == {
        ("a", "x", 2), ("b", "x", 2), ("a", "y", 2), ("", "y", 1), ("c", None, 1)
    }
    assert "Join" not in counts._jdf.queryExecution().sparkPlan().toString()
    assert {tuple(r) for r in attribution.bag_tokens(bags).where("token IS NOT NULL").select("token", "x").collect()} == {
        ("a", 1), ("b", 1), ("a", 2), ("", 1), ("c", 1)
    }


def test_attribution_joins_a_stored_table(spark):
    """rows were shuffled by bag to meet results whose size was not known."""
    rows = spark.createDataFrame([("x", "b a"), ("y", "a c"), ("y", "a c")], "cnpj string, t string")
    bags = attribution.with_bag(rows, F.split("t", " "))
    done = attribution.attribute(bags, attribution.complement_model(attribution.complement_counts(bags, "cnpj")))
    plan = done._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["RES_Previsto"] for r in done.collect()) == ["x", "y", "y"]


def test_selection_orders_few_rows(spark):
    """F14 F24: all rows were sorted by key for a delivery of 50; copies of few keys still give the whole answer."""
    rows = spark.range(5000).selectExpr(
        "concat('k', id % 400) AS chave_item", "CAST(id % 7 AS STRING) AS CNPJ_Previsto",
        "CAST(id * 7919 % 1000 AS DOUBLE) AS CNPJ_Confianca", "CAST(id % 3 AS DOUBLE) AS RiskScore", "false AS Candidato_Valido",
    )
    crowd = spark.range(3000).selectExpr("'top' AS chave_item", "'1' AS CNPJ_Previsto", "2000D AS CNPJ_Confianca", "1D AS RiskScore", "false AS Candidato_Valido")
    for table, few in ((rows, True), (rows.unionByName(crowd), False)):
        best = {}
        for r in table.collect():
            order = (-r["CNPJ_Confianca"], -r["RiskScore"], r["CNPJ_Previsto"], r["chave_item"])
            best[r["chave_item"]] = min(order, best.get(r["chave_item"], order))
        got = select_candidates(table)
        assert [(r["chave_item"], r["CNPJ_Previsto"]) for r in got.collect()] == [(o[3], o[2]) for o in sorted(best.values())[:50]]
        assert ("leading-candidates" in got.inputFiles()[0] if got.inputFiles() else False) == few
    one = table.withColumn("Candidato_Valido", F.col("chave_item") == "k7")
    assert {r["chave_item"] for r in select_candidates(one).collect()} == {"k7"}


def test_tfidf_counts_texts_where_they_lie(spark, monkeypatch):
    """Texts are in no shuffle, the pairs of the vocabulary in one, and parts of a few words count as whole batches do."""
    from collections import Counter

    from portolan.operators import ml

    rows = [(1, "Été aa bb é"), (2, "ete aa"), (2, "bb aa bb"), (None, "aa bb cc"), (3, None), (4, "x"), (5, "cc été cc")]
    df = spark.createDataFrame(rows, "i long, t string").repartition(2)
    words = {1: ["ete", "aa", "bb"], 2: ["ete", "aa", None, "bb", "aa", "bb"], None: ["aa", "bb", "cc"], 5: ["cc", "ete", "cc"]}
    tf = {k: Counter([w for w in t if w] + [f"{a} {b}" for a, b in zip(t, t[1:]) if a and b] + [f"{a} {b} {c}" for a, b, c in zip(t, t[1:], t[2:]) if a and b and c]) for k, t in words.items()}
    total = sum(tf.values(), Counter())
    chosen = sorted(total, key=lambda t: (-total[t], t))[:6]
    idf = {t: math.log((1 + len(rows)) / (1 + sum(t in c for c in tf.values()))) + 1 for t in chosen}
    want = {}
    for k, counts in tf.items():
        raw = {t: (1 + math.log(counts[t])) * idf[t] for t in chosen if counts[t]}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(k, t): v / norm for t, v in raw.items()}
    monkeypatch.setattr(ml, "PART", 2)
    got = ml.tfidf(df, "i", ["t"], most=6, n_max=3)
    assert {(r["i"], r["token"]): r["w"] for r in got.collect()} == pytest.approx(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # tokens are counted as numbers, not as rows of text
    assert ml.tfidf(df.where("i = 4"), "i", ["t"]).count() == 0


def test_margin_models_cache_no_rows_and_equal_one_vs_rest(spark, monkeypatch):
    """The fit never persists a DataFrame; margins and classes are those of OneVsRest."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import DataFrame

    from portolan.operators import ml

    df = spark.range(300).select(
        "id", (F.col("id") % 3).cast("double").alias("label"),
        array_to_vector(F.array((F.col("id") % 3 + F.rand(1)).alias("a"), ((F.col("id") % 3) * (F.col("id") % 3) + F.rand(2)).alias("b"))).alias("features"),
    )
    df = spark.createDataFrame(df.collect(), df.schema).repartition(2)
    rest = OneVsRest(classifier=LinearSVC(regParam=1e-4, maxIter=20, tol=1e-4)).fit(df).transform(df)
    want = {r["id"]: (r["prediction"], list(r["m"])) for r in rest.withColumn("m", vector_to_array("rawPrediction")).collect()}
    kept = []
    real = type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *a: kept.append(1) or real(self, *a))
    assert isinstance(df, DataFrame)
    scored = ml.fit_margin(df).transform(df)
    got = {r["id"]: (r["prediction"], list(r["m"])) for r in scored.withColumn("m", vector_to_array("rawPrediction")).collect()}
    assert not kept and scored.columns == ["id", "label", "features", "rawPrediction", "prediction"]
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()}
    assert all(m == pytest.approx(want[i][1], rel=1e-9) for i, (_, m) in got.items())
