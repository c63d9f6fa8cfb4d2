"""Sources, sinks and lots."""

import json

import pytest
from pyspark.sql import functions as F

from portolan.functions.ids import digits_only
from portolan.functions.numeric import lenient_double
from portolan.operators.history import session_pattern
from portolan.operators.profile import DIGIT_LIKE, NUMBER_START, chosen_columns, column_roles, find_id_column, narrowed
from portolan.sinks import writers as w
from portolan.sources import files as s
from portolan.streaming import lots


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" CNPJ ;x\n1-2;one\n3;two\n")
    spark.createDataFrame([("2", "k", 5), ("00000000000012", "m", 6)], "CNPJ string, x string, y int").write.parquet(
        str(tmp_path / "b.parquet")
    )
    (tmp_path / "c.txt").write_text("see 11.222.333/0001-81 and 00000000000191.")
    return str(tmp_path)


def test_folder_as_one_table(spark, folder):
    df = s.read_folder(spark, folder, "CNPJ")
    assert df.count() == 6 and {"arquivo", "CNPJ", "x", "y", "TextoPDF"} == set(df.columns)
    assert {r["CNPJ"] for r in df.where("arquivo = 'c.txt'").collect()} == {"11222333000181", "00000000000191"}


def test_progressive_merge_and_report(spark, folder):
    merged, report = s.merge_folder(spark, folder)
    rows = {r["CNPJ"]: r for r in merged.collect()}
    assert rows["00000000000012"]["x"] == "one" and rows["00000000000012"]["y"] == 6
    assert rows["00000000000002"]["x"] is None and len(rows) == 5
    assert {(r["arquivo"], r["tipo"], r["linhas"]) for r in report.collect()} == {
        ("a.csv", "csv", 2), ("b.parquet", "parquet", 2), ("c.txt", "txt", 2),
    }


def test_registered_views(spark, folder, tmp_path):
    df = s.register_auto(spark, "v_auto", folder)
    assert "filename" in df.columns and spark.table("v_auto").count() == 2
    csv = s.register_csv(spark, "v_csv", f"{folder}/a.csv")
    assert csv.count() == 2
    assert s.register_auto(spark, "v_file", f"{folder}/a.csv").count() == 2
    assert s.sniff_delimiter(spark, f"{folder}/a.csv") == ";"


def test_pairs(spark, tmp_path):
    path = tmp_path / "pairs.list"
    path.write_text("# list\n\n12;A; B\nbroken\n")
    good, bad = s.read_pairs(spark, str(path))
    assert [tuple(r) for r in good.collect()] == [("12", "A; B")] and [r[0] for r in bad.collect()] == ["broken"]


def test_history(spark, tmp_path):
    assert s.read_history(spark, str(tmp_path / "none")).count() == 0
    runs = [{"timestamp": f"2024-01-0{i}", "metricas": {"accuracy": 0.1 * i}, "kpis_medio_top10": {"K": 0.9}} for i in range(1, 5)]
    (tmp_path / "h.json").write_text(json.dumps(runs))
    sessions = s.read_history(spark, str(tmp_path / "h.json"))
    row = session_pattern(s.for_pattern(sessions)).first()
    assert (row["sessoes_analisadas"], row["tendencia"], row["kpis_recorrentes"]) == (4, "melhora", "K")
    w.append_session(sessions, str(tmp_path / "log"))
    w.append_session(sessions.limit(1), str(tmp_path / "log"))
    assert s.read_history(spark, str(tmp_path / "log")).count() == 5
    assert session_pattern(s.for_pattern(sessions.limit(2))).first()["aviso"] == "Historico curto (2 sessoes)."


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 10.0, "BAIXO"), ("b", 90.0, "CRITICO")], "k string, RiskScore double, RiskLevel string")
    path = str(tmp_path / "out")
    w.export_parquet(df, path)
    assert sorted(spark.read.parquet(path).collect()) == sorted(df.collect())
    w.write_top_risk(df, path + "-top", ["k"], 1)
    assert spark.read.parquet(path + "-top").first()["k"] == "b"
    w.write_batch(df, path + "-lots", 3)
    w.write_batch(df, path + "-lots", 3)
    assert spark.read.parquet(path + "-lots").count() == 2
    w.write_report(df.limit(1), path + "-json")
    assert spark.read.json(path + "-json").count() == 1
    w.write_profile(df, path + "-csv")
    assert spark.read.option("header", True).csv(path + "-csv").count() == 2
    w.append_events(df, path + "-events")
    w.append_events(df, path + "-events")
    assert spark.read.json(path + "-events").count() == 4
    names = spark.createDataFrame([("11222333000181", "X LTDA"), ("12", "Y")], "cnpj string, razao_social string")
    w.write_text_report(names, path + "-text")
    lines = [r[0] for r in spark.read.text(path + "-text").collect()]
    assert any("INVALIDO" in x for x in lines) and any("11.222.333/0001-81" in x for x in lines)


def test_lots_resume_without_loss_or_repeats(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    score = lambda df: df.withColumn("s", F.col("v") + 1)

    def run():
        lots.score_lots(lots.open_folder(spark, source, rows.schema), score, out, state)

    rows.where("id < 50").repartition(2).write.mode("append").parquet(source)
    run()
    first = lots.read_lots(spark, out)
    assert first.count() == 50 and first.select("Lote").distinct().count() == 2
    rows.where("id >= 50").coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    done = lots.read_lots(spark, out)
    assert sorted(r["s"] for r in done.collect()) == [2 * i + 1 for i in range(100)]
    assert done.agg(F.max("Lote")).first()[0] == 2


def test_id_column_and_roles(spark):
    df = spark.createDataFrame([("11222333000181", "a", None, "1.5")] * 30, "doc string, t string, e string, n string")
    assert find_id_column(df) == "doc" and find_id_column(df, short=True) == "doc"
    assert find_id_column(df.withColumnRenamed("t", "codigo")) == "codigo"
    varied = spark.range(100).select(
        F.lpad(F.col("id").cast("string"), 14, "1").alias("cnpj"),
        F.concat(F.lit("w"), F.col("id")).alias("texto"),
        (F.col("id") * 1.5).cast("string").alias("valor"),
        (F.col("id") % 3).cast("string").alias("grupo"),
        F.lit(None).cast("string").alias("vazio"),
    )
    chosen = chosen_columns(column_roles(varied, "cnpj"))
    assert chosen == {
        "texto": ["texto"], "categoricas": ["grupo"], "numericas": ["valor"], "temporais": [], "ignorar": ["cnpj", "vazio"],
    }


def test_narrowed(spark):
    df = spark.range(10).select("id", (F.col("id") * 40000).alias("big"), (F.col("id") / 3).alias("d"), (F.col("id") / 2).alias("f"))
    assert dict(narrowed(df).dtypes) == {"id": "tinyint", "big": "int", "d": "double", "f": "float"}


def test_arrow_batches_keep_every_row(spark):
    from portolan.operators.batches import map_arrow

    df = map_arrow(spark.range(2500).select(F.col("id").alias("n")), lambda batch: batch, "n long")
    assert df.count() == 2500 and df.agg(F.sum("n")).first()[0] == 2499 * 1250


def test_roles_parse_only_what_can_be_a_number_and_move_no_names(spark):
    odd = ["1", " -2.5", "+.5e3", "0x1p3", "1d", "\t7\n", "inf", "-Infinity", "NaN", "", " ", "n/d", "1-2", "e5", "x1", None]
    rows = [(f"{i}-{i}", v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "chave string, v string")
    by_cast = spark.createDataFrame(rows, "chave string, v string").where("try_cast(v AS double) IS NOT NULL AND NOT isnan(try_cast(v AS double))")
    number = F.col("v").rlike(NUMBER_START) & lenient_double("v").isNotNull()
    assert {r["v"] for r in df.where(number).collect()} == {r["v"] for r in by_cast.collect()}
    texts = ["1" * 7, "1" * 8, "a1b" * 8, "1" * 20, "1" * 21, "", "x", "1234\n5678\n", "٣" * 9]
    held = spark.createDataFrame([(t,) for t in texts], "v string")
    same = held.where(F.col("v").rlike(DIGIT_LIKE) != F.length(digits_only(F.col("v"))).between(8, 20))
    assert same.count() == 0
    roles = column_roles(df, "chave")
    keys = [line for line in roles._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert keys and not any("column" in line or "dtype" in line for line in keys)
    assert {r["coluna"]: (r["papel"], r["unicos"], r["rows"]) for r in roles.collect()}["v"] == ("categoricas", 15, 16)
