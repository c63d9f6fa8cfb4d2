"""Lots that guess by what earlier lots hold: restarts in mid-lot, first lots, rows without a label or text."""

import pytest
from pyspark.sql import functions as F

from portolan.functions.text import word_tokens
from portolan.operators.attribution import attribute, complement_counts, complement_model, with_bag
from portolan.plans import views
from portolan.streaming import lots
from workload import streams

SCHEMA = "id int, cnpj string, descricao string"
LOTS = [
    [(1, "a", "red steel pipe"), (2, "b", "green tea"), (3, None, "red pipe")],
    [(4, "a", "steel pipe"), (5, "c", "black tea leaves"), (6, "b", None), (4, "a", "steel pipe")],
    [(7, "c", "tea leaves"), (8, "b", ""), (9, "a", "unheard words")],
]


def prepare(rows):
    return with_bag(rows, word_tokens(F.col("descricao")))


class Folders:
    def __init__(self, root):
        self.source, self.output, self.counts, self.state = (str(root / n) for n in ("in", "out", "counts", "state"))

    def arrive(self, spark, i):
        spark.createDataFrame(LOTS[i], SCHEMA).repartition(2).write.mode("append").parquet(self.source)

    def run(self, spark):
        stream = lots.open_folder(spark, self.source, SCHEMA, files_per_lot=100)
        lots.predict_lots(stream, prepare, "cnpj", self.output, self.counts, self.state)

    def rows(self, spark):
        out = lots.read_lots(spark, self.output)
        return sorted(map(str, out.select("id", "lote", "RES_Previsto", "RES_Confianca", "RES_Top2", "Modelo").collect()))

    def learned(self, spark):
        return {(r["token"], r["class"]): r["n"] for r in lots.trained_counts(spark, self.counts).collect()}


def test_a_lot_that_fails_halfway_runs_again_whole(spark, tmp_path, monkeypatch):
    calm, broken = Folders(tmp_path / "calm"), Folders(tmp_path / "broken")
    for i in range(3):
        calm.arrive(spark, i)
        calm.run(spark)
    write = lots.write_batch

    def fail_before_counts(df, path, lot):
        if path == broken.counts and lot == 1:
            raise RuntimeError("lost")
        write(df, path, lot)

    def fail_after_counts(df, path, lot):
        write(df, path, lot)
        if path == broken.counts and lot == 2:
            raise RuntimeError("lost")

    broken.arrive(spark, 0)
    broken.run(spark)
    for i, fault in ((1, fail_before_counts), (2, fail_after_counts)):
        broken.arrive(spark, i)
        monkeypatch.setattr(lots, "write_batch", fault)
        with pytest.raises(Exception, match="lost"):
            broken.run(spark)
        monkeypatch.setattr(lots, "write_batch", write)
        broken.run(spark)
    assert broken.rows(spark) == calm.rows(spark)
    assert broken.learned(spark) == calm.learned(spark)
    assert len(calm.rows(spark)) == sum(map(len, LOTS))
    assert all("RES_Previsto=None" in r and "Modelo=None" in r for r in calm.rows(spark) if "lote=0" in r)
    # The second lot is guessed by the first alone; a row without a label taught nothing.
    first = prepare(spark.createDataFrame(LOTS[0][:2], SCHEMA))
    want = attribute(prepare(spark.createDataFrame(LOTS[1], SCHEMA)), complement_model(complement_counts(first, "cnpj")))
    guesses = lambda df: sorted(map(str, df.select("id", "RES_Previsto", "RES_Confianca").collect()))
    assert guesses(lots.read_lots(spark, calm.output).where("lote = 1")) == guesses(want)
    assert calm.learned(spark)[("pipe", "a")] == 3


def test_candidates_are_the_guessed_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "a", 0.5)], "id int, RES_Previsto string, RES_Confianca double")
    assert [tuple(r) for r in lots.guessed_candidates(rows).collect()] == [(2, "a", 0.5)]


def test_status_comes_with_the_orders_and_only_line_keys_arrive(spark, small, monkeypatch):
    columns = ("chave_item", "cnpj", "descricao")
    want = views.imports(spark, small, columns).join(views.registry(spark, small).select("cnpj", "ext_situacao"), "cnpj", "left")
    got = views.imports(spark, small, (*columns, "ext_situacao"), orders=views.registered_orders(spark, small))
    text = lambda df: sorted(map(str, df.select(*columns, "ext_situacao").collect()))
    assert text(got) == text(want)
    assert {r[0] for r in got.select("ext_situacao").distinct().collect()} >= {None, "ATIVA"}
    arrived = []
    open_folder = lots.open_folder
    monkeypatch.setattr(lots, "open_folder", lambda s, path, schema, **kw: arrived.append(schema.names) or open_folder(s, path, schema, **kw))
    assert streams.predicted(spark, small).count() == views.table(spark, small, "lineitem").count()
    assert arrived == [list(streams._LINE_KEYS)] * 3


def test_tokens_of_a_bag_are_sorted_as_before(spark):
    rows = spark.createDataFrame([(["é", "z", "a", "B", "a"],), ([],), (None,)], "w array<string>")
    old = rows.select(F.array_sort("w").alias("t")).select("t", F.md5(F.array_join("t", " ")).alias("b"))
    assert sorted(map(str, with_bag(rows, F.col("w")).select(F.col("tokens").alias("t"), F.col("bag").alias("b")).collect())) == sorted(map(str, old.collect()))
