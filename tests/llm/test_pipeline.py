"""The stages together: each against what its operator decides on its own input."""

import corpus_pipeline
from portolan.llm import exact_dedup, jaccard_join, quality_rules


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near duplicates", "secret scan", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
            break
        assert out.columns == columns
        ids = sorted(r["doc_id"] for r in rows)
        if name == "quality rules":
            judged = quality_rules.judge(docs, spark.read.parquet(f"{small}/labels.parquet")).where("kept")
            want = sorted(r["doc_id"] for r in judged.collect())
        elif name == "exact dedup":
            want = sorted(r["doc_id"] for r in exact_dedup.group_copies(docs).where("kept").collect())
        elif name == "near duplicates":
            want = sorted({r["class_id"] for r in jaccard_join.near_duplicates(docs).collect()})
        else:
            want = sorted(r["doc_id"] for r in docs.collect())
            changed = [r for r in rows if "[secret]" in r["text"]]
            assert all(r["n_chars"] == len(r["text"]) for r in changed)
        assert ids == want, name
        docs = spark.createDataFrame(rows, out.schema)


def test_stages_on_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0
        docs = out if set(docs.columns) <= set(out.columns) and "text" in out.columns else docs


def test_run_equals_the_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    pieces = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, small)) == pieces(docs)
