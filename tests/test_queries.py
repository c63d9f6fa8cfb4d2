"""Every registered query against its SQL twin, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    got_names, got = canonical([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(SQL[name])
    want_names, want = canonical(result.fetchall(), [d[0] for d in result.description])
    assert got_names == want_names
    assert got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["lof_blocks", "risk_with_outliers", "copula_sample", "auto_calibrate", "neural_model", "base_run"])
def test_query_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "chave_item" and df.count() == 6000


@pytest.mark.parametrize("name", ["strat_split", "capped_sample", "subvalorizacao", "lof_blocks", "dcr", "company_report"])
def test_result_does_not_depend_on_partitions(spark, small, name):
    def run(width):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        df = QUERIES[name](spark, small)
        return canonical([tuple(r) for r in df.collect()], df.columns)

    try:
        assert run("1") == run("7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
