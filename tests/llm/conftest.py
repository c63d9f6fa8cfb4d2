import duckdb
import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def given(small):
    return f"{small}/documents.parquet"


@pytest.fixture(scope="session")
def rows(given):
    return duckdb.sql(f"SELECT doc_id, text FROM '{given}' ORDER BY doc_id").fetchall()


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names the operators use themselves."""

    def make(pairs):
        schema = T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long, row string, sha string, kept string, n_tokens string, th string")
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "r", "x", "k", "n", "t") for i, t in pairs], schema)

    return make


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "one two"), (None, None), (6, "the cat " * 3000), (7, "x" * 20000), (8, "a\x1cb\xa0c d")]


@pytest.fixture
def odd():
    return list(ODD)
