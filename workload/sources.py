"""Sources over the given files and texts."""

from pyspark.sql import functions as F

from portolan.functions.ids import BARE_ID, FORMATTED_ID, ids_in_text
from portolan.sources import files as s
from portolan.plans.views import imports, table
from workload.catalog import IMPORTS, he, query

_TABLES = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
}


@query(
    "ingest_report",
    " UNION ALL ".join(
        f"""SELECT '{n}.parquet' AS arquivo, 'parquet' AS tipo, count(*) AS linhas, {len(c)} AS colunas,
        substring(md5('{",".join(c)}'), 1, 10) AS hash_header,
        {he(f"({' + '.join(f'count({x})' for x in c)})::DOUBLE / (count(*) * {len(c)}::DOUBLE)", 4)} AS completude FROM {n}"""
        for n, c in _TABLES.items()
    ),
)
def ingest(spark, d):
    return s.ingest_report([(f"{n}.parquet", "parquet", table(spark, d, n)) for n in _TABLES])


@query(
    "register_parquet",
    "SELECT 'lineitem.parquet' AS arquivo, count(*) AS linhas, count(DISTINCT l_orderkey) AS pedidos FROM lineitem",
)
def register(spark, d):
    df = s.register_parquet(spark, "itens_registrados", f"{d}/line*.parquet")
    name = F.regexp_extract("filename", r"[^/]+$", 0)
    return df.groupBy(name.alias("arquivo")).agg(
        F.count(F.lit(1)).alias("linhas"), F.countDistinct("l_orderkey").alias("pedidos")
    )


@query(
    "rows_per_file",
    "SELECT 'orders.parquet' AS arquivo, count(*) AS linhas FROM orders",
)
def rows_per_file(spark, d):
    return s.rows_per_file(table(spark, d, "orders"))


_FMT = FORMATTED_ID.replace("\\", "\\")
_CLEAN = "regexp_replace(m, '\\D', '', 'g')"
_PAD = f"CASE WHEN length({_CLEAN}) < 14 THEN lpad({_CLEAN}, 14, '0') ELSE {_CLEAN} END"


def _found_sql(text: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda m: {_PAD})"


def _once(expr: str) -> str:
    """Keep the first of equal entries, in order."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


_ALL = f"list_concat({_found_sql('text', _FMT)}, {_found_sql('text', BARE_ID)})"
_BODIES = "bodies AS (SELECT 'documents' AS origem, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages)"


def _bodies(spark, d):
    docs = table(spark, d, "documents").select(F.lit("documents").alias("origem"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, d, "pages").select(F.lit("pages").alias("origem"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages)


@query(
    "extract_ids",
    f"""WITH {_BODIES}, f AS (SELECT origem, id, text, {_once("found")} AS ids FROM (SELECT origem, id, text, {_ALL} AS found FROM bodies))
    SELECT origem, id, (i - 1)::INTEGER AS pos, ids[i] AS cnpj, length(text)::INTEGER AS tamanho
    FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM f)""",
)
def extract(spark, d):
    rows = s.text_rows(_bodies(spark, d), "text", ["origem", "id"])
    return rows.select("origem", "id", "pos", "cnpj", F.length("texto").alias("tamanho"))


_VARIANTS = {
    "pdf_v2": _found_sql("text", _FMT),
    "txt_v2": _found_sql("text", "\\d{14}"),
    "capture": f"list_concat({_found_sql('digits', chr(92) + 'd{14}')}, {_found_sql('text', _FMT)})",
    "capture_v3": f"list_concat({_found_sql('digits', BARE_ID)}, {_found_sql('text', _FMT)})",
}


def _variant_sql(name: str, expr: str) -> str:
    found = f"SELECT origem, id, {expr} AS found FROM digit_bodies"
    kept = "found" if name.endswith("v2") else _once("found")
    return f"SELECT origem, id, '{name}' AS variante, len({kept})::INTEGER AS achados, array_to_string({kept}, ',') AS ids FROM ({found}) WHERE len(found) > 0"


@query(
    "captured_ids",
    f"""WITH {_BODIES}, digit_bodies AS (SELECT *, regexp_replace(text, '\\D', '', 'g') AS digits FROM bodies)
    {" UNION ALL ".join(_variant_sql(n, e) for n, e in _VARIANTS.items())}""",
)
def captured(spark, d):
    bodies = _bodies(spark, d)
    cells = F.array(
        *[F.struct(F.lit(v).alias("variante"), ids_in_text(F.col("text"), v).alias("ids")) for v in _VARIANTS]
    )
    return (
        bodies.select("origem", "id", F.explode(cells).alias("c"))
        .select("origem", "id", "c.variante", F.size("c.ids").alias("achados"), F.array_join("c.ids", ",").alias("ids"))
        .where(F.col("achados") > 0)
    )


@query(
    "paired_list",
    f"""WITH {IMPORTS} SELECT DISTINCT cnpj, razao_social FROM imports WHERE razao_social LIKE '% LTDA' OR razao_social LIKE '% ME'""",
)
def paired(spark, d):
    names = imports(spark, d, ("cnpj", "razao_social")).distinct()
    named = F.col("razao_social").endswith(" LTDA") | F.col("razao_social").endswith(" ME")
    lines = names.select(
        F.when(named, F.concat_ws(";", "cnpj", "razao_social"))
        .when(F.col("razao_social").endswith("S/A"), F.concat(F.lit("# "), F.col("razao_social")))
        .otherwise(F.col("razao_social"))
        .alias("value")
    )
    return s.paired_lines(lines)[0]
