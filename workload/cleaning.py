"""Cleaning, id checks, text features, profiles, category queries."""

from pyspark.sql import functions as F

from portolan.functions.ids import cnpj_format_check, cnpj_is_valid, normalize_cnpj, normalize_id
from portolan.functions.numeric import half_even
from portolan.functions.scoring import REGIONS, region_of_state
from portolan.functions.text import company_name_profile, legal_form, text_blob, text_length, word_count
from portolan.operators import business as b
from portolan.operators import profile as p
from portolan.operators.batches import map_batches, map_values
from portolan.operators.ml import pooled_category
from portolan.operators.ngrams import gram_array, top_grams
from portolan.operators.kpis import IMPORTS as COLS
from portolan.operators.kpis import kpi_char_pattern
from portolan.plans.views import cnpj_candidates, imports, table
from workload.catalog import IMPORTS, INPUT_COLUMNS, blob_sql, grams_sql, he, query

_DV = "(CASE WHEN ({s}) % 11 < 2 THEN 0 ELSE 11 - ({s}) % 11 END)"


def dv_sql(digits: str, weights: tuple[int, ...]) -> str:
    total = " + ".join(f"substring({digits}, {i + 1}, 1)::INTEGER * {w}" for i, w in enumerate(weights))
    return _DV.format(s=total)


W1 = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
W2 = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
STEM = "(lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') || '0001')"
CANDIDATES = f"""stems AS (SELECT *, {STEM} AS stem FROM customer),
firsts AS (SELECT *, stem || {dv_sql("stem", W1)}::VARCHAR AS first13 FROM stems),
fulls AS (SELECT *, first13 || {dv_sql("first13", W2)}::VARCHAR AS full_id FROM firsts),
candidates AS (
  SELECT c_custkey AS chave,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN lpad(c_custkey::VARCHAR, 14, '0')
         WHEN c_mktsegment = 'FURNITURE' THEN substring(full_id, 1, 2) || '.' || substring(full_id, 3, 12)
         WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN NULL
         WHEN c_custkey % 2 = 0 THEN full_id
         ELSE substring(full_id, 1, 13) || ((substring(full_id, 14, 1)::INTEGER + 1) % 10)::VARCHAR END AS cnpj
  FROM fulls
)"""
ONLY_DIGITS = "regexp_replace({}, '\\D', '', 'g')"
NORMAL = "CASE WHEN length({0}) < 14 THEN lpad({0}, 14, '0') ELSE {0} END".format(ONLY_DIGITS.format("cnpj"))


@query(
    "normalize_ids",
    f"""WITH {CANDIDATES} SELECT chave, regexp_replace(trim(cnpj), '\\s+', '', 'g') AS id_limpo, {NORMAL} AS cnpj_normal
    FROM candidates WHERE length({NORMAL}) > 0""",
)
def normalize_ids(spark, d):
    df = cnpj_candidates(spark, d)
    return df.select(
        "chave", normalize_id(F.col("cnpj")).alias("id_limpo"), normalize_cnpj(F.col("cnpj")).alias("cnpj_normal")
    ).where(F.length("cnpj_normal") > 0)


@query(
    "cnpj_check",
    f"""WITH {CANDIDATES}, n AS (SELECT chave, {NORMAL} AS id FROM candidates),
    v AS (SELECT chave, id, {dv_sql("id", W1)} AS d1, {dv_sql("id", W2)} AS d2,
          substring(id, 13, 1)::INTEGER AS e1, substring(id, 14, 1)::INTEGER AS e2,
          id = repeat(substring(id, 1, 1), 14) AS flat FROM n)
    SELECT chave, coalesce(d1 = e1 AND d2 = e2 AND NOT flat, false) AS official,
           coalesce(d1 = e1 AND d1 = e2 AND NOT flat, false) AS as_published FROM v""",
)
def cnpj_check(spark, d):
    return cnpj_candidates(spark, d).select(
        "chave",
        cnpj_is_valid(F.col("cnpj")).alias("official"),
        cnpj_is_valid(F.col("cnpj"), rule="reference").alias("as_published"),
    )


@query(
    "cnpj_mask",
    f"""WITH {CANDIDATES}, n AS (SELECT chave, cnpj, {ONLY_DIGITS.format("cnpj")} AS dg FROM candidates)
    SELECT chave, CASE WHEN length(dg) = 14 THEN dg END AS cnpj_limpo,
      CASE WHEN length(dg) = 14 THEN substring(dg,1,2) || '.' || substring(dg,3,3) || '.' || substring(dg,6,3) || '/' ||
           substring(dg,9,4) || '-' || substring(dg,13,2) ELSE cnpj END AS cnpj_formatado,
      coalesce(length(dg) = 14, false) AS valido,
      CASE WHEN coalesce(length(dg) = 14, false) THEN NULL ELSE 'CNPJ deve ter 14 digitos' END AS erro FROM n""",
)
def cnpj_mask(spark, d):
    df = cnpj_candidates(spark, d).select("chave", cnpj_format_check(F.col("cnpj")).alias("c"))
    return df.select("chave", "c.cnpj_limpo", "c.cnpj_formatado", "c.valido", "c.erro")


@query(
    "legal_form",
    f"""WITH {IMPORTS}, names AS (SELECT DISTINCT razao_social AS r FROM imports)
    SELECT r AS razao_social,
      CASE WHEN upper(r) LIKE '%LTDA%' THEN 'Ltda' WHEN upper(r) LIKE '%S/A%' OR upper(r) LIKE '%SA%' THEN 'S/A'
           WHEN upper(r) LIKE '%EIRELI%' THEN 'EIRELI' WHEN upper(r) LIKE '%ME%' THEN 'ME' ELSE 'DESCONHECIDO' END AS tipo,
      CASE WHEN r LIKE '% LTDA' THEN 'Ltda' WHEN r LIKE '% S/A' THEN 'S/A' WHEN r LIKE '% EIRELI' THEN 'EIRELI'
           WHEN r LIKE '% ME' THEN 'ME' ELSE 'DESCONHECIDO' END AS tipo_palavra,
      len(list_filter(string_split_regex(trim(r), '\\s+'), lambda x: x <> ''))::INTEGER AS palavras,
      length(trim(r))::INTEGER AS tamanho, upper(trim(r)) AS maiuscula FROM names""",
)
def legal(spark, d):
    names = imports(spark, d, ("razao_social",)).distinct()
    out = names.select(
        company_name_profile(F.col("razao_social")).alias("n"), legal_form(F.col("razao_social"), "word").alias("tipo_palavra")
    )
    return out.select("n.razao_social", "n.tipo", "tipo_palavra", "n.palavras", "n.tamanho", "n.maiuscula")


_REGION_CASE = "CASE " + " ".join(
    f"WHEN uf IN ({', '.join(repr(s) for s in states)}) THEN '{region}'" for region, states in REGIONS.items()
) + " ELSE 'Desconhecida' END"


@query(
    "region",
    f"WITH {IMPORTS} SELECT {_REGION_CASE} AS regiao, uf, count(*) AS n FROM imports GROUP BY ALL",
)
def region(spark, d):
    df = imports(spark, d, ("uf",)).groupBy("uf").agg(F.count(F.lit(1)).alias("n"))
    return df.select(region_of_state(F.col("uf")).alias("regiao"), "uf", "n")


@query(
    "freq_encode",
    f"""WITH {IMPORTS}, f AS (SELECT uf, count(*)::DOUBLE / (SELECT count(uf) FROM imports) AS freq FROM imports GROUP BY uf)
    SELECT chave_item, {he("coalesce(freq, 0)", 9)} AS FE_Freq_uf FROM imports LEFT JOIN f USING (uf)""",
)
def freq(spark, d):
    df = b.frequency_encode(imports(spark, d, ("chave_item", "uf")), "uf")
    return df.select("chave_item", half_even(F.col("FE_Freq_uf"), 9).alias("FE_Freq_uf"))


@query(
    "text_features",
    f"""SELECT doc_id, length(text)::INTEGER AS FE_Len_text,
    len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> ''))::INTEGER AS FE_Words_text,
    md5({blob_sql("text")}) AS blob_md5 FROM documents""",
)
def text_features(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        text_length(text).alias("FE_Len_text"),
        word_count(text).alias("FE_Words_text"),
        F.md5(text_blob(text)).alias("blob_md5"),
    )


_PROFILE_COLUMNS = (
    "chave_item", "cnpj", "razao_social", "ncm", "descricao", "vmle_dolar", "peso_liquido", "eta_real", "pais_origem", "uf",
    "suspeito",
)
_TYPES = {"peso_liquido": "double", "eta_real": "timestamp_ntz", "suspeito": "int"}


def _profile_sql(extra: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, '{_TYPES.get(c, 'string')}' AS dtype, count(*) AS n, count({c}) AS filled, "
        f"count(DISTINCT {c}) AS unicos{extra.format(c=c)} FROM imports"
        for c in _PROFILE_COLUMNS
    )


@query(
    "column_profile",
    f"""WITH {IMPORTS}, p AS ({_profile_sql("")})
    SELECT coluna, dtype, {he("filled::DOUBLE / n", 4)} AS completude, unicos,
    {he("(n - filled)::DOUBLE / n", 4)} AS taxa_nulos, {he("unicos::DOUBLE / greatest(n, 1)", 4)} AS cardinalidade FROM p""",
)
def column_profile(spark, d):
    return p.column_profile(imports(spark, d, _PROFILE_COLUMNS))


_ROLE_EXTRA = (
    ", avg(CASE WHEN {c} IS NOT NULL THEN (length(regexp_replace({c}::VARCHAR, '\\D', '', 'g')) BETWEEN 8 AND 20)::INTEGER END) AS digit_share"
    ", count(try_cast({c}::VARCHAR AS DOUBLE))::DOUBLE / count(*) AS number_share"
)


@query(
    "column_roles",
    f"""WITH {IMPORTS}, p AS ({_profile_sql(_ROLE_EXTRA)})
    SELECT coluna, CASE WHEN coluna = 'chave_item' THEN 'ignorar'
      WHEN 1 - filled::DOUBLE / n > 0.95 OR unicos <= 1 THEN 'ignorar'
      WHEN dtype = 'timestamp_ntz' THEN 'temporais'
      WHEN coalesce(digit_share, 0) > 0.7 AND unicos > 0.5 * n THEN 'ignorar'
      WHEN number_share > 0.7 THEN CASE WHEN unicos < 20 THEN 'categoricas' ELSE 'numericas' END
      WHEN unicos < 50 THEN 'categoricas' ELSE 'texto' END AS papel, unicos FROM p""",
)
def column_roles(spark, d):
    return p.column_roles(imports(spark, d, _PROFILE_COLUMNS), "chave_item").select("coluna", "papel", "unicos")


_NARROW = {"p_partkey": "bigint", "p_size": "int", "p_retailprice": "double"}


def _int_case(c: str) -> str:
    return f"""CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767
    THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END"""


@query(
    "type_narrow",
    f"""SELECT 'p_partkey' AS coluna, 'bigint' AS de, {_int_case("p_partkey")} AS para FROM part
    UNION ALL SELECT 'p_size', 'int', {_int_case("p_size")} FROM part
    UNION ALL SELECT 'p_retailprice', 'double', CASE WHEN bool_and(p_retailprice::FLOAT::DOUBLE = p_retailprice) THEN 'float' ELSE 'double' END FROM part
    UNION ALL SELECT 'p_name', 'string', 'string' FROM part LIMIT 4""",
)
def type_narrow(spark, d):
    return p.narrow_types(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name"))


_FILLED = " + ".join(f"count({c})" for c in INPUT_COLUMNS)


@query(
    "quality_kpis",
    f"""WITH {IMPORTS}, t AS (SELECT {", ".join(INPUT_COLUMNS)} FROM imports)
    SELECT count(*) AS total_linhas, {len(INPUT_COLUMNS)} AS total_colunas,
      {he(f"({_FILLED})::DOUBLE / (count(*) * {len(INPUT_COLUMNS)}::DOUBLE)", 4)} AS completude_media,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS linhas_duplicadas,
      count(DISTINCT cnpj) AS cnpj_unicos, {he("(count(*) - count(DISTINCT cnpj))::DOUBLE / count(*)", 4)} AS taxa_duplicacao
    FROM t""",
)
def quality(spark, d):
    return b.quality_kpis(imports(spark, d), "cnpj")


@query(
    "category_truncate",
    f"""WITH {IMPORTS}, c AS (SELECT coalesce(ncm, '__NA__') AS category, count(*) AS n FROM imports GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS rn FROM c),
    g AS (SELECT CASE WHEN rn <= 500 THEN category ELSE '__OUTROS__' END AS category, sum(n)::BIGINT AS n FROM r GROUP BY 1)
    SELECT category, n, {he("n::DOUBLE / (SELECT count(*) FROM imports)", 9)} AS share FROM g""",
)
def category_truncate(spark, d):
    out = b.truncated_categories(imports(spark, d, ("ncm",)), "ncm")
    return out.withColumn("share", half_even(F.col("share"), 9))


@query(
    "rare_codes",
    f"""WITH {IMPORTS}, c AS (SELECT *, ncm || '-' || uf AS codigo FROM imports)
    SELECT codigo, any_value(vmle_dolar) AS vmle_dolar, any_value(descricao) AS descricao FROM c GROUP BY codigo HAVING count(*) = 1""",
)
def rare(spark, d):
    df = imports(spark, d, ("ncm", "uf", "vmle_dolar", "descricao")).withColumn("codigo", F.concat_ws("-", "ncm", "uf"))
    return b.rare_codes(df, "codigo", ["vmle_dolar", "descricao"])


@query(
    "value_counts",
    f"WITH {IMPORTS} SELECT pais_origem, count(*) AS n FROM imports GROUP BY pais_origem",
)
def value_counts(spark, d):
    return b.counts_of(imports(spark, d, ("pais_origem",)), "pais_origem")


@query(
    "pooled_categories",
    f"""WITH {IMPORTS}, c AS (SELECT ncm || '-' || uf AS codigo FROM imports),
    k AS (SELECT codigo FROM c GROUP BY 1 HAVING count(*) >= 2)
    SELECT CASE WHEN codigo IN (SELECT codigo FROM k) THEN codigo ELSE '__RARE__' END AS codigo, count(*) AS n FROM c GROUP BY 1""",
)
def pooled(spark, d):
    df = imports(spark, d, ("ncm", "uf")).select(F.concat_ws("-", "ncm", "uf").alias("codigo"))
    return b.counts_of(pooled_category(df, "codigo"), "codigo")


@query(
    "cap_classes",
    f"""WITH {IMPORTS}, top AS (SELECT cnpj FROM imports GROUP BY cnpj ORDER BY count(*) DESC, cnpj LIMIT 1000)
    SELECT cnpj, count(*) AS n FROM imports WHERE cnpj IN (SELECT cnpj FROM top) GROUP BY cnpj""",
)
def cap(spark, d):
    return b.counts_of(b.cap_classes(imports(spark, d, ("cnpj",)), "cnpj", 1000), "cnpj")


@query(
    "known_classes",
    f"""WITH {IMPORTS} SELECT pais_origem, count(*) AS n FROM imports
    WHERE cnpj IN (SELECT lpad(c_custkey::VARCHAR, 14, '0') FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""",
)
def known(spark, d):
    classes = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
    classes = classes.select(F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("cnpj"))
    return b.counts_of(b.known_classes(imports(spark, d, ("cnpj", "pais_origem")), classes, "cnpj"), "pais_origem")


@query("char_ngrams", f"WITH {grams_sql('documents', 'text')} SELECT gram, freq FROM top_grams")
def char_ngrams(spark, d):
    return top_grams(table(spark, d, "documents"), ["text"])


@query(
    "char_score",
    f"""WITH {grams_sql("documents", "text")}
    SELECT doc_id, {he(f"least((SELECT count(*) FROM top_grams WHERE contains({blob_sql('text')}, gram))::DOUBLE / 10::DOUBLE, 1)", 4)} AS KPI_PadraoChar
    FROM documents""",
)
def char_score(spark, d):
    docs = table(spark, d, "documents")
    grams = gram_array(top_grams(docs, ["text"]))
    return kpi_char_pattern(docs, grams, COLS.with_names(text=("text",))).select("doc_id", "KPI_PadraoChar")


@query(
    "batch_udf",
    f"""WITH {IMPORTS} SELECT chave_item, {he("score * peso_liquido", 6)} AS produto FROM imports""",
)
def batch_udf(spark, d):
    df = imports(spark, d, ("chave_item", "score", "peso_liquido"))

    def product(pdf):
        return pdf.assign(produto=((pdf["score"] * pdf["peso_liquido"]) * 1e6).round() / 1e6)[["chave_item", "produto"]]

    return map_batches(df, product, "chave_item string, produto double")


@query("element_udf", "SELECT doc_id, length(text)::BIGINT AS tamanho FROM documents")
def element_udf(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", map_values(F.col("text"), lambda s: s.str.len(), "long").alias("tamanho")
    )


_CODES = {"a": "descricao", "b": "pais_origem", "c": "ncm", "d": "cnpj"}
_SHARES = ", ".join(f"avg((length(regexp_replace({c}, '\\D', '', 'g')) BETWEEN 6 AND 20)::INTEGER) AS {n}" for n, c in _CODES.items())


@query(
    "id_column",
    f"""WITH {IMPORTS}, s AS (SELECT {_SHARES} FROM imports)
    SELECT CASE {" ".join(f"WHEN {n} > 0.8 THEN '{n}'" for n in _CODES)} END AS coluna, {", ".join(he(n, 6) + f" AS {n}" for n in _CODES)} FROM s""",
)
def id_column(spark, d):
    rows = imports(spark, d, tuple(_CODES.values())).select(*[F.col(c).alias(n) for n, c in _CODES.items()])
    shares = p.digit_shares(rows).select(*[half_even(F.col(n), 6).alias(n) for n in _CODES])
    return shares.withColumn("coluna", F.lit(p.find_id_column(rows)))
