"""Registry joins, cache upkeep, provider records, set operations."""

from pyspark.sql import functions as F

from portolan.functions.numeric import half_even
from portolan.operators import registry as r
from portolan.plans.views import AS_OF, imports, provider_answers, registry, table
from workload.catalog import IMPORTS, OPENED, REGISTRY, STATES, STATUSES, age_sql, credit_sql, he, pick, query


@query(
    "registry_join",
    f"""WITH {IMPORTS}, {REGISTRY} SELECT i.chave_item, i.cnpj, i.uf, r.ext_situacao, r.ext_idade, r.uf AS uf_ext
    FROM imports i LEFT JOIN (SELECT *, ext_uf AS uf FROM registry) r ON i.cnpj = r.cnpj""",
)
def registry_join(spark, d):
    reg = registry(spark, d).select("cnpj", "ext_situacao", "ext_idade", F.col("ext_uf").alias("uf"))
    return r.join_registry(imports(spark, d, ("chave_item", "cnpj", "uf")), reg).select(
        "chave_item", "cnpj", "uf", "ext_situacao", "ext_idade", "uf_ext"
    )


@query(
    "missing_keys",
    f"""WITH {IMPORTS}, {REGISTRY} SELECT DISTINCT cnpj FROM imports WHERE cnpj NOT IN (SELECT cnpj FROM registry)""",
)
def missing(spark, d):
    return r.missing_keys(imports(spark, d, ("cnpj",)), registry(spark, d))


@query(
    "enrichment_counts",
    f"""WITH {IMPORTS}, {REGISTRY}, k AS (SELECT DISTINCT cnpj FROM imports),
    m AS (SELECT count(*) AS missing FROM k WHERE cnpj NOT IN (SELECT cnpj FROM registry))
    SELECT (SELECT count(*) FROM k) AS cnpjs, missing, least(missing, 100) AS charged FROM m""",
)
def counts(spark, d):
    return r.enrichment_counts(imports(spark, d, ("cnpj",)), registry(spark, d), "cnpj", 100)


@query(
    "registry_upsert",
    f"""WITH {REGISTRY}, fresh AS (SELECT lpad(c_custkey::VARCHAR, 14, '0') AS cnpj, 'NOVA' AS ext_situacao, c_acctbal AS ext_capital
      FROM customer WHERE c_acctbal < 1000),
    u AS (SELECT cnpj, ext_situacao, ext_capital, ext_uf, 0 AS s FROM registry UNION ALL SELECT cnpj, ext_situacao, ext_capital, NULL, 1 FROM fresh)
    SELECT cnpj, ext_situacao, {he("ext_capital", 2)} AS ext_capital, ext_uf FROM u QUALIFY row_number() OVER (PARTITION BY cnpj ORDER BY s DESC) = 1""",
)
def upsert(spark, d):
    old = registry(spark, d).select("cnpj", "ext_situacao", "ext_capital", "ext_uf")
    fresh = table(spark, d, "customer").where(F.col("c_acctbal") < 1000).select(
        F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("cnpj"),
        F.lit("NOVA").alias("ext_situacao"),
        F.col("c_acctbal").alias("ext_capital"),
    )
    return r.upsert(old, fresh).withColumn("ext_capital", half_even(F.col("ext_capital"), 2))


_KEY = "lpad(c_custkey::VARCHAR, 14, '0')"
_BASIC = f"""basic AS (SELECT {_KEY} AS cnpj, c_name AS EXT_RazaoSocial, {pick(STATUSES, "c_custkey % 4")} AS EXT_Situacao,
  c_acctbal * 200 AS EXT_CapitalSocial, strftime(({OPENED})::DATE, '%Y-%m-%d') AS EXT_DataAbertura, {pick(STATES, "c_nationkey")} AS EXT_UF,
  (c_custkey % 5)::INTEGER AS EXT_QtdSocios, 0 AS EXT_QtdCNAESecundarios FROM customer)"""


@query(
    "provider_payload",
    f"""WITH {_BASIC}, aged AS (SELECT *, {age_sql("EXT_DataAbertura")} AS EXT_IdadeEmpresa FROM basic)
    SELECT cnpj, EXT_RazaoSocial, EXT_Situacao, {he("EXT_CapitalSocial", 2)} AS EXT_CapitalSocial, EXT_DataAbertura, EXT_UF, EXT_QtdSocios,
    EXT_QtdCNAESecundarios, CASE WHEN EXT_UF IN ('AM','RR','AP','PA','TO','RO','AC') THEN 'Norte'
      WHEN EXT_UF IN ('MA','PI','CE','RN','PB','PE','AL','SE','BA') THEN 'Nordeste' WHEN EXT_UF IN ('MT','MS','GO','DF') THEN 'Centro-Oeste'
      WHEN EXT_UF IN ('SP','RJ','MG','ES') THEN 'Sudeste' WHEN EXT_UF IN ('PR','SC','RS') THEN 'Sul' ELSE 'Desconhecida' END AS EXT_Regiao,
    EXT_IdadeEmpresa, {he(credit_sql("EXT_Situacao", "EXT_IdadeEmpresa", "EXT_CapitalSocial", "EXT_QtdSocios"), 6)} AS EXT_ScoreCredito FROM aged""",
)
def payload(spark, d):
    basic = r.parse_payload(provider_answers(spark, d), payload="basic", provider="basic")
    out = r.derived_fields(basic, F.lit(AS_OF).cast("date"))
    return out.select(
        "cnpj", "EXT_RazaoSocial", "EXT_Situacao", half_even(F.col("EXT_CapitalSocial"), 2).alias("EXT_CapitalSocial"),
        "EXT_DataAbertura", "EXT_UF", "EXT_QtdSocios", "EXT_QtdCNAESecundarios", "EXT_Regiao", "EXT_IdadeEmpresa",
        half_even(F.col("EXT_ScoreCredito"), 6).alias("EXT_ScoreCredito"),
    )


@query(
    "provider_merge",
    f"""SELECT {_KEY} AS cnpj, c_name AS EXT_RazaoSocial,
      CASE WHEN c_mktsegment <> 'MACHINERY' THEN CASE WHEN c_acctbal > 0 THEN 'Sim' ELSE 'Nao' END END AS EXT_Simples,
      CASE WHEN c_acctbal >= 0 THEN lower(c_mktsegment) ELSE {pick(STATUSES, "c_custkey % 4")} END AS EXT_Situacao,
      CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS EXT_RW_Atividade, c_name AS EXT_WS_Cidade FROM customer""",
)
def provider_merge(spark, d):
    answers = provider_answers(spark, d)
    basic, options, status, address = [
        r.parse_payload(answers, payload=p, provider=p) for p in ("basic", "options", "status", "address")
    ]
    # The status provider is read under the basic provider's name, so that a later answer wins.
    status = status.withColumnRenamed("EXT_RW_Situacao", "EXT_Situacao")
    merged = r.merge_providers([basic.select("cnpj", "EXT_RazaoSocial", "EXT_Situacao"), options, status, address])
    return merged.select("cnpj", "EXT_RazaoSocial", "EXT_Simples", "EXT_Situacao", "EXT_RW_Atividade", "EXT_WS_Cidade")


@query(
    "progressive_outer",
    f"""WITH {REGISTRY}, b AS (SELECT lpad(o_custkey::VARCHAR, 14, '0') AS cnpj, o_orderpriority, count(*) AS pedidos FROM orders GROUP BY ALL),
    c AS (SELECT {_KEY} AS cnpj, c_mktsegment FROM customer)
    SELECT coalesce(r.cnpj, b.cnpj, c.cnpj) AS cnpj, ext_situacao, o_orderpriority, pedidos, c_mktsegment
    FROM registry r FULL JOIN b ON r.cnpj = b.cnpj FULL JOIN c ON coalesce(r.cnpj, b.cnpj) = c.cnpj""",
)
def outer(spark, d):
    first = registry(spark, d).select("cnpj", "ext_situacao")
    key = lambda c: F.lpad(F.col(c).cast("string"), 14, "0")
    second = table(spark, d, "orders").groupBy(key("o_custkey").alias("cnpj"), "o_orderpriority").agg(
        F.count(F.lit(1)).alias("pedidos")
    ).withColumn("ext_situacao", F.lit("dropped"))
    third = table(spark, d, "customer").select(key("c_custkey").alias("cnpj"), "c_mktsegment")
    return r.progressive_outer([first, second, third])


@query(
    "key_difference",
    f"""WITH {REGISTRY} SELECT {_KEY} AS cnpj FROM customer EXCEPT SELECT cnpj FROM registry""",
)
def difference(spark, d):
    keys = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("cnpj"))
    return r.missing_keys(keys, registry(spark, d), budget=None)


@query("distinct_keys", f"WITH {IMPORTS} SELECT DISTINCT cnpj, uf FROM imports")
def distinct_keys(spark, d):
    return imports(spark, d, ("cnpj", "uf")).distinct()


@query(
    "batch_union",
    """SELECT l_linestatus, lower(l_linestatus) AS marca, count(*) AS n FROM (
      SELECT l_linestatus, l_orderkey FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_linestatus, l_orderkey FROM lineitem WHERE l_linestatus <> 'F')
    GROUP BY ALL""",
)
def union(spark, d):
    lines = table(spark, d, "lineitem").select("l_linestatus", "l_orderkey")
    done = lines.where(F.col("l_linestatus") == "F")
    rest = lines.where(F.col("l_linestatus") != "F").withColumn("marca", F.lower("l_linestatus"))
    both = done.unionByName(rest, allowMissingColumns=True)
    return both.groupBy("l_linestatus", F.coalesce("marca", F.lower("l_linestatus")).alias("marca")).agg(
        F.count(F.lit(1)).alias("n")
    )
