"""Company registry: joins, missing keys, cache upkeep, provider records.

No join carries a broadcast hint: Spark broadcasts a side only where its measured size is below
spark.sql.autoBroadcastJoinThreshold, and AQE splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions.scoring import company_age, credit_score, region_of_state

# Fixed value: most new ids looked up in one run.
LOOKUP_BUDGET = 500


def with_suffix(df: DataFrame, taken: list[str], keys: list[str], suffix: str = "_ext") -> DataFrame:
    for name in df.columns:
        if name in taken and name not in keys:
            df = df.withColumnRenamed(name, name + suffix)
    return df


def join_registry(df: DataFrame, registry: DataFrame, key: str = "cnpj") -> DataFrame:
    """Left join; registry columns whose names are taken get the suffix _ext."""
    return df.join(with_suffix(registry, df.columns, [key]), key, "left")


def missing_keys(df: DataFrame, registry: DataFrame, key: str = "cnpj", budget: int | None = None) -> DataFrame:
    """Distinct ids not in the registry; with a `budget` (published: LOOKUP_BUDGET) the first so many in id order."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    absent = keys.join(registry.select(key), key, "left_anti")
    return absent if budget is None else absent.orderBy(key).limit(budget)


def upsert(old: DataFrame, new: DataFrame, key: str = "cnpj") -> DataFrame:
    """One row per id, from the latest load. Rows without an id are no updates of each other and all stay.

    `load_seq` numbers the loads: `new` without it is one load after all of `old`. It is kept where a table brings it.
    Rows of one load that share an id are ordered by all their values, so that the result doesn't depend on chance.
    """
    seq = "load_seq"
    given = seq in old.columns or seq in new.columns
    if seq not in old.columns:
        old = old.withColumn(seq, F.lit(0).cast("long"))
    if seq not in new.columns:
        last = old.agg(F.coalesce(F.max(seq), F.lit(0)).alias("last"))
        new = new.withColumn(seq, last.scalar() + 1)
    rows = old.unionByName(new, allowMissingColumns=True)
    fields = [c for c in rows.columns if c != key]
    order = F.struct(F.col(seq).isNotNull().alias("known"), F.col(seq).alias("s"), F.to_json(F.struct(*fields)).alias("t"))
    latest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("row")).select(key, "row.*")
    out = latest.unionByName(rows.where(F.col(key).isNull())).select(rows.columns)
    return out if given else out.drop(seq)


def merge_providers(providers: list[DataFrame], key: str = "cnpj") -> DataFrame:
    """One record per id from several provider tables: a field comes from the last provider that has
    the field and returned a record for the id, even where that value is NULL.

    One union and one aggregation, whatever the number of providers.
    """
    fields = list(dict.fromkeys(c for p in providers for c in p.columns if c != key))
    tagged = None
    for rank, provider in enumerate(providers):
        part = provider.select(
            key, *provider.drop(key).columns, *[F.lit(rank).alias(f"rank_{c}") for c in provider.columns if c != key]
        )
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return tagged.groupBy(key).agg(*[F.max_by(c, f"rank_{c}").alias(c) for c in fields])


# The JSON fields read from provider answers.
PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("razao_social", T.StringType()),
        T.StructField("nome_fantasia", T.StringType()),
        T.StructField("cnae_fiscal", T.StringType()),
        T.StructField("cnae_fiscal_descricao", T.StringType()),
        T.StructField("natureza_juridica", T.StringType()),
        T.StructField("uf", T.StringType()),
        T.StructField("municipio", T.StringType()),
        T.StructField("descricao_situacao_cadastral", T.StringType()),
        T.StructField("porte", T.StringType()),
        T.StructField("capital_social", T.DoubleType()),
        T.StructField("data_inicio_atividade", T.StringType()),
        T.StructField("qsa", T.ArrayType(T.StringType())),
        T.StructField("cnaes_secundarios", T.ArrayType(T.StringType())),
        T.StructField("email", T.StringType()),
        T.StructField("ddd_telefone_1", T.StringType()),
        T.StructField("opcao_pelo_simples", T.BooleanType()),
        T.StructField("opcao_pelo_mei", T.BooleanType()),
        T.StructField("situacao", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("atividade_principal", T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))),
        T.StructField(
            "estabelecimento",
            T.StructType(
                [
                    T.StructField("bairro", T.StringType()),
                    T.StructField("cep", T.StringType()),
                    T.StructField("cidade", T.StructType([T.StructField("nome", T.StringType())])),
                ]
            ),
        ),
    ]
)


def _count_of(array: Column) -> Column:
    return F.when(array.isNull(), F.lit(0)).otherwise(F.size(array))


def _yes_no(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), F.lit("Sim")).otherwise(F.lit("Nao"))


def parse_payload(df: DataFrame, key: str = "cnpj", payload: str = "payload", provider: str = "basic") -> DataFrame:
    """EXT_* fields of a JSON answer. Providers: basic, options, status, address; answers without the
    provider's own mark (an error, no establishment) give no row."""
    d = df.select(key, F.from_json(payload, PAYLOAD_SCHEMA).alias("d")).where(F.col("d").isNotNull())
    if provider == "basic":
        return d.select(
            key,
            F.col("d.razao_social").alias("EXT_RazaoSocial"),
            F.col("d.nome_fantasia").alias("EXT_NomeFantasia"),
            F.coalesce("d.cnae_fiscal", F.lit("")).alias("EXT_CNAE_Codigo"),
            F.col("d.cnae_fiscal_descricao").alias("EXT_CNAE_Descricao"),
            F.col("d.natureza_juridica").alias("EXT_NaturezaJuridica"),
            F.col("d.uf").alias("EXT_UF"),
            F.col("d.municipio").alias("EXT_Municipio"),
            F.col("d.descricao_situacao_cadastral").alias("EXT_Situacao"),
            F.col("d.porte").alias("EXT_Porte"),
            F.col("d.capital_social").alias("EXT_CapitalSocial"),
            F.col("d.data_inicio_atividade").alias("EXT_DataAbertura"),
            _count_of(F.col("d.qsa")).alias("EXT_QtdSocios"),
            _count_of(F.col("d.cnaes_secundarios")).alias("EXT_QtdCNAESecundarios"),
            F.col("d.email").alias("EXT_Email"),
            F.col("d.ddd_telefone_1").alias("EXT_Telefone"),
        )
    if provider == "options":
        return d.select(
            key,
            _yes_no(F.col("d.opcao_pelo_simples")).alias("EXT_Simples"),
            _yes_no(F.col("d.opcao_pelo_mei")).alias("EXT_MEI"),
            F.col("d.email").alias("EXT_MR_Email"),
            F.col("d.ddd_telefone_1").alias("EXT_MR_Telefone"),
        )
    if provider == "status":
        return d.where(~F.col("d.status").eqNullSafe("ERROR")).select(
            key,
            F.col("d.situacao").alias("EXT_RW_Situacao"),
            F.try_element_at("d.atividade_principal", F.lit(1))["text"].alias("EXT_RW_Atividade"),
        )
    if provider == "address":
        return d.where(F.col("d.estabelecimento").isNotNull()).select(
            key,
            F.col("d.estabelecimento.bairro").alias("EXT_WS_Bairro"),
            F.col("d.estabelecimento.cep").alias("EXT_WS_CEP"),
            F.col("d.estabelecimento.cidade.nome").alias("EXT_WS_Cidade"),
        )
    raise ValueError(f"unknown provider: {provider}")


def derived_fields(df: DataFrame, as_of: Column) -> DataFrame:
    """EXT_Regiao, EXT_IdadeEmpresa and EXT_ScoreCredito from parsed provider fields."""
    opened = F.col("EXT_DataAbertura").try_cast("date")
    return (
        df.withColumn("EXT_Regiao", region_of_state(F.col("EXT_UF")))
        .withColumn("EXT_IdadeEmpresa", company_age(opened, as_of))
        .withColumn(
            "EXT_ScoreCredito",
            credit_score(
                F.col("EXT_Situacao"), F.col("EXT_IdadeEmpresa"), F.col("EXT_CapitalSocial"), F.col("EXT_QtdSocios")
            ),
        )
    )


def progressive_outer(tables: list[DataFrame], key: str = "cnpj") -> DataFrame:
    """Full outer joins in order; a later table loses the columns already present. Repeated keys multiply."""
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table.drop(*[c for c in table.columns if c in out.columns and c != key]), key, "full_outer")
    return out


def enrichment_counts(df: DataFrame, registry: DataFrame, key: str, budget: int) -> DataFrame:
    """One row: distinct ids, ids missing from the registry, and look-ups charged (never more than missing)."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    absent = ids.join(registry.select(key), key, "left_anti")
    return ids.agg(F.count(F.lit(1)).alias("cnpjs")).withColumn(
        "missing", absent.agg(F.count(F.lit(1)).alias("m")).scalar()
    ).withColumn("charged", F.least(F.col("missing"), F.lit(budget)))
