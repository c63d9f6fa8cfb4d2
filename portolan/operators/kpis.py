"""Row-level business KPIs and the weighted risk score.

Each KPI is a function from DataFrame to DataFrame adding one column; absent inputs give the
constant 0.0, as decided from the column names alone, so plans stay plain expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.ids import digits_only
from portolan.functions.numeric import clip01, divide, half_even, lenient_double
from portolan.functions.scoring import (
    WEIGHTS_10,
    is_active,
    risk_colour,
    risk_level,
    risk_score,
)
from portolan.functions.text import text_blob, text_length
from portolan.operators.quantiles import quantiles

# Importer surge limit in standard deviations, arrival limit in days, age limit in
# years, n-gram hits that give a full score.
SURGE_LIMIT = 3.0
ETA_LIMIT_DAYS = 7.0
AGE_LIMIT_YEARS = 10.0
FULL_GRAM_HITS = 10.0


@dataclass(frozen=True)
class ImportColumns:
    """Names of the input columns of an import table."""

    key: str = "chave_item"
    cnpj: str = "cnpj"
    value: str = "vmle_dolar"
    weight: str = "peso_liquido"
    hs_code: str = "ncm"
    description: str = "descricao"
    importer: str = "importador"
    eta: str = "eta"
    eta_real: str = "eta_real"
    status: str = "ext_situacao"
    age: str = "ext_idade"
    credit: str = "ext_score_credito"
    capital: str = "ext_capital"
    text: tuple[str, ...] = field(default=("descricao",))

    def with_names(self, **names: str) -> "ImportColumns":
        return replace(self, **names)


IMPORTS = ImportColumns()


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def value_per_kg(cols: ImportColumns = IMPORTS) -> Column:
    return divide(lenient_double(cols.value), lenient_double(cols.weight))


def kpi_undervaluation(
    df: DataFrame,
    cols: ImportColumns = IMPORTS,
    scope: str | None = None,
    method: str = "exact",
    base: DataFrame | None = None,
) -> DataFrame:
    """KPI_Subvalorizacao: how far value/kg lies below the median; also FE_ValorPorKg.

    The median is over the whole table, or per value of `scope`; `base` is the table it is taken from
    where `df` already carries joins the median does not need.
    """
    base = df if base is None else base
    if not _has(df, cols.value, cols.weight):
        return df.withColumns({"KPI_Subvalorizacao": F.lit(0.0), "FE_ValorPorKg": F.lit(0.0)})
    vk = value_per_kg(cols)
    wanted = {"median_vk": 0.5}
    if scope is None:
        out = df.withColumn("median_vk", quantiles(base, vk, wanted, method=method).scalar())
    else:
        per_scope = quantiles(base, vk, wanted, [scope], method).withColumnRenamed(scope, "scope_key")
        out = df.join(per_scope, F.col(scope).eqNullSafe(F.col("scope_key")), "left").drop("scope_key")
    unit = F.when(F.col("median_vk") != 0, F.col("median_vk")).otherwise(F.lit(1.0))
    return out.withColumns(
        {
            "KPI_Subvalorizacao": clip01((F.col("median_vk") - vk) / unit),
            "FE_ValorPorKg": F.coalesce(vk, F.lit(0.0)),
        }
    ).drop("median_vk")


def kpi_hs_disparity(
    df: DataFrame, cols: ImportColumns = IMPORTS, count: str = "run", by_description: bool = False
) -> DataFrame:
    """KPI_DisparidadeHS: trailing zeros of the code over its length.

    count="run" counts a run of trailing zeros once, count="zeros" counts every zero of it;
    by_description=True multiplies by the description's length over the longest one.
    """
    if count not in ("run", "zeros"):
        raise ValueError(f"unknown count: {count}")
    if not _has(df, cols.hs_code) or (by_description and not _has(df, cols.description)):
        return df.withColumn("KPI_DisparidadeHS", F.lit(0.0))
    digits = digits_only(F.col(cols.hs_code))
    tail = F.regexp_extract(digits, r"0*$", 0)
    zeros = F.length(tail) if count == "zeros" else F.when(F.length(tail) > 0, 1).otherwise(0)
    share = divide(zeros.cast("double"), F.length(digits))
    if by_description:
        length = text_length(F.col(cols.description)).cast("double")
        longest = df.agg(F.max(length).alias("longest")).scalar()
        df = df.withColumn("longest_text", longest)
        share = share * (length / F.when(F.col("longest_text") != 0, F.col("longest_text")).otherwise(F.lit(1.0)))
    return df.withColumn("KPI_DisparidadeHS", clip01(share)).drop("longest_text")


def importer_stats(df: DataFrame, cols: ImportColumns = IMPORTS) -> DataFrame:
    """Mean and sample standard deviation of value per importer."""
    value = lenient_double(cols.value)
    return df.groupBy(cols.importer).agg(F.avg(value).alias("imp_mean"), F.stddev_samp(value).alias("imp_std"))


def kpi_surge(df: DataFrame, cols: ImportColumns = IMPORTS, base: DataFrame | None = None) -> DataFrame:
    """KPI_SurgeVolume: value above the importer's mean, in units of three standard deviations.

    Statistics are aggregated per importer (map-side first) and joined back, so one importer with
    a third of the rows is never gathered into one task; AQE splits its join partition. A table that brings
    `imp_mean` and `imp_std` along is not joined.
    """
    if not _has(df, cols.importer, cols.value):
        return df.withColumn("KPI_SurgeVolume", F.lit(0.0))
    if not _has(df, "imp_mean", "imp_std"):
        df = df.join(importer_stats(df if base is None else base, cols), cols.importer, "left")
    spread = F.when(F.col("imp_std") != 0, F.col("imp_std")) * F.lit(SURGE_LIMIT)
    return (
        df.withColumn("KPI_SurgeVolume", clip01((lenient_double(cols.value) - F.col("imp_mean")) / spread))
        .drop("imp_mean", "imp_std")
    )


def day_difference(late: Column, early: Column) -> Column:
    """Whole days between two times, rounded down before the sign is dropped."""
    seconds = F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))
    return F.abs(F.floor(seconds / F.lit(86_400_000_000.0)))


def kpi_eta(df: DataFrame, cols: ImportColumns = IMPORTS) -> DataFrame:
    """KPI_DesvioETA: days between planned and real arrival over seven."""
    if not _has(df, cols.eta, cols.eta_real):
        return df.withColumn("KPI_DesvioETA", F.lit(0.0))
    late = F.col(cols.eta_real).try_cast("timestamp")
    early = F.col(cols.eta).try_cast("timestamp")
    return df.withColumn("KPI_DesvioETA", clip01(day_difference(late, early) / F.lit(ETA_LIMIT_DAYS)))


def kpi_completeness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """KPI_Completude: share of NULLs of the row over `columns` (default: all input columns)."""
    names = columns or [c for c in df.columns if not c.startswith(("KPI_", "FE_"))]
    nulls = F.lit(0)
    for name in names:
        nulls = nulls + F.col(name).isNull().cast("int")
    return df.withColumn("KPI_Completude", nulls / F.lit(float(len(names))))


def kpi_registry_status(df: DataFrame, cols: ImportColumns = IMPORTS, match: str = "substring") -> DataFrame:
    """KPI_Ext_ConsistenciaCadastral: 1 unless the status text holds "ativa"."""
    if not _has(df, cols.status):
        return df.withColumn("KPI_Ext_ConsistenciaCadastral", F.lit(0.0))
    active = is_active(F.col(cols.status), match)
    return df.withColumn("KPI_Ext_ConsistenciaCadastral", F.when(active, 0.0).otherwise(1.0))


def kpi_company_age(df: DataFrame, cols: ImportColumns = IMPORTS) -> DataFrame:
    """KPI_Ext_IdadeEmpresa: 1 at age 0 down to 0 at ten years, 0.5 when unknown."""
    if not _has(df, cols.age):
        return df.withColumn("KPI_Ext_IdadeEmpresa", F.lit(0.0))
    age = lenient_double(cols.age)
    return df.withColumn("KPI_Ext_IdadeEmpresa", clip01(F.lit(1.0) - age / F.lit(AGE_LIMIT_YEARS), 0.5))


def kpi_credit(df: DataFrame, cols: ImportColumns = IMPORTS) -> DataFrame:
    """KPI_Ext_ScoreCredito: 1 minus the credit score, 0.5 when unknown."""
    if not _has(df, cols.credit):
        return df.withColumn("KPI_Ext_ScoreCredito", F.lit(0.0))
    return df.withColumn("KPI_Ext_ScoreCredito", F.coalesce(F.lit(1.0) - lenient_double(cols.credit), F.lit(0.5)))


def kpi_char_pattern(df: DataFrame, grams: Column, cols: ImportColumns = IMPORTS) -> DataFrame:
    """KPI_PadraoChar: frequent n-grams (an array column, e.g. a scalar subquery) held, over ten."""
    texts = [c for c in cols.text if c in df.columns]
    if not texts:
        return df.withColumn("KPI_PadraoChar", F.lit(0.0))
    # The one-element array binds the cleaned text to a lambda variable, so it is computed once per row.
    blob = F.array(text_blob(*[F.col(c) for c in texts]))
    held = F.transform(blob, lambda b: F.size(F.filter("frequent_grams", lambda g: F.contains(b, g))))[0]
    score = half_even(F.least(held / F.lit(FULL_GRAM_HITS), F.lit(1.0)), 4)
    return (
        df.withColumn("frequent_grams", grams)
        .withColumn(
            "KPI_PadraoChar",
            F.when(F.col("frequent_grams").isNull() | (F.size("frequent_grams") == 0), F.lit(0.0)).otherwise(score),
        )
        .drop("frequent_grams")
    )


def business_kpi_columns(
    df: DataFrame,
    cols: ImportColumns = IMPORTS,
    input_columns: list[str] | None = None,
    base: Callable[[tuple[str, ...]], DataFrame] | None = None,
) -> DataFrame:
    """All KPIs that need no text mining or neighbour search. base(columns): the table that their statistics are taken from."""
    base = base or (lambda columns: df)
    inputs = input_columns or df.columns
    out = kpi_hs_disparity(df, cols)
    out = kpi_eta(out, cols)
    out = kpi_completeness(out, inputs)
    out = kpi_registry_status(out, cols)
    out = kpi_company_age(out, cols)
    out = kpi_credit(out, cols)
    # Table-wide statistics come from the plain input, and last: they make the plan large.
    out = kpi_surge(out, cols, base((cols.importer, cols.value)))
    return kpi_undervaluation(out, cols, base=base((cols.value, cols.weight)))


def with_risk(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """RiskScore, RiskLevel and RiskColor from the KPI columns present."""
    weights = WEIGHTS_10 if weights is None else weights
    return (
        df.withColumn("RiskScore", risk_score(df.columns, weights))
        .withColumn("RiskLevel", risk_level(F.col("RiskScore")))
        .withColumn("RiskColor", risk_colour(F.col("RiskLevel")))
    )


def level_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("RiskLevel").agg(F.count(F.lit(1)).alias("n"))


def top_kpi_means(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Mean of every KPI column over the n riskiest rows, half-even to 4 digits."""
    kpis = [c for c in df.columns if c.startswith("KPI_")] + ["RiskScore"]
    top = df.select(key, *kpis).orderBy(F.desc("RiskScore"), key).limit(n)
    return top.agg(*[half_even(F.avg(F.coalesce(F.col(c), F.lit(0.0))), 4).alias(c) for c in kpis])
