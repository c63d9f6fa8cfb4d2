"""Per-company report: the table operators grouped by id, over real rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.ids import cnpj_format_check
from portolan.functions.numeric import half_even, lenient_double
from portolan.functions.text import company_name_profile
from portolan.operators.calibration import calibration_errors
from portolan.operators.outliers import beyond_iqr
from portolan.operators.quantiles import interpolated, value_ranks
from portolan.session import stored

TOP_PER_CODE = 10


def company_report(df: DataFrame) -> DataFrame:
    """One row per company: id check, name analysis, KPIs, rows among each code's best, outliers,
    anonymity of its rows, calibration error of its scores."""
    # Stored once: each figure is its own scan, which would otherwise repeat the joins that give the table.
    amount = lenient_double("vmle_dolar")
    probability = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("score")))
    rows = stored(
        df.select("cnpj", "razao_social", "ncm", "pais_origem", "uf", amount.alias("v"), probability.alias("p"), F.col("suspeito").alias("y")),
        "company-rows",
    )
    base = rows.groupBy("cnpj").agg(
        F.count(F.lit(1)).alias("total_registros"), F.avg("v").alias("vmle_medio"), F.min("razao_social").alias("razao_social")
    )
    # Rows are counted by group once: codes, countries, best rows and anonymity are sums over the groups.
    groups = rows.groupBy("cnpj", "ncm", "pais_origem", "uf").agg(F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "company-groups")
    # The best rows per (company, code): counted, so only group sizes are needed.
    best = (
        groups.groupBy("cnpj", "ncm")
        .agg(F.sum("n").alias("n"))
        .groupBy("cnpj")
        .agg(F.count("ncm").alias("ncms_distintos"), F.sum(F.least(F.col("n"), F.lit(TOP_PER_CODE))).alias("topk_registros"))
    )
    countries = groups.select("cnpj", "pais_origem").distinct().groupBy("cnpj").agg(F.count("pais_origem").alias("paises_distintos"))
    anonymity = groups.groupBy("cnpj").agg(F.min("n").alias("k_min"))
    # Quartiles and tail come from one ranking. Equal values are outliers together, so the ranked values are counted, not the rows.
    ranks = stored(value_ranks(rows, F.col("v"), ["cnpj"]).select("cnpj", "value", "n", "before", "total"), "company-ranks")
    cuts = stored(interpolated(ranks, {"vmle_p95": 0.95, "q1": 0.25, "q3": 0.75}, ["cnpj"]), "company-cuts")
    outliers = (
        ranks.join(cuts, "cnpj")
        .where(beyond_iqr(F.col("value"), F.col("q1"), F.col("q3")))
        .groupBy("cnpj")
        .agg(F.sum("n").alias("outliers"))
    )
    errors = calibration_errors(rows.select("cnpj", "y", "p"), by=["cnpj"])
    report = (
        base.join(cuts.select("cnpj", "vmle_p95"), "cnpj", "left")
        .join(best, "cnpj")
        .join(countries, "cnpj")
        .join(outliers, "cnpj", "left")
        .join(anonymity, "cnpj")
        .join(errors.select("cnpj", "ece"), "cnpj")
    )
    check, name = cnpj_format_check(F.col("cnpj")), company_name_profile(F.col("razao_social"))
    return report.select(
        "cnpj",
        check["cnpj_formatado"].alias("cnpj_formatado"),
        check["valido"].alias("valido"),
        "razao_social",
        name["tipo"].alias("tipo"),
        name["palavras"].alias("palavras"),
        name["tamanho"].alias("tamanho"),
        "total_registros",
        "ncms_distintos",
        "paises_distintos",
        half_even(F.col("vmle_medio"), 4).alias("vmle_medio"),
        half_even(F.col("vmle_p95"), 4).alias("vmle_p95"),
        "topk_registros",
        F.coalesce("outliers", F.lit(0)).alias("outliers_encontrados"),
        "k_min",
        half_even(F.col("ece"), 9).alias("ece"),
    )
