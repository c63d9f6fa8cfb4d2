"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.ids import cnpj_format_check
from portolan.functions.text import company_name_profile
from portolan.operators.topk import top_risk


def export_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_scored(df: DataFrame, path: str) -> None:
    """Scored rows as a replaced set of Parquet parts."""
    export_parquet(df, path)


def write_top_risk(df: DataFrame, path: str, ties: list[str], n: int = 5000) -> None:
    """The n riskiest rows with their colours, Parquet."""
    export_parquet(top_risk(df, ties, n), path)


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """One lot under lote=<batch>: writing a lot again replaces it."""
    export_parquet(df, f"{path}/lote={batch}")


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as a JSON document."""
    df.write.mode("overwrite").json(path)


def write_profile(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def company_report_lines(df: DataFrame, cnpj: str = "cnpj", name: str = "razao_social") -> DataFrame:
    """(cnpj, value): a text block per record."""
    check = cnpj_format_check(F.col(cnpj))
    profile = company_name_profile(F.col(name))
    status = F.when(check["valido"], F.lit("VALIDO")).otherwise(F.concat(F.lit("INVALIDO - "), check["erro"]))
    return df.select(
        F.col(cnpj).alias("cnpj"),
        F.format_string(
            "CNPJ: %s\n  Formatado: %s\n  Status: %s\nRazao Social: %s\n  Tipo: %s\n  Palavras: %d\n  Tamanho: %d caracteres",
            F.col(cnpj),
            check["cnpj_formatado"],
            status,
            profile["razao_social"],
            profile["tipo"],
            profile["palavras"],
            profile["tamanho"],
        ).alias("value"),
    )


def write_text_report(df: DataFrame, path: str) -> None:
    company_report_lines(df).select("value").write.mode("overwrite").text(path)


def append_events(df: DataFrame, path: str) -> None:
    """Run events, one JSON line each."""
    df.write.mode("append").json(path)


def append_session(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
