"""End-to-end run over one base: KPIs, classifier, calibration, privacy report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.numeric import lenient_double
from portolan.operators.business import business_kpis
from portolan.operators.calibration import AutoCalibration, fit_auto
from portolan.operators.ml import fit_logistic, fit_preprocessor
from portolan.operators.privacy import generate_and_validate
from portolan.operators.topk import stratified_split
from portolan.sinks.writers import export_parquet, write_report

QUASI_IDS = ("ncm", "pais_origem", "uf")


@dataclass(frozen=True)
class BaseRun:
    kpis: DataFrame
    scored: DataFrame
    calibration: AutoCalibration
    privacy: DataFrame
    preprocessor: PipelineModel


def run_base(
    spark: SparkSession,
    df: DataFrame,
    output: str,
    key: str = "chave_item",
    label: str = "suspeito",
    categories: tuple[str, ...] = ("pais_origem", "uf"),
    numbers: tuple[str, ...] = ("vmle_dolar", "peso_liquido", "score"),
) -> BaseRun:
    """Trains on a hash split, scores and calibrates the held-out rows, and writes every report."""
    kpis = business_kpis(df)
    write_report(kpis, f"{output}/kpis")
    typed = df.withColumns({n: F.coalesce(lenient_double(n), F.lit(0.0)) for n in numbers}).withColumn(
        "label", F.col(label).cast("double")
    )
    # Everything that iterates reads tables written once, so neither the split nor the model is worked
    # out again per pass, and a lost executor costs a read.
    export_parquet(stratified_split(typed, "label", [key]), f"{output}/split")
    split = spark.read.parquet(f"{output}/split")
    train = split.where(F.col("split") == "train")
    preprocessor = fit_preprocessor(train, list(categories), list(numbers))
    model = fit_logistic(preprocessor.transform(train))
    held_out = preprocessor.transform(split.where(F.col("split") == "test"))
    scored = model.transform(held_out).select(
        key, F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p")
    )
    export_parquet(scored, f"{output}/scores")
    scored = spark.read.parquet(f"{output}/scores")
    calibration = fit_auto(scored)
    write_report(calibration.report, f"{output}/calibration")
    quasi = [c for c in QUASI_IDS if c in df.columns]
    columns = quasi + [n for n in numbers if n not in quasi]
    _, privacy = generate_and_validate(spark, split.select(*columns), quasi)
    write_report(privacy, f"{output}/privacy")
    return BaseRun(kpis, scored, calibration, privacy, preprocessor)
