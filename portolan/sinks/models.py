"""Model bundles: a fitted pipeline with its metrics, columns and labels."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_bundle(model: PipelineModel, metadata: DataFrame, path: str) -> None:
    """The pipeline, and its metadata (label map, metrics, chosen columns) as a table."""
    model.write().overwrite().save(f"{path}/pipeline")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/metadata")
