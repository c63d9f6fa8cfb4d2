"""User functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a function of a pandas batch to every batch. Batch size: spark.sql.execution.arrow.maxRecordsPerBatch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield func(batch)

    return df.mapInPandas(run, schema)


def map_arrow(df: DataFrame, func: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """The same on Arrow record batches, without a pandas copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield func(batch)

    return df.mapInArrow(run, schema)


def map_values(column: Column, func: Callable[[pd.Series], pd.Series], returns: str) -> Column:
    """Apply a vectorised function to a column."""

    def run(values: pd.Series) -> pd.Series:
        return func(values)

    return F.pandas_udf(run, returns)(column)
