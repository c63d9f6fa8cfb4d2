"""What the operators share: input columns, slices of texts, tables in the shared folder, sorted groups."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.session import scratch_path

SLICE_BYTES = 1 << 20
#: What a worker keeps between tasks and gives up when one ends: functions without arguments.
KEPT: list[Callable[[], object]] = []


def release() -> None:
    """Gives tables of this worker back to the system: a worker that waits for its next task holds the libraries alone."""
    for forget in KEPT:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a partition's batches that releases its worker's tables at the end, also of a task that fails."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as ''; other columns stay behind, whatever their names."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once under the shared folder and read back: work is not repeated and lineage ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes in a column; a longer value makes a slice of its own."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_slices(
    df: DataFrame, setup: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: T.StructType, column: str = "text"
) -> DataFrame:
    """mapInArrow over slices; `setup` runs once in each task and gives the function of a slice."""
    fields = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        func = setup()
        for batch in batches:
            for part in slices(batch, column):
                for out in func(part):
                    yield out.select(fields)

    return df.mapInArrow(releasing(run), schema)


def with_columns(
    df: DataFrame, setup: Callable[[], Callable[[pa.Array], dict[str, object]]], added: str, column: str = "text", drop: bool = True
) -> DataFrame:
    """Columns (`added`: DDL) that a function of the text column gives; the text itself is dropped by default."""
    kept = [f for f in df.schema.fields if not drop or f.name != column]
    extra = T.StructType.fromDDL(added)
    kinds = {f.name: arrow_type(f.dataType) for f in extra}

    def outer() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        func = setup()

        def one(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            made = func(part.column(column))
            arrays = [part.column(f.name) for f in kept] + [pa.array(made[n], kinds[n]) for n in kinds]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + list(kinds))

        return one

    return map_slices(df, outer, T.StructType(kept + extra.fields), column)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys, from a partition sorted by them; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        values = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(values) + 1):
            if i < len(values) and values[i] == values[start]:
                continue
            if current is not None and values[start] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = values[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield current, pa.Table.from_batches(held)


def packed(df: DataFrame, **values: Column) -> DataFrame:
    """All columns as one struct `row`, beside computed ones: no name can clash. Undo with unpacked()."""
    return df.select(F.struct("*").alias("row"), *[v.alias(k) for k, v in values.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")
