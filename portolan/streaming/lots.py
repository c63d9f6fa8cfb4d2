"""Resumable lots: a file stream scored batch by batch.

The checkpoint is the progress state and the batch id is the lot number. A lot is written under its
own number and replaced if it runs again, so a restart neither skips nor repeats rows. State that
grows (training counts) is stored per lot and summed on reading, for the same reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.operators.attribution import TOP, add_counts, attribute, complement_counts, complement_model
from portolan.operators.registry import enrichment_counts, join_registry
from portolan.session import stored
from portolan.sinks.writers import write_batch, write_report

MODEL_NAME = "ComplementNB"


def with_lot(df: DataFrame, lot: int, model: str | None = MODEL_NAME) -> DataFrame:
    return df.withColumns(
        {"Lote": F.lit(lot).cast("long"), "Timestamp": F.current_timestamp(), "Modelo": F.lit(model).cast("string")}
    )


def open_folder(spark: SparkSession, path: str, schema, files_per_lot: int = 1, glob: str | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder, a bounded number of files per lot."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_lot)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_lots(
    stream: DataFrame,
    process: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> None:
    """Process everything available, lot by lot, then stop. One checkpoint per base keeps bases apart."""
    query = (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def score_lots(stream: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> None:
    """Score each lot and write it under lote=<n>."""

    def process(batch: DataFrame, lot: int) -> None:
        write_batch(with_lot(score(batch), lot), output, lot)

    run_lots(stream, process, checkpoint)


def read_lots(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output)


def train_lots(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], label: str, output: str, checkpoint: str) -> None:
    """Token and class counts per lot; `prepare` gives frames from `with_bag`."""

    def process(batch: DataFrame, lot: int) -> None:
        write_batch(complement_counts(prepare(batch), label), output, lot)

    run_lots(stream, process, checkpoint)


def trained_counts(spark: SparkSession, output: str) -> DataFrame:
    """The counts of all lots so far."""
    return add_counts(spark.read.parquet(output).select("token", "class", "n"))


def counts_before(spark: SparkSession, output: str, lot: int) -> DataFrame | None:
    """The counts of the lots before one; None where these hold nothing. What the lot itself left in an earlier try is not read."""
    if not _exists(spark, output):
        return None
    counts = spark.read.parquet(output).where(F.col("lote") < lot).select("token", "class", "n")
    return None if counts.isEmpty() else stored(add_counts(counts), "counts-before")


def predict_lots(
    stream: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    label: str,
    output: str,
    counts: str,
    checkpoint: str,
    k: int = TOP,
) -> None:
    """Guess, write and learn, lot by lot: each lot is attributed by the counts of the lots before it, then counted.

    `prepare` gives frames from `with_bag` that hold the label, with whatever score columns are to be delivered. A lot is
    written under lote=<n> in both folders before its number is committed. One that stops halfway runs again whole, by the
    same counts, so its rows and counts come out the same and once. Rows of a lot that has nothing to learn from carry
    NULL guesses and a NULL model name; rows without a label are guessed but teach nothing.
    """

    def process(batch: DataFrame, lot: int) -> None:
        rows = stored(prepare(batch), "lot-rows")
        earlier = counts_before(rows.sparkSession, counts, lot)
        if earlier is None:
            write_batch(with_lot(without_guess(rows, k), lot, None), output, lot)
        else:
            write_batch(with_lot(attribute(rows, complement_model(earlier), k), lot), output, lot)
        write_batch(complement_counts(rows.where(F.col(label).isNotNull()), label), counts, lot)

    run_lots(stream, process, checkpoint)


def without_guess(rows: DataFrame, k: int = TOP) -> DataFrame:
    """The columns of attribute(), all NULL."""
    names = ["RES_Previsto", "RES_Confianca", "RES_Entropia", "RES_Margem"]
    names += [f"RES_Top{r}{end}" for r in range(1, k + 1) for end in ("", "_p")]
    text = {"RES_Previsto", *[f"RES_Top{r}" for r in range(1, k + 1)]}
    nothing = {n: F.lit(None).cast("string" if n in text else "double") for n in names}
    return rows.withColumns(nothing).drop("bag", "tokens")


def guessed_candidates(done: DataFrame) -> DataFrame:
    """Rows of all lots that carry a guess, under the names that validation and delivery read."""
    return done.where(F.col("RES_Previsto").isNotNull()).withColumnsRenamed(
        {"RES_Previsto": "CNPJ_Previsto", "RES_Confianca": "CNPJ_Confianca"}
    )


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def charged_before(spark: SparkSession, log: str, lot: int) -> int:
    """Look-ups charged by earlier lots, from their log entries."""
    if not _exists(spark, log):
        return 0
    entries = spark.read.schema("cnpjs long, missing long, charged long, lote long").json(log)
    return entries.where(F.col("lote") < lot).agg(F.coalesce(F.sum("charged"), F.lit(0))).first()[0]


def enrich_lots(
    stream: DataFrame,
    registry: DataFrame,
    output: str,
    log: str,
    checkpoint: str,
    key: str = "cnpj",
    budget: int = 500,
) -> None:
    """Join each lot with the registry; per lot, log the ids seen, missing and charged. The budget is
    for the whole run: a lot is charged the ids it misses, up to what earlier lots left."""

    def process(batch: DataFrame, lot: int) -> None:
        left = max(0, budget - charged_before(batch.sparkSession, log, lot))
        write_batch(with_lot(join_registry(batch, registry, key), lot), output, lot)
        write_report(enrichment_counts(batch, registry, key, left), f"{log}/lote={lot}")

    run_lots(stream, process, checkpoint)
