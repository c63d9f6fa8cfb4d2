"""Folders of Parquet, CSV and text files as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions.ids import ids_in_text, normalize_cnpj
from portolan.functions.numeric import half_even
from portolan.functions.scoring import header_hash

READABLE = (".csv", ".parquet", ".txt")
DELIMITERS = (";", ",", "\t", "|")
SAMPLE_LINES = 20


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Full paths of the files of a folder, in name order; the folder itself if it is a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(
        s.getPath().toString() for s in fs.listStatus(path) if not s.getPath().getName().startswith(("_", "."))
    )


def register_parquet(spark: SparkSession, view: str, path: str) -> DataFrame:
    """View over a Parquet glob, columns united by name, with a `filename` column."""
    df = spark.read.option("mergeSchema", True).parquet(path).select("*", F.col("_metadata.file_path").alias("filename"))
    df.createOrReplaceTempView(view)
    return df


def register_csv(spark: SparkSession, view: str, path: str, sep: str = ";", header: bool = True) -> DataFrame:
    """View over CSV files, types inferred from all rows."""
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=True, samplingRatio=1.0)
    df.createOrReplaceTempView(view)
    return df


def register_auto(spark: SparkSession, view: str, path: str) -> DataFrame:
    """A folder holding Parquet files reads as Parquet, else as CSV; a file by its suffix."""
    files = list_files(spark, path)
    if files == [path] or (len(files) == 1 and files[0].rstrip("/").endswith(path.rstrip("/"))):
        return register_parquet(spark, view, path) if path.endswith(".parquet") else register_csv(spark, view, path)
    if any(f.endswith(".parquet") for f in files):
        return register_parquet(spark, view, f"{path}/*.parquet")
    return register_csv(spark, view, f"{path}/*.csv")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter found most often in the first lines."""
    head = spark.read.text(path).limit(SAMPLE_LINES)
    counts = head.agg(
        *[F.sum(F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias(str(i)) for i, d in enumerate(DELIMITERS)]
    ).first()
    best = max(range(len(DELIMITERS)), key=lambda i: (counts[str(i)] or 0, -i))
    return DELIMITERS[best]


def strip_names(df: DataFrame) -> DataFrame:
    for name in df.columns:
        if name != name.strip():
            df = df.withColumnRenamed(name, name.strip())
    return df


def text_rows(bodies: DataFrame, text: str, keys: list[str], variant: str = "default") -> DataFrame:
    """One row per id found in each text body, in order, with the whole body."""
    found = bodies.select(*keys, text, F.posexplode(ids_in_text(F.col(text), variant)).alias("pos", "cnpj"))
    return found.select(*keys, "pos", "cnpj", F.col(text).alias("texto"))


def read_file(spark: SparkSession, path: str, id_column: str = "cnpj") -> DataFrame:
    """One file as a table: CSV as text columns with a found delimiter, Parquet as is, TXT as its ids."""
    suffix = re.sub(r".*(\.[a-z]+)$", r"\1", path.lower())
    if suffix == ".csv":
        return strip_names(spark.read.csv(path, sep=sniff_delimiter(spark, path), header=True, inferSchema=False))
    if suffix == ".parquet":
        return strip_names(spark.read.parquet(path))
    if suffix == ".txt":
        rows = text_rows(spark.read.text(path, wholetext=True), "value", [])
        return rows.select(F.col("cnpj").alias(id_column), F.col("texto").alias("TextoPDF"))
    raise ValueError(f"unreadable suffix: {path}")


def file_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, read on the driver."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop_path)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine() or ""
    finally:
        stream.close()


def delimiter_of(line: str) -> str:
    return max(DELIMITERS, key=line.count)


def file_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


# The first path element below the folder, as a file or as a folder of part files.
def _source_name(folder: str) -> Column:
    base = file_name(folder)
    return F.regexp_extract("_metadata.file_path", rf"/\Q{base}\E/([^/]+)", 1)


def _as_text(df: DataFrame, folder: str) -> DataFrame:
    return df.select(
        _source_name(folder).alias("arquivo"), *[F.col(f"`{c}`").cast("string").alias(c.strip()) for c in df.columns]
    )


def read_folder(spark: SparkSession, folder: str, id_column: str = "cnpj") -> DataFrame:
    """All readable files as one table of text columns with `arquivo`; columns missing from a file are
    NULL. Unreadable files are skipped when spark.sql.files.ignoreCorruptFiles is set.

    One read covers all Parquet files, one all text bodies, and one each set of CSV files with equal
    headers: the plan does not grow with the number of files.
    """
    paths = [p for p in list_files(spark, folder) if p.lower().endswith(READABLE)]
    parts = []
    headers: dict[str, list[str]] = {}
    for path in paths:
        if path.lower().endswith(".csv"):
            headers.setdefault(first_line(spark, path), []).append(path)
    for header, group in headers.items():
        parts.append(_as_text(spark.read.csv(group, sep=delimiter_of(header), header=True, inferSchema=False), folder))
    parquet = [p for p in paths if p.lower().endswith(".parquet")]
    if parquet:
        parts.append(_as_text(spark.read.option("mergeSchema", True).parquet(*parquet), folder))
    texts = [p for p in paths if p.lower().endswith(".txt")]
    if texts:
        bodies = spark.read.text(texts, wholetext=True).select(_source_name(folder).alias("arquivo"), "value")
        parts.append(
            text_rows(bodies, "value", ["arquivo"]).select("arquivo", F.col("cnpj").alias(id_column), F.col("texto").alias("TextoPDF"))
        )
    if not parts:
        raise FileNotFoundError(f"no readable file in {folder}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def file_report(name: str, kind: str, df: DataFrame) -> DataFrame:
    """One row: file, type, rows, columns, header hash, completeness."""
    columns = df.columns
    filled = sum((F.count(F.col(f"`{c}`")) for c in columns), start=F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("linhas"), filled.alias("filled")).select(
        F.lit(name).alias("arquivo"),
        F.lit(kind).alias("tipo"),
        "linhas",
        F.lit(len(columns)).alias("colunas"),
        header_hash(columns).alias("hash_header"),
        half_even(F.col("filled") / (F.col("linhas") * F.lit(float(len(columns)))), 4).alias("completude"),
    )


def ingest_report(tables: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Reports of (name, kind, table) triples as one table."""
    out = None
    for name, kind, df in tables:
        row = file_report(name, kind, df)
        out = row if out is None else out.unionByName(row)
    return out


def merge_folder(spark: SparkSession, folder: str, id_column: str = "CNPJ") -> tuple[DataFrame, DataFrame]:
    """Files holding the id column, ids normalised, joined full outer in name order (the first file to
    have a column keeps it), and their ingest report."""
    from portolan.operators.registry import progressive_outer

    tables = []
    for path in list_files(spark, folder):
        if not path.lower().endswith(READABLE):
            continue
        df = read_file(spark, path, id_column)
        if id_column in df.columns:
            kind = path.lower().rsplit(".", 1)[-1]
            tables.append((file_name(path), kind, df.withColumn(id_column, normalize_cnpj(F.col(id_column)))))
    if not tables:
        raise FileNotFoundError(f"no file with {id_column} in {folder}")
    return progressive_outer([t for _, _, t in tables], id_column), ingest_report(tables)


def rows_per_file(df: DataFrame) -> DataFrame:
    """(arquivo, linhas) of a file-based table."""
    return df.groupBy(F.col("_metadata.file_name").alias("arquivo")).agg(F.count(F.lit(1)).alias("linhas"))


def paired_lines(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(CNPJ;RAZAO lines, malformed lines): blank lines and # comments skipped, split at the first `;`."""
    text = F.trim(F.col(value))
    kept = lines.where((F.length(text) > 0) & ~text.startswith("#"))
    parts = F.split(text, ";", 2)
    good = kept.where(F.size(parts) == 2).select(
        F.trim(parts[0]).alias("cnpj"), F.trim(F.try_element_at(parts, F.lit(2))).alias("razao_social")
    )
    return good, kept.where(F.size(parts) != 2).select(text.alias("linha"))


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return paired_lines(spark.read.text(path))


SESSION_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("n_linhas", T.LongType()),
        T.StructField("n_classes", T.LongType()),
        T.StructField("modo", T.StringType()),
        T.StructField("metricas", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("kpis_medio_top10", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("top_padroes_char", T.MapType(T.StringType(), T.LongType())),
    ]
)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a JSON array or of a Parquet session log; an empty table where there is none."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return spark.createDataFrame([], SESSION_SCHEMA)
    if path.endswith(".json"):
        return spark.read.schema(SESSION_SCHEMA).json(path, multiLine=True).where(F.col("timestamp").isNotNull())
    return spark.read.schema(SESSION_SCHEMA).parquet(path)


def for_pattern(sessions: DataFrame) -> DataFrame:
    """The columns `session_pattern` reads."""
    return sessions.select(
        "timestamp",
        F.col("metricas")["accuracy"].alias("accuracy"),
        F.col("metricas")["top_5"].alias("top_5"),
        F.col("kpis_medio_top10").alias("kpis"),
    )
