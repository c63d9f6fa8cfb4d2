"""Exact duplicates by two passes over a Bloom filter (operator 2).

Pass one puts a hash of every normalised text into "seen" and "seen again" bit arrays, merged over all tasks. Pass two
lets every row whose hash can't be repeated straight through; only the others are shuffled and grouped by the SHA-256
of the normalised text, which decides. The filter has no false negatives, so no copy is missed, and its size is a
parameter that doesn't follow the data: past about 2^bits / 8 texts more single rows join the shuffle, with equal results.

Cases: null text counts as empty, and all empty texts are equal. Of equal texts, the row with the most code points in
its original text stays, then the smallest id, null ids last; of rows that agree in all this, exactly one stays.
An empty table gives an empty result. Other columns are not looked at; `dedup_rows` returns them untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.llm.sketch import SCHEMA, Counter, Repeats, repeats
from portolan.llm.support import packed, releasing, stored, texts, unpacked

BITS, FUNCTIONS = 26, 4
GAPS = " \t\n\x0b\x0c\r"


def fingerprint(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without the characters [\\x20\\x09-\\x0D]."""
    return F.sha2(F.translate(text, GAPS, "").cast("binary"), 256)


def short_hash(sha: Column) -> Column:
    return F.xxhash64(sha)


def may_repeat(hashes: DataFrame, bits: int = BITS) -> Repeats:
    """First pass over one column of hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(bits, FUNCTIONS, False)
        for batch in batches:
            seen.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield from seen.pages()

    return repeats(hashes.mapInArrow(releasing(count), SCHEMA), bits, FUNCTIONS, False)


def may_be_among(df: DataFrame, column: str, hashes: DataFrame, bits: int = BITS) -> DataFrame:
    """Adds `may_repeat`: false only for rows whose hash is not in `hashes`. For joins in which few rows have a partner."""
    return flagged(df, may_repeat(hashes.unionByName(hashes), bits), column)  # each hash twice, so that all are "seen again"


def flagged(df: DataFrame, found: Repeats, column: str) -> DataFrame:
    """Second pass: adds `may_repeat`, by the filter, from a column of hashes."""
    sent = df.sparkSession.sparkContext.broadcast(found)
    fields = df.schema.names

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = sent.value.may(batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may)], [*fields, "may_repeat"])

    return df.mapInArrow(releasing(look), T.StructType([*df.schema.fields, T.StructField("may_repeat", T.BooleanType())]))


def group_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row for each row: doc_id, keep_id, group_size, kept, text_sha256."""
    t = texts(df, id_col, text_col)
    prints = t.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("row_no")
    ).withColumn("hash", short_hash(F.col("text_sha256")))
    prints = stored(prints, "prints")  # numbered once: both passes and the join see the same rows
    marked = stored(flagged(prints, may_repeat(prints.select("hash"), bits), "hash"), "prints")
    single = marked.where("NOT may_repeat").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    again = marked.where("may_repeat")
    # The smallest struct: most code points, then the smallest id (nulls last), then the first row.
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
    # A large group is one hot key of this join. Its groups are a table, so that both sides come from shuffles of their
    # own and Spark can split a skewed partition at run time.
    groups = stored(again.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    joined = again.join(groups, "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("best.row_no")).alias("kept"), "text_sha256"
    )
    return single.unionByName(joined)


def dedup_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows that stay, with all their columns. Rows that can't be repeated are not shuffled."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = packed(df, n=-F.length(text).cast("long"), id=F.col(id_col), sha=fingerprint(text))
    keyed = keyed.withColumn("hash", short_hash(F.col("sha")))
    marked = flagged(keyed, may_repeat(keyed.select("hash"), bits), "hash")
    once = marked.where("NOT may_repeat").select("row")
    order = F.struct("n", F.col("id").isNull(), "id")
    # min_by keeps one row of each key in every task before the shuffle, so a large group arrives as one row a task.
    one = marked.where("may_repeat").groupBy("sha").agg(F.min_by("row", order).alias("row")).select("row")
    return unpacked(once.unionByName(one))
