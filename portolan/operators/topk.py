"""Rankings, top-k, samples and splits. Every order ends in a full tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.numeric import hash52, lenient_double
from portolan.session import stored


def topk_per_group(df: DataFrame, group: str, score: str, ties: list[str], k: int = 50) -> DataFrame:
    """The k best rows per group; NULL scores last. Each map task already keeps only k rows per
    group (WindowGroupLimit), so a hot group reaches the window as k rows per task."""
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), *ties)
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def largest(df: DataFrame, by: Column, ties: list[str], n: int) -> DataFrame:
    """The n rows with the largest value, NULLs last."""
    return (
        df.withColumn("sort_value", by).orderBy(F.desc_nulls_last("sort_value"), *ties).limit(n).drop("sort_value")
    )


def largest_operations(df: DataFrame, value: str, ties: list[str], n: int = 5) -> DataFrame:
    return largest(df, lenient_double(value), ties, n)


def longest_texts(df: DataFrame, text: str, ties: list[str], n: int = 3) -> DataFrame:
    return largest(df.withColumn("tamanho_desc", F.length(text)), F.col("tamanho_desc"), ties, n)


def top_risk(df: DataFrame, ties: list[str], n: int = 5000) -> DataFrame:
    return largest(df, F.col("RiskScore"), ties, n)


def top_classes(
    scores: DataFrame, row: list[str], k: int = 5, label: str = "class", p: str = "p", digits: int | None = 9
) -> DataFrame:
    """Long form (row, class, p) to one row with Top1..Topk and their values.

    Scores that differ only in the last bits (sums in another order) are ties, broken by class.
    """
    key = F.round(p, digits) if digits is not None else F.col(p)
    order = Window.partitionBy(*row).orderBy(F.desc("rank_key"), label)
    ranked = (
        scores.withColumn("rank_key", key).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    )
    picks = []
    for r in range(1, k + 1):
        picks += [
            F.max(F.when(F.col("rn") == r, F.col(label))).alias(f"Top{r}"),
            F.max(F.when(F.col("rn") == r, F.col(p))).alias(f"Top{r}_p"),
        ]
    return ranked.groupBy(*row).agg(*picks)


def first_rows(df: DataFrame, order: list[str], n: int = 30_000) -> DataFrame:
    return df.orderBy(*order).limit(n)


def capped_sample(
    df: DataFrame, source: str, key: list[str], per_source: int = 200, n: int = 30_000
) -> DataFrame:
    """At most `per_source` rows of each source and n in all, chosen by the hash of the row key, so
    that the choice does not depend on how rows are spread over tasks."""
    hashed = df.withColumn("row_hash", hash52(*[F.col(c) for c in key]))
    order = Window.partitionBy(source).orderBy("row_hash", *key)
    return (
        hashed.withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= per_source)
        .orderBy("row_hash", *key)
        .limit(n)
        .drop("rn", "row_hash")
    )


# Prefixes of the 52-bit row hash that are counted per label, and labels whose cuts are sent to every task: sizes of
# tasks, without influence on results.
PREFIX_BITS = 12
SENT_LABELS = 10_000


def hash_cuts(hashed: DataFrame, label: str, share: float) -> DataFrame:
    """(cut_label, cut, label_rows): per label, the `row_hash` at rank ceil(share * rows), counted from 1, and its rows.

    Rows are counted by label and first bits of the hash, which gives the stretch that holds the rank; only the rows inside
    it, one of 4,096, are shuffled and ordered. A cut is NULL where the rank is 0.
    """
    prefix = F.shiftright("row_hash", 52 - PREFIX_BITS).alias("prefix")
    counts = hashed.groupBy(F.col(label).alias("cut_label"), prefix).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("cut_label").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns(
        {
            "before": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "label_rows": F.sum("n").over(Window.partitionBy("cut_label")),
        }
    ).withColumn("rank", F.ceil(F.lit(share) * F.col("label_rows")))
    held = (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n"))
    stretch = placed.groupBy("cut_label").agg(
        F.max("label_rows").alias("label_rows"),
        F.max(F.when(held, F.col("prefix"))).alias("cut_prefix"),
        F.max(F.when(held, F.col("rank") - F.col("before"))).alias("rank"),
    )
    stretch = stored(stretch, "split-stretches")
    inside = hashed.select(F.col(label).alias("in_label"), prefix, "row_hash").join(
        _sent(stretch), F.col("in_label").eqNullSafe(F.col("cut_label")) & (F.col("prefix") == F.col("cut_prefix"))
    )
    values = inside.groupBy("cut_label", "rank", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("cut_label").orderBy("row_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = values.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= F.col("rank"))
    cuts = reached.groupBy(F.col("cut_label").alias("of_label")).agg(F.min("row_hash").alias("cut"))
    return stretch.join(cuts, F.col("cut_label").eqNullSafe(F.col("of_label")), "left").select("cut_label", "cut", "label_rows")


def _sent(figures: DataFrame) -> DataFrame:
    """A stored table of one row per label, broadcast where it has few."""
    return F.broadcast(figures) if len(figures.take(SENT_LABELS + 1)) <= SENT_LABELS else figures


def stratified_split(df: DataFrame, label: str, key: list[str], test_share: float = 0.2) -> DataFrame:
    """Adds `split` (train/test): per label, the rows with the smallest key hashes are the test rows.

    The hashed rows are stored once and read three times: to count, to find each label's cut, to split.
    Labels with a single row stay in train.
    """
    hashed = stored(df.withColumn("row_hash", hash52(*[F.col(c) for c in key])), "split-rows")
    cuts = _sent(stored(hash_cuts(hashed, label, test_share), "split-cuts"))
    test = (F.col("row_hash") <= F.col("cut")) & (F.col("label_rows") >= 2)
    return (
        hashed.join(cuts, F.col(label).eqNullSafe(F.col("cut_label")))
        .withColumn("split", F.when(test, "test").otherwise("train"))
        .drop("row_hash", "cut", "cut_label", "label_rows")
    )


def last_rows(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)
