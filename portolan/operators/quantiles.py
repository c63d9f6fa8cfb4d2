"""Exact ranks, quantiles and medians without a single-task sort.

Values are first counted (so a value held by a third of the rows is one row), then cut into
buckets of about equally many distinct values. Bucket totals (a table of at most `buckets` rows
per group) give each bucket its offset, and only inside a bucket is anything ordered.

Quantiles of a whole table take two passes instead: a sketch brackets each one, then a scan counts what
lies between the brackets and shuffles only the values inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.numeric import bind

BUCKETS = 1024
STRIDE = 32
SKETCH_ACCURACY = 10_000
# Brackets reach three times the sketch's rank error to each side; tables in which that is fewer ranks than LEAST keep all values.
SLACK = 3 / SKETCH_ACCURACY
LEAST = 4


def value_counts(
    df: DataFrame, value: Column, by: list[str] | None = None, rows: Column | None = None
) -> DataFrame:
    """(by..., value, n) of the non-null values; `rows` is how many rows each row stands for."""
    by = by or []
    if rows is not None:
        kept = df.select(*by, value.alias("value"), rows.alias("n")).where(F.col("value").isNotNull())
        return kept.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    return df.select(*by, value.alias("value")).where(F.col("value").isNotNull()).groupBy(*by, "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def _bucket(value: Column) -> Column:
    """How many of s.cuts lie below the value: first among every 32nd cut, then among the 32 after it."""
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < value))
    return bind(
        below(F.col("s.coarse")),
        lambda k: k * STRIDE + below(F.slice(F.col("s.cuts"), k * STRIDE + 1, F.lit(STRIDE))),
    )


def value_ranks(
    df: DataFrame, value: Column, by: list[str] | None = None, buckets: int = BUCKETS, rows: Column | None = None
) -> DataFrame:
    """(by..., value, n, before, total): rows with a smaller value, and all rows, per group."""
    by = by or []
    counts = value_counts(df, value, by, rows)
    shares = F.expr("array(" + ", ".join(f"{(i + 1) / buckets}D" for i in range(buckets - 1)) + ")")
    # The sketch also sums n, so that it reads the very shuffle the ranking reads: one scan feeds both.
    sketch = counts.agg(
        F.percentile_approx("value", shares, SKETCH_ACCURACY).alias("cuts"), F.sum("n").alias("rows")
    ).select(
        F.struct(
            "cuts", F.filter("cuts", lambda c, i: i % STRIDE == STRIDE - 1).alias("coarse"), "rows"
        ).alias("s")
    )
    placed = counts.withColumn("s", sketch.scalar()).select(*by, "value", "n", _bucket(F.col("value")).alias("bucket"))
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "bucket")
        .agg(F.sum("n").alias("in_bucket"))
        .select(
            *by,
            "bucket",
            F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("offset"),
            F.sum("in_bucket").over(Window.partitionBy(*by)).alias("total"),
        )
    )
    inside = Window.partitionBy(*by, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    # Groups may hold NULL keys, which count as a group.
    keys = [ranked[c].eqNullSafe(offsets[c]) for c in [*by, "bucket"]]
    condition = keys[0]
    for key in keys[1:]:
        condition = condition & key
    return ranked.join(offsets, condition).select(
        *[ranked[c] for c in by],
        ranked["value"],
        ranked["n"],
        (F.col("inside") + F.col("offset")).alias("before"),
        F.col("total"),
    )


def _at(position: Column) -> Column:
    """The value whose run of equal rows covers a 0-based position."""
    return F.max(F.when((F.col("before") <= position) & (position < F.col("before") + F.col("n")), F.col("value")))


def _brackets(values: DataFrame, shares: list[float]) -> Column:
    """One struct for the table: `lo` and `hi`, an entry for each share, and `open` where every value is to be kept."""
    ends = [max(0.0, q - SLACK) for q in shares] + [min(1.0, q + SLACK) for q in shares]
    cuts = F.percentile_approx("value", F.array(*[F.lit(x) for x in ends]), SKETCH_ACCURACY)
    k = len(shares)
    return (
        values.agg(cuts.alias("cuts"), F.count(F.lit(1)).alias("rows"))
        .select(
            F.struct(
                F.slice("cuts", 1, k).alias("lo"),
                F.slice("cuts", k + 1, k).alias("hi"),
                (F.col("rows") * SLACK < LEAST).alias("open"),
            ).alias("b")
        )
        .scalar()
    )


def _inside(value: Column, i: int) -> Column:
    return (value >= F.col("b.lo")[i]) & (value <= F.col("b.hi")[i])


def selected_values(values: DataFrame, brackets: Column, n: int) -> DataFrame:
    """(value, copies): the values inside one of n brackets, and one row for all between two of them, with their largest."""
    kept, gap = F.col("b.open"), F.lit(0)
    for i in range(n):
        kept = kept | _inside(F.col("value"), i)
        gap = gap + F.when(F.col("value") > F.col("b.hi")[i], 1).otherwise(0)
    placed = values.withColumn("b", brackets).select("value", kept.alias("kept"), gap.alias("gap"))
    return (
        placed.groupBy(F.when(~F.col("kept"), F.col("gap")).alias("gap"), F.when(F.col("kept"), F.col("value")).alias("inside"))
        .agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("copies"))
        .select("value", "copies")
    )


def whole_quantiles(df: DataFrame, value: Column, quantiles: dict[str, float]) -> DataFrame:
    """exact_quantiles() of all rows by selection: of the values, only those inside a bracket are shuffled and ordered.

    An answer outside its bracket cannot come from a sketch that keeps its bound; it raises.
    """
    names = sorted(quantiles, key=quantiles.get)
    values = df.select(value.alias("value")).where(F.col("value").isNotNull())
    brackets = _brackets(values, [float(quantiles[n]) for n in names])
    counted = selected_values(values, brackets, len(names))
    found = interpolated(value_ranks(counted, F.col("value"), rows=F.col("copies")), quantiles, [])
    sure = found.withColumn("b", brackets)
    for i, name in enumerate(names):
        at = F.col(name)
        fits = F.col("b.open") | at.isNull() | _inside(at, i)
        sure = sure.withColumn(name, F.when(fits, at).otherwise(F.raise_error(F.lit(f"{name} lies outside its bracket"))))
    return sure.select(*quantiles)


def exact_quantiles(
    df: DataFrame, value: Column, quantiles: dict[str, float], by: list[str] | None = None, rows: Column | None = None
) -> DataFrame:
    """One row (per group) with the linearly interpolated quantiles named in `quantiles`."""
    if not by and rows is None:
        return whole_quantiles(df, value, quantiles)
    return interpolated(value_ranks(df, value, by, rows=rows), quantiles, by or [])


def interpolated(ranks: DataFrame, quantiles: dict[str, float], by: list[str]) -> DataFrame:
    """The quantiles of ranks from value_ranks(), by position between two rows."""
    parts = []
    for name, q in quantiles.items():
        place = F.lit(float(q)) * (F.col("total") - 1)
        parts += [
            _at(F.floor(place)).alias(f"{name}_lo"),
            _at(F.ceil(place)).alias(f"{name}_hi"),
            F.max(place - F.floor(place)).alias(f"{name}_part"),
        ]
    found = ranks.groupBy(*by).agg(*parts)
    return found.select(
        *by,
        *[
            (
                F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * F.col(f"{name}_part")
            ).alias(name)
            for name in quantiles
        ],
    )


def approx_quantiles(
    df: DataFrame, value: Column, quantiles: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """The same columns from a mergeable sketch: one pass, rank error at most 1/10000."""
    by = by or []
    return df.groupBy(*by).agg(
        *[F.percentile_approx(value, F.lit(float(q)), SKETCH_ACCURACY).alias(name) for name, q in quantiles.items()]
    )


def quantiles(
    df: DataFrame, value: Column, wanted: dict[str, float], by: list[str] | None = None, method: str = "exact"
) -> DataFrame:
    if method == "exact":
        return exact_quantiles(df, value, wanted, by)
    if method == "approx":
        return approx_quantiles(df, value, wanted, by)
    raise ValueError(f"unknown method: {method}")


def median(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    return exact_quantiles(df, value, {"median": 0.5}, by)


def average_rank(df: DataFrame, value: Column) -> DataFrame:
    """(value, n, pct_rank): rank in (0, 1], ties averaged, per distinct value."""
    return value_ranks(df, value).select(
        "value",
        "n",
        ((F.col("before") + (F.col("n") + 1) / F.lit(2.0)) / F.col("total")).alias("pct_rank"),
    )


def kth_smallest(df: DataFrame, value: Column, share: float, by: list[str] | None = None) -> DataFrame:
    """(by..., cut): the value at rank ceil(share * rows), counted from 1."""
    by = by or []
    ranks = value_ranks(df, value, by)
    return ranks.groupBy(*by).agg(_at(F.ceil(F.lit(share) * F.col("total")) - 1).alias("cut"))
