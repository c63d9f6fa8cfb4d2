"""Synthetic tables by a Gaussian copula, k-anonymity, distance to closest record, disclosure."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.numeric import half_even, hash52, normal_quantile
from portolan.operators.business import truncated_categories
from portolan.operators.nearest import nearest_distances
from portolan.operators.profile import roles_by_type
from portolan.operators.quantiles import average_rank, exact_quantiles
from portolan.session import stored

RANK_EPS = 1e-6


def normal_scores(df: DataFrame, column: str) -> DataFrame:
    """(value, z): normal score of the average rank of each distinct value."""
    clipped = F.greatest(F.lit(RANK_EPS), F.least(F.lit(1.0 - RANK_EPS), F.col("pct_rank")))
    return average_rank(df, F.col(column)).select("value", normal_quantile(clipped).alias("z"))


def score_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_a, col_b, corr) of the normal scores, each pair once."""
    # Equal rows carry equal scores: they are joined once and weighted by their number.
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).groupBy(*columns).agg(
        F.count(F.lit(1)).cast("double").alias("w")
    )
    scored = rows
    for c in columns:
        # Stored, so that its size is known before the join: scores of a few values are broadcast and no row moves.
        z = stored(normal_scores(df.select(F.col(c).cast("double").alias(c)), c), "normal-scores")
        scored = scored.join(z.withColumnRenamed("value", c).withColumnRenamed("z", f"z_{c}"), c, "left")
    aggregates, pairs = [], list(combinations(columns, 2))
    for a, b in pairs:
        x, y, w = F.col(f"z_{a}"), F.col(f"z_{b}"), F.col("w")
        both = x.isNotNull() & y.isNotNull()
        total = F.sum(F.when(both, w))
        mx, my = F.sum(F.when(both, w * x)) / total, F.sum(F.when(both, w * y)) / total
        cov = F.sum(F.when(both, w * x * y)) / total - mx * my
        var_x = F.sum(F.when(both, w * x * x)) / total - mx * mx
        var_y = F.sum(F.when(both, w * y * y)) / total - my * my
        aggregates.append((cov / F.sqrt(F.when(var_x * var_y > 0, var_x * var_y))).alias(f"{a}|{b}"))
    cells = F.array(
        *[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]
    )
    return scored.agg(*aggregates).select(F.explode(cells).alias("cell")).select("cell.*")


def numeric_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std): sample deviation, 1 where it is 0 or undefined."""
    found = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns],
        *[F.stddev_samp(F.col(c).cast("double")).alias(f"std_{c}") for c in columns],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"mean_{c}").alias("mean"),
                F.when(F.col(f"std_{c}") != 0, F.col(f"std_{c}")).otherwise(F.lit(1.0)).alias("std"),
            )
            for c in columns
        ]
    )
    return found.select(F.explode(cells).alias("cell")).select("cell.*")


@dataclass(frozen=True)
class Copula:
    """Fitted figures. Those of numbers and dates are bounded by the number of columns; categories are tables of ranges."""

    numeric: list[str]
    mean: dict[str, float]
    std: dict[str, float]
    corr: np.ndarray
    categories: dict[str, DataFrame] = field(default_factory=dict)
    dates: dict[str, tuple[int, int]] = field(default_factory=dict)
    rows: int = 0


CATEGORY_PARTS = 1024


def category_ranges(counts: DataFrame) -> DataFrame:
    """(category, low, high, total): the stretch of the numbers from 0 to total - 1 that draws a category.

    counts: (category, n). Categories lie one after another by hash part, then name: a part's start comes from the totals
    of at most CATEGORY_PARTS parts, and only inside a part is anything ordered.
    """
    placed = counts.select("category", "n", (hash52(F.col("category")) % CATEGORY_PARTS).alias("part"))
    parts = placed.groupBy("part").agg(F.sum("n").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = parts.select(
        "part",
        F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("start"),
        F.sum("in_part").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("category").rowsBetween(Window.unboundedPreceding, -1)
    ranged = placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "part")
    low = F.col("start") + F.col("inside")
    return ranged.select("category", low.alias("low"), (low + F.col("n")).alias("high"), "total")


def fit_copula(df: DataFrame, max_categories: int | None = None) -> Copula:
    """Moments and score correlations of numbers, frequencies of categories, range of dates.

    All categories are kept unless `max_categories` pools the rare ones, as published with 500.
    The rows are stored once: each figure is its own scan, which would otherwise repeat the joins that give the table.
    """
    return _fitted(stored(df, "copula-rows"), max_categories)


def _fitted(df: DataFrame, max_categories: int | None = None) -> Copula:
    """fit_copula() of a stored table."""
    roles = roles_by_type(df)
    numeric = roles["numeric"]
    moments = {r["column"]: r for r in numeric_moments(df, numeric).collect()} if numeric else {}
    corr = np.eye(len(numeric))
    if len(numeric) > 1:
        for r in score_correlations(df, numeric).collect():
            i, j = numeric.index(r["col_a"]), numeric.index(r["col_b"])
            corr[i, j] = corr[j, i] = 0.0 if r["corr"] is None else r["corr"]
    categories = {
        c: stored(category_ranges(truncated_categories(df, c, max_categories)), "copula_categories")
        for c in roles["categorical"]
    }
    dates = {}
    for c in roles["datetime"]:
        low, high = df.agg(
            F.unix_micros(F.min(c).cast("timestamp")), F.unix_micros(F.max(c).cast("timestamp"))
        ).first()
        dates[c] = (low, high)
    return Copula(
        numeric,
        {c: moments[c]["mean"] for c in numeric},
        {c: moments[c]["std"] for c in numeric},
        corr,
        categories,
        dates,
        df.count(),
    )


ROWS_PER_TASK = 1_000_000


def uniform(seed: int, column: str, row: str = "row_id") -> Column:
    """A number in (0, 1) that depends on seed, column and row alone, not on partitions or earlier draws."""
    return (hash52(F.lit(seed), F.lit(column), F.col(row)) + F.lit(0.5)) / F.lit(float(1 << 52))


def drawn_category(rows: DataFrame, ranges: DataFrame, column: str, seed: int) -> DataFrame:
    """rows with a category drawn by its share: a range join made equal on buckets of the numbers that are drawn.

    Buckets are about four times as many as categories, so a frequent category has many and a rare one shares its own;
    the table of ranges grows with the categories, not with the rows.
    """
    size = ranges.agg(F.count(F.lit(1)).alias("size"), F.max("total").alias("total")).first()
    if not size["size"]:
        return rows.withColumn(column, F.lit(None).cast("string"))
    width = max(1, size["total"] // (4 * size["size"]))
    draw = F.least(F.floor(uniform(seed, column) * F.lit(float(size["total"]))), F.lit(size["total"] - 1))
    buckets = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))
    spread = ranges.select(F.explode(buckets).alias("draw_bucket"), "low", "high", F.col("category").alias(column))
    # Only the draw moves with the row: its bucket follows from it where they meet.
    same = F.floor(F.col("draw") / width) == F.col("draw_bucket")
    hit = (F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high"))
    return rows.withColumn("draw", draw).join(spread, same & hit).drop("draw", "draw_bucket", "low", "high")


def sample_copula(spark, copula: Copula, n: int | None = None, seed: int = 42) -> DataFrame:
    """n synthetic rows: correlated normals with the fitted moments, independent categories and dates.

    Every number is a hash of (seed, column, row number), so a seed gives the same rows on any cluster and in any other engine.
    """
    n = copula.rows if n is None else n
    df = spark.range(0, n, 1, max(1, -(-n // ROWS_PER_TASK))).withColumnRenamed("id", "row_id")
    # Categories first: where their joins move rows, these hold no number or date yet, which follow from the row number.
    for c, ranges in copula.categories.items():
        df = drawn_category(df, ranges, c, seed)
    k = len(copula.numeric)
    try:
        lower = np.linalg.cholesky(copula.corr) if k else np.zeros((0, 0))
    except np.linalg.LinAlgError:
        lower = np.eye(k)
    df = df.withColumns({f"draw_u{i}": uniform(seed, c) for i, c in enumerate(copula.numeric)})
    df = df.withColumns({f"draw_z{i}": normal_quantile(F.col(f"draw_u{i}")) for i in range(k)})
    out: dict[str, Column] = {}
    for i, c in enumerate(copula.numeric):
        z = sum((F.lit(float(lower[i, j])) * F.col(f"draw_z{j}") for j in range(i + 1)), start=F.lit(0.0))
        out[c] = F.lit(copula.mean[c]) + F.lit(copula.std[c]) * z
    for c, (low, high) in copula.dates.items():
        if low is None:  # no date to draw from
            out[c] = F.lit(None).cast("timestamp")
            continue
        past = F.floor(uniform(seed, c) * F.lit(float(high - low))).cast("long")
        out[c] = F.timestamp_micros(F.lit(low) + past)
    df = df.select(*copula.categories, *[value.alias(c) for c, value in out.items()])
    return df.select(*copula.numeric, *copula.categories, *copula.dates)


def k_stats(df: DataFrame, quasi: list[str], k: int = 5) -> DataFrame:
    """One row: smallest group, mean group size per record, records and groups below k, records.

    Groups (NULL keys count as keys) are counted map-side; no row is gathered by group.
    """
    if not quasi:
        n = F.count(F.lit(1))
        return df.agg(
            n.alias("k_min"),
            n.cast("double").alias("k_medio"),
            F.lit(0).cast("long").alias("registros_violados"),
            F.lit(0).cast("long").alias("grupos_violados"),
            n.alias("registros"),
        )
    low = F.col("n") < k
    return (
        df.groupBy(*quasi)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.min("n").alias("k_min"),
            (F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("k_medio"),
            F.coalesce(F.sum(F.when(low, F.col("n"))), F.lit(0)).alias("registros_violados"),
            F.count_if(low).alias("grupos_violados"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("registros"),
        )
    )


def k_anonymity(original: DataFrame, synthetic: DataFrame, quasi: list[str], k: int = 5) -> DataFrame:
    """One-row comparison of both tables."""
    o = k_stats(original, quasi, k)
    s = k_stats(synthetic, quasi, k)
    both = o.select(F.struct(*o.columns).alias("o")).withColumn("s", s.select(F.struct(*s.columns).alias("s")).scalar())
    lost = F.when(
        F.col("s.registros") > 0, F.col("s.registros_violados") / F.col("s.registros") * F.lit(100.0)
    ).otherwise(0.0)
    return both.select(
        F.col("o.k_min").alias("k_min_original"),
        F.col("s.k_min").alias("k_min_sintetico"),
        half_even(F.col("o.k_medio"), 2).alias("k_medio_original"),
        half_even(F.col("s.k_medio"), 2).alias("k_medio_sintetico"),
        F.col("o.registros_violados").alias("registros_violados_original"),
        F.col("s.registros_violados").alias("registros_violados_sintetico"),
        F.col("o.grupos_violados").alias("grupos_violados_original"),
        F.col("s.grupos_violados").alias("grupos_violados_sintetico"),
        half_even(lost, 2).alias("registros_descartados_pct"),
        (F.col("s.k_min") >= k).alias("passa_k"),
    )


def disclosure_rate(original: DataFrame, synthetic: DataFrame, quasi: list[str]) -> DataFrame:
    """Percentage of synthetic records whose quasi-ids are unique in the original.

    Both sides are counted per group first, so the null-safe join has one row per group and side.
    """
    if not quasi:
        return synthetic.agg(F.lit(0.0).alias("taxa_divulgacao_pct"))
    o = original.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n_orig"))
    s = synthetic.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n_sint"))
    condition = F.lit(True)
    for c in quasi:
        condition = condition & o[c].eqNullSafe(s[c])
    joined = s.join(o, condition, "left").select("n_sint", "n_orig")
    hit = F.coalesce(F.sum(F.when(F.col("n_orig") == 1, F.col("n_sint"))), F.lit(0))
    total = F.coalesce(F.sum("n_sint"), F.lit(0))
    return joined.agg(
        half_even(hit / F.greatest(total, F.lit(1)) * F.lit(100.0), 3).alias("taxa_divulgacao_pct")
    )


def hash_sample(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The n rows with the smallest key hash: the same rows however the table is partitioned."""
    return df.withColumn("row_hash", hash52(*[F.col(c) for c in key])).orderBy("row_hash", *key).limit(n).drop("row_hash")


def closest_record_distance(
    original: DataFrame,
    synthetic: DataFrame,
    columns: list[str],
    key: list[str] | None = None,
    sample: int | None = None,
) -> DataFrame:
    """(dcr_min, dcr_med, dcr_p05): distances of synthetic rows to their closest original, in standard deviations.

    All rows of both tables are compared, so that one copied record gives 0. With `sample`, as published, that many
    rows a side are drawn by the hash of `key` first. Rows with a NULL or non-finite column are left out; without
    columns or rows the figures are NULL.
    """
    wanted = ("dcr_min", "dcr_med", "dcr_p05")
    if not columns:
        return original.agg(*[F.lit(None).cast("double").alias(c) for c in wanted])
    if sample is not None:
        if not key:
            raise ValueError("a sample needs the key that it is drawn by")
        original, synthetic = (hash_sample(t.select(*{*key, *columns}), key, sample) for t in (original, synthetic))
    names = [f"x{i}" for i in range(len(columns))]
    complete = reduce(and_, [F.abs(F.col(n)) < F.lit(float("inf")) for n in names])
    # Stored before the filter, which would read numbers from text once more for every test.
    o, s = (
        stored(t.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)]), "dcr_rows").where(complete)
        for t in (original, synthetic)
    )
    fit = o.agg(
        F.struct(
            *[F.avg(n).alias(f"m{n}") for n in names],
            *[(F.stddev_pop(n) + F.lit(1e-9)).alias(f"d{n}") for n in names],
        ).alias("fit")
    )
    fit = stored(fit, "dcr_fit")

    def scaled(t: DataFrame) -> DataFrame:
        return t.withColumn("fit", fit.scalar()).select(
            *[((F.col(n) - F.col(f"fit.m{n}")) / F.col(f"fit.d{n}")).alias(n) for n in names]
        )

    nearest = nearest_distances(scaled(s), scaled(o), names).select("copies", "distance")
    nearest = stored(nearest, "dcr_distances")
    found = exact_quantiles(nearest, F.col("distance"), {"dcr_med": 0.5, "dcr_p05": 0.05}, rows=F.col("copies"))
    least = nearest.agg(F.min("distance").alias("dcr_min"))
    return least.withColumn("q", found.select(F.struct("dcr_med", "dcr_p05").alias("q")).scalar()).select("dcr_min", "q.*")


def generate_and_validate(
    spark, original: DataFrame, quasi: list[str], k: int = 5, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Synthetic rows and a one-row report on anonymity, closest records and disclosure."""
    original = stored(original, "copula-rows")
    copula = _fitted(original)
    synthetic = stored(sample_copula(spark, copula, seed=seed), "synthetic")
    numeric = [c for c in quasi if c in roles_by_type(original)["numeric"]]
    report = k_anonymity(original, synthetic, quasi, k)
    kept = report.columns
    dcr = closest_record_distance(original, synthetic, numeric, quasi)
    rate = disclosure_rate(original, synthetic, quasi)
    return synthetic, (
        report.withColumns(
            {
                "dcr": dcr.select(F.struct(*dcr.columns).alias("d")).scalar(),
                "taxa_divulgacao_pct": rate.scalar(),
            }
        ).select(
            *kept,
            "dcr.*",
            "taxa_divulgacao_pct",
            F.lit(copula.rows).alias("n_original"),
            F.lit(copula.rows).alias("n_sintetico"),
        )
    )
