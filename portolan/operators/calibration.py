"""Probability calibration: metrics as aggregates, calibrators as Newton fits or pooled steps.

Fits see one weighted row per distinct (p, y): the likelihood and the pooled means are unchanged and
repeated probabilities are combined before any iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.session import scratch_path, stored

BINS = 15
EPS = 1e-9
NO_TEMPERATURE = 1e12
# Newton fits: largest mean gradient of a finished one, steps until then.
GRADIENT = 1e-10
NEWTON_STEPS = 100
# Buckets of the join that applies isotonic steps: at least these, and a few for each step.
STEP_BUCKETS = 1024
METHODS = ("platt", "isotonic", "beta", "temperature")


def _bin_edge(i: int, n_bins: int) -> float:
    return 1.0 if i == n_bins else i * (1.0 / n_bins)


def bin_of(p: Column, n_bins: int = BINS) -> Column:
    """Index of the half-open bin [lo, hi) holding p; NULL outside, so p = 1 is in no bin."""
    out = F.lit(None).cast("int")
    for i in reversed(range(n_bins)):
        out = F.when((p >= _bin_edge(i, n_bins)) & (p < _bin_edge(i + 1, n_bins)), F.lit(i)).otherwise(out)
    return out


def brier_score(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def reliability(
    df: DataFrame, y: str = "y", p: str = "p", n_bins: int = BINS, by: list[str] | None = None
) -> DataFrame:
    """(by..., bin_center, accuracy, confidence, count) of the non-empty bins."""
    by = by or []
    centre = F.lit(None).cast("double")
    for i in range(n_bins):
        centre = F.when(F.col("bin") == i, F.lit((_bin_edge(i, n_bins) + _bin_edge(i + 1, n_bins)) / 2)).otherwise(centre)
    return (
        df.withColumn("bin", bin_of(F.col(p), n_bins))
        .where(F.col("bin").isNotNull())
        .groupBy(*by, "bin")
        .agg(
            F.avg(F.col(y).cast("double")).alias("accuracy"),
            F.avg(p).alias("confidence"),
            F.count(F.lit(1)).alias("count"),
        )
        .select(*by, centre.alias("bin_center"), "accuracy", "confidence", "count")
    )


def calibration_errors(
    df: DataFrame,
    y: str = "y",
    p: str = "p",
    n_bins: int = BINS,
    by: list[str] | None = None,
    rows: Column | None = None,
) -> DataFrame:
    """(by..., brier, ece, mce) in one pass: sums per bin, then over the bins. Rows outside every bin
    count in the number of rows only. `rows` is how many rows each row stands for."""
    by = by or []
    rows = F.lit(1) if rows is None else rows
    err = (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))
    bins = (
        df.withColumn("bin", bin_of(F.col(p), n_bins))
        .groupBy(*by, "bin")
        .agg(
            F.sum(rows).alias("n"),
            F.sum(rows * F.col(y).cast("double")).alias("sum_y"),
            F.sum(rows * F.col(p)).alias("sum_p"),
            F.sum(rows * err).alias("sum_err"),
        )
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sum_y") - F.col("sum_p")))
    return bins.groupBy(*by).agg(
        (F.sum("sum_err") / F.sum("n")).alias("brier"),
        (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"),
        F.coalesce(F.max(gap / F.col("n")), F.lit(0.0)).alias("mce"),
    )


def expected_calibration_error(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = BINS) -> DataFrame:
    return calibration_errors(df, y, p, n_bins).select("ece")


def maximum_calibration_error(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = BINS) -> DataFrame:
    return calibration_errors(df, y, p, n_bins).select("mce")


@dataclass(frozen=True)
class Calibrator:
    """A fitted calibrator: `apply` adds the calibrated probability; `params` are its figures."""

    method: str
    apply: Callable[[DataFrame, str, str], DataFrame]
    params: dict[str, float] = field(default_factory=dict)


def _sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(EPS), F.least(F.lit(1.0 - EPS), p))


def _distinct_points(df: DataFrame, y: str, p: str, rows: Column | None = None) -> DataFrame:
    """(p, label, weight); `rows` is how many rows each row stands for."""
    return (
        df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(p).alias("p"), F.col(y).cast("double").alias("label"))
        .agg((F.count(F.lit(1)) if rows is None else F.sum(rows)).cast("double").alias("weight"))
    )


def _logistic(points: DataFrame, features: list[Column], intercept: bool) -> tuple[list[float], float]:
    """Unpenalised maximum likelihood on explicit features, by Newton steps: each is one aggregate to one row.

    A step that raises the loss is halved. Ends when the mean gradient is below GRADIENT, one last step from its
    sums included; raises when it never is.
    """
    columns = [*features, F.lit(1.0)] if intercept else features
    size = len(columns)
    path = scratch_path(points.sparkSession, "points")
    points.select("label", "weight", *[c.alias(f"x{i}") for i, c in enumerate(columns)]).write.parquet(path)
    data = points.sparkSession.read.parquet(path)
    at, step, best = np.zeros(size), np.zeros(size), np.inf
    for _ in range(NEWTON_STEPS):
        weight, loss, gradient, curve = _newton_sums(data, at)
        if not weight:
            raise ValueError("no rows to fit")
        if np.abs(gradient).max() <= GRADIENT * weight:
            values = [float(v) for v in at + np.linalg.lstsq(curve, -gradient, rcond=None)[0]]
            return (values[:-1], values[-1]) if intercept else (values, 0.0)
        if loss > best * (1 + 1e-12):
            step = step / 2
            at = at - step
            continue
        best = loss
        step = np.linalg.lstsq(curve, -gradient, rcond=None)[0]
        at = at + step
    raise RuntimeError("the fit did not converge")


def _newton_sums(data: DataFrame, at: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Weight, loss, gradient and second derivatives at given coefficients."""
    pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]
    z = sum((F.lit(float(v)) * F.col(f"x{i}") for i, v in enumerate(at)), F.lit(0.0))
    seen = data.withColumn("z", z).withColumn("q", _sigmoid(F.col("z")))
    off = F.col("weight") * (F.col("q") - F.col("label"))
    spread = F.col("weight") * F.col("q") * (1 - F.col("q"))
    loss = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("label") * F.col("z")
    row = seen.agg(
        F.sum("weight"),
        F.sum(F.col("weight") * loss),
        *[F.sum(off * F.col(f"x{i}")) for i in range(len(at))],
        *[F.sum(spread * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs],
    ).first()
    curve = np.zeros((len(at), len(at)))
    for (i, j), value in zip(pairs, row[2 + len(at) :], strict=True):
        curve[i, j] = curve[j, i] = value or 0.0
    return row[0] or 0.0, row[1] or 0.0, np.array([v or 0.0 for v in row[2 : 2 + len(at)]]), curve


def fit_platt(df: DataFrame, y: str = "y", p: str = "p", rows: Column | None = None) -> Calibrator:
    (slope,), intercept = _logistic(_distinct_points(df, y, p, rows), [F.col("p")], True)

    def apply(frame: DataFrame, source: str, out: str) -> DataFrame:
        return frame.withColumn(out, _sigmoid(F.lit(slope) * F.col(source) + F.lit(intercept)))

    return Calibrator("platt", apply, {"slope": slope, "intercept": intercept})


def fit_sigmoid(df: DataFrame, y: str = "y", score: str = "p") -> Calibrator:
    """Sigmoid on any score, with targets pulled in from 0 and 1 so that a fit exists even where the
    score separates the classes: each row counts partly for the other label."""
    points = _distinct_points(df, y, score)
    sizes = points.agg(
        F.struct(
            F.coalesce(F.sum(F.when(F.col("label") == 1.0, F.col("weight"))), F.lit(0.0)).alias("pos"),
            F.coalesce(F.sum(F.when(F.col("label") == 0.0, F.col("weight"))), F.lit(0.0)).alias("neg"),
        ).alias("s")
    ).scalar()
    target = F.when(F.col("label") == 1.0, (F.col("s.pos") + 1) / (F.col("s.pos") + 2)).otherwise(
        1 / (F.col("s.neg") + 2)
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), (F.col("weight") * F.col("target")).alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (F.col("weight") * (1 - F.col("target"))).alias("weight")),
        )
    )
    soft = points.withColumn("s", sizes).withColumn("target", target).select("p", sides.alias("side")).select("p", "side.*")
    (slope,), intercept = _logistic(soft, [F.col("p")], True)

    def apply(frame: DataFrame, source: str, out: str) -> DataFrame:
        return frame.withColumn(out, _sigmoid(F.lit(slope) * F.col(source) + F.lit(intercept)))

    return Calibrator("sigmoid", apply, {"slope": slope, "intercept": intercept})


_BLOCK = "lo double, hi double, weight double, total double"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in ascending order to blocks of strictly rising means: a block that does not rise joins the one before."""
    lo, hi, weight, total = [], [], [], []
    for batch in batches:
        for a, b, w, t in zip(*(batch.column(n).to_pylist() for n in ("lo", "hi", "weight", "total")), strict=True):
            while weight and total[-1] / weight[-1] >= t / w:
                a, w, t = lo.pop(), w + weight.pop(), t + total.pop()
                hi.pop()
            lo.append(a), hi.append(b), weight.append(w), total.append(t)
    yield pa.RecordBatch.from_pydict(
        {n: pa.array(v, pa.float64()) for n, v in (("lo", lo), ("hi", hi), ("weight", weight), ("total", total))}
    )


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last pooling: (lo, hi, value) and the next step's lo and value."""
    for pooled in _pool(batches):
        lo, hi = pooled.column("lo"), pooled.column("hi")
        value = pa.array(pooled.column("total").to_numpy() / pooled.column("weight").to_numpy())
        follow = [pa.array(c.to_pylist()[1:] + [None] * min(len(c), 1), pa.float64()) for c in (lo, value)]
        yield pa.RecordBatch.from_arrays([lo, hi, value, *follow], ["lo", "hi", "value", "next_lo", "next_value"])


def isotonic_steps(df: DataFrame, y: str = "y", p: str = "p", rows: Column | None = None) -> DataFrame:
    """Pool-adjacent-violators as a mergeable summary: (lo, hi, value, next_lo, next_value), a row for each step.

    Neighbours that do not rise share a step in the end in whatever order they are pooled, so blocks are pooled
    inside sorted ranges of p first and the pooled ones once more, in one task. With labels of 0 and 1 that task's
    rows are few: rising means are different fractions whose denominators sum to the rows, so n rows leave at most
    about n^(2/3) blocks a range. Rows with a NULL p or label count for nothing; an empty table gives no step.
    """
    points = _distinct_points(df, y, p, rows).groupBy("p").agg(
        F.sum("weight").alias("weight"), F.sum(F.col("label") * F.col("weight")).alias("total")
    )
    ordered = points.select(F.col("p").cast("double").alias("lo"), F.col("p").cast("double").alias("hi"), "weight", "total")
    pooled = ordered.repartitionByRange("lo").sortWithinPartitions("lo").mapInArrow(_pool, _BLOCK)
    return stored(pooled, "isotonic-blocks").repartition(1).sortWithinPartitions("lo").mapInArrow(
        _steps, "lo double, hi double, value double, next_lo double, next_value double"
    )


def apply_steps(frame: DataFrame, steps: DataFrame, source: str, out: str) -> DataFrame:
    """Adds `out`: the value of the step that holds `source`, linear between two steps, the end values outside.

    A range join made equal on buckets of the fitted range: a step lies in each bucket it reaches up to the next step.
    NULL stays NULL; NaN counts as the largest value.
    """
    low, high, n = steps.agg(F.min("lo"), F.max("hi"), F.count(F.lit(1))).first()
    scale = max(STEP_BUCKETS, 2 * n) / (high - low) if high > low else 0.0
    bucket = lambda x: F.floor((x - F.lit(low)) * F.lit(scale))
    ranges = steps.select(
        *[F.col(c).alias(f"step_{c}") for c in steps.columns],
        F.explode(F.sequence(bucket(F.col("lo")), bucket(F.coalesce("next_lo", F.lit(high))))).alias("step_bucket"),
    )
    at = F.least(F.lit(high), F.greatest(F.lit(low), F.col("step_at")))
    rows = frame.withColumn("step_at", F.col(source).cast("double"))
    rows = rows.withColumn("step_at", F.when(F.col("step_at").isNotNull(), at)).withColumn("row_bucket", bucket(F.col("step_at")))
    held = (
        (F.col("row_bucket") == F.col("step_bucket"))
        & (F.col("step_at") >= F.col("step_lo"))
        & (F.col("step_next_lo").isNull() | (F.col("step_at") < F.col("step_next_lo")))
    )
    between = F.col("step_value") + (F.col("step_next_value") - F.col("step_value")) * (
        F.col("step_at") - F.col("step_hi")
    ) / (F.col("step_next_lo") - F.col("step_hi"))
    value = F.when(F.col("step_at") <= F.col("step_hi"), F.col("step_value")).otherwise(between)
    return rows.join(ranges, held, "left").select(*[c for c in frame.columns if c != out], value.alias(out))


def fit_isotonic(df: DataFrame, y: str = "y", p: str = "p", rows: Column | None = None) -> Calibrator:
    """Pool-adjacent-violators; the steps are a table, which `apply` joins by range."""
    steps = stored(isotonic_steps(df, y, p, rows), "isotonic-steps")
    n = steps.count()
    if not n:
        raise ValueError("no rows to fit")
    return Calibrator("isotonic", lambda frame, source, out: apply_steps(frame, steps, source, out), {"steps": float(n)})


def fit_beta(df: DataFrame, y: str = "y", p: str = "p", rows: Column | None = None) -> Calibrator:
    """sigmoid(a ln p + b ln(1-p) + c), the same convex problem as a logistic regression on both logs."""
    safe = _clipped(F.col("p"))
    (a, b), c = _logistic(_distinct_points(df, y, p, rows), [F.ln(safe), F.ln(F.lit(1.0) - safe)], True)

    def apply(frame: DataFrame, source: str, out: str) -> DataFrame:
        q = _clipped(F.col(source))
        return frame.withColumn(out, _sigmoid(F.lit(a) * F.ln(q) + F.lit(b) * F.ln(F.lit(1.0) - q) + F.lit(c)))

    return Calibrator("beta", apply, {"a": a, "b": b, "c": c})


def fit_temperature(df: DataFrame, y: str = "y", p: str = "p", rows: Column | None = None) -> Calibrator:
    """sigmoid(logit(p) / T). A slope that is not positive has no finite T: then T is very large and
    every output 0.5."""
    safe = _clipped(F.col("p"))
    (slope,), _ = _logistic(_distinct_points(df, y, p, rows), [F.ln(safe / (F.lit(1.0) - safe))], False)
    temperature = max(1.0 / slope, 1e-3) if slope > 1.0 / NO_TEMPERATURE else NO_TEMPERATURE

    def apply(frame: DataFrame, source: str, out: str) -> DataFrame:
        q = _clipped(F.col(source))
        return frame.withColumn(out, _sigmoid(F.ln(q / (F.lit(1.0) - q)) / F.lit(temperature)))

    return Calibrator("temperature", apply, {"T": temperature})


FITTERS = {"platt": fit_platt, "isotonic": fit_isotonic, "beta": fit_beta, "temperature": fit_temperature}


@dataclass(frozen=True)
class AutoCalibration:
    best: Calibrator
    report: DataFrame


def fit_auto(
    df: DataFrame, y: str = "y", p: str = "p", methods: tuple[str, ...] = METHODS, n_bins: int = BINS
) -> AutoCalibration:
    """The calibrator with the lowest in-sample ECE (to 12 decimals), ties to the earlier method, and its one-row report.

    A fit that fails raises; it is not skipped in silence. Fits and comparison share one table of weighted
    distinct (p, y) rows: each candidate adds a column, and one aggregation gives all errors.
    """
    points = stored(_distinct_points(df, y, p), "points")
    fitted = [FITTERS[m](points, "label", "p", rows=F.col("weight")) for m in methods]
    tried = points
    for i, calibrator in enumerate(fitted):
        tried = calibrator.apply(tried, "p", f"cal_{i}")
    columns = [F.struct(F.lit(i).alias("i"), F.col(f"cal_{i}").alias("p_cal")) for i in range(len(fitted))]
    tried = tried.select("label", "weight", F.explode(F.array(*columns)).alias("c")).select("label", "weight", "c.*")
    errors = calibration_errors(tried, "label", "p_cal", n_bins, ["i"], F.col("weight"))
    errors = errors.withColumn("rank", F.round("ece", 12)).orderBy("rank", "i").first()
    best = fitted[errors["i"]]
    before = calibration_errors(points, "label", "p", n_bins, rows=F.col("weight"))
    report = before.select(
        F.lit(best.method).alias("method"),
        F.col("brier").alias("brier_before"),
        F.lit(errors["brier"]).alias("brier_after"),
        F.col("ece").alias("ece_before"),
        F.lit(errors["ece"]).alias("ece_after"),
        F.col("mce").alias("mce_before"),
        F.lit(errors["mce"]).alias("mce_after"),
        F.lit(best.params.get("T", 1.0)).alias("temperature"),
    )
    return AutoCalibration(best, report)


def cross_fitted_sigmoid(
    scores: DataFrame, fold: str = "fold", y: str = "y", score: str = "p", out: str = "p_cal"
) -> DataFrame:
    """Sigmoid calibration in which each fold is mapped by a fit on the other folds."""
    folds = [r[fold] for r in scores.select(fold).distinct().orderBy(fold).collect()]
    parts = [
        fit_sigmoid(scores.where(F.col(fold) != f), y, score).apply(scores.where(F.col(fold) == f), score, out)
        for f in folds
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
