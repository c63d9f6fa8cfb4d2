"""Per-column profiles, column roles, id detection, type narrowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions.ids import digits_only
from portolan.functions.numeric import half_even, lenient_double

# Names taken for an id column, by table generation.
ID_NAMES = (
    "cnpj", "cnpj_cpf", "nr_cnpj", "num_cnpj", "numero_ordem", "num_ordem", "nro_ordem", "ordem",
    "id", "codigo", "cod", "numero", "nro", "num", "processo", "chave",
)
SHORT_ID_NAMES = ("chave_item", "cnpj", "id", "codigo")
# The limits of the role rules.
NULL_LIMIT = 0.95
DIGIT_SHARE = 0.7
NUMBER_SHARE = 0.7
FEW_NUMBERS = 20
FEW_TEXTS = 50
# Text with 8 to 20 digits, and how any text that a cast reads as a number begins: a failed cast costs many times a match.
DIGIT_LIKE = r"^\D*(?:\d\D*){8,20}$"
NUMBER_START = r"^[\x00-\x20]*[+-]?[0-9.nNiI]"


def _counted(df: DataFrame, names: list[str]) -> DataFrame:
    """(place, value, n): every column's values as text, counted; `place` is the column's place in `names`.

    Repeated values are combined before the shuffle, and what follows sees each value once. A place is a number, so that
    no name is hashed and moved with every value.
    """
    cells = [F.struct(F.lit(i).cast("short").alias("place"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)]
    return df.select(F.inline(F.array(*cells))).groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))


def _at_place(values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("place") + F.lit(1))


def value_census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, dtype, value, n): every column's values as text, counted."""
    names = columns or df.columns
    types = dict(df.dtypes)
    return _counted(df, names).select(
        _at_place(names).alias("column"), _at_place([types[c] for c in names]).alias("dtype"), "value", "n"
    )


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: type, completeness, distinct values, null rate, distinct over rows."""
    names = columns or df.columns
    types = dict(df.dtypes)
    rows = F.sum("n")
    filled = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
    return (
        _counted(df, names)
        .groupBy("place")
        .agg(rows.alias("rows"), filled.alias("filled"), F.count("value").alias("unicos"))
        .select(
            _at_place(names).alias("coluna"),
            _at_place([types[c] for c in names]).alias("dtype"),
            half_even(F.col("filled") / F.col("rows"), 4).alias("completude"),
            "unicos",
            half_even((F.col("rows") - F.col("filled")) / F.col("rows"), 4).alias("taxa_nulos"),
            half_even(F.col("unicos") / F.greatest(F.col("rows"), F.lit(1)), 4).alias("cardinalidade"),
        )
    )


def column_roles(df: DataFrame, id_column: str, columns: list[str] | None = None) -> DataFrame:
    """(coluna, papel): ignorar, temporais, numericas, categoricas or texto, with the figures behind it."""
    names = columns or df.columns
    temporal = [c for c, t in df.dtypes if c in names and t in ("date", "timestamp", "timestamp_ntz")]
    value = F.col("value")
    weight = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    # The role of the id and of dates does not ask what their values look like, and they have most values.
    asked = [i for i, c in enumerate(names) if c != id_column and c not in temporal]
    asked = F.col("place").isin(*asked) if asked else F.lit(False)
    figures = (
        _counted(df, names)
        .groupBy("place")
        .agg(
            F.sum("n").alias("rows"),
            weight(value.isNotNull()).alias("filled"),
            F.count("value").alias("unicos"),
            weight(F.when(asked, value.rlike(DIGIT_LIKE))).alias("digit_like"),
            weight(F.when(asked & value.rlike(NUMBER_START), lenient_double(value).isNotNull())).alias("number_like"),
        )
        .withColumn("column", _at_place(names))
    )
    null_share = 1 - F.col("filled") / F.col("rows")
    digit_share = F.when(F.col("filled") > 0, F.col("digit_like") / F.col("filled")).otherwise(0.0)
    role = (
        F.when(F.col("column") == id_column, "ignorar")
        .when((null_share > NULL_LIMIT) | (F.col("unicos") <= 1), "ignorar")
        .when(F.col("column").isin(*temporal) if temporal else F.lit(False), "temporais")
        .when((digit_share > DIGIT_SHARE) & (F.col("unicos") > 0.5 * F.col("rows")), "ignorar")
        .when(
            F.col("number_like") / F.col("rows") > NUMBER_SHARE,
            F.when(F.col("unicos") < FEW_NUMBERS, "categoricas").otherwise("numericas"),
        )
        .otherwise(F.when(F.col("unicos") < FEW_TEXTS, "categoricas").otherwise("texto"))
    )
    return figures.select(F.col("column").alias("coluna"), role.alias("papel"), "unicos", "filled", "rows")


def chosen_columns(roles: DataFrame, forced: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Columns per role; a forced list replaces the inferred one, cut to columns that exist.

    Collects one row per column of the table.
    """
    found = {r["coluna"]: r["papel"] for r in roles.select("coluna", "papel").collect()}
    out: dict[str, list[str]] = {}
    for role in ("texto", "categoricas", "numericas", "temporais", "ignorar"):
        wanted = (forced or {}).get(role)
        out[role] = [c for c in wanted if c in found] if wanted else sorted(c for c, r in found.items() if r == role)
    return out


def roles_by_type(df: DataFrame) -> dict[str, list[str]]:
    """numeric, categorical and datetime columns by their declared type."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": []}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out["datetime"].append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            out["numeric"].append(f.name)
        else:
            out["categorical"].append(f.name)
    return out


def digit_shares(df: DataFrame, low: int = 6, high: int = 20) -> DataFrame:
    """One row: per column the share of its non-null values holding `low` to `high` digits."""
    return df.agg(
        *[
            F.avg(F.when(F.col(c).isNotNull(), F.length(digits_only(F.col(c))).between(low, high).cast("double"))).alias(c)
            for c in df.columns
        ]
    )


def find_id_column(df: DataFrame, default: str = "CNPJ", short: bool = False) -> str | None:
    """The id column: the default name, a known name, else the first column that mostly holds 6-20 digits.

    short=True uses the short name list and falls back to the first column.
    """
    if short:
        return next((c for c in df.columns if c.lower().strip() in SHORT_ID_NAMES), df.columns[0])
    if default in df.columns:
        return default
    named = next((c for c in df.columns if c.lower().strip() in ID_NAMES), None)
    if named:
        return named
    shares = digit_shares(df).first()
    return next((c for c in df.columns if shares[c] is not None and shares[c] > 0.8), None)


INTEGER_RANGES = (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))


def _narrow_type(column: str, dtype: str) -> Column:
    """Aggregate expression naming the smallest type that holds every value of a column."""
    if dtype in ("bigint", "int", "smallint", "tinyint"):
        low, high = F.min(column).cast("bigint"), F.max(column).cast("bigint")
        out = F.lit("bigint")
        for name, bits in reversed(INTEGER_RANGES[:-1]):
            out = F.when((low >= -(2**bits)) & (high <= 2**bits - 1), F.lit(name)).otherwise(out)
        return F.when(low.isNull(), F.lit(dtype)).otherwise(out)
    if dtype == "double":
        exact = F.bool_and(F.col(column).cast("float").cast("double") == F.col(column))
        return F.when(F.coalesce(exact, F.lit(False)), F.lit("float")).otherwise(F.lit("double"))
    return F.lit(dtype)


def narrow_types(df: DataFrame) -> DataFrame:
    """(coluna, de, para): one pass over the table."""
    found = df.agg(*[_narrow_type(c, t).alias(c) for c, t in df.dtypes])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("coluna"), F.lit(t).alias("de"), F.col(c).alias("para"))
            for c, t in df.dtypes
        ]
    )
    return found.select(F.explode(cells).alias("cell")).select("cell.*")


def narrowed(df: DataFrame) -> DataFrame:
    """The table cast to its narrow types. Collects one row per column."""
    plan = {r["coluna"]: r["para"] for r in narrow_types(df).collect()}
    return df.select(*[F.col(c).cast(plan[c]).alias(c) for c in df.columns])
