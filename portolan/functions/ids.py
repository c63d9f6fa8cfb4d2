"""Company registration numbers (14 digits): cleaning, checking, masking, finding in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan.functions.numeric import bind

# The id formats looked for in text, and the official check-digit weights.
FORMATTED_ID = r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}"
BARE_ID = r"\b\d{14}\b"
ANY_14_DIGITS = r"\d{14}"
FIRST_WEIGHTS = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
SECOND_WEIGHTS = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def normalize_id(col: Column) -> Column:
    """Delete all white space."""
    return F.regexp_replace(F.trim(col.cast("string")), r"\s+", "")


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col.cast("string"), r"\D+", "")


def pad14(digits: Column) -> Column:
    """Left-pad with zeros to 14; longer text is kept, never cut."""
    return F.when(F.length(digits) < 14, F.lpad(digits, 14, "0")).otherwise(digits)


def normalize_cnpj(col: Column) -> Column:
    """Digits only, zero-filled to 14; NULL stays NULL."""
    return bind(digits_only(col), pad14)


def check_digit(digits: Column, weights: tuple[int, ...]) -> Column:
    """Modulo-11 check digit over the leading digits. Bind `digits` first: it is used per weight."""
    total = sum(
        (F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)),
        start=F.lit(0),
    )
    return bind(total % 11, lambda r: F.when(r < 2, F.lit(0)).otherwise(F.lit(11) - r))


def with_check_digits(stem: Column) -> Column:
    """12 digits completed by both official check digits."""
    first = bind(stem, lambda s: F.concat(s, check_digit(s, FIRST_WEIGHTS).cast("string")))
    return bind(first, lambda s: F.concat(s, check_digit(s, SECOND_WEIGHTS).cast("string")))


def cnpj_is_valid(col: Column, rule: str = "official") -> Column:
    """Check-digit test; NULL is invalid.

    rule="official" weighs 13 digits for the second check digit; rule="reference" weighs the
    first 12 again, so that only ids with two equal check digits can pass.
    """
    if rule not in ("official", "reference"):
        raise ValueError(f"unknown rule: {rule}")
    second_weights = SECOND_WEIGHTS if rule == "official" else FIRST_WEIGHTS

    def test(digits: Column) -> Column:
        checked = (
            (check_digit(digits, FIRST_WEIGHTS) == F.substring(digits, 13, 1).cast("int"))
            & (check_digit(digits, second_weights) == F.substring(digits, 14, 1).cast("int"))
            & (digits != F.repeat(F.substring(digits, 1, 1), 14))
        )
        # The length test guards the digit casts, which raise on empty text.
        return F.when(F.length(digits) == 14, checked)

    return F.coalesce(bind(normalize_cnpj(col), test), F.lit(False))


def cnpj_mask(col: Column) -> Column:
    """NN.NNN.NNN/NNNN-NN when there are exactly 14 digits, else the input."""
    shape = r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$"
    masked = bind(
        digits_only(col),
        lambda d: F.when(F.length(d) == 14, F.regexp_replace(d, F.lit(shape), F.lit("$1.$2.$3/$4-$5"))),
    )
    return F.coalesce(masked, col)


def cnpj_format_check(col: Column) -> Column:
    """struct(cnpj, cnpj_limpo, cnpj_formatado, valido, erro): the length test with its message."""
    digits = digits_only(col)
    ok = F.coalesce(F.length(digits) == 14, F.lit(False))
    return F.struct(
        col.alias("cnpj"),
        F.when(ok, digits).alias("cnpj_limpo"),
        cnpj_mask(col).alias("cnpj_formatado"),
        ok.alias("valido"),
        F.when(~ok, F.lit("CNPJ deve ter 14 digitos")).alias("erro"),
    )


def _found(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: normalize_cnpj(m))


def ids_in_text(text: Column, variant: str = "default") -> Column:
    """Array of ids found in a text body, in order.

    default     formatted ids, then bare 14-digit words, each id once
    pdf_v2      formatted ids only, repeats kept
    txt_v2      any 14 digits in a row, repeats kept
    capture     digits-only stream cut into 14-digit windows, then formatted ids, each once
    capture_v3  the whole text's digits if they are exactly 14, then formatted ids, each once
    """
    if variant == "default":
        return F.array_distinct(F.concat(_found(text, FORMATTED_ID), _found(text, BARE_ID)))
    if variant == "pdf_v2":
        return _found(text, FORMATTED_ID)
    if variant == "txt_v2":
        return _found(text, ANY_14_DIGITS)
    if variant == "capture":
        return F.array_distinct(F.concat(_found(digits_only(text), ANY_14_DIGITS), _found(text, FORMATTED_ID)))
    if variant == "capture_v3":
        return F.array_distinct(F.concat(_found(digits_only(text), BARE_ID), _found(text, FORMATTED_ID)))
    raise ValueError(f"unknown variant: {variant}")
