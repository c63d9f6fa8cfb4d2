"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_length(col: Column) -> Column:
    """Characters; NULL counts 0."""
    return F.coalesce(F.length(col), F.lit(0))


def word_count(col: Column) -> Column:
    """White-space separated words; NULL counts 0."""
    words = F.filter(F.split(col, r"\s+"), lambda w: w != "")
    return F.when(col.isNull(), F.lit(0)).otherwise(F.size(words))


def text_concat(*cols: Column) -> Column:
    """Columns joined by blanks, NULL as empty text."""
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def text_blob(*cols: Column) -> Column:
    """Joined, lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(text_concat(*cols)), r"[^a-z0-9]", "")


def char_windows(blob: Column, width: int = 5, padded: bool = False) -> Column:
    """Array with, for every position, the next `width` characters (fewer at the end).

    A look-ahead match walks the text once, where substring() at every position would walk it from
    its start each time. padded=True puts one blank on either side first.
    """
    source = F.when(F.length(blob) > 0, F.concat(F.lit(" "), blob, F.lit(" "))).otherwise(blob) if padded else blob
    return F.regexp_extract_all(source, F.lit("(?s)(?=(.{1,%d}))" % width), F.lit(1))


# Accented Latin letters and what they are without the accent.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
WORD = r"[\p{L}\p{N}_]{2,}"


def strip_accents(col: Column) -> Column:
    """Accents off lower-case Latin letters."""
    return F.translate(col, ACCENTED, PLAIN)


def word_tokens(col: Column, accents: bool = True) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    lower = F.lower(col)
    return F.regexp_extract_all(lower if accents else strip_accents(lower), F.lit(WORD), F.lit(0))


def word_bounded_ngrams(col: Column, n_min: int = 3, n_max: int = 5) -> Column:
    """Character n-grams that stay inside a word padded with one blank on either side."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.lower(col)), r"\s+", "  "), F.lit(" "))
    grams = [
        F.filter(
            F.regexp_extract_all(spaced, F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1)),
            lambda g: ~F.substring(g, 2, n - 2).contains(" "),
        )
        for n in range(n_min, n_max + 1)
    ]
    return F.concat(*grams)


def word_ngrams(tokens: Column, n_max: int = 2) -> Column:
    """Words, then runs (up to n_max) of adjacent words joined by a blank.

    Runs are zipped from shifted slices: a lambda indexing `tokens` would evaluate it per position.
    """
    grams = [tokens]
    for n in range(2, n_max + 1):
        places = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
        grams.append(
            F.zip_with(
                F.slice(grams[-1], F.lit(1), places),
                F.slice(tokens, F.lit(n), places),
                lambda left, right: F.concat_ws(" ", left, right),
            )
        )
    return F.concat(*grams)


# Legal forms in the order they are tried, with the texts that show each.
LEGAL_FORMS = (("Ltda", ("LTDA",)), ("S/A", ("S/A", "SA")), ("EIRELI", ("EIRELI",)), ("ME", ("ME",)))
UNKNOWN_FORM = "DESCONHECIDO"


def legal_form(name: Column, match: str = "substring") -> Column:
    """Legal form of a company name; match="word" asks for whole words."""
    if match not in ("substring", "word"):
        raise ValueError(f"unknown match: {match}")
    upper = F.upper(F.trim(name))
    out = F.lit(UNKNOWN_FORM)
    for form, marks in reversed(LEGAL_FORMS):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | (upper.contains(mark) if match == "substring" else upper.rlike(rf"(^|\W){mark}(\W|$)"))
        out = F.when(hit, F.lit(form)).otherwise(out)
    return out


def company_name_profile(name: Column, match: str = "substring") -> Column:
    """struct(razao_social, tipo, palavras, tamanho, maiuscula)."""
    trimmed = F.trim(name)
    return F.struct(
        trimmed.alias("razao_social"),
        legal_form(name, match).alias("tipo"),
        word_count(trimmed).alias("palavras"),
        text_length(trimmed).alias("tamanho"),
        F.upper(trimmed).alias("maiuscula"),
    )
