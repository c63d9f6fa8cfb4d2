"""Registry and risk expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan.functions.numeric import clip01, half_even

# States by region, risk levels with lower bounds and colours, KPI weights.
REGIONS = {
    "Norte": ("AM", "RR", "AP", "PA", "TO", "RO", "AC"),
    "Nordeste": ("MA", "PI", "CE", "RN", "PB", "PE", "AL", "SE", "BA"),
    "Centro-Oeste": ("MT", "MS", "GO", "DF"),
    "Sudeste": ("SP", "RJ", "MG", "ES"),
    "Sul": ("PR", "SC", "RS"),
}
UNKNOWN_REGION = "Desconhecida"
RISK_LEVELS = (("BAIXO", 0.0), ("MEDIO", 25.0), ("ALTO", 50.0), ("CRITICO", 75.0))
RISK_END = 100.01
RISK_COLOURS = {"BAIXO": "#C6EFCE", "MEDIO": "#FFEB9C", "ALTO": "#FFC7CE", "CRITICO": "#C00000"}
NO_COLOUR = "#FFFFFF"
WEIGHTS_10 = {
    "KPI_Subvalorizacao": 0.20,
    "KPI_DisparidadeHS": 0.12,
    "KPI_SurgeVolume": 0.12,
    "KPI_DesvioETA": 0.08,
    "KPI_Completude": 0.04,
    "KPI_Outlier": 0.05,
    "KPI_Ext_ConsistenciaCadastral": 0.13,
    "KPI_Ext_IdadeEmpresa": 0.08,
    "KPI_Ext_ScoreCredito": 0.10,
    "KPI_PadraoChar": 0.08,
}
WEIGHTS_8 = {
    "KPI_Subvalorizacao": 0.25,
    "KPI_DisparidadeHS": 0.15,
    "KPI_SurgeVolume": 0.15,
    "KPI_DesvioETA": 0.10,
    "KPI_Completude": 0.05,
    "KPI_Outlier": 0.05,
    "KPI_Ext_ConsistenciaCadastral": 0.15,
    "KPI_Ext_IdadeEmpresa": 0.10,
}


def region_of_state(uf: Column) -> Column:
    state = F.upper(F.trim(uf))
    out = F.lit(UNKNOWN_REGION)
    for region, states in REGIONS.items():
        out = F.when(state.isin(*states), F.lit(region)).otherwise(out)
    return out


def company_age(opened: Column, as_of: Column) -> Column:
    """Years between two dates, half-even to 2 digits."""
    return half_even(F.date_diff(as_of, opened) / F.lit(365.25), 2)


def is_active(status: Column, match: str = "substring") -> Column:
    """Status text holds "ativa". As a substring "inativa" holds it too; match="word" does not."""
    if match not in ("substring", "word"):
        raise ValueError(f"unknown match: {match}")
    lower = F.lower(status)
    hit = lower.contains("ativa") if match == "substring" else lower.rlike(r"\bativa\b")
    return F.coalesce(hit, F.lit(False))


# The published steps of the credit score.
CREDIT_BASE, ACTIVE_BONUS, CLOSED_PENALTY = 0.5, 0.2, -0.3
OLD_YEARS, OLD_BONUS, YOUNG_YEARS, YOUNG_PENALTY = 10, 0.15, 2, -0.15
LARGE_CAPITAL, LARGE_BONUS, SMALL_CAPITAL, SMALL_PENALTY = 1_000_000, 0.1, 10_000, -0.05
MANY_PARTNERS, PARTNERS_BONUS = 2, 0.05


def credit_score(status: Column, age: Column, capital: Column, partners: Column, match: str = "substring") -> Column:
    """Heuristic credit score in [0, 1]; missing age, capital and partners count as 0."""
    lower = F.lower(F.coalesce(status, F.lit("")))
    years = F.coalesce(age, F.lit(0.0))
    money = F.coalesce(capital, F.lit(0.0))
    return clip01(
        F.lit(CREDIT_BASE)
        + F.when(is_active(status, match), ACTIVE_BONUS)
        .when(lower.contains("baixada") | lower.contains("suspensa"), CLOSED_PENALTY)
        .otherwise(0.0)
        + F.when(years >= OLD_YEARS, OLD_BONUS).when(years < YOUNG_YEARS, YOUNG_PENALTY).otherwise(0.0)
        + F.when(money > LARGE_CAPITAL, LARGE_BONUS).when(money < SMALL_CAPITAL, SMALL_PENALTY).otherwise(0.0)
        + F.when(F.coalesce(partners, F.lit(0)) > MANY_PARTNERS, PARTNERS_BONUS).otherwise(0.0)
    )


def risk_score(kpis: list[str], weights: dict[str, float]) -> Column:
    """Weighted sum of the KPI columns present, times 100, clipped, half-even to 2 digits."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        if name in kpis:
            total = total + F.lit(weight) * F.coalesce(F.col(name), F.lit(0.0))
    return half_even(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total * 100)), 2)


def risk_level(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for level, low in RISK_LEVELS:
        out = F.when((score >= low) & (score < RISK_END), F.lit(level)).otherwise(out)
    return out


def risk_colour(level: Column) -> Column:
    out = F.lit(NO_COLOUR)
    for name, colour in RISK_COLOURS.items():
        out = F.when(level == name, F.lit(colour)).otherwise(out)
    return out


def signature(names: Column) -> Column:
    """First 12 hex digits of the md5 of the sorted, comma-joined names of an array."""
    return F.substring(F.md5(F.array_join(F.sort_array(names), ",")), 1, 12)


def header_hash(columns: list[str]) -> Column:
    """First 10 hex digits of the md5 of the comma-joined header."""
    return F.substring(F.md5(F.lit(",".join(columns))), 1, 10)


def entropy(probabilities: Column) -> Column:
    """-sum p ln(p + 1e-12) over an array."""
    return F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc - p * F.ln(p + F.lit(1e-12)))


def margin(probabilities: Column) -> Column:
    """Largest minus second largest of an array, 0 when there is one entry."""
    ordered = F.sort_array(probabilities, asc=False)
    return F.when(F.size(ordered) >= 2, ordered[0] - F.try_element_at(ordered, F.lit(2))).otherwise(F.lit(0.0))
