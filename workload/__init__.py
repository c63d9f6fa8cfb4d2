"""Registered queries, each with its SQL twin where the result can be written in SQL."""

from workload import attribution, cleaning, kpis, privacy, ranking, registry, roundtrips, sources, streams  # noqa: F401
from workload.catalog import oracle_sql, queries  # noqa: F401
