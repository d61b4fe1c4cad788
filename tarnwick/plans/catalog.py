"""All registered queries and their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from . import documents, graphs, models, profiling, series, streams, tables

SECTIONS = [tables.S, profiling.S, series.S, models.S, documents.S, graphs.S, streams.S]


def queries() -> dict:
    return {name: q for s in SECTIONS for name, q in s.queries.items()}


def oracle_sql() -> dict:
    return {name: q for s in SECTIONS for name, q in s.sql.items()}
