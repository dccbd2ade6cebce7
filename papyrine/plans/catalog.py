"""All queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from papyrine.plans import aggregates, claims, dialect, findings, increments, listings, more, papers, programs, relations, scalars, searching, windows, wording

FLAGSHIP = "r1_recurring_limitations"

QUERIES: dict = {}
SQL: dict = {}
for _module in (listings, aggregates, windows, scalars, relations, findings, increments):
    _queries, _sql = dialect.queries(_module.TEMPLATES)
    QUERIES |= _queries
    SQL |= _sql
for _module in (programs, claims, wording, searching, papers, more):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
