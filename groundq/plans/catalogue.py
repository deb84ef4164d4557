"""All queries of the engine by name, with DuckDB SQL that returns the same rows."""

from __future__ import annotations

from groundq.plans import queries_answers, queries_runs, queries_text, queries_trace

MODULES = (queries_answers, queries_trace, queries_text, queries_runs)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
