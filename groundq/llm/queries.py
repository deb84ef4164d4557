"""The queries opN_<name> of the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from groundq.llm import query_language, query_licenses, query_mixing, query_near_texts, query_near_vectors, query_nearest, query_packing, query_toxicity, query_urls, query_warc

MODULES = (query_urls, query_near_texts, query_mixing, query_language, query_warc, query_toxicity, query_licenses, query_packing, query_nearest, query_near_vectors)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
