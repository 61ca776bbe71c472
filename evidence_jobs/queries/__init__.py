"""The registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from importlib import import_module

from evidence_jobs.queries.registry import QUERIES, SQL

MODULES = ["scalars", "normalization", "truth", "case_packets", "chunk_index", "sources_eval", "jobs", "files"]


def _load() -> None:
    for module in MODULES:
        import_module(f"evidence_jobs.queries.{module}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
