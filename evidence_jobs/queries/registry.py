"""Where queries and their SQL are put down together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from evidence_jobs.queries.views import Data, with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Data under a name, with its SQL, where views stand in braces."""

    def put(f: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return put


def norm(text: str) -> str:
    """SQL of normalize_name."""
    return f"trim(regexp_replace(regexp_replace(lower(trim({text})), '\\bward\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def any_of(text: str, words: list[str]) -> str:
    """SQL: any of the words is a substring."""
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"
