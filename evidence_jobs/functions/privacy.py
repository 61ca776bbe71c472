"""Redaction of personal data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is personal, and what takes its place, in the order of replacement.
PERSONAL = [
    (r"(?i)\b(?:rr\s*(?:number|no\.?)?|account\s*(?:number|no\.?)?)\s*[:#-]?\s*[A-Z0-9/-]*\d[A-Z0-9/-]{5,}\b", "[REDACTED_ACCOUNT]"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"(?<!\d)(?:\+?91[-\s]?)?[6-9]\d{9}(?!\d)", "[REDACTED_PHONE]"),
]
#: Every text that PERSONAL changes holds this, which takes one pass.
SUSPECT = r"(?i)\b(?:rr|account)|@|\d{10}"
SECRET_KEYS = "(?i)(api_key|secret)"
SECRET_TOKENS = r"\b(?:sk-ant|sk-proj|sk)-[A-Za-z0-9_-]{8,}\b"


def redact(text: Column, personal: list[tuple[str, str]] = PERSONAL) -> Column:
    """Account numbers, e-mail addresses and phone numbers (or those of `personal`) masked; null as ""."""
    value = F.coalesce(text, F.lit(""))
    masked = reduce(lambda t, p: F.regexp_replace(t, p[0], F.lit(p[1])), personal, value)
    return F.when(value.rlike(SUSPECT), masked).otherwise(value) if personal is PERSONAL else masked


def has_personal(text: Column) -> Column:
    value = F.coalesce(text, F.lit(""))
    return reduce(lambda a, b: a | b, (value.rlike(p) for p, _ in PERSONAL))


def redact_map(row: Column) -> Column:
    """Every value of a map redacted."""
    return F.transform_values(row, lambda _, v: redact(v))


def redact_event(row: Column) -> Column:
    """As redact_map, without keys that look secret and with key-shaped tokens masked."""
    public = F.map_filter(row, lambda k, v: ~k.rlike(SECRET_KEYS) & ~(F.lower(k).contains("token") & (F.coalesce(v, F.lit("")) != "")))
    return F.transform_values(public, lambda _, v: F.regexp_replace(redact(v), SECRET_TOKENS, "[REDACTED_SECRET]"))


def redact_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The string columns (all, or those named) redacted; nulls stay null."""
    wanted = {n.lower() for n in names} if names else None
    strings = [c for c, kind in df.dtypes if kind == "string" and (wanted is None or c.lower() in wanted)]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), redact(F.col(c))) for c in strings})
