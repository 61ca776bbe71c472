"""Dates of several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(value: Column) -> Column:
    """ISO date as text: "" for "", null when there is no date.

    One- or two-digit months and days with an optional time are padded if they are
    valid; any other yyyy-mm-dd prefix is kept as it is.
    """
    pattern = r"^(\d{4})-(\d{1,2})-(\d{1,2})( \d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?)?$"
    part = lambda i, n: F.lpad(F.regexp_extract(value, pattern, i), n, "0")
    padded = F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))
    valid = F.when(value.rlike(pattern), F.try_to_timestamp(padded, F.lit("yyyy-MM-dd")))
    prefix = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(value, 1, 10))
    return F.when(value == "", "").otherwise(F.coalesce(F.date_format(valid, "yyyy-MM-dd"), prefix))


def parse_loose_date(value: Column) -> Column:
    """The first of yyyy-mm-dd, dd/mm/yyyy and dd-Mon-yyyy anywhere in the text that is a date; else ""."""
    found = []
    for pattern, form in ((r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"), (r"\d{2}-[A-Za-z]{3}-\d{4}", "dd-MMM-yyyy")):
        text = F.initcap(F.regexp_extract(value, pattern, 0))
        found.append(F.date_format(F.try_to_timestamp(F.when(text != "", text), F.lit(form)), "yyyy-MM-dd"))
    return F.coalesce(*found, F.lit(""))


def parse_datetime(value: Column) -> Column:
    """ISO timestamp with or without a zone, else its first ten characters as a date; without a zone it is UTC."""
    text = F.trim(value)
    return F.coalesce(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def age_days(moment: Column, now: Column) -> Column:
    """Whole days since, rounded down; negative in the future."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(moment)) / 86400).cast("long")


def archive_age(moment: Column, now: Column) -> Column:
    """struct(days, caveat): a future moment is 0 days old, with a caveat."""
    days = age_days(moment, now)
    caveat = F.when(days < 0, "Archive timestamp is in the future relative to this monitor run; review clock/source metadata.")
    return F.struct(F.greatest(days, F.lit(0)).alias("days"), caveat.alias("caveat"))
