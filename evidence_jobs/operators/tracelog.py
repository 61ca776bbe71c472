"""The append-only trace log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_traces(events: DataFrame, limit: int) -> DataFrame:
    """The newest events by epoch; a missing epoch counts as 0; ties by log order, last first."""
    return events.orderBy(F.coalesce("created_at_epoch_ms", F.lit(0)).desc(), F.col("seq").desc()).limit(limit)


def last_event(events: DataFrame) -> DataFrame:
    """The last logged event of each trace id, by log order."""
    rest = [c for c in events.columns if c != "trace_id"]
    return events.groupBy("trace_id").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("trace_id", "e.*")
