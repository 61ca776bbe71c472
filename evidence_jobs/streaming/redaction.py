"""Row-wise operators on a stream: redaction and the accept or reject split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidence_jobs.functions.privacy import redact_columns
from evidence_jobs.operators.normalize import complaint_rows


def redacted_stream(stream: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A streaming table with personal data masked; no state, any output mode."""
    return redact_columns(stream, columns)


def complaint_stream(stream: DataFrame) -> DataFrame:
    """Raw complaint rows as they come, normalised, with the reason where one is rejected."""
    return complaint_rows(stream)


def write_split(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Accepted and rejected complaints to two Parquet folders; each batch is written once.

    A batch that is retried overwrites its own part, so a lost executor leaves no doubles.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        made = complaint_rows(batch).persist()
        made.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{path}/complaints/epoch={epoch}")
        made.where("reason IS NOT NULL").select("source_id", "raw_file", "row_number", "reason").write.mode("overwrite").parquet(f"{path}/rejections/epoch={epoch}")
        made.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_safe_counts(stream: DataFrame, moment: str, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Rows per window and status, with a watermark for late ones."""
    return stream.withWatermark(moment, delay).groupBy(F.window(moment, width), "status").count()
