"""Uploads met with the events that end them, as both streams arrive."""

from pyspark.sql import DataFrame, functions as F


def _watermarked(df: DataFrame, column: str, lateness: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def _once(df: DataFrame, key: str) -> DataFrame:
    """Repeated events go; a stream remembers keys until its watermark passes them."""
    return df.dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def outcomes(uploads: DataFrame, ends: DataFrame, within: str = "7 days", lateness: str = "1 day") -> DataFrame:
    """Each upload with the events that end it within ``within``; nulls where none does.

    ``uploads`` has (id, owner, uploaded_at), ``ends`` has (id, owner, status, ended_at).  Both may be
    streams: each side keeps rows only while the other side's watermark can still bring a match, and an upload that
    nothing ends comes out once that time has passed.  Rows later than ``lateness``, and repeats of an event ID, are dropped.
    As tables the same rows come from one equi-join with a range condition.
    """
    left = _once(_watermarked(uploads, "uploaded_at", lateness), "id")
    right = _once(_watermarked(ends, "ended_at", lateness), "id").select(
        F.col("id").alias("end_id"), F.col("owner").alias("_owner"), "status", "ended_at"
    )
    near = F.expr(f"owner = _owner and ended_at >= uploaded_at and ended_at < uploaded_at + interval {within}")
    met = left.join(right, near, "left")
    return met.select(
        F.col("id").alias("upload_id"), "owner", F.col("uploaded_at").cast("timestamp_ntz").alias("uploaded_at"),
        "end_id", "status", F.col("ended_at").cast("timestamp_ntz").alias("ended_at"),
    )
