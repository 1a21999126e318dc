"""Keyed state over event streams: unique files, job status, counters, daily activity."""

from pyspark.sql import DataFrame, functions as F

from musterline.operators.dashboards import job_status


def unique_files(files: DataFrame, event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """The first arrival of each content hash.

    Without a ``horizon`` hashes are remembered for ever, as the upload rule demands, and
    state grows with distinct files.  With one (say ``"400 days"``) a hash may be accepted
    again once it is older than that.
    """
    if horizon is None:
        return files.dropDuplicates(["file_hash"])
    timed = files.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["file_hash"])


def live_job_status(
    events: DataFrame,
    key: str = "filename",
    order: tuple = ("created_at", "id"),
    values: tuple = ("status", "uploaded_by", "created_at"),
) -> DataFrame:
    """Newest status per file as events arrive; write it in update mode."""
    return job_status(events, key, order, values)


def live_upload_counts(uploads: DataFrame) -> DataFrame:
    """Uploads by owner and category; update or complete mode."""
    return uploads.groupBy("uploaded_by", "category").agg(F.count("*").alias("uploads"))


def live_action_counts(audit: DataFrame) -> DataFrame:
    """Actions by user; update or complete mode."""
    return audit.groupBy("user_email", "action").agg(F.count("*").alias("actions"))


def daily_activity(audit: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Actions per calendar day in event time; rows later than ``lateness`` are dropped.

    Watermarks need zoned times and days start at midnight UTC, so the session has to be in UTC.
    """
    timed = audit.select(F.col("created_at").cast("timestamp").alias("at"), "action")
    return (
        timed.withWatermark("at", lateness)
        .groupBy(F.window("at", "1 day").alias("w"), "action")
        .agg(F.count("*").alias("actions"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("day"), "action", "actions")
    )
