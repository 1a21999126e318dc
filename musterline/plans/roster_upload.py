"""Roster files taken in: admit, refuse known content, parse, import new IDs, record."""

from pyspark.sql import Column, DataFrame, functions as F

from musterline import constants as K
from musterline.functions import content_hash, utc_now
from musterline.operators import ingest, records
from musterline.sources import sinks


def import_roster_files(
    files: DataFrame,
    roster: DataFrame,
    history: DataFrame,
    out: str,
    batch: str,
    clock: Column | None = None,
    extra_headers: dict[str, str] | None = None,
) -> DataFrame:
    """Import ``files`` and return ``(manager_id, inserted, skipped, blank_ids)``.

    ``files`` carry ``path``, ``filename``, ``size_bytes``, ``content``, ``manager_id``,
    ``uploaded_by`` and, where known, ``content_type`` and ``created_at``.  Earlier files
    go first, then by path; within a file, rows go in file order.  Written under ``out``,
    replacing an earlier attempt at the same batch: ``inventory``, ``roster_rows``,
    ``upload_history``, ``import_counts``.  ``roster`` and ``history`` are what was there
    before this batch.
    """
    clock = utc_now() if clock is None else clock

    def publish(df: DataFrame, name: str) -> DataFrame:
        return sinks.publish(df, f"{out}/{name}", batch=batch)

    hashed = files.withColumn("file_hash", content_hash("content"))
    inventory = publish(ingest.take_in(hashed, history, ["uploaded_by"]), "inventory")
    fresh = inventory.where(F.col("verdict") == "NEW")

    parsed = ingest.parsed_new_files(hashed, fresh, extra_headers)
    problems = parsed.where(F.col("problem").isNotNull()).select("path", "problem")
    # Files are few beside their rows: rows look up their file's owner and arrival.
    owners = fresh.select("path", "manager_id", F.struct("created_at", "path").alias("_arrival"))
    rows = parsed.where(F.col("problem").isNull()).join(owners, "path").select(
        F.struct("_arrival", "row_no").alias("row_no"), "employee_id",
        F.col("employee_name").alias("full_name"), "company_email", "department", "manager_id",
    )
    rows = publish(rows, "parsed_rows")
    publish(
        ingest.import_new_rows(rows, roster).drop("row_no").withColumn("created_at", clock), "roster_rows"
    )
    ended = fresh.join(problems, "path", "left")
    status = F.when(F.col("problem").isNull(), K.STATUS_UPLOADED).otherwise(K.STATUS_FAILED)
    publish(records.upload_rows(ended, K.ROSTER_FILE, status, F.col("uploaded_by"), clock), "upload_history")
    return publish(ingest.import_counts(rows, roster), "import_counts")
