"""Sheets processed as files arrive in ``<inbox>/manager_id=<id>/``.

A sheet is one file and lands whole in one micro-batch, so "missing from the sheet" is
well defined.  Each batch writes every table under its own ``batch_id`` directory,
replacing what an earlier attempt left there, and looks for known hashes only in earlier
batches: repeating a batch changes nothing.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from musterline import constants as K
from musterline.functions import content_hash, utc_now
from musterline.operators import ingest, reconcile, records, reports
from musterline.sources import sinks
from musterline.sources.inventory import FILE_SCHEMA, all_files, owner_in_path

_INVENTORY = (
    "path string, filename string, stored_name string, manager_id string, size_bytes long, "
    "created_at timestamp_ntz, file_hash string, verdict string"
)
_COUNTS = ("roster_count", "sheet_count", "matched", "missing", "unknown", "missing_email")


@dataclass(frozen=True)
class SheetJob:
    """What a batch needs: ``roster`` and ``users`` are called anew for every batch."""

    out: str
    roster: Callable[[], DataFrame]
    users: Callable[[], DataFrame]
    max_bytes: int = K.MAX_UPLOAD_BYTES
    extra_headers: dict[str, str] | None = None

    def table(self, name: str) -> str:
        return f"{self.out}/{name}"


def arriving_files(
    spark: SparkSession, inbox: str, files_per_batch: int = 1000, max_bytes: int = K.MAX_UPLOAD_BYTES
) -> DataFrame:
    """New files with their manager; those over the limit come without content, unread."""

    def scan() -> DataFrame:
        return (
            spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
            .option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", files_per_batch)
            .load(inbox)
        )

    return all_files(scan(), scan(), max_bytes).withColumn("manager_id", owner_in_path())


def sheet_stream(
    spark: SparkSession, inbox: str, job: SheetJob, checkpoint: str, files_per_batch: int = 1000
) -> DataStreamWriter:
    """The configured writer; set a trigger and start it."""
    sinks.write_partition(spark.createDataFrame([], _INVENTORY), job.table("inventory"), batch_id=-1)
    files = arriving_files(spark, inbox, files_per_batch, job.max_bytes)
    return files.writeStream.foreachBatch(lambda batch, n: process_batch(batch, n, job)).option(
        "checkpointLocation", checkpoint
    )


def process_batch(files: DataFrame, batch_id: int, job: SheetJob, clock: Column | None = None) -> None:
    spark = files.sparkSession
    clock = utc_now() if clock is None else clock

    def publish(df: DataFrame, name: str) -> DataFrame:
        return sinks.publish(df, job.table(name), batch_id=batch_id)

    hashed = files.withColumn("file_hash", content_hash("content"))
    inventory = publish(ingest.take_in(hashed, _history(spark, job, batch_id), max_bytes=job.max_bytes), "inventory")
    fresh = inventory.where(F.col("verdict") == "NEW")

    rows = publish(ingest.parsed_new_files(hashed, fresh, job.extra_headers), "sheet_rows")
    problems = rows.where(F.col("problem").isNotNull()).select("file_hash", "problem")
    sheets = fresh.join(problems, "file_hash", "left_anti")
    readable = rows.where(F.col("problem").isNull())

    roster = job.roster().join(sheets.select("manager_id", "file_hash"), "manager_id")
    present = publish(reconcile.presence(roster, readable, by="file_hash"), "pairs")
    summary = publish(_summaries(sheets, present), "summary")
    pairs = reconcile.statuses(present, by="file_hash")
    publish(reconcile.issues(pairs, roster, readable, by="file_hash"), "issues")

    users = job.users()
    mail = users.where(F.col("role") == K.ROLE_MANAGER).select(F.col("id").alias("manager_id"), "email")
    who = F.coalesce("email", "manager_id")
    ended = fresh.join(problems, "file_hash", "left").join(mail, "manager_id", "left")
    status = F.when(F.col("problem").isNull(), K.STATUS_COMPLETED).otherwise(K.STATUS_FAILED)
    publish(records.upload_rows(ended, K.SHEET_FILE, status, who, clock), "upload_history")

    report = reports.report_name(F.concat_ws("_", "manager_id", "file_hash"), clock)
    names = (
        summary.select("file_hash", F.col("manager_id").alias("id")).join(users, "id", "left")
        .select("file_hash", F.coalesce("name", "id").alias("name"))
    )
    lines = reports.report_lines(
        summary, names,
        reconcile.department_headcount_by_owner(roster, by="file_hash"),
        pairs, reconcile.without_email(roster, by="file_hash"),
        generated=clock, by="file_hash",
    )
    sinks.write_reports(lines, f"{job.table('reports')}/batch_id={batch_id}", by="file_hash")

    owned = summary.join(mail, "manager_id", "left")
    email = F.coalesce("email", F.lit(""))
    where = F.concat(F.lit(f"reports/batch_id={batch_id}/file_hash="), F.col("file_hash"))
    publish(records.report_rows(owned, F.col("manager_id"), email, report, where, clock), "report_history")
    publish(reports.notifications(summary, users, report), "notifications")
    publish(_status_events(inventory, sheets, problems, clock), "status_events")
    publish(records.audit_rows(owned, who, K.ACTION_SHEET_DONE, report, clock), "audit_logs")


def _history(spark: SparkSession, job: SheetJob, batch_id: int) -> DataFrame:
    """Hashes accepted by earlier batches."""
    earlier = spark.read.schema(_INVENTORY + ", batch_id int").parquet(job.table("inventory"))
    return earlier.where((F.col("batch_id") < batch_id) & (F.col("verdict") == "NEW")).select("file_hash")


def _summaries(sheets: DataFrame, present: DataFrame) -> DataFrame:
    """One row per sheet, also where neither sheet nor roster has any rows."""
    counts = reconcile.summarise_presence(present, by="file_hash").select("file_hash", *_COUNTS)
    filled = sheets.select("file_hash", "manager_id", "filename").join(counts, "file_hash", "left")
    return reconcile.with_score(filled.fillna(0, subset=list(_COUNTS)))


def _status_events(inventory: DataFrame, sheets: DataFrame, problems: DataFrame, clock: Column) -> DataFrame:
    """``PROCESSING`` and then ``COMPLETED`` or ``FAILED`` for every file taken in; ``FAILED``
    alone for a file turned away.  Failures carry a reason."""
    ended = (
        inventory.join(sheets.select("path", F.lit(True).alias("_done")), "path", "left")
        .join(problems, "file_hash", "left")
    )
    done = F.col("_done").isNotNull()
    steps = F.array(
        F.struct(F.lit(0).alias("step"), F.lit(K.STATUS_PROCESSING).alias("status"), F.lit(None).cast("string").alias("reason")),
        F.struct(
            F.lit(1).alias("step"),
            F.when(done, K.STATUS_COMPLETED).otherwise(K.STATUS_FAILED).alias("status"),
            F.when(~done, F.when(F.col("verdict") == "NEW", F.col("problem")).otherwise(F.col("verdict"))).alias("reason"),
        ),
    )
    events = ended.select(
        "path", "file_hash", "filename", "manager_id", "verdict", clock.alias("created_at"), F.inline(steps)
    )
    return events.where((F.col("step") == 1) | (F.col("verdict") == "NEW")).drop("verdict")
