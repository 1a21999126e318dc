"""Counts, distributions and per-owner dashboards.

Every fact table is read once and reduced by its owner key with conditional counts before
it is joined to anything.
"""

from pyspark.sql import DataFrame, functions as F

from musterline import constants as K
from musterline.functions import department_or_unknown
from musterline.operators.ranking import latest_per_key, top_per_group


def table_counts(**tables: DataFrame) -> DataFrame:
    """``(metric, value)``: the row count of each table given by name."""
    counts = [df.agg(F.count("*").alias("value")).select(F.lit(n).alias("metric"), "value") for n, df in tables.items()]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def admin_overview(
    roster: DataFrame, uploads: DataFrame, reports: DataFrame, audit: DataFrame,
    users: DataFrame, requests: DataFrame,
) -> DataFrame:
    """All administrator numbers as ``(metric, value)``, one scan per table."""
    totals = table_counts(employees=roster, reports=reports, audit_logs=audit)
    for prefix, row in (
        ("uploads", upload_distribution(uploads)),
        ("users", user_counts(users)),
        ("requests", request_counts(requests)),
    ):
        named = [F.struct(F.lit(f"{prefix}_{c}").alias("metric"), F.col(c).alias("value")) for c in row.columns]
        totals = totals.unionByName(row.select(F.inline(F.array(*named))))
    return totals


def department_headcount(roster: DataFrame) -> DataFrame:
    return (
        roster.groupBy(department_or_unknown("department").alias("department"))
        .agg(F.count("*").alias("headcount"))
        .orderBy(F.desc("headcount"), "department")
    )


def upload_distribution(uploads: DataFrame) -> DataFrame:
    return uploads.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("category") == K.ROSTER_FILE).alias("roster_files"),
        F.count_if(F.col("category") == K.SHEET_FILE).alias("sheet_files"),
    )


def request_counts(requests: DataFrame) -> DataFrame:
    status = F.col("status")
    return requests.agg(
        F.count("*").alias("total"),
        F.count_if(status == K.REQUEST_PENDING).alias("pending"),
        F.count_if(status == K.REQUEST_APPROVED).alias("approved"),
        F.count_if(status == K.REQUEST_REJECTED).alias("rejected"),
    )


def user_counts(users: DataFrame) -> DataFrame:
    role = F.col("role")
    return users.agg(
        F.count("*").alias("total"),
        F.count_if(role == K.ROLE_MANAGER).alias("managers"),
        F.count_if(role == K.ROLE_HR).alias("hr"),
    )


def recent_uploads(uploads: DataFrame, k: int = K.RECENT_UPLOADS_OVERALL) -> DataFrame:
    return (
        uploads.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
        .limit(k)
        .select("filename", "category", "uploaded_by", F.col("created_at").alias("uploaded_at"))
    )


def recent_uploads_per_owner(uploads: DataFrame, k: int = K.RECENT_PER_OWNER) -> DataFrame:
    order = [F.desc_nulls_last("created_at"), F.desc("id")]
    return top_per_group(uploads, ["uploaded_by"], order, k, rank="position").select(
        "uploaded_by", "position", "id", "filename", "category", F.col("created_at").alias("uploaded_at")
    )


def recent_reports_per_owner(reports: DataFrame, k: int = K.RECENT_PER_OWNER) -> DataFrame:
    """The last ``k`` reports each manager downloaded, by download time."""
    taken = reports.where(F.col("downloaded_by").isNotNull())
    order = [F.desc_nulls_last("downloaded_at"), F.desc("id")]
    return top_per_group(taken, ["downloaded_by"], order, k, rank="position").select(
        "downloaded_by", "position", "id", "filename", "downloaded_at"
    )


def latest_upload_per_category(uploads: DataFrame) -> DataFrame:
    return latest_per_key(uploads, ["category"], ["created_at", "id"], ["filename"])


def job_status(
    uploads: DataFrame,
    key: str = "filename",
    order: tuple = ("created_at", "id"),
    values: tuple = ("status", "uploaded_by", "created_at"),
) -> DataFrame:
    """The newest status per file; pass ``key="file_hash"`` where names repeat."""
    return latest_per_key(uploads, [key], list(order), list(values)).withColumnRenamed("created_at", "uploaded_at")


def _uploads_by_owner(uploads: DataFrame) -> DataFrame:
    return uploads.groupBy(F.col("uploaded_by").alias("email")).agg(
        F.count("*").alias("total_uploads"),
        F.count_if(F.col("category") == K.ROSTER_FILE).alias("roster_uploads"),
        F.count_if(F.col("category") == K.SHEET_FILE).alias("sheet_uploads"),
    )


def _headcount_by_manager(roster: DataFrame) -> DataFrame:
    return roster.groupBy(F.col("manager_id").alias("id")).agg(F.count("*").alias("headcount"))


def _managers(users: DataFrame) -> DataFrame:
    return users.where(F.col("role") == K.ROLE_MANAGER).select("id", "name", "email")


def _zero(*columns: str) -> list:
    return [F.coalesce(c, F.lit(0)).alias(c) for c in columns]


def manager_dashboard(
    users: DataFrame, roster: DataFrame, uploads: DataFrame, audit: DataFrame, reports: DataFrame
) -> DataFrame:
    """One row per manager: team, uploads, comparisons, reports, latest report.

    Reports generated are counted by the manager they were made for, reports downloaded and
    the latest report by who downloaded them; never-downloaded rows do not count as latest.
    """
    hr = (
        users.where(F.col("role") == K.ROLE_HR)
        .groupBy(F.col("manager_id").alias("id")).agg(F.count("*").alias("hr_count"))
    )
    compared = (
        audit.where(F.col("action") == K.ACTION_COMPARE)
        .groupBy(F.col("user_email").alias("email")).agg(F.count("*").alias("comparisons"))
    )
    made = reports.groupBy(F.col("manager_email").alias("email")).agg(F.count("*").alias("reports_generated"))
    newest = F.max(F.when(F.col("downloaded_at").isNotNull(), F.struct("downloaded_at", "id", "filename")))
    taken = (
        reports.where(F.col("downloaded_by").isNotNull())
        .groupBy(F.col("downloaded_by").alias("email"))
        .agg(F.count("*").alias("reports_downloaded"), newest.alias("_newest"))
    )
    joined = _managers(users).join(hr, "id", "left").join(_headcount_by_manager(roster), "id", "left")
    for fact in (_uploads_by_owner(uploads), compared, made, taken):
        joined = joined.join(fact, "email", "left")
    return joined.select(
        F.col("id").alias("manager_id"), "name", "email",
        *_zero("hr_count", "headcount", "roster_uploads", "sheet_uploads", "total_uploads",
               "comparisons", "reports_generated", "reports_downloaded"),
        F.col("_newest.filename").alias("latest_report"),
    )


def hr_dashboard(
    users: DataFrame, roster: DataFrame, uploads: DataFrame, reports: DataFrame, k: int = K.RECENT_PER_OWNER
) -> DataFrame:
    """One row per HR user with the figures of their manager; zeros where none is assigned.

    ``recent_reports`` lists the manager's last ``k`` report names, newest first: k names at
    most, put together after the per-owner cut.
    """
    recent = (
        recent_reports_per_owner(reports, k)
        .groupBy(F.col("downloaded_by").alias("email"))
        .agg(F.array_sort(F.collect_list(F.struct("position", "filename"))).alias("_recent"))
    )
    managers = (
        _managers(users)
        .join(_headcount_by_manager(roster), "id", "left")
        .join(_uploads_by_owner(uploads), "email", "left")
        .join(recent, "email", "left")
        .select(
            F.col("id").alias("manager_id"),
            F.col("name").alias("manager_name"),
            F.col("email").alias("manager_email"),
            "headcount", "roster_uploads", "sheet_uploads",
            F.array_join("_recent.filename", ",").alias("recent_reports"),
        )
    )
    hr = users.where(F.col("role") == K.ROLE_HR).select(
        F.col("id").alias("hr_id"), F.col("name").alias("hr_name"), F.col("email").alias("hr_email"), "manager_id"
    )
    return hr.join(managers, "manager_id", "left").select(
        "hr_id", "hr_name", "hr_email", "manager_id", "manager_name", "manager_email",
        *_zero("headcount", "roster_uploads", "sheet_uploads"),
        F.coalesce("recent_reports", F.lit("")).alias("recent_reports"),
    )


def weekday_trend(uploads: DataFrame) -> DataFrame:
    """Sheets verified, pending and flagged by the weekday they came in on."""
    status = F.col("status")
    return (
        uploads.where(F.col("category") == K.SHEET_FILE)
        .groupBy(F.date_format(F.col("created_at").cast("date"), "E").alias("weekday"))
        .agg(
            F.count_if(status == K.STATUS_COMPLETED).alias("verified"),
            F.count_if(status == K.STATUS_PROCESSING).alias("pending"),
            F.count_if(status == K.STATUS_FAILED).alias("flagged"),
        )
    )


def newest_first(df: DataFrame, time_column: str, key: str = "id") -> DataFrame:
    """The whole table by time, newest first: a range-partitioned sort."""
    return df.orderBy(F.desc_nulls_last(time_column), F.desc(key))


def audit_trail(audit: DataFrame) -> DataFrame:
    return newest_first(audit, "created_at")


def audit_daily(audit: DataFrame) -> DataFrame:
    return (
        audit.groupBy(F.col("created_at").cast("date").cast("timestamp_ntz").alias("day"), "action")
        .agg(F.count("*").alias("actions"))
    )


def report_history_view(reports: DataFrame) -> DataFrame:
    """Report history newest first, with the ID as text."""
    shown = [c for c in (
        "manager_email", "filename", "report_type", "report_path", "generated_at", "downloaded_by", "downloaded_at"
    ) if c in reports.columns]
    ordered = newest_first(reports, "generated_at")
    return ordered.select(F.col("id").cast("string").alias("id"), *shown)


def pending_requests(requests: DataFrame) -> DataFrame:
    shown = [c for c in ("name", "email", "requested_role", "reason") if c in requests.columns]
    return requests.where(F.col("status") == K.REQUEST_PENDING).select(F.col("id").cast("string").alias("id"), *shown)
