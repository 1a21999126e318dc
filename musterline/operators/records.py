"""Rows for the upload, report and audit histories, in their declared column order.

IDs are hashes of what the row says, so building a row again gives the same ID and a
repeated append can be told from a new event.
"""

from pyspark.sql import Column, DataFrame, functions as F

from musterline.schemas import AUDIT_LOGS, REPORT_HISTORY, UPLOAD_HISTORY

DEFAULT_REPORT_TYPE = "COMPLIANCE"


def _record_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def _shaped(df: DataFrame, schema, values: dict[str, Column]) -> DataFrame:
    return df.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def audit_rows(df: DataFrame, user_email: Column, action: str, details: Column, clock: Column) -> DataFrame:
    """One audit row per row of ``df``."""
    action = F.lit(action)
    return _shaped(df, AUDIT_LOGS, {
        "id": _record_id(user_email, action, details, clock),
        "user_email": user_email, "action": action, "details": details, "created_at": clock,
    })


def upload_rows(df: DataFrame, category: str, status: Column, uploaded_by: Column, clock: Column) -> DataFrame:
    """One upload row per file of an inventory with ``filename``, ``stored_name``, ``file_hash``."""
    return _shaped(df, UPLOAD_HISTORY, {
        "id": _record_id(F.lit(category), F.col("file_hash")),
        "filename": F.col("filename"), "stored_name": F.col("stored_name"), "file_hash": F.col("file_hash"),
        "category": F.lit(category), "status": status, "uploaded_by": uploaded_by, "created_at": clock,
    })


def report_rows(
    df: DataFrame, manager_id: Column, manager_email: Column, filename: Column, path: Column, clock: Column
) -> DataFrame:
    """One report row per row of ``df``; nothing downloaded yet."""
    return _shaped(df, REPORT_HISTORY, {
        "id": _record_id(manager_id, path),
        "manager_id": manager_id, "manager_email": manager_email, "filename": filename, "report_path": path,
        "report_type": F.lit(DEFAULT_REPORT_TYPE), "generated_at": clock,
    })
