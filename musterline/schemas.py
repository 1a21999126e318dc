"""Declared column types of the entity tables.

Identifiers are strings, times are zone-less and mean UTC.
"""

from pyspark.sql import types as T

_S, _B, _I, _TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.TimestampNTZType()


def _table(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], c[2] if len(c) > 2 else True) for c in columns])


ROSTER = _table(
    ("id", _S, False), ("employee_id", _S), ("full_name", _S), ("company_email", _S),
    ("personal_email", _S), ("department", _S), ("customer", _S), ("manager", _S),
    ("manager_id", _S), ("created_at", _TS),
)
UPLOAD_HISTORY = _table(
    ("id", _S, False), ("filename", _S, False), ("stored_name", _S), ("file_hash", _S),
    ("category", _S, False), ("status", _S, False), ("uploaded_by", _S, False),
    ("created_at", _TS),
)
REPORT_HISTORY = _table(
    ("id", _S, False), ("manager_id", _S, False), ("manager_email", _S), ("filename", _S, False),
    ("report_path", _S, False), ("report_type", _S), ("generated_at", _TS),
    ("downloaded_by", _S), ("downloaded_at", _TS),
)
AUDIT_LOGS = _table(
    ("id", _S, False), ("user_email", _S, False), ("action", _S, False), ("details", _S),
    ("created_at", _TS),
)
USERS = _table(
    ("id", _S, False), ("name", _S, False), ("email", _S, False), ("role", _S, False),
    ("role_id", _S), ("manager_id", _S), ("approval_status", _S), ("active", _B),
    ("created_at", _TS), ("failed_login_attempts", _I), ("is_locked", _B), ("locked_until", _TS),
)
USER_REQUESTS = _table(
    ("id", _S, False), ("name", _S), ("email", _S), ("requested_role", _S), ("reason", _S),
    ("status", _S), ("approved_by", _S), ("created_at", _TS),
)
STATUS_EVENTS = _table(
    ("file_hash", _S, False), ("filename", _S), ("status", _S, False), ("reason", _S),
    ("uploaded_by", _S), ("created_at", _TS),
)


def user_roles() -> T.StructType:
    from musterline.constants import PERMISSION_FLAGS

    return _table(("id", _S, False), ("role_name", _S), *((flag, _B) for flag in PERMISSION_FLAGS))


TABLES = {
    "roster": ROSTER,
    "upload_history": UPLOAD_HISTORY,
    "report_history": REPORT_HISTORY,
    "audit_logs": AUDIT_LOGS,
    "users": USERS,
    "user_requests": USER_REQUESTS,
    "user_roles": user_roles(),
    "status_events": STATUS_EVENTS,
}
