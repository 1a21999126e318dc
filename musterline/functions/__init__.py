"""Column expressions, all composed of Spark built-ins."""

from musterline.functions.files import (
    content_hash,
    extension,
    file_type,
    reader_for,
    sanitized,
    timestamp_suffix,
    utc_now,
)
from musterline.functions.score import (
    advice_text,
    executive_codes,
    recommendation_codes,
    risk_level,
    round2,
    score,
    score_text,
)
from musterline.functions.text import (
    clean_id,
    contains_any,
    department_or_unknown,
    email_missing,
    normal_header,
    strip,
)

__all__ = [
    "advice_text", "clean_id", "contains_any", "content_hash", "department_or_unknown",
    "email_missing", "executive_codes", "extension", "file_type", "normal_header",
    "reader_for", "recommendation_codes", "risk_level", "round2", "sanitized", "score",
    "score_text", "strip", "timestamp_suffix", "utc_now",
]
