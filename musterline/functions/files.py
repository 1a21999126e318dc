"""File-name, file-content and clock expressions."""

from datetime import UTC, datetime

from pyspark.sql import Column, functions as F

from musterline import constants as K
from musterline.functions.text import _col

# Base name: what follows the last slash.  Extension: from the last dot of the base
# name on, provided something other than dots stands before it and something after it.
_BASE_NAME = r"([^/]*)$"
_EXTENSION = r"[^/.][^/]*(\.[^./]+)$"


def extension(filename) -> Column:
    """Lower-case extension with its dot; empty for ``.profile``, ``name.`` and ``name``."""
    return F.lower(F.regexp_extract(_col(filename), _EXTENSION, 1))


def file_type(ext: Column) -> Column:
    types = F.create_map(*[F.lit(x) for pair in K.FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(types, ext), F.lit(K.FILE_TYPE_OTHER))


def reader_for(ext: Column) -> Column:
    """Which reader takes the file; only CSV rows go on to the sheet scan."""
    return (
        F.when(ext == ".csv", "CSV").when(ext.isin(".xlsx", ".xls"), "EXCEL").otherwise("UNSUPPORTED")
    )


def sanitized(filename) -> Column:
    """Base name with every character outside letters, digits, dot, underscore, hyphen as ``_``."""
    base = F.regexp_extract(_col(filename), _BASE_NAME, 1)
    return F.regexp_replace(base, "[^A-Za-z0-9._-]", "_")


def content_hash(content) -> Column:
    return F.sha2(_col(content), 256)


def timestamp_suffix(clock: Column) -> Column:
    return F.date_format(clock, "yyyyMMdd_HHmmss")


def utc_now() -> Column:
    """The present as a constant, so that every table of one run carries the same time."""
    return F.lit(datetime.now(UTC).replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")
