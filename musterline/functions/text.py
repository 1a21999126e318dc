"""Text expressions: stripping, blank tests, header names, substring search."""

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from musterline.constants import UNKNOWN_DEPARTMENT

# Every character that counts as white space for Unicode text; the last one is U+3000.
_WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` alone removes blanks only).

    Text that starts and ends with a printable ASCII character is returned as it is: two
    byte comparisons instead of a search in the character set, for nearly every ID.
    """
    c = _col(c)
    clean_edges = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(clean_edges, c).otherwise(F.btrim(c, F.lit(_WHITE_SPACE)))


def clean_id(c) -> Column:
    """An ID as stripped text; null where nothing is left."""
    return F.nullif(strip(_col(c).cast("string")), F.lit(""))


def email_missing(c) -> Column:
    """True for a null or blank e-mail."""
    return F.coalesce(strip(c) == "", F.lit(True))


def department_or_unknown(c) -> Column:
    """Null and empty become the default; a blank such as ``' '`` is kept as it is."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(UNKNOWN_DEPARTMENT))


def normal_header(c) -> Column:
    return F.lower(strip(c))


def contains_any(columns, text: str, literal: bool = False) -> Column:
    """True where any column contains ``text``, ignoring case.

    ``%`` and ``_`` in ``text`` act as wildcards unless ``literal`` is set.  A backslash in
    front of anything but a wildcard or a backslash means that character itself.
    """
    if literal:
        text = re.sub(r"([\\%_])", r"\\\1", text)
    else:
        text = re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], text, flags=re.DOTALL)
    pattern = f"%{text}%"
    return reduce(lambda a, b: a | b, [F.coalesce(_col(c).ilike(pattern), F.lit(False)) for c in columns])
