"""Log-payload helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The deserialisation error signature and the payload that follows it.
ERROR_SIGNATURE = "cannot be deserialized"
PAYLOAD_AFTER_SIGNATURE = r"(?s)cannot be deserialized: (.*)"
# JSON's own whitespace (\s would also take a vertical tab in Java, not in RE2)
JSON_START = r"^[ \t\n\r]*[{\[]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_deserialization_error(message: Column | str) -> Column:
    return F.coalesce(_c(message).contains(ERROR_SIGNATURE), F.lit(False))


def error_payload(message: Column | str) -> Column:
    """Offending payload quoted by a deserialisation error, newlines included
    ('' when absent)."""
    return F.regexp_extract(_c(message), PAYLOAD_AFTER_SIGNATURE, 1)


def looks_like_json(text: Column | str) -> Column:
    """True when the text starts (after blanks) with ``{`` or ``[``; NULL stays NULL."""
    return _c(text).rlike(JSON_START)
