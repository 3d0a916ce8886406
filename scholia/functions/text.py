"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that Unicode counts as white space.
WHITE = "\\u0009-\\u000d\\u001c-\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def strip_white(c: Column) -> Column:
    """Without surrounding Unicode white space (``trim`` removes blanks only)."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def utc_month(ts: Column) -> Column:
    """YYYY-MM in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM")


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)
