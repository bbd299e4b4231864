"""Typed parsing of text fields at the input boundary (ANSI-safe)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_date_or_null(c: Column | str) -> Column:
    """ISO date text -> date; empty or malformed text -> null (never raises)."""
    return F.try_to_date(F.nullif(F.trim(_col(c).cast("string")), F.lit("")), "yyyy-MM-dd")


def to_utc_timestamp_ntz(c: Column | str) -> Column:
    """Date-time text with an optional zone (``2019-04-26 18:03:11 UTC``,
    ``2019-04-26T18:03:11-06:00``) -> UTC wall-clock ``timestamp_ntz``.

    Stored timestamps are zone-free UTC so results never depend on the
    session time zone. Malformed text gives null.
    """
    text = F.nullif(F.trim(_col(c).cast("string")), F.lit(""))
    instant = F.try_to_timestamp(text)
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def name_key(c: Column | str) -> Column:
    """Case-insensitive key for scientific names."""
    return F.lower(_col(c))


def ntz_literal(value) -> Column:
    """A zone-free timestamp literal (``datetime`` or ISO text). Built from
    text so the session time zone cannot shift it."""
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")
