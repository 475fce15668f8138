"""Expressions for calendar days and letters, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: day part of an ISO-like date, extended (2012-04-02) or basic (20120402), with or without a time.
ISO_DAY = r"^\s*(\d{4})([-/.]?)(\d{2})\2(\d{2})(?!\d)"


def iso_day(text: Column) -> Column:
    """DATE written at the start of an ISO-like text; NULL when it names no calendar day."""
    at = F.when(
        text.rlike(ISO_DAY),
        F.concat_ws("-", *(F.regexp_extract(text, ISO_DAY, g) for g in (1, 3, 4))),
    )
    return at.try_cast("date")


def day_number(text: Column) -> Column:
    """Days since 1970-01-01 of :func:`iso_day`. The common spelling skips the regular expression."""
    plain = F.when((F.length(text) == 10) & (F.substring(text, 5, 1) == "-"), text)
    return F.unix_date(F.coalesce(plain.try_cast("date"), iso_day(text)))
