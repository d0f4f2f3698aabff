"""Date parsing and formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def iso(ts: Column) -> Column:
    """``2026-01-01T00:00:00Z``"""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_date(value: Column, epoch: bool = True) -> Column:
    """First ISO date inside a text, or the date of an epoch given in digits; null if neither parses."""
    text = F.trim(value.cast("string"))
    found = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    parsed = F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    if not epoch:
        return parsed
    digits = F.rlike(text, F.lit(r"^\d{10,}$"))
    return F.when(digits, F.timestamp_seconds(F.left(text, F.lit(10)).cast("long")).cast("date")).otherwise(parsed)


def relative_days(rule: str) -> int:
    """``-3m``, ``-30d``, ``-1y`` as days back (a month is 30 days, a year 365)."""
    match = re.fullmatch(r"-?(\d+)([dmy])", rule.strip())
    if not match:
        raise ValueError(f"not a relative window: {rule!r}")
    return int(match.group(1)) * {"d": 1, "m": 30, "y": 365}[match.group(2)]


def age_days(as_of: str, date: Column) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), date)
