"""Dates, years and the rounding rules that go with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The course's weekday, Monday being 0, and the names of the days.
COURSE_DAY = 5
DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
#: Three rules for what counts as a year, each for its own use.
EVENT_YEAR, TEXT_YEAR, CLAIM_YEAR = r"\b(\d{3,4})\b", r"\b(1\d{3}|20\d{2})\b", r"\b(?:1[89]\d{2}|20\d{2})\b"


def iso_date(c: Column) -> Column:
    """A date from YYYY-MM-DD; null for any other precision."""
    return F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def off_cadence(d: Column) -> Column:
    return F.weekday(d) != COURSE_DAY


def weekday_name(d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(d) + 1)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def span(lo: Column, hi: Column) -> Column:
    """lo–hi; one year alone; ``-`` without years."""
    return F.when(lo.isNull(), F.lit("-")).when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("–", lo.cast("string"), hi.cast("string")))


def round1(x: Column) -> Column:
    """One decimal, halves up (towards plus infinity)."""
    return F.floor(x * 10 + 0.5) / 10


def snapshot_time(ts: Column) -> Column:
    """A 14-digit UTC time stamp; null if malformed."""
    return F.when(ts.rlike(r"^\d{14}$"), F.try_to_timestamp(ts, F.lit("yyyyMMddHHmmss")))


def age_days(ts: Column, now: Column) -> Column:
    """Days since a snapshot; infinity if its stamp is malformed."""
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(snapshot_time(ts))) / 86400.0, F.lit(float("inf")))


def event_year(year: Column, date: Column) -> Column:
    """The integer year, else the first run of three or four digits of year or date."""
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), EVENT_YEAR, 1), F.lit(""))
    return F.coalesce(year.try_cast("int"), F.coalesce(found(year.cast("string")), found(date)).try_cast("int"))


def parse_year_range(text: str) -> tuple[int, int]:
    """YYYY, YYYY-YYYY or YYYY:YYYY as bounds."""
    import re

    found = re.fullmatch(r"\s*(\d{3,4})(?:\s*[-:]\s*(\d{3,4}))?\s*", text)
    if not found:
        raise ValueError(f"not a year or a range of years: {text!r}")
    return int(found[1]), int(found[2] or found[1])
