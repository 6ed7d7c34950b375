"""Date columns. Everything is NULL-safe: bad input gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

# Time of day and offset that may follow an ISO-8601 date after any one separator character.
_SECONDS = r"[0-5][0-9](?:[.,][0-9]+)?"
_CLOCK = (
    rf"(?:(?:[01][0-9]|2[0-3])(?::[0-5][0-9](?::{_SECONDS})?|[0-5][0-9](?:{_SECONDS})?)?"
    r"|24(?::00(?::00(?:[.,]0+)?)?|00(?:00(?:[.,]0+)?)?)?)"
)
_OFFSET = r"(?:[Zz]|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9])?)"
_TAIL = rf"(?:[\x00-\x7f]{_CLOCK}{_OFFSET}?)?$"

_DAY = rf"(?s)^([0-9]{{4}})(?:-([0-9]{{2}})-([0-9]{{2}})|([0-9]{{2}})([0-9]{{2}})){_TAIL}"
_MONTH = r"^([0-9]{4})-([0-9]{2})$"
_YEAR = r"^([0-9]{4})$"
_WEEK = rf"(?s)^([0-9]{{4}})(?:-W([0-9]{{2}})(?:-([1-7]))?|W([0-9]{{2}})([1-7])?){_TAIL}"
_ORDINAL = rf"(?s)^([0-9]{{4}})-?([0-9]{{3}}){_TAIL}"
_MIDNIGHT_24 = rf"(?s)^(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{8}})[\x00-\x7f]24"


def make_date_or_null(year, month, day) -> Column:
    """Date from text or number parts; NULL for a day that does not exist (``make_date`` raises in ANSI mode)."""
    parts = [F.lpad(p.cast("string"), width, "0") for p, width in ((year, 4), (month, 2), (day, 2))]
    date = F.concat_ws("-", *parts).try_cast("date")
    return F.when(date >= F.lit("0001-01-01").cast("date"), date)


def _week_date(year: Column, week: Column, day: Column) -> Column:
    jan4 = make_date_or_null(year, F.lit(1), F.lit(4))
    monday = F.date_sub(jan4, F.weekday(jan4))
    in_range = week.try_cast("int").between(1, 53)
    return F.when(in_range, F.date_add(monday, (week.try_cast("int") - 1) * 7 + day.try_cast("int") - 1))


def _ordinal_date(year: Column, day: Column) -> Column:
    first = make_date_or_null(year, F.lit(1), F.lit(1))
    date = F.date_add(first, day.try_cast("int") - 1)
    return F.when((day.try_cast("int") >= 1) & (F.year(date) == F.year(first)), date)


def _parse_iso(c: Column) -> Column:
    def group(pattern, n):
        return F.regexp_extract(c, pattern, n)

    def either(pattern, a, b):
        return F.concat(group(pattern, a), group(pattern, b))

    day = make_date_or_null(group(_DAY, 1), either(_DAY, 2, 4), either(_DAY, 3, 5))
    week_day = F.coalesce(F.nullif(either(_WEEK, 3, 5), F.lit("")), F.lit("1"))
    return (
        F.when(F.rlike(c, F.lit(_DAY)), F.when(F.rlike(c, F.lit(_MIDNIGHT_24)), F.date_add(day, 1)).otherwise(day))
        .when(F.rlike(c, F.lit(_MONTH)), make_date_or_null(group(_MONTH, 1), group(_MONTH, 2), F.lit(1)))
        .when(F.rlike(c, F.lit(_YEAR)), make_date_or_null(group(_YEAR, 1), F.lit(1), F.lit(1)))
        .when(F.rlike(c, F.lit(_WEEK)), _week_date(group(_WEEK, 1), either(_WEEK, 2, 4), week_day))
        .when(F.rlike(c, F.lit(_ORDINAL)), _ordinal_date(group(_ORDINAL, 1), group(_ORDINAL, 2)))
    )


def iso_date(c) -> Column:
    """Calendar date as written in an ISO-8601 text, offset ignored; NULL when the text is not valid.

    Calendar (extended, basic, year or year-month only), week and ordinal dates are read, with an optional time.
    The text is never cast through a timestamp: ``2026-08-01T00:30:00+02:00`` is 1 August, not 31 July in UTC.
    """
    return bind(c, _parse_iso)


def long_date(c) -> Column:
    """``Thursday 23 July 2026``."""
    return F.date_format(c, "EEEE dd MMMM yyyy")


def try_timestamp(c) -> Column:
    """Moment of a text with date, time and offset, or of a date alone, also in basic form; NULL for anything else."""
    return F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c, F.lit("yyyyMMdd")))


def month_year(c) -> Column:
    return F.date_format(c, "yyyy-MM")
