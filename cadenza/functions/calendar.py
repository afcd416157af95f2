"""Time expressions, Column -> Column."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Monday that starts week 1 of the three-year log.
DEFAULT_ANCHOR = date(2020, 12, 28)

# The shapes a release date comes in, most exact first.
RELEASE_DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM", "yyyy"]


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(text: Column | str) -> Column:
    """String to timestamp without zone; under ANSI mode bad input raises."""
    return F.to_timestamp_ntz(as_column(text))


def week_since_anchor(ts: Column | str, anchor: date = DEFAULT_ANCHOR) -> Column:
    """Week number with the anchor's week as 1; earlier times give 0 and below."""
    days = F.datediff(F.to_date(as_column(ts)), F.lit(anchor))
    return (F.floor(days / F.lit(7.0)) + 1).cast("bigint")


def week_start(week: int, anchor: date = DEFAULT_ANCHOR) -> datetime:
    """First moment of a week, the inverse of week_since_anchor."""
    return datetime.combine(anchor, datetime.min.time()) + timedelta(weeks=week - 1)


def week_number(day: str, anchor: date = DEFAULT_ANCHOR) -> int:
    """Week number of a 'yyyy-MM-dd' string, for job arguments."""
    return (datetime.strptime(day, "%Y-%m-%d").date() - anchor).days // 7 + 1


def iso_week(ts: Column | str) -> Column:
    return F.weekofyear(as_column(ts))


def sunday_week(ts: Column | str) -> Column:
    """Week of the year counted from the first Sunday; days before it are week 0."""
    day = F.to_date(as_column(ts))
    return F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / F.lit(7.0)).cast("int")


def elapsed_ms(start: Column | str, end: Column | str) -> Column:
    """Milliseconds from start to end, to the microsecond.

    The session time zone should be UTC, as build_session sets it: in a zone
    with summer time Spark counts the hour that such a night lacks.
    """
    return F.timestamp_diff("MICROSECOND", as_column(start), as_column(end)) / F.lit(1000.0)


def release_year(text: Column | str) -> Column:
    """Year of a full or partial date; null where none can be read."""
    dates = [F.try_to_date(as_column(text), fmt) for fmt in RELEASE_DATE_FORMATS]
    return F.year(F.coalesce(*dates))
