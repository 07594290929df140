"""Date parsing, formatting and calendar parts.

All parsers are tolerant (``try_to_date``): an unparseable value becomes NULL
instead of failing the job, because ANSI mode makes ``to_date`` throw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of

# The date layouts accepted by the reference's loaders.
# Day-first layouts are tried before ISO so that 03/04/2026 is 3 April.
DAY_FIRST_PATTERNS = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "d-MMM-yyyy", "d MMM yyyy"]


def parse_dmy(c) -> Column:
    """``DD/MM/YYYY`` (one or two digit day and month) -> DATE or NULL."""
    return F.try_to_date(col_of(c), "d/M/yyyy")


def parse_day_first(c, patterns: list[str] | None = None) -> Column:
    """First layout that parses wins; NULL when none does."""
    c = F.trim(col_of(c).cast("string"))
    return F.coalesce(*[F.try_to_date(c, p) for p in (patterns or DAY_FIRST_PATTERNS)])


def parse_dmy_or_iso(c) -> Column:
    """``DD/MM/YYYY`` or ``YYYY-MM-DD``."""
    c = F.trim(col_of(c).cast("string"))
    return F.coalesce(F.try_to_date(c, "d/M/yyyy"), F.try_to_date(c, "yyyy-M-d"))


def parse_yyyymmdd(c) -> Column:
    """Accounting export date ``YYYYMMDD``."""
    return F.try_to_date(F.trim(col_of(c)), "yyyyMMdd")


def parse_d_mon_yy(c) -> Column:
    """Price-list date ``1-Apr-26``."""
    return F.try_to_date(F.initcap(F.trim(col_of(c))), "d-MMM-yy")


def to_date_any(c) -> Column:
    """Cast a TIMESTAMP / TIMESTAMP_NTZ / DATE column to DATE."""
    return col_of(c).cast("date")


def fmt_dmy(c) -> Column:
    """X11: ``dd/MM/yyyy``."""
    return F.date_format(col_of(c), "dd/MM/yyyy")


def fmt_iso(c) -> Column:
    """X11: ``yyyy-MM-dd`` (used for every date we hand out as text)."""
    return F.date_format(col_of(c), "yyyy-MM-dd")


def fmt_year_month(c) -> Column:
    """X11: ``yyyy-MM``."""
    return F.date_format(col_of(c), "yyyy-MM")


def iso_week(c) -> Column:
    """ISO-8601 week number (1..53)."""
    return F.weekofyear(col_of(c)).cast("int")


def iso_week_year(c) -> Column:
    """ISO-8601 week-based year: 2027-01-01 belongs to 2026 week 53."""
    return F.extract(F.lit("YEAROFWEEK"), col_of(c)).cast("int")


def weekday_mon0(c) -> Column:
    """Monday = 0 ... Sunday = 6 (Spark ``dayofweek`` is Sunday = 1)."""
    return F.weekday(col_of(c)).cast("int")


def is_weekend(c) -> Column:
    """Saturday or Sunday."""
    return weekday_mon0(c).isin(5, 6)


def calendar_parts(c) -> dict[str, Column]:
    """The calendar feature columns, by name."""
    d = col_of(c)
    return {
        "day": F.dayofmonth(d).cast("int"),
        "month": F.month(d).cast("int"),
        "year": F.year(d).cast("int"),
        "weekday": weekday_mon0(d),
        "week": iso_week(d),
        "is_weekend": is_weekend(d).cast("int"),
    }


def previous_day(c) -> Column:
    """X13."""
    return F.date_sub(col_of(c), 1)


def next_day(c) -> Column:
    """X13."""
    return F.date_add(col_of(c), 1)
