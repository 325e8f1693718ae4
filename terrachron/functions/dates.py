"""Partial historical dates, decimal years and ISO text.

Text years are signed and have no year zero: ``-0044`` is 44 BCE. Decimal
years are astronomical (1 BCE = 0), so text year -n is decimal year 1 - n.
Dates stay text: a DateType before year 1 cannot be collected in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Days before each month, and days of each month, in a common year.
DAYS_BEFORE_MONTH = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]
DAYS_OF_MONTH = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]

PARTIAL_DATE = r"^(-?)(\d{1,4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$"


def is_leap(year: Column) -> Column:
    """True for leap years, also before year 1."""
    return ((F.pmod(year, F.lit(4)) == 0) & (F.pmod(year, F.lit(100)) != 0)) | (
        F.pmod(year, F.lit(400)) == 0
    )


def days_in_year(year: Column) -> Column:
    return F.when(is_leap(year), 366).otherwise(365)


def _first_day(text: Column) -> Column:
    """First day of a partial date as an internal DateType; NULL when it is not one.

    The year is shifted to astronomical numbering first, then the cast to a date
    checks month and day and fills in what is missing.
    """
    body = F.ltrim(text, F.lit("-"))
    digits = F.substring_index(body, "-", 1)
    rest = F.substring(body, F.length(digits) + 1, F.lit(10))
    before = digits.try_cast("int") - 1
    shifted = F.concat(F.when(before > 0, "-").otherwise(""), F.lpad(F.abs(before).cast("string"), 4, "0"))
    year = F.when(text.startswith("-") & (before >= 0), shifted).otherwise(F.lpad(digits, 4, "0"))
    return F.when(text.rlike(PARTIAL_DATE), F.concat(year, rest).try_cast("date"))


def _hyphens(text: Column) -> Column:
    """0 for a year, 1 for a month, 2 for a full date."""
    body = F.ltrim(text, F.lit("-"))
    return F.length(body) - F.length(F.translate(body, "-", ""))


def _day(text: Column, which: str) -> Column:
    """First or last day of a partial date."""
    first = _first_day(text)
    if which == "start":
        return first
    if which != "end":
        raise ValueError("which must be 'start' or 'end'")
    hyphens = _hyphens(text)
    month = F.add_months(first, F.when(hyphens == 0, 11).otherwise(0))
    return F.when(hyphens == 2, first).otherwise(F.last_day(month))


def _month_and_day(day: Column) -> Column:
    """``-MM-DD`` of a date of any era."""
    return F.right(day.cast("string"), F.lit(6))


def pad_date(text: Column, which: str) -> Column:
    """Complete ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` to its first or last day."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.substring_index(F.ltrim(text, F.lit("-")), "-", 1)
    return F.concat(sign, F.lpad(digits, 4, "0"), _month_and_day(_day(text, which)))


def _decimal(day: Column) -> Column:
    """A date as a decimal year, at the middle of the day."""
    # The day 365 days after New Year is the 366th of a leap year, else the first.
    last = F.dayofyear(F.date_add(F.trunc(day, "year"), 365))
    return F.year(day) + (F.dayofyear(day) - F.lit(0.5)) / F.when(last == 366, 366).otherwise(365)


def iso_to_decimal(text: Column) -> Column:
    """A full ISO date as a decimal year, at the middle of its day."""
    return F.when(_hyphens(text) == 2, _decimal(_first_day(text)))


def to_decimal(text: Column, which: str) -> Column:
    """``iso_to_decimal(pad_date(text, which))`` in one step."""
    return _decimal(_day(text, which))


def year_text(year: Column) -> Column:
    """Astronomical year as signed four-digit text."""
    return F.when(
        year < 1, F.concat(F.lit("-"), F.lpad(F.abs(year - 1).cast("string"), 4, "0"))
    ).otherwise(F.lpad(year.cast("string"), 4, "0"))


def decimal_to_iso(value: Column) -> Column:
    """A decimal year as ISO text; NULL outside the years that fit four digits."""
    year = F.floor(value).cast("int")
    ordinal = F.greatest(F.ceil((value - year) * days_in_year(year)).cast("int"), F.lit(1))
    first = F.when(is_leap(year), F.lit("2000-01-01")).otherwise(F.lit("2001-01-01"))
    month_day = _month_and_day(F.date_add(first.cast("date"), ordinal - 1))
    return F.when(value.between(-9998, 9999.999999), F.concat(year_text(year), month_day))


def valid_date(text: Column) -> Column:
    """True for a real date written as YYYY-MM-DD, YYYY-MM or YYYY."""
    strict = text.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$") & ~text.startswith("0000")
    return F.coalesce(strict & _first_day(text).isNotNull(), F.lit(False))


def valid_at(start: Column, end: Column, moment: float) -> Column:
    """Half-open validity test; a missing bound is open."""
    at = F.lit(float(moment))
    return (start.isNull() | (start <= at)) & (end.isNull() | (end > at))
