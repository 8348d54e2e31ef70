"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def month_number(date: Column | str) -> Column:
    d = _c(date)
    return F.year(d) * 12 + F.month(d)


def months_apart(later: Column | str, earlier: Column | str) -> Column:
    """Difference in calendar months, whatever the day of the month."""
    return month_number(later) - month_number(earlier)


def months_on_book(on: Column | str, origination: Column | str, low: int = 1, high: int = 60) -> Column:
    return F.least(F.greatest(months_apart(on, origination), F.lit(low)), F.lit(high))


def age_years(on: Column | str, birth: Column | str) -> Column:
    return F.datediff(_c(on), _c(birth)) / F.lit(365.25)


def vintage_month(date: Column | str) -> Column:
    return F.date_format(_c(date), "yyyy-MM")


def vintage_quarter(date: Column | str) -> Column:
    d = _c(date)
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def month_ends(start: Column | str, end: Column | str) -> Column:
    """Array of the month-end dates from the month of ``start`` to the month of ``end``."""
    first, last = F.trunc(_c(start), "MM"), F.trunc(_c(end), "MM")
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    return F.transform(F.coalesce(months, F.array().cast("array<date>")), lambda d: F.last_day(d))
