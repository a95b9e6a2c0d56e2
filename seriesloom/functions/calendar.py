"""Calendar rules for return horizons. Every rule is a Column expression, so it takes literals and columns alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HORIZON_MONTHS = {"1m": 1, "3m": 3, "6m": 6, "1y": 12, "3y": 36, "5y": 60, "10y": 120}
ROLLING_YEARS = (1, 3, 5, 10)


def date(x: str | Column) -> Column:
    """A date column from an ISO text or a column."""
    return F.lit(x).cast("date") if isinstance(x, str) else x


def horizon_start(as_of: str | Column, horizon: str) -> Column:
    """as_of less the horizon's months; a day that the month lacks becomes its last day."""
    if horizon not in HORIZON_MONTHS:
        raise ValueError(f"horizon must be one of {', '.join(HORIZON_MONTHS)}")
    return F.add_months(date(as_of), -HORIZON_MONTHS[horizon])


def anniversary(day: str | Column, years: int) -> Column:
    """The same day years before; 29 February becomes 28 February."""
    return F.add_months(date(day), -12 * years)


def is_annualised(horizon: str) -> bool:
    return HORIZON_MONTHS[horizon] >= 12


def frequency_start(as_of: str | Column, months: int = 60) -> Column:
    """The first day of a window of so many calendar months that ends with as_of's month."""
    return F.add_months(F.trunc(date(as_of), "MM"), 1 - months)


def yearly_cutoffs(as_of: str | Column, years: int = 5) -> Column:
    """An array of as_of and its anniversaries, oldest first."""
    return F.transform(F.sequence(F.lit(years - 1), F.lit(0), F.lit(-1)), lambda i: F.add_months(date(as_of), F.lit(-12) * i))


def fixed_windows(first: Column, last: Column, days: int) -> Column:
    """An array of (start, end) windows of at most so many days that cover first to last."""
    starts = F.sequence(first, last, F.expr(f"interval {days} days"))
    return F.transform(starts, lambda s: F.struct(s.alias("window_start"), F.least(F.date_add(s, days - 1), last).alias("window_end")))
