"""Return arithmetic as Column expressions. A pair of points that has no return is null, with a status beside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total_return(start: Column, end: Column) -> Column:
    """Percent from start to end; null unless both are positive."""
    return F.when((start > 0) & (end > 0), (end / start - 1) * 100)


def annual_return(start: Column, end: Column, days: Column) -> Column:
    """Actual/365 compound percent a year; null unless both are positive and days is."""
    years = F.lit(365.0) / days.cast("double")
    return F.when((start > 0) & (end > 0) & (days > 0), (F.pow(end / start, years) - 1) * 100)


def trailing_return(start: Column, end: Column, days: Column, annual: bool) -> Column:
    return annual_return(start, end, days) if annual else F.when(days > 0, total_return(start, end))


def endpoint_status(end_day: Column, start_day: Column, as_of: Column, tolerance: int) -> Column:
    """Why a series has no return, or 'available'. A stale end counts before a missing start."""
    return (
        F.when(end_day.isNull() | (end_day < F.date_sub(as_of, tolerance)), "stale_endpoint")
        .when(start_day.isNull(), "insufficient_history")
        .when(start_day >= end_day, "invalid_period")
        .otherwise("available")
    )


def colour_scale(value: Column) -> Column:
    """Half the width of a symmetric colour scale over a group: at least 1."""
    return F.greatest(F.lit(1.0), F.max(F.abs(value)))
