"""Calendar parts of a date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day: Column) -> Column:
    """Monday of the day's ISO week, as a DATE."""
    return F.trunc(day, "week")


def week_label(day: Column) -> Column:
    """Two-digit day and short month name, e.g. '26 Oct'."""
    return F.date_format(day, "dd MMM")


def calendar_columns(day: Column) -> list[Column]:
    """Calendar attributes; every text column has a numeric one to order it by (Monday = 1)."""
    weekday = F.weekday(day)
    return [
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.month(day).alias("month_sort"),
        F.weekofyear(day).alias("iso_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        (weekday + 1).alias("day_sort"),
        F.when(weekday >= 5, 1).otherwise(0).alias("is_weekend"),
    ]
