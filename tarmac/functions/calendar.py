"""Calendar parts and cyclic encodings of the flight date."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25
MONTHS_PER_YEAR = 12


def calendar_columns(date: Column) -> dict[str, Column]:
    """Monday = 0 day of week, ISO week, quarter and the weekend flag."""
    dow = F.weekday(date)
    return {
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(date),
        "day_of_year": F.dayofyear(date),
        "week_of_year": F.weekofyear(date),
        "quarter": F.quarter(date),
        "is_weekend": (dow >= 5).cast("int"),
    }


def cyclic_columns(day_of_year: Column, month: Column) -> dict[str, Column]:
    """sin/cos of the day of year (period 365.25) and of the month (period 12)."""
    day_angle = F.lit(2 * math.pi) * day_of_year / F.lit(DAYS_PER_YEAR)
    month_angle = F.lit(2 * math.pi) * month / F.lit(MONTHS_PER_YEAR)
    return {
        "day_of_year_sin": F.sin(day_angle),
        "day_of_year_cos": F.cos(day_angle),
        "month_sin": F.sin(month_angle),
        "month_cos": F.cos(month_angle),
    }
