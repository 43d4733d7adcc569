"""Periods: weeks with any start day, ISO weeks, months, years, forecast leads."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday numbers and the year lengths of the annual phase.
WEEKDAYS = {"MON": 0, "TUE": 1, "WED": 2, "THU": 3, "FRI": 4, "SAT": 5, "SUN": 6}
WEEKS_PER_YEAR = 52.1775
DAYS_PER_YEAR = 365.2425


def week_start(day: Column, first_day: str = "MON") -> Column:
    return F.date_sub(day, F.pmod(F.weekday(day) - F.lit(WEEKDAYS[first_day]), F.lit(7)))


def week_end(start: Column) -> Column:
    return F.date_add(start, 6)


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day)


def iso_week_start(year: Column, week: Column) -> Column:
    """Monday of an ISO week, NULL when the year has no such week."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_add(F.trunc(fourth, "week"), ((week - 1) * 7).cast("int"))
    return F.when((iso_year(monday) == year) & (F.weekofyear(monday) == week), monday)


def midpoint(start: Column) -> Column:
    """Day that decides which month or year a week belongs to."""
    return F.date_add(start, 3)


def midpoint_month(start: Column) -> Column:
    return F.trunc(midpoint(start), "month")


def midpoint_year(start: Column) -> Column:
    return F.year(midpoint(start))


def cycle(position: Column, length: float) -> tuple[Column, Column]:
    angle = position * F.lit(2 * math.pi / length)
    return F.sin(angle), F.cos(angle)


def calendar_features(start: Column) -> dict[str, Column]:
    week = F.weekofyear(start)
    sine, cosine = cycle(week, WEEKS_PER_YEAR)
    return {
        "year": F.year(start),
        "month": F.month(midpoint(start)),
        "iso_year": iso_year(start),
        "iso_week": week,
        "week_of_year_sin": sine,
        "week_of_year_cos": cosine,
    }


def annual_phase(day: Column) -> tuple[Column, Column]:
    return cycle(F.dayofyear(day) - 1, DAYS_PER_YEAR)


def month_phase(month: Column) -> tuple[Column, Column]:
    return cycle(month, 12.0)


def month_end(start: Column) -> Column:
    return F.last_day(start)


def year_bounds(year: Column) -> tuple[Column, Column]:
    return F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))


def reference_window(as_of: Column, history_days: int = 35) -> tuple[Column, Column, Column]:
    """Start and end of the last completed Monday-Sunday week, and the history start."""
    start = F.date_sub(F.trunc(F.date_add(as_of, 1), "week"), 7)
    return start, F.date_add(start, 6), F.date_sub(start, history_days)


def target_month(init_month: Column, lead: Column) -> Column:
    return F.add_months(init_month, lead)


def month_lead(init_month: Column, target: Column) -> Column:
    return ((F.year(target) - F.year(init_month)) * 12 + F.month(target) - F.month(init_month)).cast("int")


def days_in_month(day: Column) -> Column:
    return F.day(F.last_day(day))
