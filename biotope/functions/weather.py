"""Unit conversion, humidity, hour and day flags, grid keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biotope.functions.calendar import days_in_month

# Magnus coefficients and activity thresholds.
MAGNUS_A = 17.625
MAGNUS_B = 243.04
HUMID_PCT = 80.0
VERY_HUMID_PCT = 90.0
WET_HOUR_MM = 0.1
ACTIVITY_C = (7.0, 25.0)
DEGREE_HOUR_BASE_C = 5.0
RAINY_DAY_MM = 1.0
HUMID_DAY_HOURS = 16
FAVORABLE_DAY_HOURS = 6


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(273.15)


def metres_to_mm(metres: Column) -> Column:
    return metres * F.lit(1000.0)


def rate_to_monthly_mm(metres_per_second: Column, month: Column) -> Column:
    return metres_per_second * F.lit(1000.0 * 86400.0) * days_in_month(month)


def daily_to_monthly(value: Column, month: Column) -> Column:
    return value * days_in_month(month)


def relative_humidity(temperature_c: Column, dew_point_c: Column) -> Column:
    def exponent(t: Column) -> Column:
        return F.lit(MAGNUS_A) * t / (F.lit(MAGNUS_B) + t)

    ratio = F.exp(exponent(dew_point_c) - exponent(temperature_c)) * 100.0
    return F.greatest(F.least(ratio, F.lit(100.0)), F.lit(0.0))


def flag(condition: Column) -> Column:
    return condition.cast("int")


def hour_flags(temperature: Column, humidity: Column, rain: Column) -> dict[str, Column]:
    humid = humidity >= HUMID_PCT
    return {
        "humid_hour_80": flag(humid),
        "humid_hour_90": flag(humidity >= VERY_HUMID_PCT),
        "wet_hour": flag(rain >= WET_HOUR_MM),
        "activity_hour": flag(temperature.between(*ACTIVITY_C) & humid),
        "degree_hours": F.greatest(temperature - DEGREE_HOUR_BASE_C, F.lit(0.0)),
    }


def day_flags(rain: Column, humid_hours: Column, activity_hours: Column) -> dict[str, Column]:
    return {
        "rainy_day": flag(rain >= RAINY_DAY_MM),
        "humid_day": flag(humid_hours >= HUMID_DAY_HOURS),
        "favorable_day": flag(activity_hours >= FAVORABLE_DAY_HOURS),
    }


def grid_key(latitude: Column, longitude: Column) -> Column:
    return F.format_string("%.4f|%.4f", latitude, longitude)
