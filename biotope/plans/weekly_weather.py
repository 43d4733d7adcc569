"""Hourly grid -> area-weighted site-week table with lags and calendar columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.functions.calendar import calendar_features, week_end
from biotope.operators.joins import static_join
from biotope.operators.rollups import (
    area_weighted_site_day,
    hourly_to_cell_day,
    overlay_summary,
    site_day_to_week,
)
from biotope.operators.windows import lags, over_panel, prev_mean, with_columns

LAGGED = ("temperature_mean", "humidity_mean", "rain_sum")
LAG_STEPS = (1, 2, 4)
ROLLING_WEEKS = 4


def with_history(
    weekly: DataFrame, columns: Sequence[str] = LAGGED, site: str = "site", period: str = "week_start"
) -> DataFrame:
    """Lags and rolling means of the weeks before, then calendar columns; one exchange."""
    w = over_panel(site, period)
    extra = {}
    for c in columns:
        extra |= lags(c, LAG_STEPS, w)
        extra[f"{c}_prev_{ROLLING_WEEKS}_mean"] = prev_mean(c, ROLLING_WEEKS, w)
    extra["week_end"] = week_end(F.col(period))
    return with_columns(with_columns(weekly, extra), calendar_features(F.col(period)))


def weekly_weather(
    hourly: DataFrame, overlay: DataFrame, first_day: str = "MON", keep_partial: bool = False
) -> DataFrame:
    daily = area_weighted_site_day(hourly_to_cell_day(hourly), overlay)
    weekly = site_day_to_week(daily, first_day=first_day, keep_partial=keep_partial)
    return with_history(static_join(weekly, overlay_summary(overlay), "site"))


def point_weekly(hourly: DataFrame, site: str, keep_partial: bool = False) -> DataFrame:
    """The same features from point weather per site (weight 1), as used when serving."""
    daily = hourly_to_cell_day(hourly, [site])
    return with_history(site_day_to_week(daily, [site], keep_partial=keep_partial), site=site)
