"""Hourly feed -> cell-days -> cell-weeks, and key de-duplication, as streaming jobs.

Rows later than the watermark are dropped here; ``streaming.late`` counts and keeps them. State is bounded
by the watermark: open hours, days or weeks per cell, or keys seen within it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.functions.weather import day_flags
from biotope.operators.rollups import hourly_aggregates

LATENESS = "6 hours"
WEEK_OFFSET = "4 days"  # 1970-01-01 was a Thursday; weeks start on Monday


def hourly_to_day(hourly: DataFrame, keys: Sequence[str], time: str = "time", lateness: str = LATENESS) -> DataFrame:
    """The batch cell-day measures per tumbling day."""
    days = hourly.withWatermark(time, lateness).groupBy(F.window(time, "1 day"), *keys)
    return days.agg(*hourly_aggregates()).withColumn("day", F.to_date("window.start")).drop("window")


def hourly_to_day_from_hours(hours: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """As ``hourly_to_day`` on hours that are themselves windows of the stream (their watermark applies)."""
    days = hours.groupBy(F.window(time, "1 day"), *keys)
    return days.agg(*hourly_aggregates()).withColumn("day", F.to_date("window.start")).drop("window")


def _week_aggregates() -> list:
    flags = day_flags(F.col("rain_sum"), F.col("humid_hours_80"), F.col("activity_hours"))
    return [
        F.count(F.lit(1)).alias("observation_days"),
        F.avg("temperature_mean").alias("temperature_mean"),
        F.min("temperature_mean").alias("temperature_min"),
        F.max("temperature_mean").alias("temperature_max"),
        F.avg("humidity_mean").alias("humidity_mean"),
        F.sum("rain_sum").alias("rain_sum"),
        F.max("rain_sum").alias("rain_daily_max"),
        F.sum("humid_hours_80").alias("humid_hours_80"),
        F.sum("activity_hours").alias("activity_hours"),
        F.sum(flags["rainy_day"]).alias("rainy_days"),
    ]


def week_measures(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Complete weeks of a table of cell-days, one row per key and day."""
    weeks = daily.groupBy(F.date_trunc("week", "day").cast("date").alias("week_start"), *keys)
    return weeks.agg(*_week_aggregates()).where("observation_days = 7")


def day_to_week(daily: DataFrame, keys: Sequence[str], time: str = "day_start", lateness: str = LATENESS) -> DataFrame:
    """Week sums and means of cell-days; only weeks with all seven days are emitted.

    The daily table holds one row per key and day, so counting rows counts days.
    """
    weeks = daily.withWatermark(time, lateness).groupBy(
        F.window(time, "7 days", "7 days", WEEK_OFFSET), *keys
    )
    whole = weeks.agg(*_week_aggregates()).where("observation_days = 7")
    return whole.withColumn("week_start", F.to_date("window.start")).drop("window")


def dedupe(events: DataFrame, key: str, time: str, lateness: str = LATENESS) -> DataFrame:
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def data_folder(path: str) -> str:
    return f"{path}/data"


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Process everything available into a Parquet sink below ``path`` and read it.

    The checkpoint sits beside the sink: the same path continues where an earlier
    run, or a lost driver, stopped, and writes each row once.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", data_folder(path))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(data_folder(path))
