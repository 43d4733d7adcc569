"""Gridded hourly variables in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from biotope.operators.ordering import neighbours

from biotope.functions.weather import grid_key
from biotope.operators.rollups import HOURLY_VARIABLES
from biotope.sources.tables import nan_as_null, require_columns


def time_window(df: DataFrame, time: str, first_day: str, last_day: str) -> DataFrame:
    """Rows from the first day up to and including the last day (pushed into the scan)."""
    end = F.date_add(F.lit(last_day).cast("date"), 1)
    return df.where((F.col(time) >= F.lit(first_day).cast("date")) & (F.col(time) < end))


def hourly_grid(df: DataFrame, variables: Sequence[str] = HOURLY_VARIABLES) -> DataFrame:
    """One row per (time, latitude, longitude) with all variables and the cell key."""
    require_columns(df, ["time", "latitude", "longitude", *variables], "hourly grid")
    return nan_as_null(df.select("time", "latitude", "longitude", *variables)).withColumn(
        "grid_key", grid_key(F.col("latitude"), F.col("longitude"))
    )


def read_hourly_grid(
    spark: SparkSession, path: str, first_day: str, last_day: str, variables: Sequence[str] = HOURLY_VARIABLES
) -> DataFrame:
    """Monthly files below ``path``; the window is filtered before anything else."""
    return hourly_grid(time_window(spark.read.parquet(path), "time", first_day, last_day), variables)


def prefer_final(df: DataFrame, keys: Sequence[str], value: str, version: str) -> DataFrame:
    """One value per key: the first non-null by version (final before preliminary).

    A version given twice counts with its smaller value.
    """
    each = df.groupBy(*keys, version).agg(F.min(value).alias(value))
    order = F.when(F.col(value).isNotNull(), F.col(version))
    return each.groupBy(*keys).agg(F.min_by(F.col(value), order).alias(value), F.min(order).alias("used_version"))


def axis_edges(axis: DataFrame, value: str) -> DataFrame:
    """Cell edges of a coordinate axis: midpoints inside, mirrored half steps at the ends."""
    here, before, after = F.col(value), F.col("before"), F.col("after")
    return neighbours(axis, value).select(
        here,
        (here - F.coalesce(here - before, after - here) / 2).alias("edge_low"),
        (here + F.coalesce(after - here, here - before) / 2).alias("edge_high"),
    )
