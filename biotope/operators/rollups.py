"""Aggregations: hour -> cell-day -> site-day -> site-week -> month -> year, zonal and ensemble summaries.

All are hash aggregates with map-side partials, so a hot key reaches the shuffle
as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotope.functions.calendar import week_start
from biotope.functions.weather import day_flags, hour_flags
from biotope.operators.joins import overlay_join

# Hourly input variables and the site-day measures made from them.
HOURLY_VARIABLES = (
    "air_temperature_c",
    "relative_humidity_pct",
    "precipitation_mm",
    "soil_temperature_1_c",
    "soil_temperature_2_c",
    "soil_water_1",
    "soil_water_2",
)
DAILY_MEASURES = (
    "temperature_mean",
    "humidity_mean",
    "rain_sum",
    "soil_temperature_1_mean",
    "soil_temperature_2_mean",
    "soil_water_1_mean",
    "soil_water_2_mean",
    "humid_hours_80",
    "humid_hours_90",
    "wet_hours",
    "activity_hours",
    "degree_hours_sum",
    "observation_hours",
)

# Fixed value: share of a site's area from which it counts as fully covered.
FULL_COVERAGE = 0.999

# Land-cover class codes of the overlapping groups.
CLASS_GROUPS = {
    "urban": (111, 112, 121, 122, 123, 124, 131, 132, 133, 141, 142),
    "agricultural": (211, 212, 213, 221, 222, 223, 231, 241, 242, 243, 244),
    "grassland_pasture": (231, 321),
    "forest": (311, 312, 313),
    "broad_leaved_forest": (311,),
    "coniferous_forest": (312,),
    "mixed_forest": (313,),
    "shrub_transitional": (322, 323, 324),
    "open_bare": (331, 332, 333, 334, 335),
    "wetland": (411, 412, 421, 422, 423),
    "water": (511, 512, 521, 522, 523),
}


def hourly_aggregates() -> list[Column]:
    t, rh, rain = F.col("air_temperature_c"), F.col("relative_humidity_pct"), F.col("precipitation_mm")
    flags = hour_flags(t, rh, rain)
    return [
        F.avg(t).alias("temperature_mean"),
        F.avg(rh).alias("humidity_mean"),
        F.sum(rain).alias("rain_sum"),
        F.avg("soil_temperature_1_c").alias("soil_temperature_1_mean"),
        F.avg("soil_temperature_2_c").alias("soil_temperature_2_mean"),
        F.avg("soil_water_1").alias("soil_water_1_mean"),
        F.avg("soil_water_2").alias("soil_water_2_mean"),
        F.sum(flags["humid_hour_80"]).alias("humid_hours_80"),
        F.sum(flags["humid_hour_90"]).alias("humid_hours_90"),
        F.sum(flags["wet_hour"]).alias("wet_hours"),
        F.sum(flags["activity_hour"]).alias("activity_hours"),
        F.sum(flags["degree_hours"]).alias("degree_hours_sum"),
        F.count(t).alias("observation_hours"),
    ]


def hourly_to_cell_day(hourly: DataFrame, keys: Sequence[str] = ("grid_key",), time: str = "time") -> DataFrame:
    return hourly.groupBy(F.to_date(time).alias("day"), *keys).agg(*hourly_aggregates())


def area_weighted_site_day(cell_days: DataFrame, overlay: DataFrame, key: str = "grid_key") -> DataFrame:
    """Weighted sums over the cells of each site, for means and sums alike."""
    joined = overlay_join(cell_days, overlay.select(key, "site", "cell_weight"), key)
    return joined.groupBy("day", "site").agg(
        *[F.sum(F.col(m) * F.col("cell_weight")).alias(m) for m in DAILY_MEASURES]
    )


def site_day_to_week(
    daily: DataFrame, keys: Sequence[str] = ("site",), first_day: str = "MON", keep_partial: bool = False
) -> DataFrame:
    """Site-week measures; weeks without seven days are dropped unless asked for.

    ``daily`` has one row per key and day, so counting rows counts days.
    """
    rain, humid, active = F.col("rain_sum"), F.col("humid_hours_80"), F.col("activity_hours")
    flags = day_flags(rain, humid, active)
    weekly = daily.groupBy(week_start(F.col("day"), first_day).alias("week_start"), *keys).agg(
        F.count("day").alias("observation_days"),
        F.avg("temperature_mean").alias("temperature_mean"),
        F.min("temperature_mean").alias("temperature_min"),
        F.max("temperature_mean").alias("temperature_max"),
        F.coalesce(F.stddev_samp("temperature_mean"), F.lit(0.0)).alias("temperature_std"),
        (F.max("temperature_mean") - F.min("temperature_mean")).alias("temperature_range"),
        F.avg("humidity_mean").alias("humidity_mean"),
        F.min("humidity_mean").alias("humidity_min"),
        F.max("humidity_mean").alias("humidity_max"),
        F.sum(rain).alias("rain_sum"),
        F.max(rain).alias("rain_daily_max"),
        F.avg("soil_temperature_1_mean").alias("soil_temperature_1_mean"),
        F.avg("soil_temperature_2_mean").alias("soil_temperature_2_mean"),
        F.avg("soil_water_1_mean").alias("soil_water_1_mean"),
        F.avg("soil_water_2_mean").alias("soil_water_2_mean"),
        F.sum(humid).alias("humid_hours_80"),
        F.sum("humid_hours_90").alias("humid_hours_90"),
        F.sum("wet_hours").alias("wet_hours"),
        F.sum(active).alias("activity_hours"),
        F.sum("degree_hours_sum").alias("degree_hours_sum"),
        F.sum(flags["rainy_day"]).alias("rainy_days"),
        F.sum(flags["humid_day"]).alias("humid_days"),
        F.sum(flags["favorable_day"]).alias("favorable_days"),
    )
    return weekly if keep_partial else complete_weeks(weekly)


def complete_weeks(weekly: DataFrame) -> DataFrame:
    return weekly.where("observation_days = 7")


def overlay_summary(overlay: DataFrame) -> DataFrame:
    """Cells, area and coverage of each site; the area columns repeat on all its rows."""
    return overlay.groupBy("site").agg(
        F.count_distinct("grid_key").alias("grid_cell_count"),
        F.max("site_area").alias("site_area"),
        F.max("covered_area").alias("covered_area"),
        (F.max("coverage") * 100.0).alias("covered_area_pct"),
        F.when(F.max("coverage") >= FULL_COVERAGE, "area_weighted_polygon_overlay")
        .otherwise("area_weighted_polygon_overlay_partial_coverage")
        .alias("overlay_method"),
    )


def week_to_month(
    weekly: DataFrame,
    month: Column,
    means: Sequence[str],
    sums: Sequence[str],
    maxima: Sequence[str],
    firsts: Sequence[str],
    period: str = "week_start",
    keys: Sequence[str] = ("site",),
) -> DataFrame:
    """Site-month panel; ``first`` is the value of the earliest week."""
    return (
        weekly.groupBy(*keys, month.alias("month_start"))
        .agg(
            *[F.avg(c).alias(c) for c in means],
            *[F.sum(c).alias(c) for c in sums],
            *[F.max(c).alias(c) for c in maxima],
            *[F.min_by(c, period).alias(c) for c in firsts],
        )
        .withColumn("month_end", F.last_day("month_start"))
    )


def weighted_mean(value: str, weight: str) -> Column:
    valid = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.try_divide(
        F.sum(F.when(valid, F.col(value) * F.col(weight))), F.sum(F.when(valid, F.col(weight)))
    )


def national_month(
    monthly: DataFrame, weighted: Sequence[str], sums: Sequence[str], weight: str, site: str = "site"
) -> DataFrame:
    return monthly.groupBy("month_start").agg(
        *[weighted_mean(c, weight).alias(c) for c in weighted],
        *[F.sum(c).alias(c) for c in sums],
        F.count_distinct(site).alias("sites"),
    )


def month_to_year(national: DataFrame, means: Sequence[str], sums: Sequence[str], maxima: Sequence[str]) -> DataFrame:
    return national.groupBy(F.year("month_start").alias("year")).agg(
        *[F.avg(c).alias(c) for c in means],
        *[F.sum(c).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in maxima],
    )


def yearly_by_rule(long: DataFrame, keys: Sequence[str], value: str, rule: str) -> DataFrame:
    """Sum or mean per key, whichever the rows' rule column names."""
    return long.groupBy(*keys, rule).agg(
        F.when(F.col(rule) == "sum", F.sum(value)).otherwise(F.avg(value)).alias(value),
        F.count(value).alias("months"),
    )


def station_mean(
    readings: DataFrame, keys: Sequence[str], value: str, weight: str, labels: Mapping[str, str]
) -> DataFrame:
    """Weighted mean over stations, the plain mean when no weight is positive.

    A missing weight counts as 1. Label columns become sorted distinct strings
    joined by "; " (a label is a station or unit name, so the sets are small).
    """
    w = F.coalesce(F.col(weight), F.lit(1.0))
    known = F.col(value).isNotNull()
    # plain sums per label first, so that the set aggregate below reads few rows
    parts = readings.groupBy(*keys, *set(labels.values())).agg(
        F.sum(F.when(known, F.col(value) * w)).alias("weighted_sum"),
        F.sum(F.when(known, w)).alias("weight_sum"),
        F.sum(value).alias("value_sum"),
        F.count(value).alias("component_count"),
        F.count(weight).alias("weight_count"),
    )
    total, components = F.sum("weight_sum"), F.sum("component_count")
    mean = F.when(total > 0, F.try_divide(F.sum("weighted_sum"), total)).otherwise(
        F.try_divide(F.sum("value_sum"), components)
    )
    return parts.groupBy(*keys).agg(
        F.round(mean, 6).alias("weighted_value"),
        components.alias("component_count"),
        F.sum("weight_count").alias("weight_count"),
        *[joined_set(column).alias(name) for name, column in labels.items()],
    )


def mode_value(df: DataFrame, key: str, value: str, order: str, name: str = "mode") -> DataFrame:
    """Most common value per key; ties go to the one seen first by ``order``."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("seen"))
    best = F.max_by(F.col(value), F.struct(F.col("times"), -F.col("seen"))).alias(name)
    return counted.groupBy(key).agg(best, F.max("times").alias("times"))


def zonal_statistics(
    pixels: DataFrame, site: str, value: str, tile: str, pixel_area: float, areas: DataFrame | None = None
) -> DataFrame:
    stats = pixels.groupBy(site).agg(
        F.count(value).alias("pixel_count"),
        (F.count(value) * F.lit(pixel_area)).alias("covered_area"),
        F.avg(value).alias("mean_value"),
        F.stddev_pop(value).alias("std_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        (F.max(value) - F.min(value)).alias("range_value"),
        F.count_distinct(tile).alias("tiles"),
    )
    if areas is None:
        return stats
    return stats.join(areas, site).withColumn("coverage_pct", F.col("covered_area") / F.col("area") * 100.0)


def class_shares(pixels: DataFrame, site: str, code: str, groups: Mapping[str, Sequence[int]] = CLASS_GROUPS) -> DataFrame:
    """Percent of each class group, and the dominant class (ties: smallest code).

    Pixels are first counted per site and class, so the second aggregate reads at
    most one row per class.
    """
    counts = pixels.where(F.col(code) != 0).groupBy(site, code).agg(F.count(F.lit(1)).alias("class_n"))
    total = F.sum("class_n")
    shares = [
        (F.sum(F.when(F.col(code).isin(*codes), F.col("class_n")).otherwise(0)) / total * 100.0).alias(f"{name}_pct")
        for name, codes in groups.items()
    ]
    return counts.groupBy(site).agg(
        total.alias("pixel_count"),
        *shares,
        F.max_by(F.col(code), F.struct(F.col("class_n"), -F.col(code))).alias("dominant_code"),
        (F.max("class_n") / total * 100.0).alias("dominant_pct"),
    )


def tile_coverage(pixels: DataFrame, site: str, tile: str, row: str, col: str, pixel_area: float) -> DataFrame:
    """Window of rows and columns of each tile that a site touches."""
    return pixels.groupBy(site, tile).agg(
        F.min(row).alias("row_min"),
        F.max(row).alias("row_max"),
        F.min(col).alias("col_min"),
        F.max(col).alias("col_max"),
        (F.max(row) - F.min(row) + 1).alias("window_rows"),
        (F.max(col) - F.min(col) + 1).alias("window_cols"),
        F.count(F.lit(1)).alias("pixel_count"),
        (F.count(F.lit(1)) * F.lit(pixel_area)).alias("sampled_area"),
    )


def spatial_mean(grid: DataFrame, keys: Sequence[str], value: str, cell: str) -> DataFrame:
    """Mean over grid cells per key (member and step among them)."""
    return grid.groupBy(*keys).agg(F.avg(value).alias(value), F.count_distinct(cell).alias("cells"))


def ensemble_summary(
    members: DataFrame, keys: Sequence[str], value: str, factor: Column | None = None
) -> DataFrame:
    """Mean, p10, p50, p90 and population std over members.

    One row per member, so a group is as large as the ensemble; the built-in exact
    percentile is safe here. A unit factor is applied after the quantiles.
    """
    cuts = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    summary = members.groupBy(*keys).agg(
        F.count(value).alias("members"),
        F.avg(value).alias("mean_value"),
        cuts.alias("cuts"),
        F.stddev_pop(value).alias("std_value"),
    )
    unit = F.lit(1.0) if factor is None else factor
    return summary.select(
        *keys,
        "members",
        (F.col("mean_value") * unit).alias("mean_value"),
        (F.col("cuts")[0] * unit).alias("p10"),
        (F.col("cuts")[1] * unit).alias("p50"),
        (F.col("cuts")[2] * unit).alias("p90"),
        (F.col("std_value") * unit).alias("std_value"),
    )


def joined_set(column: str, separator: str = "; ") -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def first_present(column: str, order: Column) -> Column:
    """First non-null value by ``order`` (NULL order keys skip the row)."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def availability(df: DataFrame, groups: Sequence[str], keys: Sequence[str], in_window: Column, init: str) -> DataFrame:
    key = F.struct(*keys)
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(key).alias("distinct_keys"),
        F.count_distinct(F.when(in_window, key)).alias("distinct_keys_in_window"),
        F.min(init).alias("first_init"),
        F.max(init).alias("last_init"),
    )


def source_coverage(panel: DataFrame, flags: Sequence[str], site: str, period: str, extra: Sequence[str] = ()) -> DataFrame:
    """Rows, sites and periods each source has data for, from 0/1 flags."""
    long = panel.select(site, period, *extra, *flags).unpivot(
        [site, period, *extra], list(flags), "source", "has_data"
    )
    on = F.col("has_data") == 1
    return long.groupBy("source", *extra).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("has_data").alias("rows_with_data"),
        F.round(F.avg("has_data") * 100.0, 4).alias("rows_pct"),
        F.count_distinct(F.when(on, F.col(site))).alias("sites"),
        F.count_distinct(F.when(on, F.col(period))).alias("periods"),
        F.min(F.when(on, F.col(period))).alias("first_period"),
        F.max(F.when(on, F.col(period))).alias("last_period"),
    )


def any_present_pct(columns: Sequence[str]) -> Column:
    """Percent of rows with a value in any of the columns, 0 without rows."""
    some = F.coalesce(*[F.when(F.col(c).isNotNull(), 1) for c in columns], F.lit(0))
    return F.coalesce(F.round(F.avg(some) * 100.0, 4), F.lit(0.0))


def fold_summary(results: DataFrame, keys: Sequence[str], metrics: Sequence[str], fold: str) -> DataFrame:
    """Mean and sample std of each metric over folds, and the folds completed."""
    return results.groupBy(*keys).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
        F.count(metrics[0]).alias("completed_folds"),
        F.max(fold).alias(f"max_{fold}"),
    )


def effect_summary(effects: DataFrame, keys: Sequence[str], effect: str = "effect") -> DataFrame:
    """Effects over folds with the share of completed folds in which they help."""
    helpful, done = F.count_if(F.col(effect) > 0), F.count(effect)
    share = F.round(F.try_divide(helpful.cast("double"), done) * 100.0, 4)
    return effects.groupBy(*keys).agg(
        F.avg(effect).alias("mean_effect"),
        F.stddev_samp(effect).alias("std_effect"),
        F.min(effect).alias("min_effect"),
        F.max(effect).alias("max_effect"),
        helpful.alias("helpful_folds"),
        F.coalesce(share, F.lit(0.0)).alias("helpful_folds_pct"),
    )


def value_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, min, max and sum of the non-null values, rounded to 6 decimals."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("value_count"),
        F.round(F.avg(value), 6).alias("mean_value"),
        F.round(F.min(value), 6).alias("min_value"),
        F.round(F.max(value), 6).alias("max_value"),
        F.round(F.sum(value), 6).alias("sum_value"),
    )


def climatology(df: DataFrame, month: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(month).agg(*[F.avg(c).alias(c) for c in columns])


def extents(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.min(column).alias("minimum"),
        F.max(column).alias("maximum"),
        F.avg(column).alias("mean_value"),
        F.count(column).alias("present"),
    )


def year_coverage(df: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count(F.lit(1)).alias("years")
    )


def zscores(history: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise ``rows`` by the mean and sample std of ``history`` (std below 1e-12 counts as 1)."""
    stats = history.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[
            F.when(F.abs(F.stddev_samp(c)) < 1e-12, 1.0).otherwise(F.stddev_samp(c)).alias(f"{c}_std")
            for c in columns
        ],
    )
    one = stats.select(F.struct("*")).scalar()
    placed = rows.withColumn("stats", one)
    return placed.select(
        *rows.columns,
        *[
            ((F.col(c) - F.col(f"stats.{c}_mean")) / F.col(f"stats.{c}_std")).alias(f"{c}_z")
            for c in columns
        ],
    )


def baseline_anomaly(
    df: DataFrame, scenario: str, year: str, values: Sequence[str], first: int, last: int
) -> DataFrame:
    """Value minus the scenario's mean over the baseline years; scenarios without one are dropped."""
    base = (
        df.where(F.col(year).between(first, last))
        .groupBy(scenario)
        .agg(*[F.avg(v).alias(f"{v}_baseline") for v in values])
    )
    joined = df.join(base, scenario)
    return joined.select(
        *df.columns, *[(F.col(v) - F.col(f"{v}_baseline")).alias(f"{v}_anomaly") for v in values]
    )


def reconcile_totals(long: DataFrame, row: str, period: str, value: str, sheet: Sequence[str] = ()) -> DataFrame:
    """Totals per row, per period and overall in one pass, for each sheet where sheet columns are named."""
    sheet = list(sheet)
    return long.groupingSets([[*sheet, row], [*sheet, period], sheet], *sheet, row, period).agg(
        F.sum(value).alias("computed_total"),
        F.count(F.lit(1)).alias("cells"),
        (F.grouping(row) * 2 + F.grouping(period)).cast("int").alias("grain"),
    )


def dimension_counts(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Rows per value of each single dimension, stacked.

    Rows are first counted per combination, so the grouping sets expand combinations.
    """
    sets = [[d] for d in dimensions]
    combined = df.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("rows"))
    counted = combined.groupingSets(sets, *dimensions).agg(
        F.sum("rows").alias("rows"), F.grouping_id(*dimensions).alias("which")
    )
    width = len(dimensions)
    codes = {d: (2**width - 1) ^ (1 << (width - 1 - i)) for i, d in enumerate(dimensions)}
    name = F.coalesce(*[F.when(F.col("which") == code, F.lit(d)) for d, code in codes.items()])
    value = F.coalesce(*[F.when(F.col("which") == code, F.col(d).cast("string")) for d, code in codes.items()])
    return counted.select(name.alias("dimension"), value.alias("dimension_value"), "rows")


def joined_list(column: str, separator: str = " | ") -> Column:
    return F.array_join(F.array_sort(F.collect_list(column)), separator)
