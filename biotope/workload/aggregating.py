"""Aggregations on the test tables."""

from pyspark.sql import functions as F

from biotope.functions import calendar as cal
from biotope.operators import metrics, rollups, spatial
from biotope.workload.joining import EFFECT_SQL, effects
from biotope.workload.registry import bind
from biotope.workload.scalars import PANEL_YEAR_SQL, panel_with_sources

CELL_DAY_SQL = """SELECT grid_key, CAST(time AS DATE) AS day, avg(air_temperature_c) AS temperature_mean,
      avg(relative_humidity_pct) AS humidity_mean, sum(precipitation_mm) AS rain_sum,
      avg(soil_temperature_1_c) AS soil_temperature_1_mean, avg(soil_temperature_2_c) AS soil_temperature_2_mean,
      avg(soil_water_1) AS soil_water_1_mean, avg(soil_water_2) AS soil_water_2_mean,
      count(*) FILTER (WHERE relative_humidity_pct >= 80) AS humid_hours_80,
      count(*) FILTER (WHERE relative_humidity_pct >= 90) AS humid_hours_90,
      count(*) FILTER (WHERE precipitation_mm >= 0.1::DOUBLE) AS wet_hours,
      count(*) FILTER (WHERE air_temperature_c BETWEEN 7 AND 25 AND relative_humidity_pct >= 80) AS activity_hours,
      sum(greatest(air_temperature_c - 5, 0)) AS degree_hours_sum, count(air_temperature_c) AS observation_hours
    FROM hourly GROUP BY 1, 2"""
FLOAT_DAILY = (
    "temperature_mean humidity_mean rain_sum soil_temperature_1_mean soil_temperature_2_mean soil_water_1_mean "
    "soil_water_2_mean degree_hours_sum"
)
SITE_DAY_SQL = (
    "SELECT site, day, "
    + ", ".join(f"sum({m} * cell_weight) AS {m}" for m in rollups.DAILY_MEASURES)
    + f" FROM ({CELL_DAY_SQL}) AS c JOIN overlay USING (grid_key) GROUP BY 1, 2"
)
WEEK_MEASURES_SQL = """CAST(date_trunc('week', day) AS DATE) AS week_start, count(DISTINCT day) AS observation_days,
      avg(temperature_mean) AS temperature_mean, min(temperature_mean) AS temperature_min,
      max(temperature_mean) AS temperature_max, coalesce(stddev_samp(temperature_mean), 0) AS temperature_std,
      max(temperature_mean) - min(temperature_mean) AS temperature_range, avg(humidity_mean) AS humidity_mean,
      min(humidity_mean) AS humidity_min, max(humidity_mean) AS humidity_max, sum(rain_sum) AS rain_sum,
      max(rain_sum) AS rain_daily_max, avg(soil_temperature_1_mean) AS soil_temperature_1_mean,
      avg(soil_temperature_2_mean) AS soil_temperature_2_mean, avg(soil_water_1_mean) AS soil_water_1_mean,
      avg(soil_water_2_mean) AS soil_water_2_mean, sum(humid_hours_80) AS humid_hours_80,
      sum(humid_hours_90) AS humid_hours_90, sum(wet_hours) AS wet_hours, sum(activity_hours) AS activity_hours,
      sum(degree_hours_sum) AS degree_hours_sum, count(*) FILTER (WHERE rain_sum >= 1) AS rainy_days,
      count(*) FILTER (WHERE humid_hours_80 >= 16) AS humid_days,
      count(*) FILTER (WHERE activity_hours >= 6) AS favorable_days"""
FLOAT_WEEKLY = (
    "temperature_mean temperature_min temperature_max temperature_std temperature_range humidity_mean humidity_min "
    "humidity_max rain_sum rain_daily_max soil_temperature_1_mean soil_temperature_2_mean soil_water_1_mean "
    "soil_water_2_mean humid_hours_80 humid_hours_90 wet_hours activity_hours degree_hours_sum"
)
SITE_WEEK_SQL = f"SELECT site, {WEEK_MEASURES_SQL} FROM ({SITE_DAY_SQL}) AS d GROUP BY 1, 2"


@bind("hourly_to_cell_day", CELL_DAY_SQL, needs="hourly", rounded=FLOAT_DAILY)
def hourly_to_cell_day(t):
    return rollups.hourly_to_cell_day(t.hourly)


@bind("area_weighted_site_day", SITE_DAY_SQL, needs="hourly overlay", rounded=rollups.DAILY_MEASURES)
def area_weighted_site_day(t):
    return rollups.area_weighted_site_day(rollups.hourly_to_cell_day(t.hourly), t.overlay)


@bind("site_day_to_week", SITE_WEEK_SQL, needs="hourly overlay", rounded=FLOAT_WEEKLY)
def site_day_to_week(t):
    return rollups.site_day_to_week(area_weighted_site_day(t), keep_partial=True)


@bind(
    "complete_weeks_only",
    f"SELECT * FROM ({SITE_WEEK_SQL}) AS w WHERE observation_days = 7",
    needs="hourly overlay",
    rounded=FLOAT_WEEKLY,
)
def complete_weeks_only(t):
    return rollups.site_day_to_week(area_weighted_site_day(t))


@bind(
    "overlay_summary",
    """SELECT site, count(DISTINCT grid_key) AS grid_cell_count, max(site_area) AS site_area,
      max(covered_area) AS covered_area, max(coverage) * 100 AS covered_area_pct,
      CASE WHEN max(coverage) >= 0.999 THEN 'area_weighted_polygon_overlay'
        ELSE 'area_weighted_polygon_overlay_partial_coverage' END AS overlay_method
    FROM overlay GROUP BY 1""",
    needs="overlay",
    rounded="covered_area_pct",
)
def overlay_summary(t):
    return rollups.overlay_summary(t.overlay)


MONTH_SQL = """SELECT site, CAST(date_trunc('month', week_start + 3) AS DATE) AS month_start,
      last_day(CAST(date_trunc('month', week_start + 3) AS DATE)) AS month_end, avg(temp_mean) AS temp_mean,
      avg(humid_mean) AS humid_mean, sum(rain_sum) AS rain_sum, CAST(sum(cases_a) AS BIGINT) AS cases_a,
      CAST(sum(cases_b) AS BIGINT) AS cases_b, max(temp_max) AS temp_max,
      arg_min(line_count, week_start) AS line_count
    FROM site_week GROUP BY 1, 2, 3"""


def site_months(t):
    return rollups.week_to_month(
        t.site_week,
        cal.midpoint_month(F.col("week_start")),
        means=["temp_mean", "humid_mean"],
        sums=["rain_sum", "cases_a", "cases_b"],
        maxima=["temp_max"],
        firsts=["line_count"],
    )


@bind("week_to_month_panel", MONTH_SQL, needs="site_week", rounded="temp_mean humid_mean rain_sum")
def week_to_month_panel(t):
    return site_months(t)


NATIONAL_SQL = f"""SELECT month_start, sum(temp_mean * line_count) FILTER (WHERE line_count > 0)
        / sum(line_count) FILTER (WHERE line_count > 0) AS temp_mean,
      sum(humid_mean * line_count) FILTER (WHERE line_count > 0)
        / sum(line_count) FILTER (WHERE line_count > 0) AS humid_mean,
      CAST(sum(cases_a) AS BIGINT) AS cases_a, CAST(sum(line_count) AS BIGINT) AS line_count, sum(rain_sum) AS rain_sum,
      count(DISTINCT site) AS sites, sum(cases_a)::DOUBLE / sum(line_count) * 100000 AS cases_a_per_100k
    FROM ({MONTH_SQL}) AS m GROUP BY 1"""


def national_months(t):
    months = rollups.national_month(
        site_months(t), ["temp_mean", "humid_mean"], ["cases_a", "line_count", "rain_sum"], "line_count"
    )
    return months.withColumn("cases_a_per_100k", F.col("cases_a").cast("double") / F.col("line_count") * 100000)


@bind(
    "weighted_national_month",
    NATIONAL_SQL,
    needs="site_week",
    rounded="temp_mean humid_mean rain_sum cases_a_per_100k",
)
def weighted_national_month(t):
    return national_months(t)


@bind(
    "month_to_year_panel",
    f"""SELECT CAST(year(month_start) AS INTEGER) AS year, avg(temp_mean) AS temp_mean, avg(line_count) AS line_count,
      CAST(sum(cases_a) AS BIGINT) AS cases_a, sum(rain_sum) AS rain_sum, max(sites) AS sites
    FROM ({NATIONAL_SQL}) AS n GROUP BY 1""",
    needs="site_week",
    rounded="temp_mean line_count rain_sum",
)
def month_to_year_panel(t):
    return rollups.month_to_year(national_months(t), ["temp_mean", "line_count"], ["cases_a", "rain_sum"], ["sites"])


@bind(
    "yearly_by_rule",
    """SELECT variable, year, rule, CASE WHEN rule = 'sum' THEN sum(value) ELSE avg(value) END AS value,
      count(value) AS months
    FROM (SELECT year, unnest(['temp', 'rain', 'rate_a']) AS variable, unnest(['mean', 'sum', 'mean']) AS rule,
        unnest([temp, rain, rate_a]) AS value FROM month_cases) AS l GROUP BY 1, 2, 3""",
    needs="month_cases",
    rounded="value",
)
def yearly_by_rule(t):
    long = t.month_cases.select("year", "temp", "rain", "rate_a").unpivot(
        ["year"], ["temp", "rain", "rate_a"], "variable", "value"
    )
    ruled = long.withColumn("rule", F.when(F.col("variable") == "rain", "sum").otherwise("mean"))
    return rollups.yearly_by_rule(ruled, ["variable", "year"], "value", "rule")


@bind(
    "station_weighted_mean",
    """SELECT site, month_start, CASE WHEN sum(w) FILTER (WHERE v IS NOT NULL) > 0
        THEN sum(v * w) FILTER (WHERE v IS NOT NULL) / sum(w) FILTER (WHERE v IS NOT NULL) ELSE avg(v) END AS weighted_value,
      count(v) AS component_count, count(raw_w) AS weight_count,
      array_to_string(list_sort(list_distinct(list(priority))), '; ') AS stations
    FROM (SELECT site, CAST(date_trunc('month', order_day) AS DATE) AS month_start, o_orderpriority AS priority,
        CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice) END AS v,
        CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE day(order_day)::DOUBLE END AS raw_w,
        coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE day(order_day)::DOUBLE END, 1) AS w
      FROM order_sites) AS r GROUP BY 1, 2""",
    needs="order_sites",
    rounded="weighted_value",
)
def station_weighted_mean(t):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    readings = t.order_sites.select(
        "site",
        F.trunc("order_day", "month").alias("month_start"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice")).alias("value"),
        F.when(~urgent, F.dayofmonth("order_day").cast("double")).alias("weight"),
    )
    return rollups.station_mean(readings, ["site", "month_start"], "value", "weight", {"stations": "priority"})


@bind(
    "mode_value",
    """SELECT o_orderpriority AS code, site AS mode, times FROM (SELECT *, row_number() OVER (
        PARTITION BY o_orderpriority ORDER BY times DESC, seen) AS rn
      FROM (SELECT o_orderpriority, site, count(*) AS times, min(o_orderkey) AS seen FROM order_sites GROUP BY 1, 2) AS c)
    AS r WHERE rn = 1""",
    needs="order_sites",
)
def mode_value(t):
    return rollups.mode_value(t.order_sites, "o_orderpriority", "site", "o_orderkey").withColumnRenamed(
        "o_orderpriority", "code"
    )


def located_pixels(t):
    shapes = spatial.with_edges(t.polygons, "site", "rings")
    return spatial.locate(t.pixels, shapes, "site", "x", "y").where("site is not null")


def site_areas(t):
    return t.polygons.groupBy("site").agg(F.sum(spatial.polygon_area(F.col("rings"))).alias("area"))


@bind(
    "zonal_statistics",
    """WITH a AS (SELECT site, sum(CASE WHEN ring_no = 0 THEN area ELSE -area END) AS area
      FROM (SELECT site, part, ring_no, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edges GROUP BY 1, 2, 3) AS r GROUP BY 1)
    SELECT l.site, count(value) AS pixel_count, count(value) * 0.0001::DOUBLE AS covered_area, avg(value) AS mean_value,
      stddev_pop(value) AS std_value, min(value) AS min_value, max(value) AS max_value,
      max(value) - min(value) AS range_value, count(DISTINCT tile) AS tiles, a.area,
      count(value) * 0.0001::DOUBLE / a.area * 100 AS coverage_pct
    FROM located l JOIN a ON l.site = a.site GROUP BY l.site, a.area""",
    needs="located",
    rounded="covered_area mean_value std_value area coverage_pct",
)
def zonal_statistics(t):
    return rollups.zonal_statistics(located_pixels(t), "site", "value", "tile", 0.0001, site_areas(t))


@bind(
    "class_share",
    "WITH c AS (SELECT site, code, count(*) AS n FROM located WHERE site IS NOT NULL AND code <> 0 GROUP BY 1, 2) "
    "SELECT site, CAST(sum(n) AS BIGINT) AS pixel_count, "
    + ", ".join(
        f"coalesce(sum(n) FILTER (WHERE code IN ({', '.join(map(str, codes))})), 0) / sum(n)::DOUBLE * 100 AS {g}_pct"
        for g, codes in rollups.CLASS_GROUPS.items()
    )
    + ", arg_max(code, n * 1000 - code) AS dominant_code, max(n)::DOUBLE / sum(n) * 100 AS dominant_pct FROM c GROUP BY 1",
    needs="located",
    rounded=[f"{g}_pct" for g in rollups.CLASS_GROUPS] + ["dominant_pct"],
)
def class_share(t):
    return rollups.class_shares(located_pixels(t), "site", "code")


@bind(
    "tile_coverage",
    """SELECT site, tile, min(row_no) AS row_min, max(row_no) AS row_max, min(col_no) AS col_min, max(col_no) AS col_max,
      max(row_no) - min(row_no) + 1 AS window_rows, max(col_no) - min(col_no) + 1 AS window_cols,
      count(*) AS pixel_count, count(*) * 0.0001::DOUBLE AS sampled_area
    FROM located WHERE site IS NOT NULL GROUP BY 1, 2""",
    needs="located",
    rounded="sampled_area",
)
def tile_coverage(t):
    return rollups.tile_coverage(located_pixels(t), "site", "tile", "row_no", "col_no", 0.0001)


MEMBER_SQL = """SELECT family, init_month, target_month, member, avg(value) AS value, count(DISTINCT cell) AS cells
    FROM ensemble GROUP BY 1, 2, 3, 4"""
MEMBER_KEYS = ["family", "init_month", "target_month", "member"]


def member_means(t):
    return rollups.spatial_mean(t.ensemble, MEMBER_KEYS, "value", "cell")


@bind("spatial_mean", MEMBER_SQL, needs="ensemble", rounded="value", digits=3)
def spatial_mean(t):
    return member_means(t)


@bind(
    "ensemble_summary",
    f"""SELECT family, init_month, target_month, count(value) AS members,
      avg(value) * d AS mean_value, quantile_cont(value, 0.1::DOUBLE) * d AS p10,
      quantile_cont(value, 0.5::DOUBLE) * d AS p50, quantile_cont(value, 0.9::DOUBLE) * d AS p90,
      stddev_pop(value) * d AS std_value
    FROM (SELECT *, day(last_day(target_month)) / 990.0::DOUBLE AS d FROM ({MEMBER_SQL}) AS m) AS s GROUP BY 1, 2, 3, d""",
    needs="ensemble",
    rounded="mean_value p10 p50 p90 std_value",
    digits=4,
)
def ensemble_summary(t):
    return rollups.ensemble_summary(
        member_means(t),
        ["family", "init_month", "target_month"],
        "value",
        cal.days_in_month(F.col("target_month")) / 990.0,
    )


@bind(
    "wide_family_collapse",
    """SELECT init_month, lead_month, target_month, first(value ORDER BY member, value DESC) FILTER (WHERE family = 'N') AS first_n,
      max(value) FILTER (WHERE family = 'A') AS max_a, array_to_string(list_sort(list_distinct(list(family))), '; ') AS families,
      bool_or(family = 'N') AS has_n, bool_or(family = 'A') AS has_a, bool_or(family = 'R') AS has_r
    FROM ensemble GROUP BY 1, 2, 3""",
    needs="ensemble",
)
def wide_family_collapse(t):
    family = F.col("family")
    members = t.ensemble.groupBy("init_month", "lead_month", "target_month", "family", "member").agg(
        F.max("value").alias("value")
    )
    rows = members.withColumn("n_value", F.when(family == "N", F.col("value")))
    return rows.groupBy("init_month", "lead_month", "target_month").agg(
        rollups.first_present("n_value", F.col("member")).alias("first_n"),
        F.max(F.when(family == "A", F.col("value"))).alias("max_a"),
        rollups.joined_set("family").alias("families"),
        *[F.bool_or(family == f).alias(f"has_{f.lower()}") for f in "NAR"],
    )


@bind(
    "availability_summary",
    """SELECT family, count(*) AS rows, count(DISTINCT (init_month, target_month)) AS distinct_keys,
      count(DISTINCT CASE WHEN target_month <= DATE '1998-12-01' THEN (init_month, target_month) END) AS distinct_keys_in_window,
      min(init_month) AS first_init, max(init_month) AS last_init
    FROM ensemble GROUP BY 1""",
    needs="ensemble",
)
def availability_summary(t):
    window = F.col("target_month") <= F.lit("1998-12-01").cast("date")
    return rollups.availability(t.ensemble, ["family"], ["init_month", "target_month"], window, "init_month")


COVERAGE_LONG_SQL = f"""SELECT site, week_start, year, unnest(['has_census', 'has_local']) AS source,
      unnest([CAST(population IS NOT NULL AS INTEGER), CAST(local_humidity IS NOT NULL AS INTEGER)]) AS has_data
    FROM (SELECT *, CAST(year(week_start) AS INTEGER) AS year FROM ({PANEL_YEAR_SQL}) AS p) AS q"""


@bind(
    "source_coverage",
    f"""SELECT source, year, count(*) AS rows, CAST(sum(has_data) AS BIGINT) AS rows_with_data,
      avg(has_data) * 100 AS rows_pct, count(DISTINCT CASE WHEN has_data = 1 THEN site END) AS sites,
      count(DISTINCT CASE WHEN has_data = 1 THEN week_start END) AS periods,
      min(CASE WHEN has_data = 1 THEN week_start END) AS first_period,
      max(CASE WHEN has_data = 1 THEN week_start END) AS last_period
    FROM ({COVERAGE_LONG_SQL}) AS l GROUP BY 1, 2""",
    needs="site_week yearly_site static_site",
    rounded="rows_pct",
    digits=4,
)
def source_coverage(t):
    panel = panel_with_sources(t).select(
        "site",
        "week_start",
        F.year("week_start").alias("year"),
        F.col("population").isNotNull().cast("int").alias("has_census"),
        F.col("local_humidity").isNotNull().cast("int").alias("has_local"),
    )
    return rollups.source_coverage(panel, ["has_census", "has_local"], "site", "week_start", ["year"])


@bind(
    "variant_summary",
    """SELECT scenario, avg(temp) AS temp_mean, stddev_samp(temp) AS temp_std, avg(soil) AS soil_mean,
      stddev_samp(soil) AS soil_std, count(temp) AS completed_folds, max(year) AS max_year
    FROM scenario_year GROUP BY 1""",
    needs="scenario_year",
    rounded="temp_mean temp_std soil_mean soil_std",
)
def variant_summary(t):
    """Scenarios stand for variants, years for folds."""
    return rollups.fold_summary(t.scenario_year, ["scenario"], ["temp", "soil"], "year")


EFFECT_SUMMARY_SQL = f"""SELECT scenario, kind, avg(effect) AS mean_effect, stddev_samp(effect) AS std_effect, min(effect) AS min_effect,
      max(effect) AS max_effect, count(*) FILTER (WHERE effect > 0) AS helpful_folds,
      round(count(*) FILTER (WHERE effect > 0)::DOUBLE / count(effect) * 100, 4) AS helpful_folds_pct
    FROM ({EFFECT_SQL}) AS e GROUP BY 1, 2"""


def effect_summary(t):
    return rollups.effect_summary(effects(t), ["scenario", "kind"])


@bind(
    "group_effect_summary",
    EFFECT_SUMMARY_SQL,
    needs="scenario_year",
    rounded="mean_effect std_effect min_effect max_effect helpful_folds_pct",
)
def group_effect_summary(t):
    return effect_summary(t)


@bind(
    "monthly_climatology",
    "SELECT month, avg(temp) AS temp, avg(rain) AS rain FROM month_cases GROUP BY 1",
    needs="month_cases",
    rounded="temp rain",
)
def monthly_climatology(t):
    return rollups.climatology(t.month_cases, "month", ["temp", "rain"])


ANOMALY_SQL = """SELECT s.scenario, s.year, s.temp - b.temp AS temp_anomaly, s.humidity - b.humidity AS humidity_anomaly,
      s.rain - b.rain AS rain_anomaly, s.soil - b.soil AS soil_anomaly
    FROM scenario_year s JOIN (SELECT scenario, avg(temp) AS temp, avg(humidity) AS humidity, avg(rain) AS rain,
        avg(soil) AS soil FROM scenario_year WHERE year BETWEEN 1995 AND 1998 GROUP BY 1) b ON s.scenario = b.scenario"""
CLIMATE = ("temp", "humidity", "rain", "soil")
ANOMALIES = [f"{c}_anomaly" for c in CLIMATE]


def anomalies(t):
    rows = rollups.baseline_anomaly(t.once("scenario_year"), "scenario", "year", CLIMATE, 1995, 1998)
    return rows.select("scenario", "year", *ANOMALIES)


@bind("baseline_anomaly", ANOMALY_SQL, needs="scenario_year", rounded=ANOMALIES)
def baseline_anomaly(t):
    return anomalies(t)


@bind(
    "zscore_index",
    f"""WITH a AS ({ANOMALY_SQL}), h AS (SELECT {', '.join(f'avg({c}) AS {c}_m, CASE WHEN abs(stddev_samp({c})) < 1e-12 THEN 1 ELSE stddev_samp({c}) END AS {c}_s' for c in ANOMALIES)}
      FROM a WHERE year <= 1999)
    SELECT scenario, year, (temp_anomaly - temp_anomaly_m) / temp_anomaly_s
        + (humidity_anomaly - humidity_anomaly_m) / humidity_anomaly_s AS thermal_humidity_index,
      (rain_anomaly - rain_anomaly_m) / rain_anomaly_s + (soil_anomaly - soil_anomaly_m) / soil_anomaly_s AS wetness_index
    FROM a, h""",
    needs="scenario_year",
    rounded="thermal_humidity_index wetness_index",
)
def zscore_index(t):
    return climate_indices(anomalies(t), F.col("year") <= 1999)


def climate_indices(rows, history):
    z = rollups.zscores(rows.where(history), rows, ANOMALIES)
    return z.select(
        "scenario",
        "year",
        (F.col("temp_anomaly_z") + F.col("humidity_anomaly_z")).alias("thermal_humidity_index"),
        (F.col("rain_anomaly_z") + F.col("soil_anomaly_z")).alias("wetness_index"),
    )


@bind(
    "scenario_collapse",
    f"SELECT year, {', '.join(f'avg({c}) AS {c}' for c in ANOMALIES)} FROM ({ANOMALY_SQL}) AS a GROUP BY 1",
    needs="scenario_year",
    rounded=ANOMALIES,
)
def scenario_collapse(t):
    return anomalies(t).groupBy("year").agg(*[F.avg(c).alias(c) for c in ANOMALIES])


@bind(
    "group_manifest",
    """SELECT region_name, count(*) AS columns_count, array_to_string(list_sort(list(site_name)), ' | ') AS columns_list
    FROM static_site GROUP BY 1""",
    needs="static_site",
)
def group_manifest(t):
    return t.static_site.groupBy("region_name").agg(
        F.count(F.lit(1)).alias("columns_count"), rollups.joined_list("site_name").alias("columns_list")
    )


@bind(
    "dimension_counts",
    """SELECT 'o_orderpriority' AS dimension, o_orderpriority AS dimension_value, count(*) AS rows FROM order_sites GROUP BY 2
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM order_sites GROUP BY 2
    UNION ALL SELECT 'site', site, count(*) FROM order_sites GROUP BY 2
    UNION ALL SELECT 'order_year', CAST(year(order_day) AS VARCHAR), count(*) FROM order_sites GROUP BY 2""",
    needs="order_sites",
)
def dimension_counts(t):
    rows = t.order_sites.withColumn("order_year", F.year("order_day"))
    return rollups.dimension_counts(rows, ["o_orderpriority", "o_orderstatus", "site", "order_year"])


@bind(
    "coverage_pct",
    f"""SELECT site, 100 * avg(CAST(population IS NOT NULL OR local_humidity IS NOT NULL AS INTEGER)) AS covered_pct
    FROM ({PANEL_YEAR_SQL}) AS p GROUP BY 1""",
    needs="site_week yearly_site static_site",
    rounded="covered_pct",
    digits=4,
)
def coverage_pct(t):
    return panel_with_sources(t).groupBy("site").agg(
        rollups.any_present_pct(["population", "local_humidity"]).alias("covered_pct")
    )


@bind(
    "period_totals_by_split",
    """SELECT split, week_start, sum(target)::BIGINT AS target_total, sum(score) AS prediction_total
    FROM risk_panel GROUP BY 1, 2""",
    needs="risk_panel",
    rounded="prediction_total",
)
def period_totals_by_split(t):
    return metrics.period_totals(t.risk_panel, "target", "score", ["split", "week_start"])


@bind(
    "coverage_by_scenario",
    "SELECT scenario, min(year) AS first_year, max(year) AS last_year, count(*) AS years FROM scenario_year GROUP BY 1",
    needs="scenario_year",
)
def coverage_by_scenario(t):
    return rollups.year_coverage(t.scenario_year, ["scenario"], "year")


@bind(
    "yearly_species_summary",
    """SELECT site, year, count(value) AS species_count, avg(value) AS mean_value, min(value) AS min_value,
      max(value) AS max_value, sum(value) AS sum_value
    FROM (SELECT site, CAST(year(order_day) AS INTEGER) AS year, o_orderpriority,
        CASE WHEN count(*) > 1 THEN CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS DOUBLE) / count(*) END AS value
      FROM order_sites GROUP BY 1, 2, 3) AS s GROUP BY 1, 2""",
    needs="order_sites",
    rounded="mean_value min_value max_value sum_value",
)
def yearly_species_summary(t):
    n = F.count(F.lit(1))
    species = t.order_sites.groupBy("site", F.year("order_day").alias("year"), "o_orderpriority").agg(
        F.when(n > 1, F.sum(F.round("o_totalprice").cast("bigint")).cast("double") / n).alias("value")
    )
    return rollups.value_summary(species, ["site", "year"], "value").withColumnRenamed("value_count", "species_count")


@bind(
    "column_extents",
    """SELECT min(air_temperature_c) AS minimum, max(air_temperature_c) AS maximum, avg(air_temperature_c) AS mean_value,
      count(air_temperature_c) AS present FROM hourly""",
    needs="hourly",
    rounded="minimum maximum mean_value",
)
def column_extents(t):
    return rollups.extents(t.hourly, "air_temperature_c")
