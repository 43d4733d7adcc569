"""Scans, sources and sinks on the test tables."""

from pyspark.sql import functions as F

from biotope.session import shared_folder
from biotope.sources import documents, forecast_files, gridded, layout, tables
from biotope.workload.registry import bind


@bind(
    "scan_required_columns",
    """SELECT code, trim(raw_name) AS raw_name, brand FROM names WHERE trim(brand) <> '' AND size > 1""",
    needs="names",
)
def scan_required_columns(t):
    raw = t.names.withColumn("brand", F.when(F.col("size") > 1, F.col("brand")).otherwise("   "))
    return tables.clean_table(raw, ["code", "raw_name", "brand"], ["brand"], "names")


@bind("scan_hourly_grid", "SELECT * FROM hourly", needs="hourly")
def scan_hourly_grid(t):
    return t.hourly


@bind(
    "scan_time_window",
    """SELECT event_id, CAST(ts AS DATE) AS day, event_type, value FROM events
    WHERE ts >= DATE '2024-01-08' AND ts < DATE '2024-01-22'""",
)
def scan_time_window(t):
    rows = gridded.time_window(t.table("events"), "ts", "2024-01-08", "2024-01-21")
    return rows.select("event_id", F.to_date("ts").alias("day"), "event_type", "value")


def cube_documents(t):
    """One cube per region: two measures x its sites and a total x the census years."""
    years = t.once("yearly_site").agg(F.sort_array(F.collect_set("year"))).scalar()
    sites = t.static_site.select("region_name", "site")
    wanted = sites.withColumn("year", F.explode(years)).join(t.once("yearly_site"), ["site", "year"], "left")
    measures = F.array(
        F.struct(F.lit("density").alias("measure"), F.col("density").alias("value")),
        F.struct(F.lit("population").alias("measure"), F.col("population").cast("double").alias("value")),
    )
    long = wanted.select("region_name", "site", "year", F.explode(measures).alias("m")).select(
        "region_name", "m.measure", "site", "year", "m.value"
    )
    totals = long.groupBy("region_name", "measure", "year").agg(F.sum("value").alias("value"))
    full = long.unionByName(totals.withColumn("site", F.lit("TOTAL")))
    cells = F.sort_array(F.collect_list(F.struct("measure", "site", "year", "value")))

    def codes(name):
        return F.struct(F.sort_array(F.collect_set(F.col(name).cast("string"))).alias("codes"))

    packed = full.groupBy("region_name").agg(
        cells.alias("cells"), codes("measure").alias("m"), codes("site").alias("s"), codes("year").alias("y")
    )
    values = F.transform("cells", lambda c: c["value"])
    flagged = F.filter(
        F.transform("cells", lambda c, i: F.when(c["value"].isNull(), F.struct(i.cast("string"), F.lit("M")))),
        lambda e: e.isNotNull(),
    )
    return packed.select(
        F.to_json(
            F.struct(
                F.array(F.lit("measure"), F.lit("site"), F.lit("year")).alias("id"),
                F.array(F.size("m.codes"), F.size("s.codes"), F.size("y.codes")).alias("size"),
                values.alias("value"),
                F.map_from_entries(flagged).alias("status"),
                F.create_map(
                    F.lit("measure"), F.col("m"), F.lit("site"), F.col("s"), F.lit("year"), F.col("y")
                ).alias("dimension"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("document")
    )


@bind(
    "scan_data_cube",
    """SELECT site, year, CAST(population AS DOUBLE) AS value, CASE WHEN population IS NULL THEN 'M' END AS status,
      ln(1 + CAST(population AS DOUBLE)) AS log_value
    FROM static_site CROSS JOIN (SELECT DISTINCT year FROM yearly_site) AS years
    LEFT JOIN yearly_site USING (site, year)""",
    needs="static_site yearly_site",
    rounded="log_value",
)
def scan_data_cube(t):
    return documents.decode_cube(
        cube_documents(t), "document", ["measure", "site", "year"], "population", "site", "year", total="TOTAL"
    )


@bind(
    "scan_geojson_features",
    """SELECT CAST(s_suppkey AS VARCHAR) AS code, trim(s_name) AS name,
      CASE WHEN s_acctbal > 5000 THEN CAST(s_nationkey AS VARCHAR) END AS optional_id, CAST(4 AS INTEGER) AS points
    FROM supplier WHERE s_acctbal >= 0""",
)
def scan_geojson_features(t):
    """One collection per supplier; those in debt come without a name."""
    key = F.col("s_suppkey").cast("double")
    ring = F.array(
        F.array(key, F.lit(0.0)), F.array(key, F.lit(1.0)), F.array(key + 1, F.lit(1.0)), F.array(key, F.lit(0.0))
    )
    feature = F.struct(
        F.struct(
            F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("code"),
            F.when(F.col("s_acctbal") >= 0, F.concat(F.col("s_name"), F.lit("  "))).otherwise("  ").alias("name"),
            F.when(F.col("s_acctbal") > 5000, F.col("s_nationkey").cast("string")).otherwise("").alias("optional_id"),
        ).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    texts = t.table("supplier").select(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("text")
    )
    valid = documents.valid_features(documents.parse_features(texts, "text"))
    return valid.select("code", "name", "optional_id", F.size(F.get("rings", F.lit(0))).alias("points"))


@bind(
    "scan_parallel_arrays",
    """SELECT grid_key, CAST(time AS DATE) AS day, CAST(hour(time) AS INTEGER) AS hour_no,
      air_temperature_c, relative_humidity_pct FROM hourly""",
    needs="hourly",
)
def scan_parallel_arrays(t):
    """A payload holds the at most 24 hours of one cell and day."""
    hours = F.sort_array(
        F.collect_list(F.struct(F.hour("time").alias("h"), "air_temperature_c", "relative_humidity_pct"))
    )
    packed = t.hourly.groupBy("grid_key", F.to_date("time").alias("day")).agg(hours.alias("hours"))
    payloads = packed.select(
        "grid_key",
        "day",
        F.to_json(
            F.struct(
                F.transform("hours", lambda r: r["h"]).alias("hour_no"),
                F.transform("hours", lambda r: r["air_temperature_c"]).alias("air_temperature_c"),
                F.transform("hours", lambda r: r["relative_humidity_pct"]).alias("relative_humidity_pct"),
            )
        ).alias("payload"),
    )
    schema = "hour_no array<int>, air_temperature_c array<double>, relative_humidity_pct array<double>"
    parsed = payloads.select("grid_key", "day", F.from_json("payload", schema).alias("p")).select("grid_key", "day", "p.*")
    return documents.unnest_arrays(
        parsed, ["grid_key", "day"], ["hour_no", "air_temperature_c", "relative_humidity_pct"]
    )


def forecast_file_names(t):
    """Archive names of the ensemble: per-variable files next to combined ones for one family."""
    family = F.when(F.col("family") == "N", "copernicus_air_temperature").when(
        F.col("family") == "A", "copernicus_precipitation"
    ).otherwise("copernicus_soil_water")
    keys = t.ensemble.groupBy(family.alias("family"), "init_month").agg(
        F.min("lead_month").alias("lead_min"), F.max("lead_month").alias("lead_max")
    )
    stem = F.format_string(
        "seasonal-monthly-single-levels_ecmwf_system_51_%s_init_%s_lead_%d-%d",
        F.col("family"), F.date_format("init_month", "yyyy_MM"), F.col("lead_min"), F.col("lead_max"),
    )
    endings = F.when(
        F.col("family") == "copernicus_soil_water",
        F.array(F.lit(".grib"), F.lit("_rawvar_swvl1.grib"), F.lit("_rawvar_swvl2.grib")),
    ).otherwise(F.array(F.lit(".grib"), F.lit(".log")))
    return keys.select(stem.alias("stem"), F.explode(endings).alias("ending")).select(
        F.concat("stem", "ending").alias("file_name")
    )


FILE_INDEX_SQL = """SELECT CAST(51 AS INTEGER) AS system, family, init_month, raw_variable,
      'seasonal-monthly-single-levels_ecmwf_system_51_' || family || '_init_' || strftime(init_month, '%Y_%m')
        || '_lead_' || lead_min || '-' || lead_max
        || CASE WHEN raw_variable = '' THEN '' ELSE '_rawvar_' || raw_variable END || '.grib' AS file_name,
      lead_min, lead_max
    FROM (SELECT CASE family WHEN 'N' THEN 'copernicus_air_temperature' WHEN 'A' THEN 'copernicus_precipitation'
            ELSE 'copernicus_soil_water' END AS family, init_month,
          min(lead_month) AS lead_min, max(lead_month) AS lead_max FROM ensemble GROUP BY 1, 2) AS keys
    JOIN (VALUES ('copernicus_air_temperature', ''), ('copernicus_precipitation', ''),
      ('copernicus_soil_water', 'swvl1'), ('copernicus_soil_water', 'swvl2')) AS v(family, raw_variable)
      USING (family)"""


@bind("scan_file_index", FILE_INDEX_SQL, needs="ensemble")
def scan_file_index(t):
    return forecast_files.file_index(forecast_file_names(t))


@bind(
    "explode_lead_months",
    f"""SELECT system, family, init_month, raw_variable, file_name, lead_month,
      CAST(init_month + to_months(lead_month) AS DATE) AS target_month
    FROM ({FILE_INDEX_SQL}) AS files
    JOIN (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS lead_month) AS leads
      ON lead_month BETWEEN lead_min AND lead_max""",
    needs="ensemble",
)
def explode_lead_months(t):
    return forecast_files.lead_index(forecast_files.file_index(forecast_file_names(t)))


@bind("sink_ordered_table", "SELECT site, week_start, cases_a, cases_b FROM site_week", needs="site_week")
def sink_ordered_table(t):
    """Written by year into the shared folder, then read back."""
    path = shared_folder(t.spark, "site_week")
    panel = t.site_week.withColumn("year", F.year("week_start"))
    columns = ["site", "week_start", "cases_a", "cases_b", "year"]
    tables.write_ordered(panel, path, columns, ["site", "week_start"], partition="year")
    return t.spark.read.parquet(path).select(*columns[:-1])


@bind(
    "sink_clustered_table",
    """SELECT time, latitude, longitude, air_temperature_c FROM hourly
    WHERE time >= (SELECT min(time) + INTERVAL 7 DAY FROM hourly) AND time < (SELECT min(time) + INTERVAL 14 DAY FROM hourly)
      AND latitude BETWEEN 45.15 AND 45.45 AND longitude < 13.4""",
    needs="hourly",
    rounded="latitude longitude air_temperature_c",
)
def sink_clustered_table(t):
    """Hours written along a curve through time and place, then a week of a box read back."""
    path = shared_folder(t.spark, "clustered_hours")
    hours = t.once("hourly")
    layout.write_clustered(hours, path, ["time", "latitude", "longitude"], 16)
    first = hours.agg(F.min("time")).scalar()
    week = (F.col("time") >= first + F.expr("INTERVAL 7 DAYS")) & (F.col("time") < first + F.expr("INTERVAL 14 DAYS"))
    box = F.col("latitude").between(45.15, 45.45) & (F.col("longitude") < 13.4)
    return t.spark.read.parquet(path).where(week & box).select("time", "latitude", "longitude", "air_temperature_c")


@bind(
    "table_profile",
    """SELECT count(*) AS rows, count(DISTINCT site) AS sites, count(DISTINCT week_start) AS periods,
      min(week_start) AS first_period, max(week_start) AS last_period,
      CAST(sum(cases_a) AS BIGINT) AS cases_a_total, CAST(sum(cases_b) AS BIGINT) AS cases_b_total,
      count(*) FILTER (WHERE site IS NULL) AS site_nulls,
      count(*) FILTER (WHERE week_start IS NULL) AS week_start_nulls,
      count(*) FILTER (WHERE cases_a IS NULL) AS cases_a_nulls,
      count(*) FILTER (WHERE cases_b IS NULL) AS cases_b_nulls,
      count(*) FILTER (WHERE elevation_mean IS NULL) AS elevation_mean_nulls,
      'site,week_start,cases_a,cases_b,elevation_mean' AS column_names
    FROM site_week LEFT JOIN static_site USING (site)""",
    needs="site_week static_site",
)
def table_profile(t):
    panel = t.site_week.join(t.static_site, "site", "left").select(
        "site", "week_start", "cases_a", "cases_b", "elevation_mean"
    )
    return tables.table_profile(panel, "site", "week_start", ["cases_a", "cases_b"])
