"""Structured Streaming jobs on the events table, run until everything available is processed."""

from pyspark.sql import functions as F

from biotope.functions.weather import grid_key
from biotope.session import shared_folder
from biotope.streaming import hourly, late
from biotope.streaming.weekly_lags import weekly_lags
from biotope.workload.aggregating import CELL_DAY_SQL, FLOAT_DAILY
from biotope.workload.registry import bind
from biotope.workload.relations import CELLS, cents


def event_stream(t):
    schema = t.table("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return stream.withColumn("time", F.col("ts").cast("timestamp"))


def hour_stream(t):
    """Hourly cell means from the feed, as in the batch relation."""
    value = cents(F.col("value"))
    cell = F.array_position(F.array(*[F.lit(c) for c in CELLS]), F.col("event_type")).cast("int")
    hours = (
        event_stream(t)
        .withWatermark("time", hourly.LATENESS)
        .groupBy(F.window("time", "1 hour"), cell.alias("cell_no"))
        .agg(
            F.avg(value).alias("v"),
            F.avg(F.pmod(value * 7, F.lit(10000))).alias("h"),
            F.avg(F.pmod(value, F.lit(300))).alias("r"),
        )
    )
    return hours.select(
        F.window_time("window").alias("time"),
        grid_key(F.lit(45) + F.col("cell_no") / 10, F.lit(13) + F.col("cell_no") / 8).alias("grid_key"),
        (F.col("v") / 990).alias("air_temperature_c"),
        (F.col("h") / 101).alias("relative_humidity_pct"),
        (F.col("r") / 510).alias("precipitation_mm"),
        (F.col("v") / 1900).alias("soil_temperature_1_c"),
        (F.col("v") / 3700).alias("soil_temperature_2_c"),
        (F.col("h") / 21000).alias("soil_water_1"),
        (F.col("h") / 41000).alias("soil_water_2"),
    )


def day_table(t, path):
    days = hourly.hourly_to_day_from_hours(hour_stream(t), ["grid_key"])
    return hourly.run_to_table(days, path)


CLOSED_DAY_SQL = f"""SELECT * FROM ({CELL_DAY_SQL}) AS d
    WHERE day + 1 <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)"""


@bind("stream_hourly_to_day", CLOSED_DAY_SQL, needs="hourly", rounded=FLOAT_DAILY)
def stream_hourly_to_day(t):
    return day_table(t, shared_folder(t.spark, "stream_days"))


@bind(
    "stream_day_to_week",
    f"""SELECT grid_key, CAST(date_trunc('week', day) AS DATE) AS week_start, count(*) AS observation_days,
      avg(temperature_mean) AS temperature_mean, min(temperature_mean) AS temperature_min, max(temperature_mean) AS temperature_max,
      avg(humidity_mean) AS humidity_mean, sum(rain_sum) AS rain_sum, max(rain_sum) AS rain_daily_max,
      CAST(sum(humid_hours_80) AS BIGINT) AS humid_hours_80, CAST(sum(activity_hours) AS BIGINT) AS activity_hours,
      count(*) FILTER (WHERE rain_sum >= 1) AS rainy_days
    FROM ({CLOSED_DAY_SQL}) AS c GROUP BY 1, 2
    HAVING count(*) = 7 AND CAST(date_trunc('week', day) AS DATE) + 7 <=
      (SELECT max(day) - INTERVAL 6 HOUR FROM ({CLOSED_DAY_SQL}) AS c2)""",
    needs="hourly",
    rounded="temperature_mean temperature_min temperature_max humidity_mean rain_sum rain_daily_max",
)
def stream_day_to_week(t):
    """A second stream over the daily table the first one has written."""
    path = shared_folder(t.spark, "stream_days")
    days = day_table(t, path)
    stream = t.spark.readStream.schema(days.schema).parquet(hourly.data_folder(path)).withColumn(
        "day_start", F.col("day").cast("timestamp")
    )
    weeks = hourly.day_to_week(stream, ["grid_key"])
    return hourly.run_to_table(weeks, shared_folder(t.spark, "stream_weeks"))


@bind("stream_dedupe_keys", "SELECT event_id, user_id, event_type, value FROM events")
def stream_dedupe_keys(t):
    """The feed delivered twice, each event kept once."""
    once = event_stream(t)
    twice = once.unionByName(event_stream(t))
    kept = hourly.dedupe(twice, "event_id", "time")
    kept = kept.select("event_id", "user_id", "event_type", "value")
    return hourly.run_to_table(kept, shared_folder(t.spark, "stream_events"))


def hours_in_parts(t, parts: int = 5):
    """The hourly table delivered in files one after another, each tenth row one file later than its time."""
    folder = shared_folder(t.spark, "stream_hours")
    hours = t.once("hourly")
    first, last = hours.agg(F.min("time").cast("long"), F.max("time").cast("long")).first()
    own = F.floor((F.col("time").cast("long") - first) * parts / (last - first + 1))
    part = own + (F.pmod(F.xxhash64("time", "grid_key"), F.lit(10)) == 0).cast("int")
    for k in range(parts + 1):
        hours.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(hours.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@bind(
    "stream_late_corrections",
    f"""SELECT * FROM ({CELL_DAY_SQL}) AS d WHERE day + 1 <= (SELECT max(time) - INTERVAL 6 HOUR FROM hourly)""",
    needs="hourly",
    rounded=FLOAT_DAILY,
)
def stream_late_corrections(t):
    """Days of a feed with late rows, corrected, equal those of the whole table."""
    days, _ = late.run_with_corrections(hours_in_parts(t), shared_folder(t.spark, "stream_late"))
    return days


def weeks_in_parts(t, folder: str, parts: range, every: int = 5):
    """The weekly panel delivered in files; the last week of a file comes with the next one for half of the sites."""
    weeks = t.once("site_week").select("site", "week_start", "cases_a")
    first, last = weeks.agg(F.min("week_start"), F.max("week_start")).first()
    day = lambda c: F.datediff(c, F.lit(first))
    own = lambda c: F.floor(day(c) * every / ((last - first).days + 1))
    moved = (own(F.date_add("week_start", 7)) > own("week_start")) & (F.pmod(F.xxhash64("site"), F.lit(2)) == 0)
    part = F.least(own("week_start") + moved.cast("int"), F.lit(every - 1))
    for k in parts:
        weeks.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(weeks.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@bind(
    "stream_weekly_lags",
    """SELECT * FROM (SELECT site, week_start, CAST(cases_a AS DOUBLE) AS cases_a, CAST(lag(cases_a, 1) OVER w AS DOUBLE) AS lag_1,
        CAST(lag(cases_a, 2) OVER w AS DOUBLE) AS lag_2,
        CASE WHEN count(cases_a) OVER f = 4 THEN CAST(sum(cases_a) OVER f AS DOUBLE) END AS prev_sum, FALSE AS repeated
      FROM site_week WINDOW w AS (PARTITION BY site ORDER BY week_start),
        f AS (PARTITION BY site ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS s
    WHERE week_start <= (SELECT max(week_start) - INTERVAL 14 DAY FROM site_week)""",
    needs="site_week",
)
def stream_weekly_lags(t):
    """Lags and four-week sums of a stream of weeks out of order, for all weeks that the watermark has passed."""
    stream = weeks_in_parts(t, shared_folder(t.spark, "stream_panel"), range(5))
    return hourly.run_to_table(weekly_lags(stream), shared_folder(t.spark, "stream_lags"))
