"""Window functions on the test tables."""

from pyspark.sql import functions as F

from biotope.functions import rules
from biotope.operators import metrics, ordering, windows
from biotope.plans import upkeep, weekly_weather
from biotope.session import shared_folder
from biotope.workload.aggregating import EFFECT_SUMMARY_SQL, FLOAT_WEEKLY, SITE_WEEK_SQL, effect_summary
from biotope.workload.registry import bind
from biotope.workload.scalars import CALENDAR_SQL

PANEL_WINDOW = "WINDOW w AS (PARTITION BY site ORDER BY week_start)"


def panel(t):
    return t.site_week, windows.over_panel("site", "week_start")


@bind(
    "lags",
    "SELECT site, week_start, "
    + ", ".join(f"lag(temp_mean, {k}) OVER w AS temp_mean_lag_{k}" for k in (1, 2, 4))
    + ", "
    + ", ".join(f"lag(cases_a, {k}) OVER w AS cases_a_lag_{k}" for k in (2, 3))
    + f" FROM site_week {PANEL_WINDOW}",
    needs="site_week",
)
def lags(t):
    df, w = panel(t)
    columns = windows.lags("temp_mean", [1, 2, 4], w) | windows.lags("cases_a", [2, 3], w)
    return df.select("site", "week_start", *[c.alias(n) for n, c in columns.items()])


@bind(
    "rolling_prev_mean_min1",
    """SELECT site, week_start, avg(temp_mean) OVER (PARTITION BY site ORDER BY week_start
      ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS temp_prev_4_mean FROM site_week""",
    needs="site_week",
    rounded="temp_prev_4_mean",
)
def rolling_prev_mean_min1(t):
    df, w = panel(t)
    return df.select("site", "week_start", windows.prev_mean("temp_mean", 4, w).alias("temp_prev_4_mean"))


def full_sql(column, frame, k, how="sum"):
    over = f"OVER (PARTITION BY site ORDER BY week_start ROWS BETWEEN {frame})"
    return f"CASE WHEN count({column}) {over} = {k} THEN {how}({column}) {over} END"


@bind(
    "rolling_prev_full",
    f"""SELECT site, week_start, CAST({full_sql('cases_a', '4 PRECEDING AND 1 PRECEDING', 4)} AS BIGINT) AS cases_a_prev_4_sum,
      CAST({full_sql('cases_b', '8 PRECEDING AND 1 PRECEDING', 8)} AS BIGINT) AS cases_b_prev_8_sum,
      {full_sql('rain_sum', '12 PRECEDING AND 1 PRECEDING', 12, 'avg')} AS rain_prev_12_mean
    FROM site_week""",
    needs="site_week",
    rounded="rain_prev_12_mean",
)
def rolling_prev_full(t):
    df, w = panel(t)
    return df.select(
        "site",
        "week_start",
        windows.prev_full("cases_a", 4, w).alias("cases_a_prev_4_sum"),
        windows.prev_full("cases_b", 8, w).alias("cases_b_prev_8_sum"),
        windows.prev_full("rain_sum", 12, w, "avg").alias("rain_prev_12_mean"),
    )


@bind(
    "trailing_burden_per100k",
    f"""SELECT site, week_start, {full_sql('cases_a', '3 PRECEDING AND CURRENT ROW', 4)} / line_count * 100000 AS burden_4,
      {full_sql('cases_a', '7 PRECEDING AND CURRENT ROW', 8)} / line_count * 100000 AS burden_8
    FROM site_week""",
    needs="site_week",
    rounded="burden_4 burden_8",
)
def trailing_burden_per100k(t):
    df, w = panel(t)
    return df.select(
        "site",
        "week_start",
        *[
            rules.per_100k(windows.trailing_full("cases_a", k, w), F.col("line_count")).alias(f"burden_{k}")
            for k in (4, 8)
        ],
    )


NEXT_SQL = {k: f"CAST({full_sql('cases_a', f'1 FOLLOWING AND {k} FOLLOWING', k)} AS BIGINT)" for k in (4, 8)}


@bind(
    "forward_window_target",
    "SELECT site, week_start, "
    + ", ".join(
        f"{NEXT_SQL[k]} AS cases_a_next_{k}, CAST({NEXT_SQL[k]} > 0 AS INTEGER) AS cases_a_any_next_{k}, "
        f"{NEXT_SQL[k]} / line_count * 100000 AS cases_a_per_100k_next_{k}"
        for k in (4, 8)
    )
    + " FROM site_week",
    needs="site_week",
    rounded="cases_a_per_100k_next_4 cases_a_per_100k_next_8",
)
def forward_window_target(t):
    base = t.site_week.select("site", "week_start", "cases_a", "line_count")
    return windows.forward_targets(base, "cases_a", [4, 8], "site", "week_start", "line_count").drop(
        "cases_a", "line_count"
    )


@bind(
    "forward_fill",
    """SELECT site, week_start, last_value(CASE WHEN cases_b > 3 THEN humid_mean END IGNORE NULLS) OVER (
      PARTITION BY site ORDER BY week_start ROWS UNBOUNDED PRECEDING) AS humid_filled FROM site_week""",
    needs="site_week",
)
def forward_fill(t):
    df, w = panel(t)
    sparse = df.withColumn("humid", F.when(F.col("cases_b") > 3, F.col("humid_mean")))
    return sparse.select("site", "week_start", windows.forward_fill("humid", w).alias("humid_filled"))


@bind(
    "latest_per_group",
    """SELECT target_month, family, init_month, members FROM (SELECT *, row_number() OVER (
        PARTITION BY target_month, family ORDER BY init_month DESC) AS rn
      FROM (SELECT target_month, family, init_month, count(*) AS members FROM ensemble GROUP BY 1, 2, 3) AS k) AS r
    WHERE rn = 1""",
    needs="ensemble",
)
def latest_per_group(t):
    issues = t.ensemble.groupBy("target_month", "family", "init_month").agg(F.count(F.lit(1)).alias("members"))
    return windows.first_per_key(issues, ["target_month", "family"], [F.col("init_month").desc()])


@bind(
    "rank_in_group",
    f"""SELECT kind, scenario, CAST(row_number() OVER (PARTITION BY kind ORDER BY mean_effect DESC, helpful_folds_pct DESC, scenario)
      AS INTEGER) AS position FROM ({EFFECT_SUMMARY_SQL}) AS s""",
    needs="scenario_year",
)
def rank_in_group(t):
    order = [F.desc("mean_effect"), F.desc("helpful_folds_pct"), F.asc("scenario")]
    ranked = windows.rank_in_group(effect_summary(t), ["kind"], order)
    return ranked.select("kind", "scenario", "position")


@bind(
    "average_rank",
    """SELECT doc_id, split, score, rank() OVER (PARTITION BY split ORDER BY score)
      + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS avg_rank FROM rated""",
    needs="rated",
)
def average_rank(t):
    rows = t.rated.select("doc_id", "split", "score")
    return ordering.average_rank(rows, "score", ["split"])


GAIN_SQL = """SELECT doc_id, split, position, positives_so_far, positives_so_far::DOUBLE / position AS precision_at,
      position::DOUBLE / n AS fraction, (positives_so_far::DOUBLE / position) / prevalence AS lift
    FROM (SELECT doc_id, split, row_number() OVER w AS position, CAST(sum(target) OVER w AS BIGINT) AS positives_so_far,
        count(*) OVER (PARTITION BY split) AS n, avg(target) OVER (PARTITION BY split) AS prevalence
      FROM scored WINDOW w AS (PARTITION BY split ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) AS r"""


@bind(
    "cumulative_gain",
    f"SELECT * FROM ({GAIN_SQL}) AS g WHERE fraction <= 0.2",
    needs="scored",
    rounded="precision_at fraction lift",
)
def cumulative_gain(t):
    rows = t.scored.select("doc_id", "split", "target", "score")
    gain = metrics.cumulative_gain(rows, "target", "score", "doc_id", ["split"])
    return gain.select("doc_id", "split", "position", "positives_so_far", "precision_at", "fraction", "lift")


@bind(
    "inverse_group_weight",
    "SELECT scenario, year, 1.0::DOUBLE / count(*) OVER (PARTITION BY year) AS row_weight FROM scenario_year",
    needs="scenario_year",
)
def inverse_group_weight(t):
    return windows.inverse_group_weight(t.once("scenario_year").select("scenario", "year"), "year")


@bind(
    "empirical_percentile_score",
    """WITH h AS (SELECT score FROM rated WHERE split IN ('validation', 'test'))
    SELECT doc_id, score AS raw_score, CAST(round_even(100.0::DOUBLE * (SELECT count(*) FROM h WHERE h.score <= rated.score)
      / (SELECT count(*) FROM h), 0) AS INTEGER) AS percentile FROM rated""",
    needs="rated",
)
def empirical_percentile_score(t):
    rows = t.rated.select("doc_id", "split", F.col("score").alias("raw_score"))
    holdout = rows.where(F.col("split").isin("validation", "test"))
    return ordering.percentile_scores(holdout, rows.drop("split"), "raw_score", name="percentile")


@bind(
    "deaccumulate",
    """WITH h AS (SELECT grid_key, time, precipitation_mm AS total, CAST(time - INTERVAL 1 HOUR AS DATE) AS accumulation_day,
        CAST(CASE WHEN hour(time) = 0 THEN 24 ELSE hour(time) END AS INTEGER) AS accumulation_step FROM hourly)
    SELECT grid_key, time, total, accumulation_day, accumulation_step, greatest(total - coalesce(lag(total) OVER (
      PARTITION BY grid_key, accumulation_day ORDER BY accumulation_step), 0), 0)::DOUBLE AS increment FROM h""",
    needs="hourly",
)
def deaccumulate(t):
    totals = t.hourly.select("grid_key", "time", F.col("precipitation_mm").alias("total"))
    return windows.deaccumulate(totals, ["grid_key"], "time", "total")


@bind(
    "period_delta",
    f"""SELECT site, week_start, score - lag(score) OVER w AS delta FROM risk_panel {PANEL_WINDOW}""",
    needs="risk_panel",
    rounded="delta",
)
def period_delta(t):
    deltas = windows.period_delta(t.risk_panel.select("site", "week_start", "score"), "score", "site", "week_start")
    return deltas.drop("score")


@bind(
    "drop_duplicates",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) AS r WHERE rn = 1""",
)
def drop_duplicates(t):
    events = t.table("events").select("user_id", "event_type", "event_id", "value")
    return windows.first_per_key(events, ["user_id", "event_type"], [F.col("event_id").asc()])


@bind(
    "month_of_window_group_rank",
    f"""SELECT split, doc_id, position, positives_so_far, precision_at / (SELECT sum(target) FROM scored s WHERE s.split = g.split)
      AS term FROM ({GAIN_SQL}) AS g WHERE doc_id IN (SELECT doc_id FROM scored WHERE target = 1)""",
    needs="scored",
    rounded="term",
)
def month_of_window_group_rank(t):
    rows = t.scored.select("doc_id", "split", "target", "score")
    terms = metrics.precision_terms(rows, "target", "score", "doc_id", ["split"]).where("target = 1")
    positives = rows.groupBy("split").agg(F.sum("target").alias("positives"))
    return terms.join(positives, "split").select(
        "split", "doc_id", "position", "positives_so_far", (F.col("precision_at") / F.col("positives")).alias("term")
    )


HISTORY_SQL = ", ".join(
    f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in weekly_weather.LAGGED for k in weekly_weather.LAG_STEPS
) + ", " + ", ".join(
    f"avg({c}) OVER (PARTITION BY {{0}} ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS {c}_prev_4_mean"
    for c in weekly_weather.LAGGED
)
FLOAT_HISTORY = (
    [f"{c}_lag_{k}" for c in weekly_weather.LAGGED for k in weekly_weather.LAG_STEPS]
    + [f"{c}_prev_4_mean" for c in weekly_weather.LAGGED]
    + ["week_of_year_sin", "week_of_year_cos"]
)


@bind(
    "weekly_weather_features",
    f"""SELECT w0.*, o.* EXCLUDE (site), week_start + 6 AS week_end, {HISTORY_SQL.format('site')}, {CALENDAR_SQL}
    FROM ({SITE_WEEK_SQL}) AS w0 JOIN (
      SELECT site, count(DISTINCT grid_key) AS grid_cell_count, max(site_area) AS site_area,
        max(covered_area) AS covered_area, max(coverage) * 100 AS covered_area_pct,
        CASE WHEN max(coverage) >= 0.999 THEN 'area_weighted_polygon_overlay'
          ELSE 'area_weighted_polygon_overlay_partial_coverage' END AS overlay_method
      FROM overlay GROUP BY 1) AS o USING (site)
    WHERE observation_days = 7 {PANEL_WINDOW}""",
    needs="hourly overlay",
    rounded=[*FLOAT_WEEKLY.split(), *FLOAT_HISTORY, "covered_area_pct"],
)
def weekly_weather_features(t):
    """Hourly grid to site-week features in one plan."""
    return weekly_weather.weekly_weather(t.hourly, t.overlay)


POINT_DAY_SQL = """SELECT grid_key, CAST(time AS DATE) AS day, avg(air_temperature_c) AS temperature_mean,
      avg(relative_humidity_pct) AS humidity_mean, sum(precipitation_mm) AS rain_sum,
      avg(soil_temperature_1_c) AS soil_temperature_1_mean, avg(soil_temperature_2_c) AS soil_temperature_2_mean,
      avg(soil_water_1) AS soil_water_1_mean, avg(soil_water_2) AS soil_water_2_mean,
      count(*) FILTER (WHERE relative_humidity_pct >= 80) AS humid_hours_80,
      count(*) FILTER (WHERE relative_humidity_pct >= 90) AS humid_hours_90,
      count(*) FILTER (WHERE precipitation_mm >= 0.1::DOUBLE) AS wet_hours,
      count(*) FILTER (WHERE air_temperature_c BETWEEN 7 AND 25 AND relative_humidity_pct >= 80) AS activity_hours,
      sum(greatest(air_temperature_c - 5, 0)) AS degree_hours_sum
    FROM hourly GROUP BY 1, 2"""


@bind(
    "weather_week_contract",
    f"""WITH d AS ({POINT_DAY_SQL}),
      w1 AS (SELECT grid_key, week_start, temperature_mean, humidity_mean, rain_sum, humid_hours_80::BIGINT AS humid_hours_80,
        rainy_days FROM (SELECT grid_key, CAST(date_trunc('week', day) AS DATE) AS week_start, count(DISTINCT day) AS observation_days,
          avg(temperature_mean) AS temperature_mean, avg(humidity_mean) AS humidity_mean, sum(rain_sum) AS rain_sum,
          sum(humid_hours_80) AS humid_hours_80, count(*) FILTER (WHERE rain_sum >= 1) AS rainy_days FROM d GROUP BY 1, 2) AS g
        WHERE observation_days = 7)
    SELECT *, week_start + 6 AS week_end, {HISTORY_SQL.format('grid_key')}, {CALENDAR_SQL}
    FROM w1 WINDOW w AS (PARTITION BY grid_key ORDER BY week_start)""",
    needs="hourly",
    rounded=["temperature_mean", "humidity_mean", "rain_sum", *FLOAT_HISTORY],
)
def weather_week_contract(t):
    weekly = weekly_weather.point_weekly(t.hourly, "grid_key")
    drop = [
        c
        for c in FLOAT_WEEKLY.split()
        if c not in ("temperature_mean", "humidity_mean", "rain_sum", "humid_hours_80")
    ]
    return weekly.drop(*drop, "observation_days", "humid_days", "favorable_days")


UPKEEP_SQL = ", ".join(
    f"""lag({c}, 1) OVER w AS {c}_lag_1, lag({c}, 2) OVER w AS {c}_lag_2,
      CASE WHEN count({c}) OVER b4 = 4 THEN CAST(sum({c}) OVER b4 AS BIGINT) END AS {c}_prev_4,
      CASE WHEN count({c}) OVER b8 = 8 THEN CAST(sum({c}) OVER b8 AS BIGINT) END AS {c}_prev_8,
      CASE WHEN count({c}) OVER a4 = 4 THEN CAST(sum({c}) OVER a4 AS BIGINT) END AS {c}_next_4"""
    for c in ("cases_a", "cases_b")
)


@bind(
    "panel_upkeep",
    f"""SELECT site, week_start, cases_a, cases_b, {UPKEEP_SQL} FROM site_week
    WINDOW w AS (PARTITION BY site ORDER BY week_start), b4 AS (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
      b8 AS (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), a4 AS (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""",
    needs="site_week",
)
def panel_upkeep(t):
    """A panel written before one week in fifty was revised, brought up to date from these weeks alone."""
    now = t.once("site_week").select("site", "week_start", "cases_a", "cases_b")
    revised = F.pmod(F.xxhash64("site", "week_start"), F.lit(50)) == 0
    before = now.withColumn("cases_a", F.col("cases_a") + F.when(revised, 1).otherwise(0))
    path, build = shared_folder(t.spark, "case_panel"), upkeep.case_panel()
    upkeep.write_panel(before, path, build, F.year)
    upkeep.refresh(now, path, now.where(revised), build, F.year)
    return t.spark.read.parquet(path).drop("part")
