"""Pivots, unpivots, unions of history and future on the test tables."""

from pyspark.sql import functions as F

from biotope.operators import metrics, reshape, rollups
from biotope.workload.registry import bind

WEEKS = range(1, 54)


def wide_weeks(t):
    """Site x ISO year rows with one column per week and a total, as the sheets of a case workbook."""
    keyed = t.site_week.select(
        "site",
        F.extract(F.lit("YEAROFWEEK"), "week_start").alias("iso_year"),
        F.weekofyear("week_start").alias("week"),
        "cases_a",
    )
    wide = keyed.groupBy("site", "iso_year").pivot("week", list(WEEKS)).agg(F.first("cases_a"))
    total = sum([F.coalesce(f"`{w}`", F.lit(0)) for w in WEEKS], F.lit(0)).alias("SKUPAJ")
    return wide.select("site", "iso_year", *[F.col(f"`{w}`").alias(f"{w:02d}") for w in WEEKS], total)


LONG_WEEKS_SQL = """SELECT site, CAST(isoyear(week_start) AS INTEGER) AS iso_year,
      CAST(weekofyear(week_start) AS INTEGER) AS iso_week, cases_a AS value FROM site_week"""


def long_weeks(t):
    """All sheets at once: the sheet's year is an id of the row."""
    return reshape.unpivot_week_numbers(wide_weeks(t), ["site", "iso_year", "SKUPAJ"]).where("value is not null")


@bind("unpivot_week_columns", LONG_WEEKS_SQL, needs="site_week")
def unpivot_week_columns(t):
    return long_weeks(t).select("site", "iso_year", "iso_week", "value")


@bind(
    "unpivot_year_columns",
    "SELECT site, year, CAST(population AS DOUBLE) AS value FROM yearly_site",
    needs="yearly_site",
)
def unpivot_year_columns(t):
    """The years of the wide table are those of the data, a calendar's handful."""
    rows = t.once("yearly_site")
    years = [r.year for r in rows.select("year").distinct().orderBy("year").collect()]
    wide = rows.groupBy("site").pivot("year", years).agg(F.first("population").cast("double"))
    named = wide.select("site", *[F.col(f"`{y}`").alias(f"metric_{y}") for y in years])
    return reshape.unpivot_years(named, ["site"], "metric_")


@bind(
    "pivot_parameter",
    """SELECT site, month_start,
      first(value ORDER BY week_start) FILTER (WHERE parameter = 'temp') AS temp,
      first(value ORDER BY week_start) FILTER (WHERE parameter = 'humid') AS humid,
      first(value ORDER BY week_start) FILTER (WHERE parameter = 'rain') AS rain
    FROM (SELECT site, week_start, CAST(date_trunc('month', week_start) AS DATE) AS month_start,
        unnest(['temp', 'humid', 'rain']) AS parameter, unnest([temp_mean, humid_mean, rain_sum]) AS value
      FROM site_week) AS long GROUP BY 1, 2""",
    needs="site_week",
)
def pivot_parameter(t):
    renamed = t.site_week.select(
        "site",
        "week_start",
        F.trunc("week_start", "month").alias("month_start"),
        F.col("temp_mean").alias("temp"),
        F.col("humid_mean").alias("humid"),
        F.col("rain_sum").alias("rain"),
    )
    long = renamed.unpivot(["site", "week_start", "month_start"], ["temp", "humid", "rain"], "parameter", "value")
    return reshape.pivot_values(
        long, ["site", "month_start"], "parameter", ["temp", "humid", "rain"], F.min_by("value", "week_start")
    )


@bind(
    "pivot_availability",
    """SELECT init_month, lead_month, target_month, coalesce(bool_or(family = 'A'), false) AS "has_A",
      coalesce(bool_or(family = 'N'), false) AS "has_N", coalesce(bool_or(family = 'R'), false) AS "has_R",
      min(CASE WHEN family = 'A' THEN cell || '-' || member END) AS "path_A",
      min(CASE WHEN family = 'N' THEN cell || '-' || member END) AS "path_N",
      min(CASE WHEN family = 'R' THEN cell || '-' || member END) AS "path_R",
      bool_or(family = 'A') AND bool_or(family = 'N') AND bool_or(family = 'R') AS has_all_families
    FROM ensemble GROUP BY 1, 2, 3""",
    needs="ensemble",
)
def pivot_availability(t):
    index = t.ensemble.withColumn("path", F.concat_ws("-", F.col("cell").cast("string"), F.col("member").cast("string")))
    return reshape.pivot_availability(
        index, ["init_month", "lead_month", "target_month"], "family", ["A", "N", "R"], "path"
    )


METRIC_SQL = """SELECT split, count(*) AS n, sqrt(avg((target - score) * (target - score))) AS rmse,
      avg(abs(target - score)) AS mae FROM scored GROUP BY 1"""


@bind(
    "melt_metrics",
    f"""SELECT split, metric_name, metric_value FROM (
      SELECT split, unnest(['rmse', 'mae']) AS metric_name, unnest([rmse, mae]) AS metric_value FROM ({METRIC_SQL}) AS m
    ) AS long""",
    needs="scored",
    rounded="metric_value",
)
def melt_metrics(t):
    wide = metrics.regression_metrics(t.scored, "target", "score", ["split"])
    return reshape.melt_metrics(wide, ["split"], ["rmse", "mae"])


@bind(
    "history_future_union",
    """WITH p AS (SELECT scenario, year + 10 AS year, rate_a + 5 AS value, temp FROM scenario_year),
      h AS (SELECT year, rate_a AS value FROM scenario_year WHERE scenario = '5-LOW')
    SELECT * FROM (
      SELECT scenario, CAST(year AS INTEGER) AS year, value, CAST(NULL AS DOUBLE) AS temp, 'observed' AS role
      FROM h CROSS JOIN (SELECT DISTINCT scenario FROM p) AS s
      UNION ALL SELECT scenario, CAST(year AS INTEGER), value, temp, 'predicted' FROM p) AS u WHERE year <= 2008""",
    needs="scenario_year",
)
def history_future_union(t):
    s = t.once("scenario_year")
    predictions = s.select("scenario", (F.col("year") + 10).alias("year"), (F.col("rate_a") + 5).alias("value"), "temp")
    history = s.where("scenario = '5-LOW'").select("year", F.col("rate_a").alias("value"))
    return reshape.history_and_future(history, predictions, "scenario", "year", F.lit(2008))


@bind(
    "split_future_backtest",
    """SELECT init_month, target_month, CASE WHEN target_month > (SELECT max(month_start) FROM month_cases)
      THEN 'future' ELSE 'backtest' END AS scope, count(*) AS members
    FROM ensemble GROUP BY 1, 2, 3""",
    needs="ensemble month_cases",
)
def split_future_backtest(t):
    template = t.ensemble.groupBy("init_month", "target_month").agg(F.count(F.lit(1)).alias("members"))
    last = t.month_cases.agg(F.max("month_start")).scalar()
    return reshape.scope_by_date(template, "target_month", last)


@bind(
    "total_reconciliation",
    f"""WITH l AS ({LONG_WEEKS_SQL}), g AS (
      SELECT iso_year, site, iso_week, CAST(sum(value) AS BIGINT) AS computed_total, count(*) AS cells,
        CAST(grouping(site) * 2 + grouping(iso_week) AS INTEGER) AS grain
      FROM l GROUP BY GROUPING SETS ((iso_year, site), (iso_year, iso_week), (iso_year)))
    SELECT g.*, CASE WHEN grain = 1 THEN computed_total END AS published_total, true AS as_published FROM g""",
    needs="site_week",
)
def total_reconciliation(t):
    """Totals of every sheet at three grains, the site grain against the sheet's own total column."""
    totals = rollups.reconcile_totals(long_weeks(t), "site", "iso_week", "value", ["iso_year"])
    published = wide_weeks(t).select("iso_year", "site", F.col("SKUPAJ").cast("bigint").alias("published_total"))
    joined = totals.join(published, ["iso_year", "site"], "left")
    same = F.col("published_total").isNull() | (F.col("published_total") == F.col("computed_total"))
    return joined.withColumn("as_published", same)
