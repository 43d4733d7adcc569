"""Projections, filters and scalar functions on the test tables."""

from pyspark.sql import functions as F

from biotope.functions import calendar as cal
from biotope.functions import rules, text, weather
from biotope.operators import joins, windows
from biotope.operators.rollups import hourly_to_cell_day
from biotope.sources import gridded
from biotope.workload.registry import bind

FOLD_SQL = (
    "trim(regexp_replace(regexp_replace(upper(strip_accents({0})), '[-/.()]', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@bind("name_normalize", f"SELECT code, {FOLD_SQL.format('raw_name')} AS folded_name FROM names", needs="names")
def name_normalize(t):
    return t.names.select("code", text.fold_name(F.col("raw_name")).alias("folded_name"))


@bind("name_decompose", f"SELECT code, upper(strip_accents(raw_name)) AS plain_name FROM names", needs="names")
def name_decompose(t):
    return t.names.select("code", F.upper(text.strip_marks(F.col("raw_name"))).alias("plain_name"))


@bind(
    "name_alias_resolve",
    """SELECT coalesce(site, '(unmatched)') AS code, site_name AS name, count(*) AS rows
    FROM (SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS wanted FROM customer) AS c
    LEFT JOIN static_site ON wanted = site GROUP BY 1, 2""",
    needs="static_site",
)
def name_alias_resolve(t):
    """Customers name their nation in one of two spellings; those in debt name none we know."""
    key = F.col("c_nationkey").cast("string")
    raw = (
        F.when(F.col("c_acctbal") < 0, "nowhere")
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("Lánd-"), key, F.lit(" (stát)")))
        .otherwise(F.concat(F.lit("Nátion_"), key))
    )
    rows = t.table("customer").select(text.fold_name(raw).alias("folded"))
    aliases = t.static_site.select(
        F.concat(F.lit("LAND "), "site", F.lit(" STAT")).alias("alias"),
        text.fold_name(F.col("site_name")).alias("canonical"),
    )
    reference = t.static_site.select(
        text.fold_name(F.col("site_name")).alias("folded_name"), F.col("site").alias("code"), F.col("site_name").alias("name")
    )
    resolved = joins.resolve_names(rows, "folded", aliases, reference)
    return resolved.groupBy(F.coalesce("code", F.lit("(unmatched)")).alias("code"), "name").agg(
        F.count(F.lit(1)).alias("rows")
    )


CODE_VARIANT_SQL = """CASE WHEN size = 1 THEN '0000' WHEN size = 2 THEN '  ' WHEN size = 3 THEN 'A' || code ELSE code END"""


@bind(
    "code_normalize",
    f"""SELECT code, CASE WHEN regexp_replace(trim(v), '^0+', '') = '' THEN '0'
      ELSE regexp_replace(trim(v), '^0+', '') END AS site_code,
      CAST(TRY_CAST(trim(v) AS BIGINT) AS VARCHAR) AS integer_code
    FROM (SELECT code, {CODE_VARIANT_SQL} AS v FROM names) AS n""",
    needs="names",
)
def code_normalize(t):
    size, code = F.col("size"), F.col("code")
    variant = F.when(size == 1, "0000").when(size == 2, "  ").when(size == 3, F.concat(F.lit("A"), code)).otherwise(code)
    return t.names.select(
        "code", text.site_code(variant).alias("site_code"), text.integer_code(variant).alias("integer_code")
    )


@bind(
    "parse_decimal_comma",
    """SELECT code, CASE WHEN size = 1 OR size = 2 THEN NULL ELSE c / 100.0::DOUBLE END AS number,
      CASE WHEN size = 1 OR size = 2 THEN NULL ELSE CAST(round_even(c / 100.0::DOUBLE, 0) AS BIGINT) END AS whole
    FROM (SELECT code, size, CAST(round(price * 100) AS BIGINT) AS c FROM names) AS n""",
    needs="names",
)
def parse_decimal_comma(t):
    whole = F.round(F.col("price") * 100).cast("bigint")
    written = F.format_string(" %d,%02d ", F.floor(whole / 100), F.pmod(whole, F.lit(100)))
    value = F.when(F.col("size") == 1, "NaN").when(F.col("size") == 2, "n/a").otherwise(written)
    return t.names.select(
        "code", text.decimal_comma(value).alias("number"), text.decimal_comma_int(value).alias("whole")
    )


@bind(
    "parse_case_count",
    """SELECT code, CASE WHEN size = 1 THEN 0 WHEN size > 3 THEN CAST(size AS BIGINT) WHEN size = 2 THEN 2 END AS cases,
      size = 3 AS rejected FROM names""",
    needs="names",
)
def parse_case_count(t):
    size = F.col("size").cast("string")
    written = (
        F.when(F.col("size") == 1, "  ")
        .when(F.col("size") == 2, F.concat(size, F.lit(".0")))
        .when(F.col("size") == 3, F.concat(size, F.lit(".5")))
        .otherwise(size)
    )
    return t.names.select(
        "code", text.case_count(written).alias("cases"), text.bad_case_count(written).alias("rejected")
    )


def token(t):
    size = F.col("size")
    return (
        F.when(size == 1, " NaN ").when(size == 2, "null").when(size == 3, "").when(size == 4, "None").otherwise(
            F.col("brand")
        )
    )


TOKEN_SQL = "CASE WHEN size IN (1, 2, 3, 4) THEN NULL ELSE brand END"


@bind("missing_token", f"SELECT code, {TOKEN_SQL} AS token, size IN (1, 2, 3, 4) AS missing FROM names", needs="names")
def missing_token(t):
    return t.names.select(
        "code", text.null_if_missing(token(t)).alias("token"), text.is_missing(token(t)).alias("missing")
    )


@bind(
    "categorical_fill",
    """SELECT code, CASE size WHEN 1 THEN ' NaN ' WHEN 2 THEN 'null' WHEN 3 THEN '__MISSING__' WHEN 4 THEN 'None'
      ELSE brand END AS category FROM names""",
    needs="names",
)
def categorical_fill(t):
    return t.names.select("code", text.fill_category(token(t)).alias("category"))


@bind(
    "key_slug",
    """SELECT code, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug,
      CASE WHEN s = '' THEN 'unknown' ELSE lower(s) END AS lower_slug
    FROM (SELECT code, CASE WHEN size = 1 THEN ''
        ELSE trim(regexp_replace(raw_name, '[^0-9A-Za-z]+', '_', 'g'), '_') END AS s FROM names) AS n""",
    needs="names",
)
def key_slug(t):
    value = F.when(F.col("size") == 1, " -- ").otherwise(F.col("raw_name"))
    return t.names.select(
        "code", text.key_slug(value).alias("slug"), text.key_slug(value, lower=True).alias("lower_slug")
    )


@bind("grid_key", "SELECT pixel_id, printf('%.4f|%.4f', 46 + y, 14 + x) AS grid_key FROM pixels", needs="pixels")
def grid_key(t):
    return t.pixels.select("pixel_id", weather.grid_key(46 + F.col("y"), 14 + F.col("x")).alias("grid_key"))


@bind(
    "axis_edges",
    """SELECT value, value - coalesce(value - b, a - value) / 2 AS edge_low,
      value + coalesce(a - value, value - b) / 2 AS edge_high
    FROM (SELECT value, lag(value) OVER (ORDER BY value) AS b, lead(value) OVER (ORDER BY value) AS a
      FROM (SELECT DISTINCT floor(x * 50) / 50 + 0.0 AS value FROM pixels) AS d) AS w""",
    needs="pixels",
    rounded="value edge_low edge_high",
)
def axis_edges(t):
    axis = t.pixels.select((F.floor(F.col("x") * 50) / 50 + 0.0).alias("value")).distinct()
    return gridded.axis_edges(axis, "value")


@bind(
    "unit_convert",
    """SELECT month_start, temp * 10 - 273.15::DOUBLE AS celsius, rain / 1000 * 1000.0::DOUBLE AS mm,
      rain / 1000000000 * (1000.0::DOUBLE * 86400.0::DOUBLE) * day(last_day(month_start)) AS monthly_mm,
      rain * day(last_day(month_start)) AS monthly_total
    FROM month_cases""",
    needs="month_cases",
    rounded="celsius mm monthly_mm monthly_total",
)
def unit_convert(t):
    rain, month = F.col("rain"), F.col("month_start")
    return t.month_cases.select(
        "month_start",
        weather.kelvin_to_celsius(F.col("temp") * 10).alias("celsius"),
        weather.metres_to_mm(rain / 1000).alias("mm"),
        weather.rate_to_monthly_mm(rain / 1000000000, month).alias("monthly_mm"),
        weather.daily_to_monthly(rain, month).alias("monthly_total"),
    )


@bind(
    "relative_humidity",
    """SELECT grid_key, time, greatest(least(100 * exp(17.625::DOUBLE * d / (243.04::DOUBLE + d)
        - 17.625::DOUBLE * a / (243.04::DOUBLE + a)), 100), 0)::DOUBLE AS humidity
    FROM (SELECT grid_key, time, air_temperature_c AS a, soil_temperature_1_c + 5 AS d FROM hourly) AS h""",
    needs="hourly",
    rounded="humidity",
)
def relative_humidity(t):
    dew = F.col("soil_temperature_1_c") + 5
    return t.hourly.select(
        "grid_key", "time", weather.relative_humidity(F.col("air_temperature_c"), dew).alias("humidity")
    )


HOUR_FLAGS_SQL = """CAST(relative_humidity_pct >= 80 AS INTEGER) AS humid_hour_80,
      CAST(relative_humidity_pct >= 90 AS INTEGER) AS humid_hour_90,
      CAST(precipitation_mm >= 0.1::DOUBLE AS INTEGER) AS wet_hour,
      CAST(air_temperature_c BETWEEN 7 AND 25 AND relative_humidity_pct >= 80 AS INTEGER) AS activity_hour,
      greatest(air_temperature_c - 5, 0)::DOUBLE AS degree_hours"""


@bind("hour_threshold_flags", f"SELECT grid_key, time, {HOUR_FLAGS_SQL} FROM hourly", needs="hourly", rounded="degree_hours")
def hour_threshold_flags(t):
    flags = weather.hour_flags(F.col("air_temperature_c"), F.col("relative_humidity_pct"), F.col("precipitation_mm"))
    return t.hourly.select("grid_key", "time", *[c.alias(n) for n, c in flags.items()])


@bind(
    "day_threshold_flags",
    """SELECT grid_key, day, CAST(rain >= 1 AS INTEGER) AS rainy_day, CAST(humid >= 16 AS INTEGER) AS humid_day,
      CAST(active >= 6 AS INTEGER) AS favorable_day
    FROM (SELECT grid_key, CAST(time AS DATE) AS day, sum(precipitation_mm) AS rain,
        count(*) FILTER (WHERE relative_humidity_pct >= 80) AS humid,
        count(*) FILTER (WHERE air_temperature_c BETWEEN 7 AND 25 AND relative_humidity_pct >= 80) AS active
      FROM hourly GROUP BY 1, 2) AS days""",
    needs="hourly",
)
def day_threshold_flags(t):
    days = hourly_to_cell_day(t.hourly)
    flags = weather.day_flags(F.col("rain_sum"), F.col("humid_hours_80"), F.col("activity_hours"))
    return days.select("grid_key", "day", *[c.alias(n) for n, c in flags.items()])


@bind(
    "rate_per_100k",
    """SELECT site, year, CASE WHEN p > 0 THEN density / p * 100000 END AS rate
    FROM (SELECT *, population - 2000 AS p FROM yearly_site) AS y""",
    needs="yearly_site",
    rounded="rate",
)
def rate_per_100k(t):
    return t.yearly_site.select(
        "site", "year", rules.per_100k(F.col("density"), F.col("population") - 2000).alias("rate")
    )


@bind(
    "weight_transform",
    """WITH w AS (SELECT doc_id, ln(1 + feature) AS by_log, CASE WHEN score > 0.5 THEN exp(score) - 1 END AS by_exp,
        CASE WHEN feature > 100 THEN feature END AS by_value FROM rated)
    SELECT doc_id, by_log / (SELECT avg(by_log) FROM w) AS log_weight,
      by_exp / (SELECT avg(by_exp) FROM w) AS exp_weight, by_value / (SELECT avg(by_value) FROM w) AS plain_weight
    FROM w""",
    needs="rated",
    rounded="log_weight exp_weight plain_weight",
)
def weight_transform(t):
    """Weights divided by their overall mean, which is one number from its own aggregate."""
    w = t.rated.select(
        "doc_id",
        rules.weight(F.col("feature"), "log1p").alias("by_log"),
        rules.weight(F.when(F.col("score") > 0.5, F.col("score")), "expm1").alias("by_exp"),
        rules.weight(F.when(F.col("feature") > 100, F.col("feature"))).alias("by_value"),
    )
    mean = w.agg(F.avg("by_log").alias("l"), F.avg("by_exp").alias("e"), F.avg("by_value").alias("v"))
    placed = w.withColumn("mean", mean.select(F.struct("*")).scalar())
    return placed.select(
        "doc_id",
        (F.col("by_log") / F.col("mean.l")).alias("log_weight"),
        (F.col("by_exp") / F.col("mean.e")).alias("exp_weight"),
        (F.col("by_value") / F.col("mean.v")).alias("plain_weight"),
    )


@bind(
    "iso_week_bounds",
    """SELECT iso_year, iso_week, monday AS week_start, monday + 6 AS week_end,
      CASE WHEN isoyear(w53) = iso_year THEN w53 END AS week_53_start, rows
    FROM (SELECT iso_year, iso_week, rows,
        CAST(date_trunc('week', make_date(iso_year, 1, 4)) AS DATE) + CAST((iso_week - 1) * 7 AS INTEGER) AS monday,
        CAST(date_trunc('week', make_date(iso_year, 1, 4)) AS DATE) + 364 AS w53
      FROM (SELECT CAST(isoyear(order_day) AS INTEGER) AS iso_year, CAST(weekofyear(order_day) AS INTEGER) AS iso_week,
          count(*) AS rows FROM order_sites GROUP BY 1, 2) AS k) AS b""",
    needs="order_sites",
)
def iso_week_bounds(t):
    keys = t.order_sites.groupBy(
        cal.iso_year(F.col("order_day")).alias("iso_year"), F.weekofyear("order_day").alias("iso_week")
    ).agg(F.count(F.lit(1)).alias("rows"))
    start = cal.iso_week_start(F.col("iso_year"), F.col("iso_week"))
    return keys.select(
        "*",
        start.alias("week_start"),
        cal.week_end(start).alias("week_end"),
        cal.iso_week_start(F.col("iso_year"), F.lit(53)).alias("week_53_start"),
    )


@bind(
    "week_bucket_any_start",
    "SELECT order_day, "
    + ", ".join(
        f"order_day - CAST((isodow(order_day) - 1 - {k} + 7) % 7 AS INTEGER) AS week_{d.lower()}"
        for d, k in cal.WEEKDAYS.items()
    )
    + ", order_day - CAST((isodow(order_day) - 1 - 6 + 7) % 7 AS INTEGER) + 6 AS week_sun_end, count(*) AS rows"
    " FROM order_sites GROUP BY order_day",
    needs="order_sites",
)
def week_bucket_any_start(t):
    days = t.order_sites.groupBy("order_day").agg(F.count(F.lit(1)).alias("rows"))
    starts = {f"week_{d.lower()}": cal.week_start(F.col("order_day"), d) for d in cal.WEEKDAYS}
    starts["week_sun_end"] = cal.week_end(starts["week_sun"])
    return windows.with_columns(days, starts)


CALENDAR_SQL = """CAST(year(week_start) AS INTEGER) AS year, CAST(month(week_start + 3) AS INTEGER) AS month,
      CAST(isoyear(week_start) AS INTEGER) AS iso_year, CAST(weekofyear(week_start) AS INTEGER) AS iso_week,
      sin(weekofyear(week_start) * (2 * pi() / 52.1775::DOUBLE)) AS week_of_year_sin,
      cos(weekofyear(week_start) * (2 * pi() / 52.1775::DOUBLE)) AS week_of_year_cos"""


@bind(
    "calendar_features",
    f"SELECT site, week_start, {CALENDAR_SQL} FROM site_week",
    needs="site_week",
    rounded="week_of_year_sin week_of_year_cos",
)
def calendar_features(t):
    return windows.with_columns(
        t.site_week.select("site", "week_start"), cal.calendar_features(F.col("week_start"))
    )


@bind(
    "annual_phase",
    """SELECT order_day, sin((dayofyear(order_day) - 1) * (2 * pi() / 365.2425::DOUBLE)) AS phase_sin,
      cos((dayofyear(order_day) - 1) * (2 * pi() / 365.2425::DOUBLE)) AS phase_cos, count(*) AS rows
    FROM order_sites GROUP BY 1, 2, 3""",
    needs="order_sites",
    rounded="phase_sin phase_cos",
)
def annual_phase(t):
    days = t.order_sites.groupBy("order_day").agg(F.count(F.lit(1)).alias("rows"))
    sine, cosine = cal.annual_phase(F.col("order_day"))
    return days.select("*", sine.alias("phase_sin"), cosine.alias("phase_cos"))


@bind(
    "midpoint_period",
    """SELECT site, week_start, CAST(date_trunc('month', week_start + 3) AS DATE) AS month_start,
      CAST(year(week_start + 3) AS INTEGER) AS mid_year,
      sin(month(week_start + 3) * (2 * pi() / 12)) AS month_sin, cos(month(week_start + 3) * (2 * pi() / 12)) AS month_cos
    FROM site_week""",
    needs="site_week",
    rounded="month_sin month_cos",
)
def midpoint_period(t):
    start = F.col("week_start")
    sine, cosine = cal.month_phase(F.month(cal.midpoint(start)))
    return t.site_week.select(
        "site",
        "week_start",
        cal.midpoint_month(start).alias("month_start"),
        cal.midpoint_year(start).alias("mid_year"),
        sine.alias("month_sin"),
        cosine.alias("month_cos"),
    )


@bind(
    "period_end",
    """SELECT month_start, last_day(month_start) AS month_end, make_date(year, 1, 1) AS year_start,
      make_date(year, 12, 31) AS year_end FROM month_cases""",
    needs="month_cases",
)
def period_end(t):
    first, last = cal.year_bounds(F.col("year"))
    return t.month_cases.select(
        "month_start", cal.month_end(F.col("month_start")).alias("month_end"), first.alias("year_start"), last.alias("year_end")
    )


@bind(
    "reference_week",
    """SELECT order_day AS as_of, CAST(s AS DATE) AS reference_start, CAST(s AS DATE) + 6 AS reference_end,
      CAST(s AS DATE) - 35 AS history_start, count(*) AS rows
    FROM (SELECT order_day, CAST(date_trunc('week', order_day + 1) AS DATE) - 7 AS s FROM order_sites) AS d
    GROUP BY 1, 2, 3, 4""",
    needs="order_sites",
)
def reference_week(t):
    days = t.order_sites.groupBy(F.col("order_day").alias("as_of")).agg(F.count(F.lit(1)).alias("rows"))
    start, end, history = cal.reference_window(F.col("as_of"))
    return days.select(
        "*", start.alias("reference_start"), end.alias("reference_end"), history.alias("history_start")
    )


@bind(
    "lead_target_month",
    """SELECT init_month, lead_month, CAST(init_month + to_months(lead_month) AS DATE) AS target_month,
      CAST(init_month + to_months(lead_month) AS DATE) BETWEEN (SELECT min(month_start) FROM month_cases)
        AND (SELECT max(month_start) FROM month_cases) AS in_window, count(*) AS members
    FROM ensemble GROUP BY 1, 2, 3, 4""",
    needs="ensemble month_cases",
)
def lead_target_month(t):
    keys = t.ensemble.groupBy("init_month", "lead_month").agg(F.count(F.lit(1)).alias("members"))
    span = t.month_cases.agg(F.struct(F.min("month_start").alias("a"), F.max("month_start").alias("b")))
    target = cal.target_month(F.col("init_month"), F.col("lead_month"))
    placed = keys.withColumn("span", span.scalar())
    return placed.select(
        "init_month",
        "lead_month",
        target.alias("target_month"),
        target.between(F.col("span.a"), F.col("span.b")).alias("in_window"),
        "members",
    )


@bind(
    "classify_level",
    """SELECT doc_id, CASE WHEN score < 0.4 THEN 'Low' WHEN score < 0.7 THEN 'Medium' ELSE 'High' END AS level
    FROM rated""",
    needs="rated",
)
def classify_level(t):
    return t.rated.select("doc_id", rules.level(F.col("score"), F.lit(0.4), F.lit(0.7)).alias("level"))


@bind(
    "trend_label",
    """SELECT trend, count(*) AS rows FROM (
      SELECT CASE WHEN d > 0 THEN '+' || d || ' točk glede na prejšnji teden'
        WHEN d < 0 THEN d || ' točk glede na prejšnji teden'
        ELSE 'brez spremembe glede na prejšnji teden' END AS trend
      FROM (SELECT cases_a - lag(cases_a) OVER (PARTITION BY site ORDER BY week_start) AS d FROM site_week) AS x
      WHERE d IS NOT NULL) AS y GROUP BY 1""",
    needs="site_week",
)
def trend_label(t):
    w = windows.over_panel("site", "week_start")
    deltas = t.site_week.select((F.col("cases_a") - F.lag("cases_a").over(w)).alias("delta")).where("delta is not null")
    return deltas.groupBy(rules.trend_label(F.col("delta")).alias("trend")).agg(F.count(F.lit(1)).alias("rows"))


EVIDENCE_STATS_SQL = """SELECT site, CASE WHEN region_name IN ('ASIA', 'EUROPE') THEN 'core' ELSE 'local' END AS group_class,
        100.0::DOUBLE * count(*) FILTER (WHERE cases_b > 1) / count(*) AS coverage,
        avg(cases_a) FILTER (WHERE year(week_start) < 2001) - avg(cases_b) FILTER (WHERE year(week_start) < 2001) AS effect,
        100.0::DOUBLE * count(*) FILTER (WHERE cases_a >= cases_b) / count(*) AS helpful,
        avg(cases_a) FILTER (WHERE year(week_start) >= 2001) - avg(cases_b) FILTER (WHERE year(week_start) >= 2001) AS holdout
      FROM site_week JOIN static_site USING (site) GROUP BY 1, 2"""


@bind(
    "evidence_labels",
    f"""WITH s AS ({EVIDENCE_STATS_SQL}), e AS (SELECT *, CASE WHEN group_class = 'core' AND coverage >= 95 THEN 'national_coverage'
        WHEN coverage < 10 THEN 'exploratory_low_coverage' WHEN coverage < 25 THEN 'partial_local_coverage'
        WHEN coverage < 95 THEN 'moderate_subnational_coverage' ELSE 'broad_coverage' END AS coverage_label FROM s)
    SELECT site, group_class, coverage_label,
      CASE WHEN group_class = 'core' THEN CASE WHEN effect > 0 AND helpful >= 75 THEN 'stable_core_signal'
          WHEN effect > 0 THEN 'mixed_core_signal' ELSE 'not_stably_useful' END
        WHEN effect > 0 AND helpful >= 75 THEN CASE WHEN coverage_label = 'exploratory_low_coverage'
          THEN 'exploratory_positive_local_signal' ELSE 'promising_local_signal' END
        WHEN effect > 0 THEN 'weak_or_mixed_local_signal' ELSE 'no_stable_added_value' END AS development_label,
      CASE WHEN effect > 0 AND holdout > 0 THEN 'confirmed_on_holdout' WHEN effect > 0 THEN 'did_not_confirm_on_holdout'
        WHEN holdout > 0 THEN 'holdout_positive_but_not_dev_stable' ELSE 'consistently_not_helpful' END AS confirmation
    FROM e""",
    needs="site_week static_site",
)
def evidence_labels(t):
    core = F.when(F.col("region_name").isin("ASIA", "EUROPE"), "core").otherwise("local")
    early = F.year("week_start") < 2001
    a, b = F.col("cases_a"), F.col("cases_b")

    def gap(condition):
        return F.avg(F.when(condition, a)) - F.avg(F.when(condition, b))

    stats = t.site_week.join(t.static_site, "site").groupBy("site", core.alias("group_class")).agg(
        (100.0 * F.count_if(b > 1) / F.count(F.lit(1))).alias("coverage"),
        gap(early).alias("effect"),
        (100.0 * F.count_if(a >= b) / F.count(F.lit(1))).alias("helpful"),
        gap(~early).alias("holdout"),
    )
    evidence = rules.coverage_evidence(F.col("coverage"), F.col("group_class"))
    labelled = stats.withColumn("coverage_label", evidence)
    return labelled.select(
        "site",
        "group_class",
        "coverage_label",
        rules.development_signal(
            F.col("effect"), F.col("helpful"), F.col("group_class"), F.col("coverage_label")
        ).alias("development_label"),
        rules.holdout_confirmation(F.col("effect"), F.col("holdout")).alias("confirmation"),
    )


# Column names put in front of the brands to give the rules something to match.
REGISTRY_KEYS = (
    ("obcina_sifra", False), ("week_start", False), ("iso_week", False), ("lyme_cases", False),
    ("overlay_method", False), ("has_arso_local", False), ("tick_activity_", True), ("arso_precipitation_sum_mm", False),
    ("arso_", True), ("gozdis_relative_humidity_", True), ("gozdis_", True),
    ("gozdis_relative_humidity_mean_pct", False), ("gozdis_air_temperature_max_c", False), ("obrod_species_", True), ("obrod_", True),
    ("elevation_", True), ("population_total", False), ("dominant_clc_code", False), ("forest_cover_pct", False),
    ("air_temperature_", True), ("humidity_hours_", True), ("precipitation_", True), ("soil_water_", True),
    ("lyme_cases_", True), ("wind_", True), ("other_", True),
)


@bind(
    "rule_classify",
    f"""WITH k AS (SELECT [{', '.join(f"'{n}'" for n, _ in REGISTRY_KEYS)}][size % {len(REGISTRY_KEYS)} + 1]
        || CASE WHEN [{', '.join(str(int(s)) for _, s in REGISTRY_KEYS)}][size % {len(REGISTRY_KEYS)} + 1] = 1
          THEN lower(replace(brand, '#', '_')) ELSE '' END AS key, * FROM names)
    SELECT key, count(*) AS rows,
      CASE WHEN key = 'obcina_sifra' OR key = 'week_start' THEN 'panel_index'
        WHEN key IN ('iso_week', 'overlay_method', 'has_arso_local') THEN 'pipeline' WHEN key = 'lyme_cases' THEN 'nijz'
        WHEN key LIKE 'arso%' THEN 'arso' WHEN key LIKE 'gozdis%' THEN 'gozdis' WHEN key LIKE 'obrod%' THEN 'obrod'
        WHEN key LIKE 'lyme_cases_%' OR key LIKE 'wind%' OR key LIKE 'other%' THEN 'unclassified'
        ELSE 'copernicus' END AS source_group,
      CASE WHEN key = 'obcina_sifra' THEN 'location_key' WHEN key = 'week_start' THEN 'time_index'
        WHEN key = 'iso_week' THEN 'raw_calendar_control' WHEN key = 'lyme_cases' THEN 'current_epidemiology'
        WHEN key = 'overlay_method' THEN 'processing_metadata' WHEN key = 'has_arso_local' THEN 'coverage_flag'
        WHEN key LIKE 'tick_activity%' THEN 'retired_tick_activity_proxy'
        WHEN key = 'arso_precipitation_sum_mm' THEN 'local_precipitation'
        WHEN key = 'gozdis_relative_humidity_mean_pct' THEN 'local_humidity'
        WHEN key = 'gozdis_air_temperature_max_c' THEN 'local_temperature'
        WHEN key LIKE 'arso%' OR key LIKE 'gozdis%' THEN 'local_weather'
        WHEN key LIKE 'obrod_species%' THEN 'local_forestry_species_detail'
        WHEN key LIKE 'obrod%' THEN 'local_forestry_summary' WHEN key LIKE 'elevation%' THEN 'topography'
        WHEN key = 'population_total' THEN 'population'
        WHEN key IN ('dominant_clc_code', 'forest_cover_pct') THEN 'land_cover'
        WHEN key LIKE 'air_temperature%' THEN 'weather_temperature' WHEN key LIKE 'humidity_hours%' THEN 'weather_humidity'
        WHEN key LIKE 'precipitation%' THEN 'weather_precipitation' WHEN key LIKE 'soil_water%' THEN 'weather_soil'
        ELSE 'review_needed' END AS feature_family,
      CASE WHEN key = 'obcina_sifra' THEN 'group_only' WHEN key = 'week_start' THEN 'index_only'
        WHEN key = 'iso_week' THEN 'replace_with_hidden_time_control' WHEN key = 'lyme_cases' THEN 'target_source_only'
        WHEN key = 'overlay_method' THEN 'exclude_metadata' WHEN key = 'has_arso_local' THEN 'exclude_coverage_flag'
        WHEN key LIKE 'tick_activity%' THEN 'exclude_retired_tick_activity_proxy'
        WHEN key LIKE 'obrod_species%' THEN 'exclude_sparse_detail'
        WHEN key LIKE 'arso%' OR key LIKE 'gozdis%' OR key LIKE 'obrod%' THEN 'include_local_optional'
        WHEN key LIKE 'lyme_cases_%' OR key LIKE 'wind%' OR key LIKE 'other%' THEN 'review'
        ELSE 'include_core_predictor' END AS feature_action,
      CASE WHEN key IN ('obcina_sifra', 'lyme_cases') OR key LIKE 'lyme_cases_%' OR key LIKE 'wind%' OR key LIKE 'other%'
          THEN 'high'
        WHEN key IN ('iso_week', 'has_arso_local', 'dominant_clc_code') OR key LIKE 'obrod_species%' THEN 'medium'
        ELSE 'low' END AS review_priority,
      CASE WHEN key LIKE 'lyme\\_cases\\_%' ESCAPE '\\' THEN 'history' WHEN key = 'iso_week' THEN 'seasonality'
        WHEN key LIKE '%temperature%' OR key LIKE '%precip%' OR key LIKE '%humidity%' OR key LIKE '%wind%' THEN 'climate'
        WHEN key LIKE 'elevation%' THEN 'terrain' WHEN key LIKE '%cover_pct%' OR key LIKE '%clc%' THEN 'land_cover'
        WHEN key LIKE '%population%' OR key LIKE '%obcina%' THEN 'demography' ELSE 'other' END AS report_family,
      CASE WHEN key = 'obcina_sifra' THEN 'optional_predictive_only' WHEN key = 'week_start' THEN 'index_only'
        WHEN key = 'iso_week' THEN 'replace_with_hidden_time_control' WHEN key = 'lyme_cases' THEN 'target_source_only'
        WHEN key = 'overlay_method' THEN 'exclude_metadata' WHEN key = 'has_arso_local' THEN 'review_missingness_proxy'
        WHEN key LIKE 'tick_activity%' THEN 'exclude_retired_tick_activity_proxy'
        WHEN key LIKE 'obrod_species%' THEN 'review_sparse_detail'
        WHEN key LIKE 'arso%' OR key LIKE 'gozdis%' OR key LIKE 'obrod%' THEN 'include_local_optional'
        WHEN key LIKE 'lyme_cases_%' OR key LIKE 'wind%' OR key LIKE 'other%' THEN 'review'
        ELSE 'include_core_predictor' END AS forecasting_action,
      CASE WHEN key = 'arso_precipitation_sum_mm' THEN 'arso_precipitation'
        WHEN key = 'gozdis_relative_humidity_mean_pct' THEN 'gozdis_humidity'
        WHEN key = 'gozdis_air_temperature_max_c' THEN 'gozdis_temperature'
        WHEN key LIKE 'arso%' OR key LIKE 'gozdis%' THEN 'local_weather_unclassified'
        WHEN key LIKE 'obrod_species%' THEN 'not_in_graph' WHEN key LIKE 'obrod%' THEN 'obrod_summary'
        WHEN key LIKE 'elevation%' THEN 'topography' WHEN key = 'population_total' THEN 'population'
        WHEN key IN ('dominant_clc_code', 'forest_cover_pct') THEN 'land_cover'
        WHEN key LIKE 'air_temperature%' THEN 'copernicus_temperature' WHEN key LIKE 'humidity_hours%' THEN 'copernicus_humidity'
        WHEN key LIKE 'precipitation%' THEN 'copernicus_precipitation' WHEN key LIKE 'soil_water%' THEN 'copernicus_soil'
        WHEN key LIKE 'lyme\\_cases\\_%' ESCAPE '\\' OR key LIKE 'wind%' OR key LIKE 'other%' THEN 'review_needed'
        ELSE 'not_in_graph' END AS graph_group,
      CASE WHEN key IN ('obcina_sifra', 'week_start') THEN 'weekly_panel_index' WHEN key = 'iso_week' THEN 'derived_from_week_index'
        WHEN key = 'lyme_cases' THEN 'weekly_direct' WHEN key = 'overlay_method' THEN 'mixed_support_metadata'
        WHEN key = 'has_arso_local' THEN 'source_availability_marker' WHEN key LIKE 'arso%' THEN 'monthly_to_weekly'
        WHEN key LIKE 'gozdis%' THEN 'weekly_local_direct' WHEN key LIKE 'obrod%' THEN 'yearly_to_weekly'
        WHEN key LIKE 'elevation%' OR key IN ('dominant_clc_code', 'forest_cover_pct') THEN 'static_repeated_to_week'
        WHEN key = 'population_total' THEN 'yearly_repeated_to_week'
        WHEN key LIKE 'lyme\\_cases\\_%' ESCAPE '\\' OR key LIKE 'wind%' OR key LIKE 'other%' THEN 'review_needed'
        ELSE 'weekly_direct_or_precomputed_history' END AS time_alignment
    FROM k GROUP BY key""",
    needs="names",
)
def rule_classify(t):
    place = F.pmod(F.col("size"), F.lit(len(REGISTRY_KEYS)))
    stem = F.get(F.array(*[F.lit(n) for n, _ in REGISTRY_KEYS]), place)
    open_ended = F.get(F.array(*[F.lit(s) for _, s in REGISTRY_KEYS]), place)
    brand = F.lower(F.replace(F.col("brand"), F.lit("#"), F.lit("_")))
    keys = t.names.groupBy(F.concat(stem, F.when(open_ended, brand).otherwise("")).alias("key")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    key = F.col("key")
    return windows.with_columns(
        keys,
        {**rules.registry_flags(key), "report_family": rules.first_rule(key, rules.REPORT_FAMILY_RULES, "other")},
    )


@bind(
    "code_subset",
    "SELECT doc_id, site, split, score FROM rated WHERE split IN ('validation', 'test') AND site IN ('src1', 'src5', 'src9', 'src12')",
    needs="rated",
)
def code_subset(t):
    holdout = t.rated.where(F.col("split").isin("validation", "test"))
    return holdout.where(F.col("site").isin("src1", "src5", "src9", "src12")).select("doc_id", "site", "split", "score")


@bind(
    "drop_retired_columns",
    "SELECT site, week_start, line_count, cases_a, cases_b, temp_mean, humid_mean, rain_sum FROM site_week",
    needs="site_week",
)
def drop_retired_columns(t):
    return t.site_week.drop("temp_min", "temp_max", "not_there")


PANEL_YEAR_SQL = """SELECT s.site, week_start, cases_a, population, density, elevation_mean, region_name,
      CASE WHEN cases_b > 2 THEN humid_mean END AS local_humidity
    FROM site_week s LEFT JOIN yearly_site y ON s.site = y.site AND year(week_start) = y.year
    LEFT JOIN static_site p ON s.site = p.site"""


def panel_with_sources(t):
    weekly = t.site_week.select(
        "site",
        "week_start",
        "cases_a",
        F.year("week_start").alias("year"),
        F.when(F.col("cases_b") > 2, F.col("humid_mean")).alias("local_humidity"),
    )
    static = t.static_site.select("site", "elevation_mean", "region_name")
    return joins.static_join(joins.static_join(weekly, t.yearly_site, ["site", "year"]), static, "site").drop("year")


@bind(
    "source_presence",
    f"""SELECT site, week_start, CAST(population IS NOT NULL OR density IS NOT NULL AS INTEGER) AS has_census,
      CAST(local_humidity IS NOT NULL AS INTEGER) AS has_local,
      CAST(population IS NOT NULL OR density IS NOT NULL AS INTEGER) + CAST(local_humidity IS NOT NULL AS INTEGER)
        AS sources_present_count
    FROM ({PANEL_YEAR_SQL}) AS p""",
    needs="site_week yearly_site static_site",
)
def source_presence(t):
    census = rules.present([F.col("population"), F.col("density")])
    local = rules.present([F.col("local_humidity")])
    return panel_with_sources(t).select(
        "site", "week_start", census.alias("has_census"), local.alias("has_local"), (census + local).alias("sources_present_count")
    )


@bind(
    "row_any_all_null",
    f"""SELECT site, week_start, population IS NOT NULL OR local_humidity IS NOT NULL AS any_present,
      population IS NOT NULL AND local_humidity IS NOT NULL AND elevation_mean IS NOT NULL AS all_present
    FROM ({PANEL_YEAR_SQL}) AS p""",
    needs="site_week yearly_site static_site",
)
def row_any_all_null(t):
    return panel_with_sources(t).select(
        "site",
        "week_start",
        rules.any_present([F.col("population"), F.col("local_humidity")]).alias("any_present"),
        rules.all_present([F.col("population"), F.col("local_humidity"), F.col("elevation_mean")]).alias("all_present"),
    )


@bind(
    "status_note",
    f"""SELECT init_month, target_month, CASE WHEN n AND a AND r THEN '{rules.NOTE_FULL}'
      WHEN n THEN '{rules.NOTE_TEMPERATURE_ONLY}' ELSE '{rules.NOTE_NOT_READY}' END AS note
    FROM (SELECT init_month, target_month, bool_or(family = 'N') AS n, bool_or(family = 'A') AS a, bool_or(family = 'R') AS r
      FROM ensemble GROUP BY 1, 2) AS f""",
    needs="ensemble",
)
def status_note(t):
    def has(family):
        return F.max(F.when(F.col("family") == family, True))

    flags = t.ensemble.groupBy("init_month", "target_month").agg(
        has("N").alias("n"), (has("N") & has("A") & has("R")).alias("core")
    )
    return flags.select("init_month", "target_month", rules.extraction_note(F.col("core"), F.col("n")).alias("note"))


@bind("nonnegative_clip", "SELECT c_custkey, greatest(c_acctbal, 0)::DOUBLE AS clipped FROM customer")
def nonnegative_clip(t):
    return t.table("customer").select("c_custkey", rules.nonnegative(F.col("c_acctbal")).alias("clipped"))


@bind(
    "rename_map",
    "SELECT month_start, temp AS air_temperature_c_mean, rain AS precipitation_sum_mm, rate_a FROM month_cases",
    needs="month_cases",
)
def rename_map(t):
    from biotope.operators.reshape import rename

    names = {"temp": "air_temperature_c_mean", "rain": "precipitation_sum_mm", "absent": "unused"}
    return rename(t.month_cases.select("month_start", "temp", "rain", "rate_a"), names)


@bind(
    "scenario_family",
    """SELECT year, family, CAST(family = 'high_emissions' AS DOUBLE) AS is_high, count(*) AS scenarios
    FROM (SELECT year, CASE scenario WHEN '1-URGENT' THEN 'high_emissions' WHEN '2-HIGH' THEN 'high_emissions'
        WHEN '3-MEDIUM' THEN 'medium_emissions' WHEN '5-LOW' THEN 'historical' ELSE scenario END AS family
      FROM scenario_year) AS s GROUP BY 1, 2, 3""",
    needs="scenario_year",
)
def scenario_family(t):
    experiments = {"1-URGENT": "rcp_8_5", "2-HIGH": "ssp5_8_5", "3-MEDIUM": "ssp2_4_5", "5-LOW": "historical"}
    named = t.scenario_year.replace(experiments, subset=["scenario"])
    family = rules.scenario_family(F.col("scenario"))
    return (
        named.withColumn("family", family)
        .groupBy("year", "family", rules.indicator(F.col("family") == "high_emissions").alias("is_high"))
        .agg(F.count(F.lit(1)).alias("scenarios"))
    )


@bind(
    "merge_versions",
    """SELECT user_id, day, first(value ORDER BY version, value) AS value, min(version) AS used_version
    FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, value,
        CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS INTEGER) AS version
      FROM events WHERE event_type <> 'error') AS v GROUP BY 1, 2
    UNION ALL SELECT user_id, CAST(ts AS DATE), NULL, NULL FROM events GROUP BY 1, 2 HAVING bool_and(event_type = 'error')""",
)
def merge_versions(t):
    """Events of a user and day as versions of one value; an error carries none."""
    kind = F.col("event_type")
    version = F.when(kind == "purchase", 1).when(kind == "click", 2).otherwise(3)
    rows = t.table("events").select(
        "user_id",
        F.to_date("ts").alias("day"),
        F.when(kind != "error", F.col("value")).alias("value"),
        version.alias("version"),
    )
    return gridded.prefer_final(rows, ["user_id", "day"], "value", "version")


@bind(
    "feature_vector",
    """SELECT s.site, week_start, temp_mean, coalesce(CASE WHEN cases_a > 3 THEN rain_sum END, elevation_range) AS relief,
      elevation_mean, region_name AS region
    FROM site_week s JOIN static_site p ON s.site = p.site""",
    needs="site_week static_site",
)
def feature_vector(t):
    dynamic = t.site_week.select(
        "site", "week_start", "temp_mean", F.when(F.col("cases_a") > 3, F.col("rain_sum")).alias("relief")
    )
    static = t.static_site.select(
        "site", F.col("elevation_range").alias("relief"), "elevation_mean", F.col("region_name").alias("region")
    )
    return joins.feature_rows(dynamic, static, "site", ["temp_mean", "relief", "elevation_mean", "region"], ["region"])
