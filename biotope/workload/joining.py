"""Joins on the test tables."""

from pyspark.sql import functions as F

from biotope.functions import calendar as cal
from biotope.functions import rules
from biotope.operators import joins, rollups, spatial
from biotope.workload.registry import bind


@bind(
    "overlay_join",
    """SELECT grid_key, site, time, air_temperature_c, cell_weight FROM hourly JOIN overlay USING (grid_key)""",
    needs="hourly overlay",
)
def overlay_join(t):
    joined = joins.overlay_join(t.hourly, t.overlay)
    return joined.select("grid_key", "site", "time", "air_temperature_c", "cell_weight")


@bind(
    "static_left_join",
    """SELECT site, week_start, cases_a, elevation_mean, elevation_range, stations
    FROM site_week LEFT JOIN static_site USING (site)""",
    needs="site_week static_site",
)
def static_left_join(t):
    static = t.static_site.select("site", "elevation_mean", "elevation_range", "stations")
    return joins.static_join(t.site_week.select("site", "week_start", "cases_a"), static, "site")


@bind(
    "panel_target_join",
    """SELECT w.site, w.week_start, w.temp_mean, c.cases_a, c.cases_a IS NULL AS target_missing
    FROM site_week w LEFT JOIN (SELECT * FROM site_week WHERE cases_a > 0) c
      ON w.site = c.site AND w.week_start = c.week_start""",
    needs="site_week",
)
def panel_target_join(t):
    base = t.once("site_week").select("site", "week_start", "temp_mean")
    targets = t.once("site_week").where("cases_a > 0").select("site", "week_start", "cases_a")
    return joins.target_join(base, targets, ["site", "week_start"], "cases_a")


@bind(
    "panel_inner_targets",
    """SELECT kept, dropped, cases FROM
      (SELECT count(*) AS kept, CAST(sum(cases_b) AS BIGINT) AS cases FROM site_week WHERE cases_b > 0) AS k,
      (SELECT count(*) AS dropped FROM site_week WHERE NOT cases_b > 0) AS d""",
    needs="site_week",
)
def panel_inner_targets(t):
    base = t.once("site_week").select("site", "week_start", "temp_mean")
    targets = t.once("site_week").where("cases_b > 0").select("site", "week_start", "cases_b")
    kept, dropped = joins.inner_targets(base, targets, ["site", "week_start"])
    lost = dropped.agg(F.count(F.lit(1))).scalar()
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.sum("cases_b").alias("cases")).withColumn("dropped", lost)


@bind(
    "panel_multi_enrich",
    """SELECT w.site, w.week_start, w.cases_a, elevation_mean, stations, local_humidity, population,
      CAST(elevation_mean IS NOT NULL OR stations IS NOT NULL AS INTEGER) AS has_relief,
      CAST(local_humidity IS NOT NULL AS INTEGER) AS has_local,
      CAST(population IS NOT NULL AS INTEGER) AS has_census,
      CAST(elevation_mean IS NOT NULL OR stations IS NOT NULL AS INTEGER) + CAST(local_humidity IS NOT NULL AS INTEGER)
        + CAST(population IS NOT NULL AS INTEGER) AS sources_present_count
    FROM site_week w LEFT JOIN static_site s ON w.site = s.site
    LEFT JOIN (SELECT site, week_start, humid_mean AS local_humidity FROM site_week WHERE cases_b > 1) l
      ON w.site = l.site AND w.week_start = l.week_start
    LEFT JOIN yearly_site y ON w.site = y.site AND year(w.week_start + 3) = y.year""",
    needs="site_week static_site yearly_site",
)
def panel_multi_enrich(t):
    panel = t.once("site_week").select("site", "week_start", "cases_a", cal.midpoint_year(F.col("week_start")).alias("year"))
    local = t.once("site_week").where("cases_b > 1").select("site", "week_start", F.col("humid_mean").alias("local_humidity"))
    sources = {
        "relief": (t.static_site.select("site", "elevation_mean", "stations"), ["site"]),
        "local": (local, ["site", "week_start"]),
        "census": (t.yearly_site.select("site", "year", "population"), ["site", "year"]),
    }
    return joins.enrich(panel, sources).drop("year")


@bind(
    "asof_latest_year",
    """SELECT w.site, w.week_start, y.population, y.density, y.year AS source_year
    FROM (SELECT site, week_start, year(week_start) AS panel_year FROM site_week) w
    ASOF LEFT JOIN yearly_site y ON w.site = y.site AND w.panel_year >= y.year""",
    needs="site_week yearly_site",
)
def asof_latest_year(t):
    panel = t.site_week.select("site", "week_start", F.year("week_start").alias("year"))
    return joins.asof_year(panel, t.yearly_site, "site", "year", ["population", "density"], "source_year").drop("year")


@bind(
    "yearly_ffill_attach",
    """WITH k AS (SELECT DISTINCT site, CAST(year(week_start) AS INTEGER) AS year FROM site_week),
      f AS (SELECT k.site, k.year, last_value(population IGNORE NULLS) OVER w AS population,
          last_value(CASE WHEN population IS NOT NULL THEN k.year END IGNORE NULLS) OVER w AS source_year
        FROM k LEFT JOIN yearly_site y ON k.site = y.site AND k.year = y.year
        WINDOW w AS (PARTITION BY k.site ORDER BY k.year ROWS UNBOUNDED PRECEDING))
    SELECT w.site, w.week_start, f.population, f.source_year
    FROM site_week w LEFT JOIN f ON w.site = f.site AND year(w.week_start) = f.year""",
    needs="site_week yearly_site",
)
def yearly_ffill_attach(t):
    panel = t.once("site_week").select("site", "week_start", F.year("week_start").alias("year"))
    return joins.yearly_fill(panel, t.yearly_site, "site", "year", "population", "source_year").drop("year")


@bind(
    "left_join_zero_fill",
    """SELECT o.site, o.week_start, coalesce(cases_a, 0) AS cases_a, coalesce(cases_b, 0) AS cases_b
    FROM (SELECT DISTINCT site, CAST(date_trunc('week', order_day) AS DATE) AS week_start FROM order_sites) AS o
    LEFT JOIN site_week w ON o.site = w.site AND o.week_start = w.week_start""",
    needs="order_sites site_week",
)
def left_join_zero_fill(t):
    weeks = t.order_sites.select("site", cal.week_start(F.col("order_day")).alias("week_start")).distinct()
    return joins.zero_filled(weeks, t.site_week, ["site", "week_start"], ["cases_a", "cases_b"])


@bind(
    "coarse_to_week",
    """WITH m AS (SELECT site, CAST(date_trunc('month', order_day) AS DATE) AS month_start, count(*) AS monthly_value
      FROM order_sites GROUP BY 1, 2)
    SELECT w.site, w.week_start, m.month_start, m.monthly_value FROM site_week w JOIN m
      ON w.site = m.site AND date_trunc('month', w.week_start + 3) = m.month_start""",
    needs="site_week order_sites",
)
def coarse_to_week(t):
    monthly = t.order_sites.groupBy("site", F.trunc("order_day", "month").alias("month_start")).agg(
        F.count(F.lit(1)).alias("monthly_value")
    )
    weeks = t.site_week.select("site", "week_start")
    return joins.coarse_to_weeks(weeks, monthly, "site", "month_start", cal.midpoint_month(F.col("week_start")))


FAMILY_MONTH_SQL = "SELECT target_month, avg(value) AS {1} FROM ensemble WHERE family = '{0}' GROUP BY 1"


@bind(
    "full_outer_merge",
    f"""SELECT coalesce(n.target_month, a.target_month) AS target_month, temperature, rain
    FROM ({FAMILY_MONTH_SQL.format('N', 'temperature')} HAVING count(*) > 3) n
    FULL OUTER JOIN ({FAMILY_MONTH_SQL.format('A', 'rain')} HAVING count(*) > 3) a ON n.target_month = a.target_month""",
    needs="ensemble",
    rounded="temperature rain",
    digits=3,
)
def full_outer_merge(t):
    def months(family, name):
        rows = t.once("ensemble").where(F.col("family") == family).groupBy("target_month")
        found = rows.agg(F.avg("value").alias(name), F.count(F.lit(1)).alias("n"))
        return found.where("n > 3").drop("n")

    return joins.outer_merge([months("N", "temperature"), months("A", "rain")], ["target_month"])


@bind(
    "template_value_join",
    """WITH k AS (SELECT DISTINCT family, init_month, lead_month, target_month, member FROM ensemble),
      v AS (SELECT family, init_month, lead_month, target_month, member, avg(value) AS value, true AS extracted
        FROM ensemble WHERE value > 5000000 GROUP BY 1, 2, 3, 4, 5)
    SELECT k.*, v.value, coalesce(v.extracted, false) AS ready FROM k LEFT JOIN v
      ON k.family = v.family AND k.init_month = v.init_month AND k.lead_month = v.lead_month
      AND k.target_month = v.target_month AND k.member = v.member""",
    needs="ensemble",
    rounded="value",
    digits=3,
)
def template_value_join(t):
    keys = ["family", "init_month", "lead_month", "target_month", "member"]
    template = t.once("ensemble").select(*keys).distinct()
    extracted = t.once("ensemble").where("value > 5000000").groupBy(*keys).agg(
        F.avg("value").alias("value"), F.lit(True).alias("extracted")
    )
    return joins.template_values(template, extracted, keys, "extracted")


EFFECT_SQL = """SELECT r.scenario, r.year, r.temp, CASE WHEN r.scenario < '3' THEN 'add' ELSE 'remove' END AS kind,
      b.temp AS reference_temp,
      CASE WHEN r.scenario < '3' THEN b.temp - r.temp ELSE -(b.temp - r.temp) END AS effect,
      CASE WHEN b.temp <> 0 THEN CASE WHEN r.scenario < '3' THEN b.temp - r.temp ELSE -(b.temp - r.temp) END
        / b.temp * 100 END AS effect_pct
    FROM scenario_year r LEFT JOIN scenario_year b ON r.year = b.year AND b.scenario = '5-LOW'
    WHERE r.scenario <> '5-LOW'"""


def effects(t):
    results = t.once("scenario_year").select(
        "scenario", "year", "temp", F.when(F.col("scenario") < "3", "add").otherwise("remove").alias("kind")
    )
    return joins.reference_effect(results, ["year"], "scenario", "5-LOW", "temp", "kind")


@bind("reference_effect_join", EFFECT_SQL, needs="scenario_year", rounded="effect effect_pct")
def reference_effect_join(t):
    return effects(t)


@bind(
    "dev_holdout_merge",
    f"""WITH e AS ({EFFECT_SQL}),
      d AS (SELECT scenario, kind, avg(effect) AS development_effect FROM e WHERE year < 2000 GROUP BY 1, 2),
      h AS (SELECT scenario, kind, avg(effect) AS holdout_effect FROM e WHERE year >= 2000 AND kind = 'add' GROUP BY 1, 2)
    SELECT scenario, kind, development_effect, holdout_effect,
      CASE WHEN holdout_effect IS NULL THEN false ELSE (development_effect > 0) = (holdout_effect > 0) END AS sign_match,
      holdout_effect - development_effect AS shift,
      CASE WHEN development_effect > 0 AND holdout_effect > 0 THEN 'confirmed_on_holdout'
        WHEN development_effect > 0 THEN 'did_not_confirm_on_holdout'
        WHEN holdout_effect > 0 THEN 'holdout_positive_but_not_dev_stable' ELSE 'consistently_not_helpful' END AS confirmation
    FROM d LEFT JOIN h USING (scenario, kind)""",
    needs="scenario_year",
    rounded="development_effect holdout_effect shift",
)
def dev_holdout_merge(t):
    keys = ["scenario", "kind"]
    e = effects(t)
    development = e.where("year < 2000").groupBy(*keys).agg(F.avg("effect").alias("development_effect"))
    holdout = e.where("year >= 2000 and kind = 'add'").groupBy(*keys).agg(F.avg("effect").alias("holdout_effect"))
    dev, hold = F.col("development_effect"), F.col("holdout_effect")
    return development.join(holdout, keys, "left").select(
        *keys,
        dev,
        hold,
        F.coalesce((dev > 0) == (hold > 0), F.lit(False)).alias("sign_match"),
        (hold - dev).alias("shift"),
        rules.holdout_confirmation(dev, hold).alias("confirmation"),
    )


@bind(
    "climatology_anomaly",
    """SELECT m.month_start, m.month, m.temp, m.rain, m.temp - c.temp AS temp_anomaly, m.rain - c.rain AS rain_anomaly
    FROM month_cases m JOIN (SELECT month, avg(temp) AS temp, avg(rain) AS rain FROM month_cases GROUP BY 1) c
      ON m.month = c.month""",
    needs="month_cases",
    rounded="temp_anomaly rain_anomaly",
)
def climatology_anomaly(t):
    months = t.once("month_cases").select("month_start", "month", "temp", "rain")
    norms = rollups.climatology(months, "month", ["temp", "rain"])
    return joins.climatology_anomaly(months, norms, "month", ["temp", "rain"])


ANCHOR_SQL = """SELECT t.year, t.month, least(t.month - 1, 4) AS issue_month, t.month - least(t.month - 1, 4) AS lead_month,
      t.rate_a, t.temp, d.rate_a AS rate_a_anchor_prev, q.rate_a AS rate_a_anchor_q4_mean,
      s.rate_a AS rate_a_same_month_last_year
    FROM month_cases t JOIN month_cases d ON d.month = 12 AND d.year + 1 = t.year
    JOIN (SELECT year, avg(rate_a) AS rate_a FROM month_cases WHERE month BETWEEN 10 AND 12 GROUP BY 1
      HAVING count(*) = 3) q ON q.year + 1 = t.year
    JOIN month_cases s ON s.month = t.month AND s.year + 1 = t.year
    WHERE t.month BETWEEN 2 AND 10"""


def anchored(t):
    months = t.once("month_cases").select("year", "month", "rate_a")
    rows = joins.anchored_rows(months, [], ["rate_a"])
    return rows.join(t.once("month_cases").select("year", "month", "temp"), ["year", "month"])


@bind("anchor_joins", ANCHOR_SQL, needs="month_cases", rounded="rate_a_anchor_q4_mean")
def anchor_joins(t):
    return anchored(t)


@bind(
    "constant_anchor_attach",
    """WITH l AS (SELECT * FROM month_cases WHERE year = (SELECT max(year) - 1 FROM month_cases)),
      f AS (SELECT DISTINCT target_month, CAST(month(target_month) AS INTEGER) AS month FROM ensemble)
    SELECT f.target_month, f.month, (SELECT rate_a FROM l WHERE month = 12) AS rate_a_anchor_prev,
      (SELECT avg(rate_a) FROM l WHERE month BETWEEN 10 AND 12) AS rate_a_anchor_q4_mean,
      l.rate_a AS rate_a_same_month_last_year
    FROM f JOIN l ON f.month = l.month""",
    needs="month_cases ensemble",
    rounded="rate_a_anchor_q4_mean",
)
def constant_anchor_attach(t):
    """One series: its anchors are one struct."""
    last = t.once("month_cases").agg(F.max("year") - 1).scalar()
    months = t.once("month_cases").select("year", "month", "rate_a")
    future = t.ensemble.select("target_month").distinct().select("target_month", F.month("target_month").alias("month"))
    return joins.constant_anchors(future, months, [], ["rate_a"], last)


@bind(
    "prediction_truth_join",
    """SELECT p.scenario, p.year, p.prediction, p.baseline, o.rate_a AS truth, o.rate_a - p.prediction AS residual,
      o.rate_a - p.baseline AS baseline_residual
    FROM (SELECT scenario, year + 1 AS year, rate_a * 0.9::DOUBLE + 40 AS prediction, rate_a AS baseline FROM scenario_year) p
    LEFT JOIN scenario_year o ON p.scenario = o.scenario AND p.year = o.year""",
    needs="scenario_year",
    rounded="prediction residual baseline_residual",
)
def prediction_truth_join(t):
    s = t.once("scenario_year")
    predictions = s.select(
        "scenario", (F.col("year") + 1).alias("year"), (F.col("rate_a") * 0.9 + 40).alias("prediction"), F.col("rate_a").alias("baseline")
    )
    observed = s.select("scenario", "year", F.col("rate_a").alias("truth"))
    return joins.prediction_truth(predictions, observed, ["scenario", "year"], "prediction", "baseline", "truth")


@bind(
    "point_in_polygon",
    "SELECT pixel_id, x, y, site FROM located",
    needs="located",
)
def point_in_polygon(t):
    shapes = spatial.with_edges(t.polygons, "site", "rings")
    return spatial.locate(t.pixels.select("pixel_id", "x", "y"), shapes, "site", "x", "y")


@bind(
    "pixel_zonal_join",
    "SELECT pixel_id, site, value FROM located WHERE site IS NOT NULL AND value <> 0",
    needs="located",
)
def pixel_zonal_join(t):
    shapes = spatial.with_edges(t.polygons, "site", "rings")
    rows = spatial.zonal_pixels(t.pixels, shapes, "site", "x", "y", "value", 0.0)
    return rows.select("pixel_id", "site", "value")


def supplier_polygons(t):
    """A pentagon per supplier, placed and sized by its key and balance."""
    x, y = F.pmod(F.col("s_suppkey") * 37, F.lit(1000)) / 10.0, F.pmod(F.col("s_suppkey") * 91, F.lit(1000)) / 10.0
    size = 2 + F.abs("s_acctbal") / 4000

    def at(dx, dy):
        return F.struct((x + size * dx).alias("x"), (y + size * dy).alias("y"))

    ring = F.array(at(0.0, 0.0), at(1.0, 0.2), at(1.3, 1.1), at(0.5, 1.6), at(-0.2, 0.9), at(0.0, 0.0))
    return t.table("supplier").select(F.col("s_suppkey").cast("string").alias("site"), F.array(ring).alias("rings"))


def square_cells(t, step=2.0):
    """The grid cells of the plane's parts where suppliers stand, with a margin."""
    polygons = spatial.with_edges(supplier_polygons(t), "site", "rings")
    spread = polygons.select(
        F.explode(F.sequence(F.floor(F.col("x_min") / step), F.floor(F.col("x_max") / step))).alias("i"), "y_min", "y_max"
    ).select("i", F.explode(F.sequence(F.floor(F.col("y_min") / step), F.floor(F.col("y_max") / step))).alias("j"))
    return spread.distinct().select(
        F.concat_ws("|", F.col("i").cast("string"), F.col("j").cast("string")).alias("cell"),
        (F.col("i") * step).alias("x_min"),
        ((F.col("i") + 1) * step).alias("x_max"),
        (F.col("j") * step).alias("y_min"),
        ((F.col("j") + 1) * step).alias("y_max"),
    )


@bind(
    "polygon_grid_overlay",
    """WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS site, (s_suppkey * 37) % 1000 / 10.0::DOUBLE AS x, (s_suppkey * 91) % 1000 / 10.0::DOUBLE AS y,
        2 + abs(s_acctbal) / 4000 AS size FROM supplier),
      e AS (SELECT site, x + size * p[1] AS xa, y + size * p[2] AS ya, x + size * q[1] AS xb, y + size * q[2] AS yb FROM (
        SELECT site, x, y, size, unnest([[0.0, 0.0], [1.0, 0.2], [1.3, 1.1], [0.5, 1.6], [-0.2, 0.9]]::DOUBLE[][]) AS p,
          unnest([[1.0, 0.2], [1.3, 1.1], [0.5, 1.6], [-0.2, 0.9], [0.0, 0.0]]::DOUBLE[][]) AS q FROM s) AS r),
      c AS (SELECT site, i, unnest(range(CAST(floor(y0 / 2) AS BIGINT), CAST(floor(y1 / 2) AS BIGINT) + 1)) AS j FROM (
        SELECT site, y0, y1, unnest(range(CAST(floor(x0 / 2) AS BIGINT), CAST(floor(x1 / 2) AS BIGINT) + 1)) AS i FROM (
          SELECT site, min(xa) AS x0, max(xa) AS x1, min(ya) AS y0, max(ya) AS y1 FROM e GROUP BY 1) AS b) AS b),
      h AS (SELECT e.site, i, j, xb - xa AS run, greatest(2 * i, least(2 * i + 2, xa)) AS x1, greatest(2 * i, least(2 * i + 2, xb)) AS x2, xa, ya, yb
        FROM e JOIN c ON e.site = c.site),
      g AS (SELECT site, i, j, x2 - x1 AS dx, ya + (x1 - xa) * (yb - ya) / run - 2 * j AS u, ya + (x2 - xa) * (yb - ya) / run - 2 * j AS v
        FROM h WHERE x1 <> x2),
      f AS (SELECT site, i, j, dx, u, v, CASE WHEN u <= 0 THEN 0 WHEN u >= 2 THEN 2 * u - 2 ELSE u * u / 2 END AS gu,
          CASE WHEN v <= 0 THEN 0 WHEN v >= 2 THEN 2 * v - 2 ELSE v * v / 2 END AS gv FROM g),
      a AS (SELECT site, i || '|' || j AS cell, abs(sum(dx * CASE WHEN abs(u - v) < 1e-12 THEN greatest(0, least(2, u)) ELSE (gv - gu) / (v - u) END)) AS intersection_area
        FROM f GROUP BY 1, 2),
      k AS (SELECT * FROM a WHERE intersection_area > 4e-9),
      t AS (SELECT site, sum(intersection_area) AS covered_area FROM k GROUP BY 1),
      w AS (SELECT site, size * size * (1.0 * 1.1 - 1.3 * 0.2 + 1.3 * 1.6 - 0.5 * 1.1 + 0.5 * 0.9 + 0.2 * 1.6)::DOUBLE / 2 AS site_area FROM s)
    SELECT k.site, cell, intersection_area, covered_area, site_area, intersection_area / covered_area AS cell_weight, covered_area / site_area AS coverage
    FROM k JOIN t ON k.site = t.site JOIN w ON k.site = w.site""",
    rounded="intersection_area covered_area site_area cell_weight coverage",
    digits=5,
)
def polygon_grid_overlay(t):
    polygons = supplier_polygons(t)
    overlay = spatial.grid_overlay(polygons, square_cells(t), "site", "rings", 2.0)
    return spatial.all_sites_covered(polygons, overlay, "site")


@bind(
    "polygon_overlay_totals",
    """WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS site, 2 + abs(s_acctbal) / 4000 AS size FROM supplier)
    SELECT site, size * size * (1.0 * 1.1 - 1.3 * 0.2 + 1.3 * 1.6 - 0.5 * 1.1 + 0.5 * 0.9 + 0.2 * 1.6)::DOUBLE / 2 AS covered_area,
      1.0::DOUBLE AS weight_total, 1.0::DOUBLE AS coverage FROM s""",
    rounded="covered_area weight_total coverage",
)
def polygon_overlay_totals(t):
    """Cells tile the plane, so every site is covered fully and its weights add up to 1."""
    overlay = spatial.grid_overlay(supplier_polygons(t), square_cells(t), "site", "rings", 2.0)
    return overlay.groupBy("site").agg(
        F.sum("intersection_area").alias("covered_area"),
        F.sum("cell_weight").alias("weight_total"),
        F.max("coverage").alias("coverage"),
    )


@bind(
    "key_difference",
    """WITH a AS (SELECT DISTINCT site, CAST(date_trunc('week', order_day) AS DATE) AS week_start FROM order_sites),
      b AS (SELECT site, week_start FROM site_week)
    SELECT site, week_start, 'missing' AS difference FROM (SELECT * FROM a EXCEPT SELECT * FROM b) AS m
    UNION ALL SELECT site, week_start, 'unexpected' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) AS u""",
    needs="order_sites site_week",
)
def key_difference(t):
    expected = t.order_sites.select("site", cal.week_start(F.col("order_day")).alias("week_start"))
    return joins.key_difference(expected, t.site_week, ["site", "week_start"])


@bind(
    "scenario_corridor",
    """SELECT m.year, m.rate_a AS medium_value, h.rate_a AS high_value, least(m.rate_a, h.rate_a) AS band_low,
      greatest(m.rate_a, h.rate_a) AS band_high
    FROM scenario_year m JOIN scenario_year h ON m.year = h.year
    WHERE m.scenario = '3-MEDIUM' AND h.scenario = '2-HIGH'""",
    needs="scenario_year",
)
def scenario_corridor(t):
    s = t.once("scenario_year")
    return joins.corridor(s.where("scenario = '3-MEDIUM'"), s.where("scenario = '2-HIGH'"), ["year"], "rate_a")


@bind(
    "static_dynamic_join",
    """WITH p AS (SELECT site, week_start, temp_mean, lag(temp_mean) OVER w AS previous_temp, lag(week_start) OVER w AS previous_week
      FROM site_week WINDOW w AS (PARTITION BY site ORDER BY week_start))
    SELECT p.site, p.week_start, p.temp_mean, p.previous_temp, s.elevation_mean, s.region_name
    FROM p JOIN static_site s ON p.site = s.site
    WHERE previous_week = week_start - 7""",
    needs="site_week static_site",
)
def static_dynamic_join(t):
    weeks = t.once("site_week").select("site", "week_start", "temp_mean")
    static = t.static_site.select("site", "elevation_mean", "region_name")
    paired = joins.current_and_previous(weeks, static, "site", "week_start", ["temp_mean"])
    return paired.withColumnRenamed("previous_temp_mean", "previous_temp")


@bind(
    "boundary_value_join",
    """WITH v AS (SELECT site, avg(value) AS mean_value FROM located WHERE site IS NOT NULL GROUP BY 1)
    SELECT e.site, e.part, CAST(count(*) AS INTEGER) AS edge_count, v.mean_value,
      CASE WHEN v.mean_value < -5 THEN 'Low' WHEN v.mean_value < 5 THEN 'Medium' ELSE 'High' END AS level
    FROM edges e JOIN v ON e.site = v.site GROUP BY e.site, e.part, v.mean_value""",
    needs="located",
    rounded="mean_value",
)
def boundary_value_join(t):
    shapes = spatial.with_edges(t.polygons, "site", "rings")
    located = spatial.locate(t.pixels, shapes, "site", "x", "y").where("site is not null")
    values = located.groupBy("site").agg(F.avg("value").alias("mean_value"))
    outlines = t.polygons.select(
        "site", "part", F.aggregate("rings", F.lit(0), lambda acc, r: acc + F.size(r) - 1).alias("edge_count")
    )
    return joins.boundaries_with_values(
        outlines, values, "site", rules.level(F.col("mean_value"), F.lit(-5), F.lit(5))
    )
