"""Splits, metrics, models and risk publication on the test tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotope.operators import metrics, splits, windows
from biotope.operators.joins import asof_year
from biotope.operators.ordering import earlier_mean, target_history
from biotope.plans import ridge, risk, training, trees
from biotope.session import materialize
from biotope.workload.aggregating import ANOMALIES, ANOMALY_SQL, anomalies, climate_indices
from biotope.workload.joining import ANCHOR_SQL, anchored
from biotope.workload.registry import bind
from biotope.workload.relations import Tables


@bind(
    "typed_training_rows",
    """SELECT doc_id, CASE WHEN doc_id < 5 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' END AS week_start,
      CASE WHEN toxic = 1 AND quality = 0 THEN 2 ELSE quality END::DOUBLE AS target,
      CASE WHEN lang IN ('de', 'fr') THEN NULL ELSE n_chars END::DOUBLE AS feature,
      CASE WHEN lang = 'es' THEN '__MISSING__' ELSE source END AS category,
      problem, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 1 THEN NULL WHEN doc_id % 17 = 2 THEN 'inf'::DOUBLE ELSE n_chars END::DOUBLE AS row_weight,
      CASE WHEN problem IS NOT NULL THEN doc_id END AS problem_row
    FROM (SELECT *, CASE WHEN doc_id < 5 THEN 'bad time' WHEN toxic = 1 AND quality = 0 THEN 'target is not 0 or 1'
        WHEN lang = 'fr' THEN 'bad number in feature' WHEN doc_id % 11 = 0 THEN 'missing weight'
        WHEN doc_id % 13 = 1 THEN 'weight is not a number' WHEN doc_id % 17 = 2 THEN 'weight is not finite' END AS problem
      FROM labels JOIN documents USING (doc_id) WHERE NOT (toxic = 1 AND quality = 1)) AS rows""",
)
def typed_training_rows(t):
    """Labels written as text, with gaps and errors that follow from the rows' own values."""
    rows = t.table("labels").join(t.table("documents").drop("text"), "doc_id")
    toxic, lang = F.col("toxic") == 1, F.col("lang")
    raw = rows.select(
        "doc_id",
        F.when(F.col("doc_id") < 5, "soon").otherwise("2024-01-01").alias("week_start"),
        F.when(toxic & (F.col("quality") == 1), " NA ")
        .when(toxic, "2")
        .otherwise(F.col("quality").cast("string"))
        .alias("target"),
        F.when(lang == "de", "").when(lang == "fr", "many").otherwise(F.col("n_chars").cast("string")).alias("feature"),
        F.when(lang == "es", "").otherwise(F.col("source")).alias("category"),
        F.when(F.col("doc_id") % 11 == 0, " ").when(F.col("doc_id") % 13 == 1, "heavy").when(F.col("doc_id") % 17 == 2, "Infinity")
        .otherwise(F.col("n_chars").cast("string")).alias("row_weight"),
    )
    return training.typed_rows(
        raw, "week_start", "target", ["feature"], ["category"], binary=True, weight="row_weight", row_id="doc_id"
    )


@bind(
    "ratio_time_split",
    """WITH p AS (SELECT week_start, row_number() OVER (ORDER BY week_start) AS no, count(*) OVER () AS n
      FROM (SELECT DISTINCT week_start FROM site_week) AS d)
    SELECT site, week_start, CASE WHEN no <= greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train'
      WHEN no <= greatest(1, floor(n * 0.7::DOUBLE)) + greatest(1, floor(n * 0.15::DOUBLE)) THEN 'validation'
      ELSE 'test' END AS split FROM site_week JOIN p USING (week_start)""",
    needs="site_week",
)
def ratio_time_split(t):
    return splits.ratio_split(t.once("site_week").select("site", "week_start"), "week_start")


@bind(
    "boundary_time_split",
    """SELECT site, week_start, CASE WHEN week_start <= DATE '1999-12-27' THEN 'train'
      WHEN week_start <= DATE '2000-12-25' THEN 'validation' ELSE 'test' END AS split FROM site_week""",
    needs="site_week",
)
def boundary_time_split(t):
    return splits.boundary_split(t.site_week.select("site", "week_start"), "week_start", "1999-12-27", "2000-12-25")


@bind(
    "year_role_split",
    """SELECT site, week_start, CASE WHEN cases_b = 0 THEN 'not_eligible' WHEN year(week_start) < 1998 THEN 'historical'
      WHEN year(week_start) < 2001 THEN 'development' ELSE 'holdout' END AS role FROM site_week""",
    needs="site_week",
)
def year_role_split(t):
    role = splits.year_role(F.year("week_start"), F.col("cases_b") > 0, 1998, 2001)
    return t.site_week.select("site", "week_start", role.alias("role"))


FOLDS = (1999, 2000, 2001)
FOLDS_SQL = f"(SELECT unnest({list(FOLDS)})::INTEGER AS fold_year)"


@bind(
    "expanding_folds",
    f"""SELECT fold_year, CASE WHEN year < fold_year THEN 'train' ELSE 'validate' END AS fold_role, site, count(*) AS rows,
      CAST(sum(cases_a) AS BIGINT) AS cases
    FROM (SELECT *, year(week_start) AS year FROM site_week) AS w JOIN {FOLDS_SQL} AS f ON year <= fold_year GROUP BY 1, 2, 3""",
    needs="site_week",
)
def expanding_folds(t):
    rows = t.site_week.select("site", F.year("week_start").alias("year"), "cases_a")
    folds = splits.expanding_folds(rows, "year", FOLDS)
    return folds.groupBy("fold_year", "fold_role", "site").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("cases_a").alias("cases")
    )


@bind(
    "split_summary",
    """SELECT split, count(*) AS rows, count(target) AS eligible_rows, count(*) FILTER (WHERE target > 0) AS positive_rows,
      100.0::DOUBLE * count(*) FILTER (WHERE target > 0) / count(target) AS positive_pct, count(DISTINCT site) AS sites,
      count(DISTINCT week_start) AS periods, min(week_start) AS first_period, max(week_start) AS last_period
    FROM risk_panel GROUP BY 1""",
    needs="risk_panel",
    rounded="positive_pct",
)
def split_summary(t):
    return splits.split_summary(t.risk_panel, "split", "target", "site", "week_start")


@bind(
    "regression_metrics",
    """SELECT split, count(*) AS rows, sqrt(avg((target - score) * (target - score))) AS rmse, avg(abs(target - score)) AS mae,
      any_value(m) AS mean_target, CASE WHEN sum((target - m) * (target - m)) = 0 THEN 1
        ELSE 1 - sum((target - score) * (target - score)) / sum((target - m) * (target - m)) END AS r2
    FROM scored JOIN (SELECT split, avg(target) AS m FROM scored GROUP BY 1) AS means USING (split) GROUP BY 1""",
    needs="scored",
    rounded="rmse mae mean_target r2",
)
def regression_metrics(t):
    return metrics.regression_metrics(t.scored, "target", "score", ["split"])


@bind(
    "bias_mape",
    """SELECT split, avg(score - target) AS bias,
      avg(CASE WHEN abs(target) > 1e-9 THEN abs((score - target) / target) * 100 END) AS mape_pct FROM scored GROUP BY 1""",
    needs="scored",
    rounded="bias mape_pct",
)
def bias_mape(t):
    return metrics.bias_and_mape(t.scored, "target", "score", ["split"])


@bind(
    "weighted_errors",
    """SELECT split, sqrt(sum(feature * (score - target) * (score - target)) / sum(feature)) AS weighted_rmse,
      sum(feature * abs(score - target)) / sum(feature) AS weighted_mae,
      sum(feature * (score - target)) / sum(feature) AS weighted_bias,
      sum(feature * abs(score - target) / target * 100) FILTER (WHERE target = 1)
        / sum(feature) FILTER (WHERE target = 1) AS weighted_mape_pct
    FROM scored GROUP BY 1""",
    needs="scored",
    rounded="weighted_rmse weighted_mae weighted_bias weighted_mape_pct",
)
def weighted_errors(t):
    return metrics.weighted_errors(t.scored, "target", "score", "feature", ["split"])


@bind(
    "confusion_metrics",
    """WITH c AS (SELECT split, count(*) AS rows, count(*) FILTER (WHERE target = 1 AND score >= 0.5) AS tp,
        count(*) FILTER (WHERE target = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE target = 1 AND score < 0.5) AS fn,
        count(*) FILTER (WHERE target = 0 AND score < 0.5) AS tn FROM scored GROUP BY 1),
      r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS q FROM c)
    SELECT split, rows, tp, fp, fn, tn, (tp + tn)::DOUBLE / rows AS accuracy, p AS precision, q AS recall,
      coalesce(2 * p * q / nullif(p + q, 0), 0) AS f1, (tp + fn)::DOUBLE / rows AS positive_rate FROM r""",
    needs="scored",
    rounded="accuracy precision recall f1 positive_rate",
)
def confusion_metrics(t):
    return metrics.confusion_metrics(t.scored, "target", "score", ["split"])


@bind(
    "roc_auc",
    """SELECT split, CAST(sum(target) AS BIGINT) AS positives, CAST(count(*) - sum(target) AS BIGINT) AS negatives,
      coalesce((sum(avg_rank) FILTER (WHERE target = 1) - sum(target) * (sum(target) + 1) / 2.0::DOUBLE)
        / nullif(sum(target) * (count(*) - sum(target)), 0), 0) AS roc_auc
    FROM (SELECT split, target, rank() OVER (PARTITION BY split ORDER BY score)
      + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS avg_rank FROM scored) AS r GROUP BY 1""",
    needs="scored",
    rounded="roc_auc",
)
def roc_auc(t):
    return metrics.roc_auc(t.scored, "target", "score", ["split"])


@bind(
    "average_precision",
    """SELECT split, count(*) FILTER (WHERE target = 1) AS positives,
      coalesce(avg(CASE WHEN target = 1 THEN found / position END), 0) AS average_precision
    FROM (SELECT split, target, row_number() OVER w AS position, CAST(sum(target) OVER w AS DOUBLE) AS found
      FROM scored WINDOW w AS (PARTITION BY split ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) AS r GROUP BY 1""",
    needs="scored",
    rounded="average_precision",
)
def average_precision(t):
    rows = t.scored.select("doc_id", "split", "target", "score")
    return metrics.average_precision(rows, "target", "score", "doc_id", ["split"])


@bind(
    "calibration_bins",
    """WITH e AS (SELECT list_distinct(quantile_cont(score, [i::DOUBLE / 10 FOR i IN range(1, 10)])) AS edges FROM scored)
    SELECT CAST(len(list_filter(edges, lambda v: v < score)) AS INTEGER) AS bin, count(*) AS rows, avg(score) AS mean_score,
      avg(target) AS observed_rate FROM scored, e GROUP BY 1""",
    needs="scored",
    rounded="mean_score observed_rate",
)
def calibration_bins(t):
    return metrics.calibration(t.scored, "target", "score")


@bind(
    "pr_curve",
    """SELECT split, score AS threshold, CAST(found AS DOUBLE) / called AS precision, CAST(found AS DOUBLE) / total AS recall
    FROM (SELECT split, score, sum(n) OVER w AS called, sum(p) OVER w AS found, sum(p) OVER (PARTITION BY split) AS total
      FROM (SELECT split, score, count(*) AS n, sum(target) AS p FROM scored GROUP BY 1, 2) AS c
      WINDOW w AS (PARTITION BY split ORDER BY score DESC)) AS r""",
    needs="scored",
    rounded="precision recall",
)
def pr_curve(t):
    return metrics.pr_curve(t.scored, "target", "score", ["split"])


@bind(
    "spearman",
    """SELECT split, count(*) AS rows, corr(a, b) AS spearman FROM (
      SELECT split, rank() OVER (PARTITION BY split ORDER BY score)
          + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (PARTITION BY split ORDER BY week_no) + (count(*) OVER (PARTITION BY split, week_no) - 1) / 2.0::DOUBLE AS b
      FROM (SELECT *, week_start - DATE '2024-01-01' AS week_no FROM scored) AS s) AS r GROUP BY 1""",
    needs="scored",
    rounded="spearman",
)
def spearman(t):
    rows = t.scored.withColumn("week_no", F.date_diff("week_start", F.lit("2024-01-01").cast("date")))
    return metrics.spearman(rows.select("split", "score", "week_no"), "score", "week_no", ["split"])


@bind(
    "aggregate_fit",
    """WITH w AS (SELECT split, week_start, sum(target)::DOUBLE AS y, sum(score) AS p FROM risk_panel GROUP BY 1, 2)
    SELECT split, count(*) AS periods, corr(y, p) AS correlation,
      1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) AS r2
    FROM w JOIN (SELECT split, avg(y) AS m FROM w GROUP BY 1) AS means USING (split) GROUP BY 1""",
    needs="risk_panel",
    rounded="correlation r2",
)
def aggregate_fit(t):
    return metrics.aggregate_fit(t.risk_panel, "target", "score", "split", "week_start")


@bind(
    "tercile_thresholds",
    """SELECT split, quantile_cont(score, 1::DOUBLE / 3) AS low_threshold, quantile_cont(score, 2::DOUBLE / 3) AS medium_threshold
    FROM scored GROUP BY 1""",
    needs="scored",
    rounded="low_threshold medium_threshold",
)
def tercile_thresholds(t):
    return risk.tercile_thresholds(t.scored, "score", ["split"])


@bind(
    "binned_dependence",
    """WITH s AS (SELECT feature, score * (target_b + 1) + target AS effect FROM scored),
      e AS (SELECT list_distinct(quantile_cont(feature, [i::DOUBLE / 12 FOR i IN range(0, 12)])) AS edges FROM s)
    SELECT CAST(greatest(len(list_filter(edges, lambda v: v < feature)) - 1, 0) AS INTEGER) AS bin, count(*) AS rows,
      avg(feature) AS feature_mean, quantile_cont(effect, 0.5::DOUBLE) AS effect_median FROM s, e GROUP BY 1""",
    needs="scored",
    rounded="feature_mean effect_median",
)
def binned_dependence(t):
    effect = F.col("score") * (F.col("target_b") + 1) + F.col("target")
    return metrics.binned_dependence(t.scored.select("feature", effect.alias("effect")), "feature", "effect")



def ridge_sql(source: str, key: str, target: str, alphas: str) -> str:
    """Two-feature ridge in closed form per key and penalty (features temp and rain)."""
    return f"""(SELECT {key}, alpha, n, my - b1 / s1 * m1 - b2 / s2 * m2 AS intercept, b1 / s1 AS coef_temp, b2 / s2 AS coef_rain
      FROM (SELECT *, ((n + alpha) * c1 - g * c2) / ((n + alpha) * (n + alpha) - g * g) AS b1,
          ((n + alpha) * c2 - g * c1) / ((n + alpha) * (n + alpha) - g * g) AS b2
        FROM (SELECT {key}, any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my,
            any_value(s1) AS s1, any_value(s2) AS s2, sum((temp - m1) / s1 * (rain - m2) / s2) AS g,
            sum((temp - m1) / s1 * ({target} - my)) AS c1, sum((rain - m2) / s2 * ({target} - my)) AS c2
          FROM {source} JOIN (SELECT {key}, count(*) AS n, avg(temp) AS m1, avg(rain) AS m2, avg({target}) AS my,
              stddev_pop(temp) AS s1, stddev_pop(rain) AS s2 FROM {source} GROUP BY {key}) AS st USING ({key})
          GROUP BY {key}) AS sums, (SELECT unnest({alphas})::DOUBLE AS alpha) AS a) AS solved)"""


@bind(
    "ridge_fit",
    f"""SELECT scenario, alpha, intercept, coef_temp, coef_rain
    FROM {ridge_sql('scenario_year', 'scenario', 'rate_a', '[1, 10]')} AS fits""",
    needs="scenario_year",
    rounded="intercept coef_temp coef_rain",
    digits=5,
)
def ridge_fit(t):
    sums = ridge.gram_sums(t.once("scenario_year"), ["temp", "rain"], "rate_a", groups=["scenario"])
    fits = ridge.solve_folds(sums, [1.0, 10.0], "scenario string")
    return fits.select(
        "scenario",
        "alpha",
        "intercept",
        F.col("coefficients")[0].alias("coef_temp"),
        F.col("coefficients")[1].alias("coef_rain"),
    )


@bind(
    "ridge_sums",
    """SELECT scenario, count(*) AS rows, sum(humidity) AS weight_sum, any_value(m1) AS mean_temp, any_value(my) AS mean_rate,
      sum(humidity * (temp - m1) * (temp - m1)) AS temp_temp, sum(humidity * (temp - m1) * (rate_a - my)) AS temp_rate
    FROM scenario_year JOIN (SELECT scenario, sum(humidity * temp) / sum(humidity) AS m1,
        sum(humidity * rate_a) / sum(humidity) AS my FROM scenario_year GROUP BY 1) AS m USING (scenario) GROUP BY 1""",
    needs="scenario_year",
    rounded="weight_sum mean_temp mean_rate temp_temp temp_rate",
    digits=4,
)
def ridge_sums(t):
    sums = ridge.gram_sums(t.once("scenario_year"), ["temp"], "rate_a", weight="humidity", groups=["scenario"])
    return sums.select(
        "scenario",
        "rows",
        "weight_sum",
        F.col("means")[0].alias("mean_temp"),
        F.col("means")[1].alias("mean_rate"),
        F.col("products")[0].alias("temp_temp"),
        F.col("products")[1].alias("temp_rate"),
    )


POOLED = "(SELECT *, 1 AS pool FROM month_cases WHERE year <= 1999)"


@bind(
    "linear_score",
    f"""SELECT m.month_start, greatest(f.intercept + f.coef_temp * m.temp + f.coef_rain * m.rain - 300, 0) AS prediction
    FROM month_cases m, {ridge_sql(POOLED, 'pool', 'rate_a', '[10]')} AS f""",
    needs="month_cases",
    rounded="prediction",
    digits=5,
)
def linear_score(t):
    """Coefficients from the early months, applied to all as a generated expression."""
    model = ridge.fit(t.once("month_cases").where("year <= 1999"), ["temp", "rain"], "rate_a", 10.0)
    shifted = ridge.RidgeModel(model.features, model.alpha, model.intercept - 300, model.coefficients)
    return t.once("month_cases").select("month_start", shifted.predict().alias("prediction"))


@bind(
    "alpha_grid",
    f"""WITH tr AS (SELECT temp, rain, rate_a, fold_year FROM month_cases JOIN {FOLDS_SQL} AS f ON year < fold_year),
      fits AS (SELECT * FROM {ridge_sql('tr', 'fold_year', 'rate_a', '[0.1, 1, 10, 100]')} AS r),
      s AS (SELECT alpha, fold_year, sqrt(avg((rate_a - greatest(intercept + coef_temp * temp + coef_rain * rain, 0))
          * (rate_a - greatest(intercept + coef_temp * temp + coef_rain * rain, 0)))) AS rmse
        FROM fits JOIN month_cases ON year = fold_year GROUP BY 1, 2),
      g AS (SELECT alpha, avg(rmse) AS mean_rmse, count(*) AS folds FROM s GROUP BY 1)
    SELECT *, alpha = (SELECT alpha FROM g ORDER BY mean_rmse, alpha LIMIT 1) AS selected FROM g""",
    needs="month_cases",
    rounded="mean_rmse",
    digits=5,
)
def alpha_grid(t):
    rows = t.month_cases.select("year", "temp", "rain", "rate_a")
    return ridge.alpha_scores(rows, ["temp", "rain"], "rate_a", "year", FOLDS, [0.1, 1.0, 10.0, 100.0])


RESIDUAL_SQL = "(SELECT year, temp, rain, 300 + rain * 10 AS baseline, rate_a - (300 + rain * 10) AS residual FROM month_cases)"


@bind(
    "alpha_grid_residual",
    f"""WITH m AS {RESIDUAL_SQL}, tr AS (SELECT temp, rain, residual, fold_year FROM m JOIN {FOLDS_SQL} AS f ON year < fold_year),
      fits AS (SELECT * FROM {ridge_sql('tr', 'fold_year', 'residual', '[0.1, 1, 10, 100]')} AS r),
      s AS (SELECT alpha, fold_year, sqrt(avg((baseline + residual - greatest(baseline + intercept + coef_temp * temp + coef_rain * rain, 0))
          * (baseline + residual - greatest(baseline + intercept + coef_temp * temp + coef_rain * rain, 0)))) AS rmse
        FROM fits JOIN m ON year = fold_year GROUP BY 1, 2),
      g AS (SELECT alpha, avg(rmse) AS mean_rmse, count(*) AS folds FROM s GROUP BY 1)
    SELECT *, alpha = (SELECT alpha FROM g ORDER BY mean_rmse, alpha LIMIT 1) AS selected FROM g""",
    needs="month_cases",
    rounded="mean_rmse",
    digits=5,
)
def alpha_grid_residual(t):
    """Penalties for a model of residuals, which are negative where the baseline is too high."""
    base = F.lit(300) + F.col("rain") * 10
    rows = t.month_cases.select("year", "temp", "rain", base.alias("baseline"), (F.col("rate_a") - base).alias("residual"))
    return ridge.alpha_scores(rows, ["temp", "rain"], "residual", "year", FOLDS, [0.1, 1.0, 10.0, 100.0], baseline="baseline")


@bind(
    "recursive_projection",
    """WITH RECURSIVE r AS (
      SELECT scenario, 1998 AS year, NULL::DOUBLE AS lag_1, NULL::DOUBLE AS rolling_3, NULL::DOUBLE AS predicted,
        max(rate_a) FILTER (WHERE year = 1998) AS p1, max(rate_a) FILTER (WHERE year = 1997) AS p2,
        max(rate_a) FILTER (WHERE year = 1996) AS p3
      FROM scenario_year GROUP BY 1
      UNION ALL
      SELECT r.scenario, r.year + 1, p1, (p3 + p2 + p1) / 3, v, v, p1, p2 FROM r JOIN (
        SELECT scenario, year, temp FROM scenario_year) s ON s.scenario = r.scenario AND s.year = r.year + 1,
        LATERAL (SELECT greatest(50 + 0.5::DOUBLE * p1 + 0.3::DOUBLE * ((p3 + p2 + p1) / 3) + 20 * s.temp, 0) AS v) AS l)
    SELECT scenario, CAST(year AS INTEGER) AS year, lag_1, rolling_3, predicted FROM r WHERE year > 1998""",
    needs="scenario_year",
    rounded="lag_1 rolling_3 predicted",
)
def recursive_projection(t):
    s = t.once("scenario_year")
    history, ahead = s.where("year <= 1998"), s.where("year > 1998")
    return ridge.project(
        history, ahead, ["scenario"], "year", "rate_a", ["temp"], F.lit(50.0), F.lit(0.5), F.lit(0.3), [F.lit(20.0)]
    )


MOMENTUM_SQL = """SELECT scenario, year, rate_a, CASE WHEN n = 3 THEN lag_1 END AS baseline, CASE WHEN n = 3 THEN lag_1 - mean_3 END AS momentum,
      CASE WHEN n = 3 THEN mean_3 END AS baseline_rolling
    FROM (SELECT scenario, year, rate_a, lag(rate_a) OVER w AS lag_1,
        avg(rate_a) OVER (PARTITION BY scenario ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean_3,
        count(rate_a) OVER (PARTITION BY scenario ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n
      FROM scenario_year WINDOW w AS (PARTITION BY scenario ORDER BY year)) AS m"""


def momentum(t):
    w = windows.over_panel("scenario", "year")
    lag1 = ridge.baseline_momentum("rate_a", w, "lag1")
    rolling = ridge.baseline_momentum("rate_a", w, "rolling3")
    return t.once("scenario_year").select(
        "scenario",
        "year",
        "rate_a",
        lag1["baseline"].alias("baseline"),
        lag1["momentum"].alias("momentum"),
        rolling["baseline"].alias("baseline_rolling"),
    )


@bind("baseline_momentum", MOMENTUM_SQL, needs="scenario_year", rounded="momentum baseline_rolling")
def baseline_momentum(t):
    return momentum(t)


INDEX_SQL = f"""(WITH a AS ({ANOMALY_SQL}), h AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s' for c in ANOMALIES)} FROM a)
    SELECT scenario, year, (temp_anomaly - temp_anomaly_m) / temp_anomaly_s
        + (humidity_anomaly - humidity_anomaly_m) / humidity_anomaly_s AS thermal_humidity_index,
      (rain_anomaly - rain_anomaly_m) / rain_anomaly_s + (soil_anomaly - soil_anomaly_m) / soil_anomaly_s AS wetness_index
    FROM a, h)"""


@bind(
    "residual_training_frame",
    f"""SELECT m.scenario, m.year, baseline, momentum, thermal_humidity_index, wetness_index, rate_a,
      rate_a - baseline AS residual_target
    FROM ({MOMENTUM_SQL}) AS m JOIN {INDEX_SQL} AS i ON m.scenario = i.scenario AND m.year = i.year WHERE baseline IS NOT NULL""",
    needs="scenario_year",
    rounded="momentum thermal_humidity_index wetness_index residual_target",
)
def residual_training_frame(t):
    indices = climate_indices(anomalies(t), F.lit(True))
    rows = momentum(t).join(indices, ["scenario", "year"])
    return training.residual_frame(
        rows, "rate_a", "baseline", ["momentum", "thermal_humidity_index", "wetness_index"], ["scenario", "year"]
    )


@bind(
    "residual_anchor_gaps",
    f"""SELECT year, month, rate_a - rate_a_same_month_last_year AS residual_target,
      rate_a_same_month_last_year - rate_a_anchor_prev AS gap_to_december,
      rate_a_same_month_last_year - rate_a_anchor_q4_mean AS gap_to_q4 FROM ({ANCHOR_SQL}) AS a""",
    needs="month_cases",
    rounded="residual_target gap_to_december gap_to_q4",
)
def residual_anchor_gaps(t):
    same = F.col("rate_a_same_month_last_year")
    rows = anchored(t).withColumn("gap_to_december", same - F.col("rate_a_anchor_prev")).withColumn(
        "gap_to_q4", same - F.col("rate_a_anchor_q4_mean")
    )
    framed = training.residual_frame(
        rows, "rate_a", "rate_a_same_month_last_year", ["gap_to_december", "gap_to_q4"], ["year", "month"]
    )
    return framed.select("year", "month", "residual_target", "gap_to_december", "gap_to_q4")


@bind(
    "observed_reference_table",
    """WITH o AS (SELECT year, rate, lag(rate) OVER (ORDER BY year) AS rate_lag_1, lag(rate, 2) OVER (ORDER BY year) AS rate_lag_2
      FROM (SELECT year, avg(rate_a) AS rate FROM month_cases GROUP BY 1) AS y)
    SELECT scenario, s.year, temp, rate, rate_lag_1, rate_lag_2, 'calibration' AS table_role
    FROM scenario_year s LEFT JOIN o ON s.year = o.year WHERE s.year <= 1999
    UNION ALL SELECT scenario, year, temp, NULL, NULL, NULL, 'projection' FROM scenario_year WHERE year BETWEEN 2000 AND 2001""",
    needs="month_cases scenario_year",
    rounded="rate rate_lag_1 rate_lag_2",
)
def observed_reference_table(t):
    """The national series has one row per year, so its lags are joins of the year before."""
    yearly = t.once("month_cases").groupBy("year").agg(F.avg("rate_a").alias("rate"))
    observed = yearly
    for k in (1, 2):
        before = yearly.select((F.col("year") + k).alias("year"), F.col("rate").alias(f"rate_lag_{k}"))
        observed = observed.join(before, "year", "left")
    climate = t.scenario_year.select("scenario", "year", "temp")
    return training.scenario_tables(climate, observed, "year", ["rate"], 1999, 2001)


RISK_SQL = """h AS (SELECT * FROM risk_panel WHERE split IN ('validation', 'test')),
      q AS (SELECT quantile_cont(score, 1::DOUBLE / 3) AS lo, quantile_cont(score, 2::DOUBLE / 3) AS me FROM h)"""
SCORE_SQL = """CAST(round_even(100.0::DOUBLE * (SELECT count(*) FROM h h2 WHERE h2.score <= {0}.score)
      / (SELECT count(*) FROM h), 0) AS INTEGER)"""


@bind(
    "risk_snapshot",
    f"""WITH {RISK_SQL}, s AS (SELECT site, site_name, week_start, score AS value, {SCORE_SQL.format('h')} AS score,
        CASE WHEN score < lo THEN 'Low' WHEN score < me THEN 'Medium' ELSE 'High' END AS level,
        lo AS low_threshold, me AS medium_threshold FROM h, q WHERE split = 'test' AND week_start = (SELECT max(week_start) FROM h WHERE split = 'test')),
      r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, value DESC, site_name) AS INTEGER) AS position FROM s)
    SELECT site, site_name, week_start, value, score, level, low_threshold, medium_threshold,
      CASE WHEN position <= 8 THEN position END AS top_position FROM r""",
    needs="risk_panel",
    rounded="low_threshold medium_threshold",
)
def risk_snapshot(t):
    holdout = t.risk_panel.where(F.col("split").isin("validation", "test")).withColumnRenamed("score", "value")
    return risk.snapshot(holdout, "site", "site_name", "week_start", "value")


LIVE_WEEK_SQL = "(SELECT max(week_start) - 14 FROM risk_panel)"


@bind(
    "live_risk_snapshot",
    f"""WITH {RISK_SQL}, p AS (SELECT site, site_name, week_start, score AS value, {SCORE_SQL.format('risk_panel')} AS score,
        CASE WHEN score < lo THEN 'Low' WHEN score < me THEN 'Medium' ELSE 'High' END AS level,
        lo AS low_threshold, me AS medium_threshold FROM risk_panel, q
      WHERE week_start BETWEEN {LIVE_WEEK_SQL} - 7 AND {LIVE_WEEK_SQL}),
      d AS (SELECT *, score - lag(score) OVER (PARTITION BY site ORDER BY week_start) AS score_delta FROM p),
      c AS (SELECT * FROM d WHERE week_start = {LIVE_WEEK_SQL} AND score_delta IS NOT NULL),
      r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, value DESC, site_name) AS INTEGER) AS position FROM c)
    SELECT site, site_name, week_start, value, score, level, score_delta, low_threshold, medium_threshold,
      CASE WHEN score_delta > 0 THEN '+' || score_delta || ' točk glede na prejšnji teden'
        WHEN score_delta < 0 THEN score_delta || ' točk glede na prejšnji teden'
        ELSE 'brez spremembe glede na prejšnji teden' END AS trend,
      CASE WHEN position <= 8 THEN position END AS top_position FROM r""",
    needs="risk_panel",
    rounded="low_threshold medium_threshold",
)
def live_risk_snapshot(t):
    panel = t.once("risk_panel").withColumnRenamed("score", "value")
    holdout = panel.where(F.col("split").isin("validation", "test"))
    week = panel.agg(F.date_sub(F.max("week_start"), 14)).scalar()
    return risk.live_snapshot(holdout, panel, "site", "site_name", "week_start", "value", week)


@bind(
    "weekly_training_table",
    """WITH c AS (SELECT site, week_start, cases_a, cases_b, lag(cases_a, 2) OVER w AS cases_a_lag_2, lag(cases_a, 3) OVER w AS cases_a_lag_3,
        lag(cases_b, 2) OVER w AS cases_b_lag_2,
        CASE WHEN count(*) OVER (PARTITION BY site ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4
          THEN CAST(sum(cases_a) OVER (PARTITION BY site ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS BIGINT) END
          AS cases_a_prev_4_sum,
        CASE WHEN count(*) OVER (PARTITION BY site ORDER BY week_start ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) = 8
          THEN CAST(sum(cases_b) OVER (PARTITION BY site ORDER BY week_start ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS BIGINT) END
          AS cases_b_prev_8_sum
      FROM site_week WHERE line_count > 1 WINDOW w AS (PARTITION BY site ORDER BY week_start))
    SELECT p.site, p.week_start, p.temp_mean, p.rain_sum, s.elevation_mean, s.region_name, p.year, y.year AS population_source_year,
      y.population, y.density, c.cases_a, c.cases_b, cases_a_lag_2, cases_a_lag_3, cases_b_lag_2, cases_a_prev_4_sum,
      cases_b_prev_8_sum, c.cases_a IS NULL AS target_missing
    FROM (SELECT *, CAST(year(week_start) AS INTEGER) AS year FROM site_week) p LEFT JOIN static_site s ON p.site = s.site
    ASOF LEFT JOIN yearly_site y ON p.site = y.site AND p.year >= y.year
    LEFT JOIN c ON p.site = c.site AND p.week_start = c.week_start""",
    needs="site_week static_site yearly_site",
)
def weekly_training_table(t):
    """Weather, static, yearly and case columns in one plan."""
    weather = t.once("site_week").select("site", "week_start", "temp_mean", "rain_sum")
    static = t.static_site.select("site", "elevation_mean", "region_name")
    cases = t.once("site_week").where("line_count > 1")
    return training.weekly_training(weather, static, t.yearly_site, cases)


MODEL_FEATURES = ("temp_mean", "rain_sum", "humid_mean", "elevation_mean", "population", "cases_a_lag_2", "month")
SPEC = trees.TreeSpec(
    target="target",
    numeric=MODEL_FEATURES,
    categorical=("region_name",),
    time="week_start",
    balanced=True,
    ids=("site", "week_start"),
)
#: Seven core and seven local groups; the month takes part in every variant.
CORE_GROUPS = {
    "temperature": ["temp_mean", "temp_min", "temp_max"],
    "humidity": ["humid_mean"],
    "precipitation": ["rain_sum"],
    "soil": ["rain_prev_4"],
    "topography": ["elevation_mean", "elevation_range"],
    "land_cover": ["stations"],
    "population": ["population", "density"],
}
LOCAL_GROUPS = {
    "temperature_last_week": ["temp_lag_1"],
    "humidity_last_week": ["humid_lag_1"],
    "precipitation_last_week": ["rain_lag_1"],
    "temperature_before": ["temp_lag_2"],
    "humidity_before": ["humid_lag_2"],
    "precipitation_before": ["rain_lag_2"],
    "cases_before": ["cases_a_lag_2", "cases_b_lag_2"],
}
CONTROL = ["month"]
ABLATION_TARGETS = ["cases_next_4", "cases_b_next_4", "cases_next_8"]
ABLATION_FOLDS = [1998, 1999, 2000, 2001]
#: Folds that measure the iterations of the fit scored on 2001, which none of them sees.
FROZEN_FOLDS = [1997, 1998, 1999, 2000]


def training_panel(t: Tables):
    """Site-weeks with features and a next-four-weeks target, written once for the boosting rounds."""
    w = windows.over_panel("site", "week_start")
    panel = t.site_week.select(
        "site",
        "week_start",
        "temp_mean",
        "rain_sum",
        "humid_mean",
        F.month("week_start").alias("month"),
        F.year("week_start").alias("year"),
        "temp_min",
        "temp_max",
        *[F.lag(f"{c}_{kind}", k).over(w).alias(f"{c}_lag_{k}") for c, kind in (("temp", "mean"), ("humid", "mean"), ("rain", "sum")) for k in (1, 2)],
        *[F.lag(f"cases_{c}", 2).over(w).alias(f"cases_{c}_lag_2") for c in "ab"],
        windows.prev_full("rain_sum", 4, w).alias("rain_prev_4"),
        windows.next_full("cases_a", 4, w).alias("cases_next_4"),
        windows.next_full("cases_b", 4, w).alias("cases_b_next_4"),
        windows.next_full("cases_a", 8, w).alias("cases_next_8"),
    )
    panel = panel.join(t.static_site.select("site", "elevation_mean", "elevation_range", "stations", "region_name"), "site", "left")
    panel = asof_year(panel, t.yearly_site, "site", "year", ["population", "density"], "population_year")
    panel = materialize(panel, "feature_panel")
    typical = panel.groupBy("year").agg(F.avg("cases_next_4").alias("typical"))
    labelled = panel.join(typical, "year").withColumn(
        "target", (F.col("cases_next_4") > F.col("typical")).cast("int")
    )
    split = (
        F.when(F.col("year") < 2000, "train").when(F.col("year") < 2001, "validation").otherwise("test")
    )
    return materialize(labelled.withColumn("split", split).where("target is not null"), "training_panel")


@bind(
    "ordered_target_statistics",
    """WITH panel AS (SELECT w.site, w.week_start, s.region_name, w.cases_a FROM site_week w LEFT JOIN static_site s ON w.site = s.site),
    cells AS (SELECT region_name, week_start, count(cases_a) AS n, sum(cases_a) AS total FROM panel WHERE cases_a IS NOT NULL GROUP BY 1, 2),
    every AS (SELECT week_start, sum(n) AS n, sum(total) AS total FROM cells GROUP BY 1),
    own AS (SELECT p.site, p.week_start, coalesce(sum(c.n), 0) AS n, coalesce(sum(c.total), 0) AS total
      FROM panel p LEFT JOIN cells c ON c.region_name = p.region_name AND c.week_start < p.week_start GROUP BY 1, 2),
    prior AS (SELECT w.week_start, sum(e.total) / sum(e.n) AS mean FROM (SELECT DISTINCT week_start FROM panel) w
      LEFT JOIN every e ON e.week_start < w.week_start GROUP BY 1)
    SELECT p.site, p.week_start, p.region_name, (o.total + 10.0 * r.mean) / (o.n + 10.0) AS earlier_cases
    FROM panel p JOIN own o ON o.site = p.site AND o.week_start = p.week_start JOIN prior r ON r.week_start = p.week_start""",
    needs="site_week static_site",
    rounded="earlier_cases",
)
def ordered_target_statistics(t):
    """Mean cases of the region's earlier weeks for each site-week, drawn towards that of all earlier weeks."""
    panel = t.once("site_week").select("site", "week_start", "cases_a").join(t.static_site.select("site", "region_name"), "site", "left")
    history = target_history(panel, "region_name", "cases_a", "week_start")
    found = earlier_mean(panel, history, "region_name", "week_start", "earlier_cases")
    return found.select("site", "week_start", "region_name", "earlier_cases")


@bind("gbt_train_score")
def gbt_train_score(t):
    """Metrics per split of a balanced classifier with early stop on the validation year."""
    panel = training_panel(t)
    model = trees.train(panel, SPEC)
    scored = materialize(trees.score(model, panel, SPEC), "scored_panel")
    confusion = metrics.confusion_metrics(scored, "target", "score", ["split"])
    auc = metrics.roc_auc(scored, "target", "score", ["split"]).select("split", "roc_auc")
    return confusion.join(auc, "split")


@bind("holdout_predictions")
def holdout_predictions(t):
    panel = training_panel(t)
    return trees.holdout_predictions(trees.train(panel, SPEC), panel, SPEC)


@bind("feature_importance")
def feature_importance(t):
    panel = training_panel(t)
    return trees.importances(t.spark, trees.train(panel, SPEC), SPEC)


@bind("feature_attributions")
def feature_attributions(t):
    """What each feature adds to the log odds of the validation and test rows, next to the score they sum to."""
    panel = training_panel(t)
    model = trees.train(panel, SPEC)
    held = panel.where("split in ('validation', 'test')").select(*SPEC.ids, *SPEC.numeric, *SPEC.categorical)
    effects = [f"effect_{c}" for c in (*SPEC.numeric, *SPEC.categorical)]
    scored = trees.score(model, trees.attributions(model, held, SPEC), SPEC)
    return scored.select(*SPEC.ids, *effects, "base_value", "score")


@bind("attribution_dependence")
def attribution_dependence(t):
    """Median attribution of a feature in bins of its values, for three features of the classifier."""
    panel = training_panel(t)
    model = trees.train(panel, SPEC)
    rows = materialize(trees.attributions(model, panel.select(*SPEC.ids, *SPEC.numeric, *SPEC.categorical), SPEC), "attributions")
    parts = [metrics.binned_dependence(rows, c, f"effect_{c}").withColumn("feature", F.lit(c)) for c in ("temp_mean", "rain_sum", "population")]
    return reduce(DataFrame.unionByName, parts)


REGRESSION = trees.TreeSpec(target="cases_next_4", numeric=("temp_mean",), binary=False)


@bind("grouped_ablation")
def grouped_ablation(t):
    """All targets and variants on four folds, with the effect of each group against the reference."""
    from biotope.operators.joins import reference_effect

    panel = training_panel(t)
    results = trees.grouped_ablation(
        panel, ABLATION_TARGETS, CORE_GROUPS, LOCAL_GROUPS, "year", ABLATION_FOLDS, REGRESSION, CONTROL
    )
    return reference_effect(results, ["target", "fold_year"], "variant", "reference", "rmse", "comparison")


@bind("frozen_holdout")
def frozen_holdout(t):
    """Regression trained before 2001 with the frozen iteration count, scored once on 2001."""
    from dataclasses import replace

    panel = training_panel(t)
    spec = replace(REGRESSION, numeric=("temp_mean", "rain_sum", "month"))
    rows = panel.where(F.col(spec.target).isNotNull())
    best = trees.best_iterations(rows, spec, "year", FROZEN_FOLDS)
    scored = trees.frozen_holdout(panel, spec, "year", 2001, best)
    return scored.select("site", "week_start", "cases_next_4", "score", "iterations")
