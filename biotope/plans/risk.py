"""Risk publication: percentile score, level, trend, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotope.functions.rules import level, trend_label
from biotope.operators.ordering import percentile_scores, quantile_columns
from biotope.operators.windows import period_delta, top_per_key
from biotope.session import materialize

# The quantiles that part Low, Medium and High.
LOW_QUANTILE = 1 / 3
MEDIUM_QUANTILE = 2 / 3
TOP_SITES = 8

# Display labels of features; others show their name with blanks.
FEATURE_LABELS = {
    "week_of_year_cos": "sezonski signal",
    "week_of_year_sin": "sezonski signal",
    "urban_cover_pct": "urbaniziranost",
    "air_temperature_c_mean_rolling_4w_mean": "temperaturni trend",
    "elevation_m_std": "razgiban relief",
    "elevation_m_range": "visinska raznolikost",
    "elevation_m_mean": "nadmorska visina",
    "forest_cover_pct": "gozdna pokrovnost",
    "mixed_forest_cover_pct": "mesani gozd",
    "broad_leaved_forest_cover_pct": "listnati gozd",
    "coniferous_forest_cover_pct": "iglasti gozd",
    "dominant_clc_cover_pct": "tip rabe tal",
    "agricultural_cover_pct": "kmetijska krajina",
    "shrub_transitional_cover_pct": "grmisca in prehodni habitat",
    "soil_temperature_level_1_c_mean": "temperatura tal",
    "soil_temperature_level_2_c_mean": "temperatura globljih tal",
    "wet_hours_ge_0_1mm_sum": "mokri dnevi",
}


def feature_label(name: Column, labels: dict[str, str] = FEATURE_LABELS) -> Column:
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.replace(name, F.lit("_"), F.lit(" ")))


def tercile_thresholds(holdout: DataFrame, score: str, groups: Sequence[str] = ()) -> DataFrame:
    named = {"low_threshold": LOW_QUANTILE, "medium_threshold": MEDIUM_QUANTILE}
    return quantile_columns(holdout, score, named, groups)


def site_order(score: str, value: str, name: str) -> list[Column]:
    return [F.col(score).desc(), F.col(value).desc(), F.col(name).asc()]


def publish(holdout: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Percentile score, level and the level's thresholds of ``rows`` against the holdout distribution.

    The holdout includes the published week itself.
    """
    thresholds = tercile_thresholds(holdout, value).select(F.struct("*").alias("cut")).scalar()
    scored = percentile_scores(holdout, rows, value).withColumn("cut", thresholds)
    return scored.withColumn(
        "level", level(F.col(value), F.col("cut.low_threshold"), F.col("cut.medium_threshold"))
    ).select("*", "cut.low_threshold", "cut.medium_threshold").drop("cut")


def snapshot(holdout: DataFrame, site: str, name: str, period: str, value: str, top: int = TOP_SITES) -> DataFrame:
    """Latest test week of the holdout, scored; the first sites get their position.

    The holdout is read by the thresholds, the percentiles and the ranking, so it is
    written once.
    """
    holdout = materialize(holdout.select(site, name, period, "split", value), "holdout")
    latest = holdout.where("split = 'test'").agg(F.max(period)).scalar()
    week = holdout.where((F.col("split") == "test") & (F.col(period) == latest))
    published = publish(holdout, week.select(site, name, period, value), value)
    return mark_top(published, site, name, period, value, top)


def mark_top(published: DataFrame, site: str, name: str, period: str, value: str, top: int) -> DataFrame:
    """Position among the first ``top`` sites of the period, NULL for the others."""
    first = top_per_key(published, [period], site_order("score", value, name), top, "top_position")
    return published.join(first.select(site, period, "top_position"), [site, period], "left")


def live_snapshot(holdout: DataFrame, weeks: DataFrame, site: str, name: str, period: str, value: str,
                  reference_week: Column, top: int = TOP_SITES) -> DataFrame:
    """Current and previous week of every site scored alike, with level and trend."""
    holdout = materialize(holdout.select(value), "holdout")
    weeks = materialize(weeks.select(site, name, period, value), "weeks")
    pair = weeks.where(F.col(period).between(F.date_sub(reference_week, 7), reference_week))
    published = publish(holdout, pair.select(site, name, period, value), value)
    current = (
        period_delta(published, "score", site, period, "score_delta")
        .where(F.col(period) == reference_week)
        .where("score_delta is not null")
        .withColumn("trend", trend_label(F.col("score_delta")))
    )
    return mark_top(current, site, name, period, value, top)
