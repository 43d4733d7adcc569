"""Typed training rows and the weekly training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotope.functions.text import fill_category, is_missing, nan_to_null
from biotope.operators.joins import asof_year, static_join
from biotope.operators.windows import lags, over_panel, prev_full, with_columns


def typed_rows(
    raw: DataFrame,
    time: str,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    binary: bool = False,
    skip_missing_target: bool = True,
    weight: str | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Text columns -> typed columns plus ``problem``, NULL for usable rows.

    The first violation of a row is named, as the row-by-row reader would have
    reported it; callers keep one side or the other with ``usable`` and ``rejected``.
    A sample weight must be there, numeric and finite. ``row_id`` names the column whose
    value ``problem_row`` repeats for rejected rows (a distributed reader has no line numbers).
    """
    kept = raw.where(~is_missing(F.col(target))) if skip_missing_target else raw

    def number(name: str) -> Column:
        return F.nullif(F.trim(F.col(name)), F.lit("")).try_cast("double")

    written = F.trim(F.col(target))
    checks = [
        F.when(F.col(time).try_cast("timestamp").isNull(), "bad time"),
        F.when(is_missing(written), "missing target"),
    ]
    if binary:
        checks.append(F.when(~written.isin("0", "1"), "target is not 0 or 1"))
    else:
        checks.append(F.when(number(target).isNull(), "target is not a number"))
    checks += [
        F.when((F.coalesce(F.trim(F.col(c)), F.lit("")) != "") & number(c).isNull(), F.lit(f"bad number in {c}"))
        for c in numeric
    ]
    if weight:
        checks += [
            F.when(is_missing(F.trim(F.col(weight))), "missing weight"),
            F.when(number(weight).isNull(), "weight is not a number"),
            F.when(F.isnan(number(weight)) | (F.abs(number(weight)) == float("inf")), "weight is not finite"),
        ]
    typed = [c for c in raw.columns if c not in (time, target, weight, *numeric, *categorical)]
    problem = F.coalesce(*checks)
    return kept.select(
        *typed,
        F.col(time).try_cast("timestamp").alias(time),
        number(target).alias(target),
        *[nan_to_null(number(c)).alias(c) for c in numeric],
        *[fill_category(F.col(c)).alias(c) for c in categorical],
        *([number(weight).alias(weight)] if weight else []),
        problem.alias("problem"),
        *([F.when(problem.isNotNull(), F.col(row_id)).alias("problem_row")] if row_id else []),
    )


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("problem is null").drop("problem")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("problem is not null")


def weekly_training(
    weather: DataFrame, static: DataFrame, annual: DataFrame, cases: DataFrame, site: str = "site", period: str = "week_start"
) -> DataFrame:
    """Weather weeks with static columns, as-of yearly attributes, case history and targets.

    Joins go from the panel outwards and keep its rows; the case history is made on
    the case panel before the join, in one exchange by site.
    """
    w = over_panel(site, period)
    extra = lags("cases_a", [2, 3], w) | lags("cases_b", [2], w)
    extra["cases_a_prev_4_sum"] = prev_full("cases_a", 4, w)
    extra["cases_b_prev_8_sum"] = prev_full("cases_b", 8, w)
    history = with_columns(cases.select(site, period, "cases_a", "cases_b"), extra)
    base = static_join(weather, static, site).withColumn("year", F.year(period))
    attributed = asof_year(base, annual, site, "year", ["population", "density"], "population_source_year")
    return attributed.join(history, [site, period], "left").withColumn(
        "target_missing", F.col("cases_a").isNull()
    )


def residual_frame(
    rows: DataFrame, target: str, baseline: str, features: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Residual target against the baseline, complete rows only."""
    framed = rows.select(
        *keys, baseline, *features, F.col(target), (F.col(target) - F.col(baseline)).alias("residual_target")
    )
    return framed.dropna()


def scenario_tables(
    climate: DataFrame, observed: DataFrame, year: str, targets: Sequence[str], last_observed: int, horizon: int
) -> DataFrame:
    """Calibration years with observed targets and lags, projection years with typed NULLs."""
    lagged = observed.columns
    calibration = climate.where(F.col(year) <= last_observed).join(observed, year, "left")
    ahead = climate.where((F.col(year) > last_observed) & (F.col(year) <= horizon))
    kinds = dict(observed.dtypes)
    projection = ahead.select(
        *climate.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in lagged if c != year]
    )
    return calibration.withColumn("table_role", F.lit("calibration")).unionByName(
        projection.withColumn("table_role", F.lit("projection"))
    )
