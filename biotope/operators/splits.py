"""Time-ordered splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def bucket_sizes(periods: int, train: float, validation: float) -> tuple[int, int, int]:
    """Periods per split: floors of the ratios, at least one each, the rest to test.

    When nothing is left for test, validation gives up periods first, then train.
    """
    if periods < 3:
        raise ValueError("at least 3 distinct periods are needed")
    n_train = max(1, int(periods * train))
    n_validation = max(1, int(periods * validation))
    excess = max(0, n_train + n_validation - (periods - 1))
    from_validation = min(excess, n_validation - 1)
    n_validation -= from_validation
    n_train -= excess - from_validation
    return n_train, n_validation, periods - n_train - n_validation


def ratio_split(df: DataFrame, period: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """All rows of a period share a split.

    Only the distinct periods (a calendar's length) are numbered, and joined back.
    """
    periods = df.select(period).distinct()
    sizes = bucket_sizes(periods.count(), train, validation)
    numbered = periods.withColumn("period_no", F.row_number().over(Window.orderBy(period)))
    split = (
        F.when(F.col("period_no") <= sizes[0], "train")
        .when(F.col("period_no") <= sizes[0] + sizes[1], "validation")
        .otherwise("test")
    )
    return df.join(numbered.select(period, split.alias("split")), period)


def boundary_split(df: DataFrame, period: str, train_end: str, validation_end: str) -> DataFrame:
    if train_end >= validation_end:
        raise ValueError("the train boundary must be before the validation boundary")
    return df.withColumn(
        "split",
        F.when(F.col(period) <= F.lit(train_end).cast("date"), "train")
        .when(F.col(period) <= F.lit(validation_end).cast("date"), "validation")
        .otherwise("test"),
    )


def year_role(year: Column, eligible: Column, development_from: int, holdout_year: int) -> Column:
    return (
        F.when(~F.coalesce(eligible, F.lit(False)), "not_eligible")
        .when(year < development_from, "historical")
        .when(year < holdout_year, "development")
        .otherwise("holdout")
    )


def expanding_folds(df: DataFrame, year: str, fold_years: Sequence[int]) -> DataFrame:
    """Rows of each fold: earlier years train, the fold year validates.

    The folds a row takes part in come from a filtered literal array, not from a
    range join.
    """
    folds = F.array(*[F.lit(y) for y in fold_years])
    taken = F.filter(folds, lambda f: f >= F.col(year))
    return df.withColumn("fold_year", F.explode(taken)).withColumn(
        "fold_role", F.when(F.col(year) < F.col("fold_year"), "train").otherwise("validate")
    )


def split_summary(df: DataFrame, split: str, target: str, site: str, period: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(target).alias("eligible_rows"),
        F.count_if(F.col(target) > 0).alias("positive_rows"),
        (F.try_divide(F.count_if(F.col(target) > 0).cast("double"), F.count(target)) * 100.0).alias("positive_pct"),
        F.count_distinct(site).alias("sites"),
        F.count_distinct(period).alias("periods"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
    )
