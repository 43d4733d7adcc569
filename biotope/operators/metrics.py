"""Regression, classification, ranking and calibration metrics.

Every metric is an aggregate over rows or over value cells; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotope.operators.ordering import (
    ordered_totals,
    quantile_bins,
    quantile_columns,
    value_prefix,
)
from biotope.session import materialize

THRESHOLD = 0.5


def r_squared(mse: Column, variance: Column) -> Column:
    return F.when(variance == 0, 1.0).otherwise(1.0 - F.try_divide(mse, variance))


def regression_metrics(df: DataFrame, truth: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, mean target and R2 = 1 - SSE / SST (1 when the target does not vary).

    SST comes from the population variance, which Spark merges from central moments;
    so one pass suffices and large targets do not cancel.
    """
    error = F.col(truth) - F.col(prediction)
    mse, variance = F.avg(error * error), F.var_pop(truth)
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(truth).alias("mean_target"),
        r_squared(mse, variance).alias("r2"),
    )


def bias_and_mape(df: DataFrame, truth: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    error = F.col(prediction) - F.col(truth)
    share = F.when(F.abs(truth) > 1e-9, F.abs(error / F.when(F.abs(truth) > 1e-9, F.col(truth))) * 100.0)
    return df.groupBy(*groups).agg(F.avg(error).alias("bias"), F.avg(share).alias("mape_pct"))


def weighted_errors(
    df: DataFrame, truth: str, prediction: str, weight: str, groups: Sequence[str] = ()
) -> DataFrame:
    error, w = F.col(prediction) - F.col(truth), F.col(weight)
    usable = F.abs(truth) > 1e-9
    share = F.abs(error / F.when(usable, F.col(truth))) * 100.0
    return df.groupBy(*groups).agg(
        F.sqrt(F.sum(w * error * error) / F.sum(w)).alias("weighted_rmse"),
        (F.sum(w * F.abs(error)) / F.sum(w)).alias("weighted_mae"),
        (F.sum(w * error) / F.sum(w)).alias("weighted_bias"),
        (F.sum(F.when(usable, w * share)) / F.sum(F.when(usable, w))).alias("weighted_mape_pct"),
    )


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def confusion_metrics(
    df: DataFrame, truth: str, score: str, groups: Sequence[str] = (), threshold: float = THRESHOLD
) -> DataFrame:
    actual, called = F.col(truth) == 1, F.col(score) >= threshold
    counts = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(actual & called).alias("tp"),
        F.count_if(~actual & called).alias("fp"),
        F.count_if(actual & ~called).alias("fn"),
        F.count_if(~actual & ~called).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    return counts.select(
        "*",
        ratio_or_zero(tp + tn, F.col("rows")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio_or_zero(2 * precision * recall, precision + recall).alias("f1"),
        ratio_or_zero(tp + fn, F.col("rows")).alias("positive_rate"),
    )


def roc_auc(df: DataFrame, truth: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney statistic with averaged ties; 0 when a class is absent.

    Needs only the cells per distinct score: a positive beats the negatives
    below it and half of those tied with it.
    """
    groups = list(groups)
    cells = value_prefix(df, score, groups, {"positives": (F.col(truth) == 1).cast("int")})
    negatives = F.col("n") - F.col("positives")
    negatives_before = F.col("n_before") - F.col("positives_before")
    wins = F.sum(F.col("positives") * (negatives_before + negatives / 2.0))
    pairs = F.sum("positives") * F.sum(negatives)
    return cells.groupBy(*groups).agg(
        F.sum("positives").alias("positives"),
        F.sum(negatives).alias("negatives"),
        F.coalesce(F.try_divide(wins, pairs), F.lit(0.0)).alias("roc_auc"),
    )


def precision_terms(
    df: DataFrame, truth: str, score: str, tie: str, groups: Sequence[str] = (), staged: bool = False
) -> DataFrame:
    """Running positives and precision at every row by score descending, then id."""
    sums = {"positives_so_far": (F.col(truth) == 1).cast("int")}
    ranked = ordered_totals(df, score, tie, groups, sums, staged=staged)
    return ranked.withColumn("precision_at", F.col("positives_so_far") / F.col("position"))


def average_precision(
    df: DataFrame, truth: str, score: str, tie: str, groups: Sequence[str] = ()
) -> DataFrame:
    """Mean precision at the positives; 0 when there is none."""
    terms = precision_terms(df, truth, score, tie, groups)
    positive = F.col(truth) == 1
    return terms.groupBy(*groups).agg(
        F.count_if(positive).alias("positives"),
        F.coalesce(F.avg(F.when(positive, F.col("precision_at"))), F.lit(0.0)).alias("average_precision"),
    )


def group_sizes(rows: DataFrame, truth: str, groups: Sequence[str]) -> DataFrame:
    positive = (F.col(truth) == 1).cast("int")
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("group_rows"), F.avg(positive).alias("prevalence"))
    return sizes


def cumulative_gain(
    df: DataFrame, truth: str, score: str, tie: str, groups: Sequence[str], largest_fraction: float = 0.2
) -> DataFrame:
    """Running positives, precision and lift over the highest-scored fraction of each group."""
    groups = list(groups)
    rows = materialize(df, "gain_rows")
    ranked = precision_terms(rows, truth, score, tie, groups, staged=True)
    joined = ranked.join(group_sizes(rows, truth, groups), groups)
    return joined.withColumn("fraction", F.col("position") / F.col("group_rows")).withColumn(
        "lift", F.try_divide(F.col("precision_at"), F.col("prevalence"))
    ).where(F.col("fraction") <= largest_fraction)


def top_fraction(
    df: DataFrame, truth: str, score: str, tie: str, groups: Sequence[str], fraction: float = 0.01
) -> DataFrame:
    """Precision and lift of the first max(1, floor(n * fraction)) rows."""
    groups = list(groups)
    rows = materialize(df, "top_rows")
    ranked = ordered_totals(rows, score, tie, groups, staged=True)
    positive = (F.col(truth) == 1).cast("int")
    joined = ranked.join(group_sizes(rows, truth, groups), groups).where(
        F.col("position") <= F.greatest(F.lit(1), F.floor(F.col("group_rows") * fraction))
    )
    return joined.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("top_rows"),
        F.avg(positive).alias("top_precision"),
        F.try_divide(F.avg(positive), F.max("prevalence")).alias("top_lift"),
    )


def calibration(df: DataFrame, truth: str, score: str, bins: int = 10, groups: Sequence[str] = ()) -> DataFrame:
    placed = quantile_bins(df, score, bins, groups)
    return placed.groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(truth).cast("double")).alias("observed_rate"),
    )


def binned_dependence(df: DataFrame, feature: str, effect: str, bins: int = 12, least: int = 4) -> DataFrame:
    """Mean feature and median effect per quantile bin; no rows below ``least`` distinct values.

    The medians come from running counts per bin, so a bin may hold most rows.
    """
    rows = materialize(df.where(F.col(feature).isNotNull()), "dependence")
    distinct = rows.select(feature).distinct().limit(bins).count()
    placed = quantile_bins(rows, feature, max(distinct, 1), lowest_joins_first=True, staged=True)
    placed = placed.where(F.lit(distinct >= least))
    means = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), F.avg(feature).alias("feature_mean"))
    medians = quantile_columns(placed, effect, {"effect_median": 0.5}, ["bin"])
    return means.join(medians, "bin")


def pr_curve(df: DataFrame, truth: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Precision and recall when everything scored at least the threshold is called."""
    groups = list(groups)
    positive = (F.col(truth) == 1).cast("int")
    cells = value_prefix(df, score, groups, {"positives": positive}, descending=True)
    totals = cells.groupBy(*groups).agg(F.sum("positives").alias("all_positives"))
    joined = cells.join(totals, groups) if groups else cells.withColumn(
        "all_positives", totals.scalar()
    )
    found = F.col("positives_before") + F.col("positives")
    return joined.select(
        *groups,
        F.col(score).alias("threshold"),
        (found / (F.col("n_before") + F.col("n"))).alias("precision"),
        ratio_or_zero(found, F.col("all_positives")).alias("recall"),
    )


def correlation(first: str, second: str) -> Column:
    """Pearson correlation, NULL when either side does not vary."""
    return F.try_divide(F.covar_pop(first, second), F.stddev_pop(first) * F.stddev_pop(second))


def spearman(df: DataFrame, first: str, second: str, groups: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of tie-averaged ranks over the pairs without a missing member.

    Pairs are counted per distinct (first, second) first, so ties are ranked once; both mean
    ranks are (n + 1) / 2 by construction. NULL where a side has a single value.
    """
    groups = list(groups)
    pairs = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    cells = materialize(pairs.groupBy(*groups, first, second).agg(F.count(F.lit(1)).alias("pairs")), "pairs")

    def ranked(value: str, name: str) -> DataFrame:
        prefix = value_prefix(cells, value, groups, {"held": F.col("pairs")}, staged=True)
        return prefix.select(*groups, value, (F.col("held_before") + (F.col("held") + 1) / 2.0).alias(name))

    sizes = cells.groupBy(*groups).agg(((F.sum("pairs") + 1) / 2.0).alias("middle"))
    placed = cells.join(ranked(first, "rank_a"), [*groups, first]).join(ranked(second, "rank_b"), [*groups, second])
    placed = placed.join(sizes, groups) if groups else placed.withColumn("middle", sizes.scalar())
    a, b, n = F.col("rank_a") - F.col("middle"), F.col("rank_b") - F.col("middle"), F.col("pairs")
    spread = F.sqrt(F.sum(n * a * a)) * F.sqrt(F.sum(n * b * b))
    return placed.groupBy(*groups).agg(
        F.sum("pairs").alias("rows"), (F.sum(n * a * b) / F.nullif(spread, F.lit(0.0))).alias("spearman")
    )


def period_totals(df: DataFrame, truth: str, prediction: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(truth).alias("target_total"), F.sum(prediction).alias("prediction_total"))


def aggregate_fit(df: DataFrame, truth: str, prediction: str, split: str, period: str) -> DataFrame:
    """R2 and correlation of the period totals of each split."""
    totals = period_totals(df, truth, prediction, [split, period])
    error = F.col("target_total") - F.col("prediction_total")
    return totals.groupBy(split).agg(
        F.count(F.lit(1)).alias("periods"),
        correlation("target_total", "prediction_total").alias("correlation"),
        r_squared(F.avg(error * error), F.var_pop("target_total")).alias("r2"),
    )
