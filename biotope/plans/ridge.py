"""Ridge regression from distributed sums, penalty selection and recursive projection.

Training reads the data once, or twice with weights (means, then centred products), whatever its size and number of
folds; what leaves the aggregate is one k x k matrix per year, merged into one per fold and solved with numpy.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotope.functions.rules import nonnegative
from biotope.session import materialize

SMALLEST_SCALE = 1e-12

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class RidgeModel:
    """Coefficients on the raw scale of the features."""

    features: tuple[str, ...]
    alpha: float
    intercept: float
    coefficients: tuple[float, ...]

    def predict(self, baseline: Column | None = None) -> Column:
        """Prediction as a plain column expression, clipped at 0.

        A model of residuals is added to its baseline before the cut, so a negative residual counts.
        """
        value = linear(self.intercept, dict(zip(self.features, self.coefficients)))
        return nonnegative(value if baseline is None else baseline + value)


def linear(intercept: float, coefficients: dict[str, float]) -> Column:
    total = F.lit(float(intercept))
    for name, coefficient in coefficients.items():
        total = total + F.lit(float(coefficient)) * F.col(name)
    return total


def gram_sums(
    df: DataFrame, features: Sequence[str], target: str, weight: str | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """Per group: weight sum, means, and centred sums of products (row-major, features then target)."""
    columns, groups = [*features, target], list(groups)
    w = F.col(weight) if weight else F.lit(1.0)
    means = df.groupBy(*groups).agg(
        F.sum(w).alias("weight_sum"),
        F.array(*[F.sum(w * F.col(c)) / F.sum(w) for c in columns]).alias("means"),
    )
    if groups:
        centred = df.join(means, groups)
    else:
        one = means.select(F.struct("*")).scalar()
        centred = df.withColumn("stats", one).select("*", "stats.weight_sum", "stats.means")
    def away(i):
        return F.col(columns[i]) - F.col("means")[i]

    products = [
        F.sum(w * away(i) * away(j)).alias(f"p_{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))
    ]
    sums = centred.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.first("weight_sum").alias("weight_sum"),
        F.first("means").alias("means"),
        *products,
    )
    return sums.select(
        *groups,
        "rows",
        "weight_sum",
        "means",
        F.array(
            *[
                F.col(f"p_{min(i, j)}_{max(i, j)}")
                for i in range(len(columns))
                for j in range(len(columns))
            ]
        ).alias("products"),
    )


def moments(df: DataFrame, features: Sequence[str], target: str, groups: Sequence[str]) -> DataFrame:
    """As ``gram_sums`` without weights for complete rows, in one pass: Spark merges covariances as central moments."""
    columns = [F.col(c).cast("double") for c in (*features, target)]
    n, size = F.count(F.lit(1)), len(columns)
    sums = df.groupBy(*groups).agg(
        n.alias("rows"),
        n.cast("double").alias("weight_sum"),
        F.array(*[F.avg(c) for c in columns]).alias("means"),
        *[(F.covar_pop(columns[i], columns[j]) * n).alias(f"p_{i}_{j}") for i in range(size) for j in range(i, size)],
    )
    products = F.array(*[F.col(f"p_{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)])
    return sums.select(*groups, "rows", "weight_sum", "means", products.alias("products"))


def fold_sums(
    df: DataFrame, features: Sequence[str], target: str, year: str, fold_years: Sequence[int], weight: str | None = None
) -> DataFrame:
    """Sums of the rows before each fold year, from sums by year.

    The rows are summed once, whatever the number of folds; a fold is the merger of its years, of which there
    are as many as the calendar has: means by weight, products by those within and between the years. A fold
    before which there are no rows is left out.
    """
    size = len(features) + 1
    known = df.where(F.col(year).isNotNull())
    by_year = gram_sums(known, features, target, weight, [year]) if weight else moments(known, features, target, [year])
    later = F.filter(F.array(*[F.lit(y) for y in fold_years]), lambda f: f > F.col(year))
    years = materialize(by_year, "year_sums").withColumn("fold_year", F.explode(later))
    w = F.col("weight_sum")
    whole = years.groupBy("fold_year").agg(
        F.sum("rows").alias("all_rows"), F.sum(w).alias("all_weight"), F.array(*[F.sum(w * F.col("means")[i]) / F.sum(w) for i in range(size)]).alias("middle")
    )

    def away(i: int) -> Column:
        return F.col("means")[i] - F.col("middle")[i]

    merged = years.join(whole, "fold_year").groupBy("fold_year").agg(
        F.first("all_rows").alias("rows"),
        F.first("all_weight").alias("weight_sum"),
        F.first("middle").alias("means"),
        *[F.sum(F.col("products")[i * size + j] + w * away(i) * away(j)).alias(f"p_{i}_{j}") for i in range(size) for j in range(i, size)],
    )
    products = F.array(*[F.col(f"p_{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)])
    return merged.select("fold_year", "rows", "weight_sum", "means", products.alias("products"))


def solve(weight_sum: float, means: Sequence[float], products: Sequence[float], alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and raw-scale coefficients from the sums of one group."""
    k = len(means) - 1
    full = np.asarray(products, dtype=float).reshape(k + 1, k + 1)
    scales = np.sqrt(np.diag(full)[:k] / weight_sum)
    scales = np.where(scales > SMALLEST_SCALE, scales, 1.0)
    gram = full[:k, :k] / np.outer(scales, scales)
    beta = np.linalg.pinv(gram + alpha * np.eye(k)) @ (full[:k, k] / scales) / scales
    return float(means[k] - np.dot(np.asarray(means[:k]), beta)), beta


def fit(df: DataFrame, features: Sequence[str], target: str, alpha: float, weight: str | None = None) -> RidgeModel:
    row = gram_sums(df, features, target, weight).head()
    intercept, beta = solve(row.weight_sum, row.means, row.products, alpha)
    return RidgeModel(tuple(features), float(alpha), intercept, tuple(float(b) for b in beta))


def solve_folds(sums: DataFrame, alphas: Sequence[float], groups: str) -> DataFrame:
    """One model per row of sums and penalty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            solved = [solve(r.weight_sum, r.means, r.products, r.alpha) for r in pdf.itertuples()]
            out = pdf.drop(columns=["rows", "weight_sum", "means", "products"])
            yield out.assign(
                intercept=[s[0] for s in solved], coefficients=[[float(b) for b in s[1]] for s in solved]
            )

    each = sums.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return each.mapInPandas(run, f"{groups}, alpha double, intercept double, coefficients array<double>")


def alpha_scores(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    year: str,
    fold_years: Sequence[int],
    alphas: Sequence[float],
    weight: str | None = None,
    baseline: str | None = None,
) -> DataFrame:
    """Mean fold RMSE per penalty and the selected one (ties: the smaller penalty).

    With a ``baseline`` the target is the residual from it, and the error is that of baseline plus
    predicted residual, clipped at 0.

    Sums by year give those of each fold, one small solve each (fold, penalty), and the validation
    rows are scored against that coefficient table; no row is copied into a fold.
    """
    extra = [c for c in (weight, baseline) if c]
    rows = materialize(df.select(year, *features, target, *extra), "alpha_rows")
    models = solve_folds(fold_sums(rows, features, target, year, fold_years, weight), alphas, "fold_year int")
    held_out = rows.where(F.col(year).isin(list(fold_years))).withColumn("fold_year", F.col(year).cast("int")).join(models, "fold_year")
    total = F.col("intercept")
    for i, name in enumerate(features):
        total = total + F.col("coefficients")[i] * F.col(name)
    base = F.col(baseline) if baseline else F.lit(0.0)
    error = base + F.col(target) - nonnegative(base + total)
    scored = held_out.groupBy("alpha", "fold_year").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    grid = scored.groupBy("alpha").agg(F.avg("rmse").alias("mean_rmse"), F.count(F.lit(1)).alias("folds"))
    best = grid.agg(F.min_by(F.col("alpha"), F.struct("mean_rmse", "alpha"))).scalar()
    return grid.withColumn("selected", F.col("alpha") == best)


def project(
    history: DataFrame,
    scenarios: DataFrame,
    keys: Sequence[str],
    year: str,
    target: str,
    features: Sequence[str],
    intercept: Column,
    lag: Column,
    rolling: Column,
    slopes: Sequence[Column],
) -> DataFrame:
    """Year-by-year projection feeding predictions back as lag-1 and mean of the last three.

    Each scenario's years form one sorted array (a calendar's length); the state of
    the fold is the last three values, so the recursion stays in the JVM. The three
    years before the first projected one must be observed, and the projected years
    must follow each other; anything else is an error.
    """
    keys = list(keys)
    recent = (
        history.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(year, target))).alias("past"))
        .select(*keys, F.slice("past", -3, 3).alias("past"))
    )
    ahead = scenarios.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(year, *[F.col(f).cast("double").alias(f) for f in features]))).alias("ahead")
    )
    span = F.transform("ahead", lambda p: p[year].cast("int"))
    seen = F.transform("past", lambda p: p[year].cast("int"))
    first = F.array_min(span)
    sound = (seen == F.array(first - 3, first - 2, first - 1)) & (span == F.sequence(first, F.array_max(span)))
    joined = ahead.join(recent, keys).withColumn(
        "seed",
        F.when(sound, F.transform("past", lambda p: p[target].cast("double"))).otherwise(
            F.raise_error(F.lit("three observed years are needed right before the projection, whose years must follow each other"))
        ),
    )
    empty = F.array().cast(f"array<struct<{year}:int,lag_1:double,rolling_3:double,predicted:double>>")
    start = F.struct(F.col("seed").alias("last3"), empty.alias("rows"))

    def step(state: Column, now: Column) -> Column:
        last3 = state["last3"]
        mean3 = (last3[0] + last3[1] + last3[2]) / 3.0
        value = intercept + lag * last3[2] + rolling * mean3
        for feature, slope in zip(features, slopes):
            value = value + slope * now[feature]
        predicted = nonnegative(value)
        row = F.struct(
            now[year].cast("int").alias(year),
            last3[2].alias("lag_1"),
            mean3.alias("rolling_3"),
            predicted.alias("predicted"),
        )
        return F.struct(
            F.array(last3[1], last3[2], predicted).alias("last3"),
            F.concat(state["rows"], F.array(row)).alias("rows"),
        )

    rows = F.aggregate("ahead", start, step, lambda state: state["rows"])
    return joined.select(*keys, F.inline(rows))


def baseline_momentum(target: str, window, strategy: str = "lag1") -> dict[str, Column]:
    """Baseline (value of the year before, or mean of the three years before) and recent momentum.

    ``window`` is ordered by a whole-numbered year; a missing year gives NULL, not the next older one.
    """
    lag_1 = F.max(target).over(window.rangeBetween(-1, -1))
    frame = window.rangeBetween(-3, -1)
    mean3 = F.when(F.count(target).over(frame) == 3, F.avg(target).over(frame))
    baseline = F.when(mean3.isNotNull(), lag_1) if strategy == "lag1" else mean3
    return {"baseline": baseline, "momentum": lag_1 - mean3}
