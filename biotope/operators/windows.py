"""Panel windows: partitioned by site, ordered by period.

A panel holds one row per site and period, so a window partition is as long as
the calendar, not as the raw data. Frames count rows, not periods. All columns of
one call share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def over_panel(site: str | Sequence[str], period: str):
    keys = [site] if isinstance(site, str) else list(site)
    return Window.partitionBy(*keys).orderBy(period)


def lags(column: str, steps: Sequence[int], window) -> dict[str, Column]:
    return {f"{column}_lag_{k}": F.lag(column, k).over(window) for k in steps}


def prev_mean(column: str, k: int, window) -> Column:
    """Mean of the previous ``k`` rows, from as few as one value."""
    return F.avg(column).over(window.rowsBetween(-k, -1))


def prev_full(column: str, k: int, window, how: str = "sum") -> Column:
    """Sum or mean of the previous ``k`` rows, NULL unless all ``k`` have a value."""
    frame = window.rowsBetween(-k, -1)
    value = F.sum(column) if how == "sum" else F.avg(column)
    return F.when(F.count(column).over(frame) == k, value.over(frame))


def trailing_full(column: str, k: int, window) -> Column:
    frame = window.rowsBetween(-(k - 1), 0)
    return F.when(F.count(column).over(frame) == k, F.sum(column).over(frame))


def next_full(column: str, k: int, window) -> Column:
    """Sum of the next ``k`` rows, NULL where fewer remain."""
    frame = window.rowsBetween(1, k)
    return F.when(F.count(column).over(frame) == k, F.sum(column).over(frame))


def forward_targets(df: DataFrame, cases: str, horizons: Sequence[int], site: str, period: str,
                    population: str | None = None) -> DataFrame:
    """Sum, presence flag and rate of the next ``k`` periods' cases."""
    w = over_panel(site, period)
    sums = df.select("*", *[next_full(cases, k, w).alias(f"{cases}_next_{k}") for k in horizons])
    extra = []
    for k in horizons:
        total = F.col(f"{cases}_next_{k}")
        extra.append((total > 0).cast("int").alias(f"{cases}_any_next_{k}"))
        if population:
            rate = F.when(F.col(population) > 0, total / F.col(population) * 100000.0)
            extra.append(rate.alias(f"{cases}_per_100k_next_{k}"))
    return sums.select("*", *extra)


def forward_fill(column: str, window) -> Column:
    return F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key; the rank limit is applied before the exchange, so hot keys shrink early."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("key_row", F.row_number().over(w)).where("key_row = 1").drop("key_row")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Positions of a summary table's rows (variants of a target, a handful per group)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def period_delta(df: DataFrame, value: str, site: str, period: str, name: str = "delta") -> DataFrame:
    """Value minus the value of the period before."""
    before = F.lag(value).over(over_panel(site, period))
    return df.withColumn(name, F.col(value) - before)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, the same ones whatever the partitioning; kept by a top-n per task."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def inverse_group_weight(df: DataFrame, group: str, name: str = "row_weight") -> DataFrame:
    """1 / rows of the group, from a pre-aggregated count instead of a window over the group."""
    sizes = df.groupBy(group).agg((F.lit(1.0) / F.count(F.lit(1))).alias(name))
    return df.join(sizes, group)


def deaccumulate(
    df: DataFrame, cell: Sequence[str], time: str, total: str, name: str = "increment"
) -> DataFrame:
    """Running daily total -> hourly increments.

    Hour 0 closes the accumulation day before it as step 24; the first step has
    nothing before it; a falling total counts as 0.
    """
    day = F.to_date(F.col(time) - F.expr("INTERVAL 1 HOUR"))
    hour = F.hour(time)
    step = F.when(hour == 0, 24).otherwise(hour)
    steps = df.withColumn("accumulation_day", day).withColumn("accumulation_step", step)
    w = Window.partitionBy(*cell, "accumulation_day").orderBy("accumulation_step")
    change = F.col(total) - F.coalesce(F.lag(total).over(w), F.lit(0.0))
    return steps.withColumn(name, F.greatest(change, F.lit(0.0)))


def with_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Append named columns in one projection."""
    return df.select("*", *[c.alias(name) for name, c in columns.items()])
