"""Wide <-> long, lead expansion, history and future unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEK_LABEL = r"^(\d{4})-(\d{1,2})$"


def unpivot_weeks(wide: DataFrame, ids: Sequence[str], year: int | None = None) -> DataFrame:
    """``YYYY-WW`` columns -> (ids, iso_year, iso_week, value).

    A header of another year than the sheet's is an error; a total column stays out.
    """
    labels = [c for c in wide.columns if c not in ids and c[:4].isdigit() and c[4:5] == "-"]
    foreign = [c for c in labels if year is not None and int(c[:4]) != year]
    if foreign:
        raise ValueError(f"week columns of another year: {foreign}")
    long = wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in labels], "label", "value")
    return long.select(
        *ids,
        F.regexp_extract("label", WEEK_LABEL, 1).cast("int").alias("iso_year"),
        F.regexp_extract("label", WEEK_LABEL, 2).cast("int").alias("iso_week"),
        "value",
    )


def unpivot_week_numbers(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``WW`` columns of sheets whose year is among the ids -> (ids, iso_week, value)."""
    labels = [c for c in wide.columns if c not in ids and c.isdigit()]
    long = wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in labels], "label", "value")
    return long.select(*ids, F.col("label").cast("int").alias("iso_week"), "value")


def unpivot_years(wide: DataFrame, ids: Sequence[str], prefix: str) -> DataFrame:
    """``<prefix>YYYY`` columns -> (ids, year, value) without NULL values."""
    labels = [c for c in wide.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    long = wide.unpivot(list(ids), labels, "label", "value").where("value is not null")
    return long.select(*ids, F.substring("label", len(prefix) + 1, 4).cast("int").alias("year"), "value")


def pivot_values(
    long: DataFrame, keys: Sequence[str], parameter: str, values: Sequence[str], pick: Column
) -> DataFrame:
    """One column per listed parameter; listing them avoids the extra distinct pass."""
    return long.groupBy(*keys).pivot(parameter, list(values)).agg(pick)


def pivot_availability(
    index: DataFrame, keys: Sequence[str], family: str, families: Sequence[str], path: str
) -> DataFrame:
    """Per key and family: available or not, and the first file; plus a flag for all families."""
    flags = [
        F.max(F.when(F.col(family) == f, True)).alias(f"has_{f}") for f in families
    ]
    paths = [F.min(F.when(F.col(family) == f, F.col(path))).alias(f"path_{f}") for f in families]
    wide = index.groupBy(*keys).agg(*flags, *paths)
    filled = wide.fillna(False, [f"has_{f}" for f in families])
    every = F.lit(True)
    for f in families:
        every = every & F.col(f"has_{f}")
    return filled.withColumn("has_all_families", every)


def explode_leads(files: DataFrame, first: str, last: str, name: str = "lead_month") -> DataFrame:
    return files.withColumn(name, F.explode(F.sequence(first, last)))


def melt_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(metrics), "metric_name", "metric_value")


def history_and_future(
    history: DataFrame, predictions: DataFrame, scenario: str, year: str, last_year: int | Column
) -> DataFrame:
    """Observed history repeated for every scenario, then the predictions, up to the horizon.

    The scenarios are the handful named by the predictions; they reach the history
    as one array.
    """
    names = predictions.agg(F.sort_array(F.collect_set(scenario))).scalar()
    repeated = history.withColumn(scenario, F.explode(names)).withColumn("role", F.lit("observed"))
    stacked = repeated.unionByName(predictions.withColumn("role", F.lit("predicted")), allowMissingColumns=True)
    return stacked.where(F.col(year) <= last_year)


def scope_by_date(template: DataFrame, target: str, last_observed: Column) -> DataFrame:
    """Label template rows as future or backtest by their target date."""
    return template.withColumn("scope", F.when(F.col(target) > last_observed, "future").otherwise("backtest"))


def prefer_split_files(files: DataFrame, keys: Sequence[str], variable: str) -> DataFrame:
    """Drop combined files of a key that also has per-variable files."""
    split = files.where(F.col(variable) != "").select(*keys).distinct()
    combined = files.where(F.col(variable) == "")
    return files.where(F.col(variable) != "").unionByName(combined.join(split, list(keys), "left_anti"))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
