"""Headered tables: required columns, trimmed values, table profile, ordered sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, required: Sequence[str], label: str = "table") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks required columns: {', '.join(missing)}")
    return df


def clean_table(df: DataFrame, required: Sequence[str], keys: Sequence[str], label: str = "table") -> DataFrame:
    """Required columns only, strings trimmed, rows with a blank key dropped."""
    require_columns(df, required, label)
    kinds = dict(df.dtypes)
    trimmed = df.select(*[(F.trim(c) if kinds[c] == "string" else F.col(c)).alias(c) for c in required])
    for key in keys:
        trimmed = trimmed.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return trimmed


def read_csv(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Headered UTF-8 file (a byte-order mark is skipped by the reader) with an explicit schema."""
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return clean_table(raw, schema.fieldNames(), keys, path)


def nan_as_null(df: DataFrame) -> DataFrame:
    """Map NaN to NULL once at ingest, so that Spark's aggregates skip it."""
    fractional = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(
        *[(F.when(~F.isnan(c), F.col(c)) if c in fractional else F.col(c)).alias(c) for c in df.columns]
    )


def table_profile(df: DataFrame, site: str, period: str, totals: Sequence[str]) -> DataFrame:
    """Row, site and period counts, period range, totals and NULL counts in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(site).alias("sites"),
        F.count_distinct(period).alias("periods"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
        *[F.sum(c).alias(f"{c}_total") for c in totals],
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns],
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def write_ordered(
    df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str | Column], partition: str | None = None
) -> None:
    """Parquet with explicit columns, range-partitioned and sorted by ``order``.

    With ``partition`` one folder per value is written, and only the folders
    present in ``df`` are replaced.
    """
    out = df.select(*columns)
    if partition is None:
        out.orderBy(*order).write.mode("overwrite").parquet(path)
        return
    (
        out.repartitionByRange(partition, *order)
        .sortWithinPartitions(partition, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
