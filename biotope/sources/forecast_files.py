"""Index of forecast files from their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotope.operators.reshape import explode_leads, prefer_split_files

# Fixed value: the naming scheme of the forecast archive.
FORECAST_NAME = (
    r"seasonal-monthly-single-levels_ecmwf_system_(\d+)_(copernicus_[a-z_]+)_init_(\d{4})_(\d{2})_"
    r"lead_(\d+)-(\d+)(?:_rawvar_([a-z0-9_]+))?\.grib$"
)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names below a folder, without reading the contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file_name"))


def file_index(files: DataFrame, name: str = "file_name") -> DataFrame:
    """System, family, initial month, lead range and raw variable of every matching name.

    Combined files are dropped where the same key has per-variable files.
    """
    def part(i: int):
        return F.regexp_extract(name, FORECAST_NAME, i)

    matching = files.where(F.col(name).rlike(FORECAST_NAME))
    parsed = matching.select(
        name,
        part(1).cast("int").alias("system"),
        part(2).alias("family"),
        F.make_date(part(3).cast("int"), part(4).cast("int"), F.lit(1)).alias("init_month"),
        part(5).cast("int").alias("lead_min"),
        part(6).cast("int").alias("lead_max"),
        part(7).alias("raw_variable"),
    )
    return prefer_split_files(parsed, ["system", "family", "init_month", "lead_min", "lead_max"], "raw_variable")


def lead_index(index: DataFrame) -> DataFrame:
    """One row per file and lead month, with the month it forecasts."""
    leads = explode_leads(index, "lead_min", "lead_max")
    return leads.withColumn("target_month", F.add_months("init_month", F.col("lead_month"))).drop(
        "lead_min", "lead_max"
    )
