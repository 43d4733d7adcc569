"""JSON documents: data cubes, feature collections, payloads of parallel arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUBE_SCHEMA = (
    "id array<string>, size array<int>, value array<double>, status map<string,string>, "
    "dimension map<string, struct<codes: array<string>>>"
)
FEATURES_SCHEMA = (
    "type string, features array<struct<properties: struct<code: string, name: string, optional_id: string>, "
    "geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
)


def decode_cube(
    documents: DataFrame, text: str, dimensions: Sequence[str], measure: str, site: str, year: str, total: str = "0"
) -> DataFrame:
    """Dense cubes -> (site, year, value, status, log value) of one measure.

    The flat index runs with the last dimension fastest. The total member is
    skipped; a cube whose dimensions come in another order is an error.
    """
    parsed = documents.select(F.from_json(text, CUBE_SCHEMA).alias("cube")).select("cube.*")
    expected = F.array(*[F.lit(d) for d in dimensions])
    checked = parsed.withColumn(
        "size", F.when(F.col("id") == expected, F.col("size")).otherwise(
            F.raise_error(F.lit(f"cube dimensions are not {', '.join(dimensions)}"))
        )
    )
    cells = checked.select("size", "status", "dimension", F.posexplode("value").alias("flat", "value"))
    sites, years = F.col("size")[1], F.col("size")[2]
    codes = [F.col("dimension")[d]["codes"] for d in dimensions]
    measures_at = F.floor(F.col("flat") / (sites * years)).cast("int")
    site_at = F.pmod(F.floor(F.col("flat") / years), sites).cast("int")
    year_at = F.pmod(F.col("flat"), years).cast("int")
    decoded = cells.select(
        F.get(codes[0], measures_at).alias("measure"),
        F.get(codes[1], site_at).alias(site),
        F.get(codes[2], year_at).cast("int").alias(year),
        "value",
        F.try_element_at("status", F.col("flat").cast("string")).alias("status"),
    )
    return decoded.where((F.col("measure") == measure) & (F.col(site) != total)).select(
        site, year, "value", "status", F.log1p("value").alias("log_value")
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections from whole-file JSON."""
    return features(spark.read.schema(FEATURES_SCHEMA).option("multiLine", True).json(path))


def parse_features(documents: DataFrame, text: str) -> DataFrame:
    return features(documents.select(F.from_json(text, FEATURES_SCHEMA).alias("doc")).select("doc.*"))


def features(collections: DataFrame) -> DataFrame:
    """One row per feature with trimmed code, name and optional id; blanks become NULL."""
    rows = collections.select(F.explode("features").alias("feature"))

    def trimmed(name: str) -> Column:
        return F.nullif(F.trim(F.col(f"feature.properties.{name}")), F.lit(""))

    return rows.select(
        trimmed("code").alias("code"),
        trimmed("name").alias("name"),
        trimmed("optional_id").alias("optional_id"),
        F.col("feature.geometry.coordinates").alias("rings"),
    )


def valid_features(rows: DataFrame) -> DataFrame:
    return rows.where("code is not null and name is not null")


def invalid_features(rows: DataFrame) -> DataFrame:
    return rows.where("code is null or name is null")


def unnest_arrays(payloads: DataFrame, ids: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Equal-length arrays -> one row per position; a NULL in any of them is an error."""
    zipped = payloads.select(*ids, F.inline(F.arrays_zip(*[F.col(a) for a in arrays])))
    checked = [
        F.coalesce(F.col(a), F.raise_error(F.lit(f"payload array {a} has a missing value"))).alias(a)
        for a in arrays
    ]
    return zipped.select(*ids, *checked)
