"""Late rows counted and kept, and the days and weeks that they open again.

Spark's own aggregates drop what comes after the watermark. Here every micro-batch writes its rows to a table by
epoch and day, marked late where their day was closed by the batches before, and a line of a ledger with their numbers.
Days that the batch closes, and closed days that its late rows fall into, are then computed from all their rows; so
are the weeks of those days. Only the touched days and weeks are read again. Each epoch writes folders of its own and
overwrites them when it is repeated after a failure; the newest epoch of a day or week is the valid one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biotope.operators.rollups import hourly_to_cell_day
from biotope.streaming.hourly import LATENESS, week_measures

LEDGER = "late_from timestamp, last_time timestamp, rows long, late_rows long, untimed_rows long, epoch long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Per epoch: rows, late rows, rows without a time, the newest time so far, and the time before which days are closed."""
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger")


def all_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """Every row with its ``day`` and whether it came ``late``."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{names}, late boolean, epoch long, day date").parquet(f"{path}/rows")


def newest(spark: SparkSession, folder: str, keys: Sequence[str], schema: str, until: int | None = None) -> DataFrame:
    """Rows of the newest epoch of each key."""
    rows = spark.read.schema(f"{schema}, epoch long").parquet(folder)
    rows = rows if until is None else rows.where(F.col("epoch") <= until)
    whole = F.max_by(F.struct(*rows.columns), F.col("epoch")).alias("row")
    return rows.groupBy(*keys).agg(whole).select("row.*").drop("epoch")


def _written(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _empty_folder(spark: SparkSession, folder: str) -> None:
    """A folder that can be read before anything is written to it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def run_with_corrections(stream: DataFrame, path: str, keys: Sequence[str] = ("grid_key",), time: str = "time", lateness: str = LATENESS) -> tuple[DataFrame, DataFrame]:
    """(days, weeks) below ``path`` after everything available has been read.

    A day is closed once a row is newer than its end by ``lateness``; complete weeks of closed days are summed up. Rows
    without a time are counted and kept out. The same path continues where an earlier run stopped.
    """
    spark, keys = stream.sparkSession, list(keys)
    for name in ("ledger", "rows", "days", "weeks"):
        _empty_folder(spark, f"{path}/{name}")
    shape = stream.schema
    day_schema = hourly_to_cell_day(spark.createDataFrame([], shape), keys, time).schema
    week_schema = week_measures(spark.createDataFrame([], day_schema), keys).schema

    def on_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = ledger(spark, path).where(F.col("epoch") < epoch).agg(F.max("last_time").alias("at"), F.max("late_from").alias("limit")).first()
        ends = F.date_add("day", 1).cast("timestamp")
        late = F.coalesce(ends <= F.lit(seen.limit).cast("timestamp"), F.lit(False))
        dated = batch.withColumn("day", F.to_date(time)).where("day is not null")
        dated.withColumn("late", late).write.mode("overwrite").partitionBy("day").parquet(f"{path}/rows/epoch={epoch}")
        counts = batch.agg(F.count("*").alias("rows"), F.count_if(F.col(time).isNull()).alias("untimed_rows"), F.max(time).cast("timestamp").alias("newest"))
        mine = all_rows(spark, path, shape).where(F.col("epoch") == epoch)
        last = F.greatest("newest", F.lit(seen.at).cast("timestamp"))
        line = counts.select(
            (last - F.expr(f"INTERVAL {lateness}")).alias("late_from"), last.alias("last_time"), "rows",
            F.lit(mine.where("late").count()).cast("long").alias("late_rows"), "untimed_rows",
        )
        line.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/epoch={epoch}")
        limit = ledger(spark, path).where(F.col("epoch") == epoch).first().late_from
        known = all_rows(spark, path, shape).where(F.col("epoch") <= epoch)
        opened = F.lit(True) if seen.limit is None else ends > F.lit(seen.limit)
        closed = known.where(opened & (ends <= F.lit(limit).cast("timestamp")))
        touched = mine.where("late").select("day", *keys).distinct()
        again = known.join(touched, ["day", *keys], "left_semi")
        days = hourly_to_cell_day(closed.unionByName(again).drop("day", "late", "epoch"), keys, time)
        days.write.mode("overwrite").parquet(f"{path}/days/epoch={epoch}")
        changed = spark.read.schema(day_schema).parquet(f"{path}/days/epoch={epoch}")
        monday = F.date_trunc("week", "day").cast("date")
        weeks = changed.select(*keys, monday.alias("__week")).distinct()
        current = newest(spark, f"{path}/days", [*keys, "day"], _written(day_schema), epoch).withColumn("__week", monday)
        week_measures(current.join(weeks, [*keys, "__week"], "left_semi").drop("__week"), keys).write.mode("overwrite").parquet(f"{path}/weeks/epoch={epoch}")

    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return (
        newest(spark, f"{path}/days", [*keys, "day"], _written(day_schema)),
        newest(spark, f"{path}/weeks", [*keys, "week_start"], _written(week_schema)),
    )
