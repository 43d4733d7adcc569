"""The streaming jobs give what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from biotope.operators import windows
from biotope.operators.rollups import hourly_to_cell_day
from biotope.session import shared_folder
from biotope.streaming import hourly, late
from biotope.streaming.weekly_lags import weekly_lags
from test_golden import hourly_fixture


def test_stream_days_equal_batch_days(spark, tmp_path):
    grid = hourly_fixture(spark)
    grid.write.parquet(str(tmp_path / "grid"))
    stream = spark.readStream.schema(grid.schema).parquet(str(tmp_path / "grid"))
    streamed = hourly.run_to_table(
        hourly.hourly_to_day(stream, ["grid_key"]), shared_folder(spark, "test_days")
    )
    batch = hourly_to_cell_day(grid).select(*streamed.columns)
    last = batch.agg(F.max("day")).head()[0]
    closed = batch.where(F.col("day") < F.lit(last))
    assert streamed.exceptAll(closed).count() == 0 and closed.exceptAll(streamed).count() == 0


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    source, path = str(tmp_path / "events"), shared_folder(spark, "test_restart")

    def events(first, end):
        seconds = F.timestamp_seconds(F.col("id") + 1704067200)
        return spark.range(first, end).select(F.col("id").alias("event_id"), seconds.alias("time"))

    rows = events(0, 10)
    rows.write.parquet(source)

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        return hourly.run_to_table(hourly.dedupe(stream, "event_id", "time"), path)

    assert run().count() == 10
    events(5, 15).write.mode("append").parquet(source)
    assert run().count() == 15


def test_late_rows_are_counted_kept_and_corrected(spark, tmp_path):
    """Hours in shuffled files, over a restart: days and weeks equal the batch, every late row is in the ledger and the table."""
    grid, source, path = hourly_fixture(spark), str(tmp_path / "hours"), shared_folder(spark, "test_late")
    shuffled = grid.withColumn("part", F.pmod(F.xxhash64("time", "grid_key"), F.lit(6)))
    untimed = grid.limit(2).withColumn("time", F.lit(None).cast(grid.schema["time"].dataType))

    def run():
        stream = spark.readStream.schema(grid.schema).option("maxFilesPerTrigger", 1).parquet(source)
        return late.run_with_corrections(stream, path)

    for k in range(6):
        part = shuffled.where(F.col("part") == k).drop("part")
        (part.unionByName(untimed) if k == 2 else part).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 5):
            days, weeks = run()
    last = grid.agg((F.max("time") - F.expr("INTERVAL 6 HOURS")).alias("t")).first()[0]
    batch = hourly_to_cell_day(grid).select(*days.columns).where(F.date_add("day", 1).cast("timestamp") <= F.lit(last))
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
    assert rounded(days).exceptAll(rounded(batch)).count() == 0 and days.count() == batch.count() > 0
    whole = hourly.week_measures(batch, ["grid_key"]).select(*weeks.columns)
    assert rounded(weeks).exceptAll(rounded(whole)).count() == 0 and weeks.count() == whole.count() > 0
    kept = late.all_rows(spark, path, grid.schema)
    counts = late.ledger(spark, path).agg(F.sum("rows"), F.sum("late_rows"), F.sum("untimed_rows")).first()
    assert kept.count() == grid.count() == counts[0] - 2 and counts[2] == 2
    assert kept.where("late").count() == counts[1] > 0
    again, _ = run()
    assert again.exceptAll(days).count() == 0


def test_weekly_lags_go_on_after_a_restart(spark, tmp_path):
    """Weeks out of order within the lateness equal the batch operators, over two runs; a week behind the watermark and a repeated one change nothing."""
    weeks = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * k) for k in range(30)]
    rows = [(site, w, None if (k * site) % 11 == 5 else k * site) for k, w in enumerate(weeks) for site in (1, 2, 3) if (k + site) % 6]
    schema = "site int, week_start date, cases_a long"
    source, path = str(tmp_path / "weeks"), shared_folder(spark, "test_lags")
    swapped = sorted(rows, key=lambda r: (weeks.index(r[1]) // 2, -weeks.index(r[1])))
    late_row, twice = (1, weeks[3], 999), (2, weeks[20], 888)

    def run(some):
        for part in some:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            found = hourly.run_to_table(weekly_lags(stream), path)
        return found

    run([swapped[:40]])
    found = run([[*swapped[40:], late_row, twice], [(4, weeks[29], 1)]]).collect()
    batch = spark.createDataFrame(rows, schema)
    w = windows.over_panel("site", "week_start")
    want = windows.with_columns(batch, windows.lags("cases_a", [1, 2], w) | {"prev": windows.prev_full("cases_a", 4, w)})
    limit = weeks[29] - dt.timedelta(days=14)
    number = lambda x: None if x is None else float(x)
    wanted = {(r.site, r.week_start): (number(r.cases_a), number(r.cases_a_lag_1), number(r.cases_a_lag_2), number(r.prev)) for r in want.collect() if r.week_start <= limit}
    got = {(r.site, r.week_start): (r.cases_a, r.lag_1, r.lag_2, r.prev_sum) for r in found if not r.repeated}
    assert got == wanted
    assert [(r.site, r.week_start, r.cases_a, r.lag_1) for r in found if r.repeated] == [(2, weeks[20], 888.0, None)]
