"""Tables along a space-filling curve: the curve itself, and the files that a week-and-box scan must open."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from biotope.sources import layout, tables


def test_interleaving_is_bitwise(spark):
    rows = [(x, y, z) for x in (0, 1, 5, 7) for y in (0, 2, 7) for z in (0, 3, 6)]
    df = spark.createDataFrame(rows, "x int, y int, z int")
    found = df.select("*", layout.interleaved([F.col("x"), F.col("y"), F.col("z")], 3).alias("c")).collect()
    for r in found:
        bits = "".join(f"{r.x:03b}"[k] + f"{r.y:03b}"[k] + f"{r.z:03b}"[k] for k in range(3))
        assert r.c == int(bits, 2)


@pytest.fixture(scope="module")
def grid(spark):
    hour = F.timestamp_seconds(F.floor(F.col("id") / 400) * 21600 + 1704067200)
    cell = F.col("id") % 400
    rows = spark.range(400 * 4 * 84).select(hour.alias("time"), (F.floor(cell / 20) * 0.1 + 45).alias("latitude"), ((cell % 20) * 0.1 + 13).alias("longitude"), F.col("id").alias("v"))
    odd = rows.limit(3).select("time", F.lit(None).cast("double").alias("latitude"), F.lit(float("nan")).alias("longitude"), F.col("v") - 10)
    return rows.union(odd)


def opened(path, lows, highs):
    """Files with a row group whose statistics meet the box."""
    count = 0
    for name in glob.glob(f"{path}/*.parquet"):
        meta, meets = pq.ParquetFile(name).metadata, False
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k).statistics for k in range(meta.num_columns)}
            plain = lambda x: x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x
            meets |= all(stats[c] is None or not stats[c].has_min_max or (plain(stats[c].max) >= lows[c] and plain(stats[c].min) <= highs[c]) for c in lows)
        count += meets
    return count


def test_a_week_of_a_box_opens_few_files(spark, grid, tmp_path):
    """All rows are there, missing values too; the scan meets a few of 64 files, where the ordered table by time or place meets many."""
    columns = ["time", "latitude", "longitude"]
    layout.write_clustered(grid, f"{tmp_path}/curve", columns, 64)
    back = spark.read.parquet(f"{tmp_path}/curve")
    assert back.columns == grid.columns and back.count() == grid.count()
    assert back.agg(F.sum("v")).first() == grid.agg(F.sum("v")).first()
    for k, order in enumerate((columns, ["latitude", "longitude", "time"])):
        grid.repartitionByRange(64, *order).sortWithinPartitions(*order).write.parquet(f"{tmp_path}/plain{k}")
    first = dt.datetime(2024, 2, 1)
    lows = {"time": first, "latitude": 45.5, "longitude": 13.5}
    highs = {"time": first + dt.timedelta(days=7), "latitude": 45.8, "longitude": 13.8}
    files = [opened(f"{tmp_path}/{name}", lows, highs) for name in ("curve", "plain0", "plain1")]
    assert files[0] <= 8 and files[0] < files[1] and files[0] < files[2]
    box = F.col("time").between(F.lit(first), F.lit(highs["time"])) & F.col("latitude").between(45.5, 45.8) & F.col("longitude").between(13.5, 13.8)
    assert back.where(box).exceptAll(grid.where(box)).count() == 0 and back.where(box).count() == grid.where(box).count() > 0
    tables.write_ordered(grid, f"{tmp_path}/ordered", grid.columns, columns)
