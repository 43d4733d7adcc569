"""Golden values of small hand-made inputs."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from biotope.functions import calendar as cal
from biotope.functions import rules, text, weather
from biotope.operators import joins, metrics, ordering, quality, reshape, rollups, spatial, splits, windows
from biotope.plans import ridge, training, weekly_weather
from biotope.sources import documents, gridded, tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head()


def test_axis_edges(spark):
    axis = spark.createDataFrame([(46.9,), (46.8,), (46.7,)], "value double")
    rows = gridded.axis_edges(axis, "value").orderBy(F.desc("value")).collect()
    edges = [rows[0].edge_high, *[r.edge_low for r in rows]]
    assert edges == pytest.approx([46.95, 46.85, 46.75, 46.65])


def test_cell_key_and_calendar(spark):
    day = F.lit("2026-03-30").cast("date")
    row = one(
        spark,
        key=weather.grid_key(F.lit(46.91234), F.lit(13.31234)),
        **{n: c for n, c in cal.calendar_features(day).items()},
        first=cal.iso_week_start(F.lit(2020), F.lit(1)),
        last=cal.iso_week_start(F.lit(2020), F.lit(53)),
        none=cal.iso_week_start(F.lit(2021), F.lit(53)),
    )
    assert row.key == "46.9123|13.3123"
    assert (row.iso_year, row.iso_week, row.month) == (2026, 14, 4)
    assert (row["first"], row["last"]) == (dt.date(2019, 12, 30), dt.date(2020, 12, 28))
    assert row["none"] is None


def test_reference_week_counts_a_sunday_as_completed(spark):
    row = one(
        spark,
        sunday=cal.reference_window(F.lit("2024-03-10").cast("date"))[1],
        saturday=cal.reference_window(F.lit("2024-03-09").cast("date"))[1],
    )
    assert (row.sunday, row.saturday) == (dt.date(2024, 3, 10), dt.date(2024, 3, 3))


def hourly_fixture(spark):
    hours = spark.range(24 * 8).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("time")
    )
    cells = spark.createDataFrame(
        [(lat, lon) for lat in (46.0, 45.9) for lon in (14.0, 14.1)], "latitude double, longitude double"
    )
    west = F.col("longitude") == 14.0

    def pick(a, b):
        return F.when(west, F.lit(float(a))).otherwise(F.lit(float(b)))

    grid = hours.crossJoin(cells).select(
        "time",
        "latitude",
        "longitude",
        pick(10, 20).alias("air_temperature_c"),
        pick(80, 60).alias("relative_humidity_pct"),
        pick(0.5, 1.0).alias("precipitation_mm"),
        pick(8, 12).alias("soil_temperature_1_c"),
        pick(7, 11).alias("soil_temperature_2_c"),
        pick(0.30, 0.40).alias("soil_water_1"),
        pick(0.35, 0.45).alias("soil_water_2"),
    )
    return gridded.hourly_grid(grid)


def rectangle(x0, y0, x1, y1):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]


RINGS = "site string, rings array<array<struct<x:double,y:double>>>"


def test_weekly_weather_of_two_sites(spark):
    sites = spark.createDataFrame(
        [("1", rectangle(13.95, 45.85, 14.05, 46.05)), ("2", rectangle(14.05, 45.85, 14.15, 46.05))], RINGS
    )
    step = 0.1
    cells = spark.createDataFrame(
        [
            (f"{lat:.4f}|{lon:.4f}", lon - step / 2, lon + step / 2, lat - step / 2, lat + step / 2)
            for lat in (46.0, 45.9)
            for lon in (14.0, 14.1)
        ],
        "cell string, x_min double, x_max double, y_min double, y_max double",
    )
    overlay = spatial.grid_overlay(sites, cells, "site", "rings", step).withColumnRenamed("cell", "grid_key")
    overlay = overlay.where("intersection_area > 1e-9")
    assert overlay.groupBy("site").agg(F.sum("cell_weight").alias("w")).where("abs(w - 1) > 1e-6").count() == 0
    rows = weekly_weather.weekly_weather(hourly_fixture(spark), overlay).orderBy("site").collect()
    assert len(rows) == 2
    left, right = rows
    assert (left.temperature_mean, right.temperature_mean) == pytest.approx((10, 20))
    assert (left.rain_sum, right.rain_sum) == pytest.approx((84, 168))
    assert (left.humid_hours_80, right.humid_hours_80) == pytest.approx((168, 0))
    assert (left.activity_hours, right.activity_hours) == pytest.approx((168, 0))
    assert left.covered_area_pct == pytest.approx(100, abs=0.1)
    assert right.observation_days == 7


def test_zonal_statistics(spark):
    pixels = spark.createDataFrame(
        [("t", r, c, 400000 + 30 * c + 15.0, 100060 - 30 * r - 15.0, v)
         for r, c, v in ((0, 0, 100.0), (0, 1, 200.0), (1, 0, 300.0), (1, 1, 400.0))],
        "tile string, row_no int, col_no int, x double, y double, value double",
    )
    sites = spark.createDataFrame(
        [("1", rectangle(400000, 100000, 400030, 100060)), ("2", rectangle(400030, 100000, 400060, 100060))], RINGS
    )
    shapes = spatial.with_edges(sites, "site", "rings")
    located = spatial.zonal_pixels(pixels, shapes, "site", "x", "y", "value", -9999.0)
    areas = sites.select("site", spatial.polygon_area(F.col("rings")).alias("area"))
    left, right = rollups.zonal_statistics(located, "site", "value", "tile", 900.0, areas).orderBy("site").collect()
    assert (left.pixel_count, left.tiles, left.mean_value, left.std_value) == (2, 1, 200.0, 100.0)
    assert (left.min_value, left.max_value, left.coverage_pct) == (100.0, 300.0, 100.0)
    assert (right.mean_value, right.min_value, right.max_value) == (300.0, 200.0, 400.0)


def test_class_shares_break_ties_by_code(spark):
    lookup = {1: 311, 2: 231, 3: 324}
    rows = [("1", lookup[1]), ("1", lookup[2]), ("2", lookup[3]), ("2", lookup[1])]
    pixels = spark.createDataFrame(rows, "site string, code int")
    left, right = rollups.class_shares(pixels, "site", "code").orderBy("site").collect()
    assert (left.dominant_code, left.forest_pct, left.grassland_pasture_pct, left.shrub_transitional_pct) == (231, 50, 50, 0)
    assert (right.dominant_code, right.forest_pct, right.grassland_pasture_pct, right.shrub_transitional_pct) == (311, 50, 0, 50)


def test_wide_case_sheet(spark):
    wide = spark.createDataFrame(
        [("Ajdovščina", "1", " ", 1), ("Sv. Trojica v Slov. goricah", "", "2", 2)],
        "`name` string, `2020-01` string, `2020-53` string, SKUPAJ int",
    )
    long = reshape.unpivot_weeks(wide, ["name", "SKUPAJ"], 2020).withColumn("cases", text.case_count(F.col("value")))
    assert long.count() == 4
    totals = {r.name: r.t for r in long.groupBy("name").agg(F.sum("cases").alias("t")).collect()}
    assert sorted(totals.values()) == [1, 2]
    with pytest.raises(ValueError):
        reshape.unpivot_weeks(wide, ["name", "SKUPAJ"], 2021)
    folded = one(spark, n=text.fold_name(F.lit("Sv. Trojica v Slov.  goricah (š)"))).n
    assert folded == "SV TROJICA V SLOV GORICAH S"


def test_population_cube(spark):
    cube = (
        '{"id":["m","site","year"],"size":[1,3,2],"value":[2120000,2125000,19891,19895,3948,null],'
        '"status":{"5":"z"},"dimension":{"m":{"codes":["pop"]},"site":{"codes":["0","1","10"]},"year":{"codes":["2024","2025"]}}}'
    )
    docs = spark.createDataFrame([(cube,)], "text string")
    rows = documents.decode_cube(docs, "text", ["m", "site", "year"], "pop", "site", "year").orderBy("year", "site").collect()
    assert [r.site for r in rows] == ["1", "10", "1", "10"]
    assert rows[0].log_value == pytest.approx(math.log1p(19891))
    assert rows[3].value is None and rows[3].status == "z" and rows[3].year == 2025


def test_cube_in_another_order_is_an_error(spark):
    docs = spark.createDataFrame([('{"id":["a","b"],"size":[1,1],"value":[1],"status":{},"dimension":{}}',)], "text string")
    with pytest.raises(Exception, match="cube dimensions"):
        documents.decode_cube(docs, "text", ["m", "site", "year"], "pop", "site", "year").collect()


def test_payload_with_a_gap_is_an_error(spark):
    good = spark.createDataFrame([("c", [1, 2], [1.0, 2.0])], "id string, h array<int>, t array<double>")
    assert documents.unnest_arrays(good, ["id"], ["h", "t"]).count() == 2
    bad = spark.createDataFrame([("c", [1, 2], [1.0, None])], "id string, h array<int>, t array<double>")
    with pytest.raises(Exception, match="missing value"):
        documents.unnest_arrays(bad, ["id"], ["h", "t"]).collect()


def test_training_join(spark):
    monday = dt.date(2021, 1, 4)
    cases = spark.createDataFrame(
        [("1", monday + dt.timedelta(weeks=i), i + 1, b) for i, b in enumerate((0, 1, 0, 1, 0, 0, 1, 0, 1))],
        "site string, week_start date, cases_a int, cases_b int",
    )
    weeks = spark.createDataFrame(
        [("1", dt.date(2021, 2, 22), 5.0), ("1", dt.date(2021, 3, 1), 6.0)], "site string, week_start date, temp double"
    )
    static = spark.createDataFrame([("1", "311")], "site string, dominant_code string")
    annual = spark.createDataFrame([("1", 2020, 9.9, 78.0)], "site string, year int, population double, density double")
    first, second = training.weekly_training(weeks, static, annual, cases).orderBy("week_start").collect()
    assert (first.cases_a_lag_2, first.cases_a_lag_3, first.cases_a_prev_4_sum, first.cases_b_prev_8_sum) == (6, 5, 22, None)
    assert (second.cases_a_lag_2, second.cases_a_lag_3, second.cases_a_prev_4_sum) == (7, 6, 26)
    assert (second.cases_b_lag_2, second.cases_b_prev_8_sum) == (1, 3)
    assert (second.population, second.density, second.population_source_year) == (9.9, 78.0, 2020)
    assert second.dominant_code == "311"


def test_lags_do_not_look_ahead(spark):
    rows = [("1", dt.date(2020, 1, 6) + dt.timedelta(weeks=i), float(i * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "site string, week_start date, v double")

    def features(frame):
        w = windows.over_panel("site", "week_start")
        columns = windows.lags("v", [1, 2], w) | {"m": windows.prev_mean("v", 4, w), "s": windows.prev_full("v", 4, w)}
        return {r.week_start: r for r in windows.with_columns(frame, columns).collect()}

    whole, cut = features(df), features(df.where("week_start < '2020-05-01'"))
    assert all(whole[k] == row for k, row in cut.items())


def test_splits(spark):
    assert splits.bucket_sizes(6, 0.67, 0.17) == (4, 1, 1)
    assert splits.bucket_sizes(3, 0.9, 0.9) == (1, 1, 1)
    days = [dt.date(2024, 4, d) for d in range(1, 7)]
    df = spark.createDataFrame([(d, i) for d in days for i in range(2)], "day date, i int")
    ratio = {r.split: r["count"] for r in splits.ratio_split(df, "day", 0.67, 0.17).groupBy("split").count().collect()}
    assert ratio == {"train": 8, "validation": 2, "test": 2}
    edge = splits.boundary_split(df, "day", "2024-04-03", "2024-04-05").groupBy("split").count()
    assert {r.split: r["count"] for r in edge.collect()} == {"train": 6, "validation": 4, "test": 2}
    with pytest.raises(ValueError):
        splits.boundary_split(df, "day", "2024-04-05", "2024-04-03")


def test_typed_rows_skip_and_reject(spark):
    raw = spark.createDataFrame(
        [(1, "2024-01-01", "1", "2,5"), (2, "2024-01-01", "", "3"), (3, "2024-01-01", "2", "1"), (4, "x", "0", "nan"),
         (5, "2024-01-01", "0", "nan"), (6, "2024-01-01", "0", "none")],
        "id int, t string, y string, x string",
    )
    typed = training.typed_rows(raw, "t", "y", ["x"], binary=True)
    assert {r.id: r.problem for r in typed.collect()} == {1: "bad number in x", 3: "target is not 0 or 1", 4: "bad time", 5: None, 6: "bad number in x"}
    assert training.rejected(typed).count() == 4 and [r.x for r in training.usable(typed).collect()] == [None]


def test_weights_average_one(spark):
    df = spark.createDataFrame([(0.2,), (0.5,), (1.5,)], "v double")
    w = df.select(rules.weight(F.col("v"), "expm1").alias("w"))
    normal = w.select((F.col("w") / w.agg(F.avg("w")).scalar()).alias("w"))
    assert normal.agg(F.avg("w")).head()[0] == pytest.approx(1.0)
    assert one(spark, w=rules.weight(F.lit(-1.0), "log1p")).w is None


def test_auc_and_average_precision(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.4), (3, 1, 0.35), (4, 1, 0.8)], "id int, y int, p double")
    assert metrics.roc_auc(df, "y", "p").head().roc_auc == pytest.approx(0.75)
    assert metrics.average_precision(df, "y", "p", "id").head().average_precision == pytest.approx(5 / 6)


def test_metrics_without_a_class_or_variance(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.9)], "id int, y int, p double")
    assert metrics.roc_auc(df, "y", "p").head().roc_auc == 0
    assert metrics.regression_metrics(df, "y", "p").head().r2 == 1
    assert metrics.confusion_metrics(df.where("p > 1"), "y", "p").head().f1 == 0


def test_half_even_percentile(spark):
    holdout = spark.createDataFrame([(float(i),) for i in range(40)], "v double")
    scored = {r.v: r.score for r in ordering.percentile_scores(holdout, holdout, "v").collect()}
    assert scored == {float(i): round(100 * (i + 1) / 40) for i in range(40)}


def test_deaccumulate_closes_the_day_at_midnight(spark):
    start = dt.datetime(2024, 1, 1, 22)
    values = [5.0, 7.0, 8.0, 1.0, 0.5]
    df = spark.createDataFrame(
        [("c", start + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "cell string, time timestamp, total double"
    )
    rows = windows.deaccumulate(df, ["cell"], "time", "total").orderBy("time").collect()
    assert [r.increment for r in rows] == [5.0, 2.0, 1.0, 1.0, 0.0]
    assert rows[2].accumulation_step == 24


def test_ridge_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    x, w = rng.normal(size=(60, 3)) * [1, 50, 0.1] + [5, 1000, 0], rng.uniform(0.5, 2, 60)
    y = x @ [1.0, 0.2, -3.0] + rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w)], "a double, b double, c double, y double, w double")
    model = ridge.fit(df, ["a", "b", "c"], "y", 10.0, weight="w")
    mean = np.average(x, axis=0, weights=w)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    z, t = (x - mean) / scale, y - np.average(y, weights=w)
    beta = np.linalg.solve((z * w[:, None]).T @ z + 10 * np.eye(3), (z * w[:, None]).T @ t) / scale
    assert model.coefficients == pytest.approx(tuple(beta))
    assert model.intercept == pytest.approx(np.average(y, weights=w) - mean @ beta)


def test_projection_needs_three_years(spark):
    history = spark.createDataFrame([("s", 2020, 1.0), ("s", 2021, 2.0)], "k string, year int, y double")
    ahead = spark.createDataFrame([("s", 2022, 1.0)], "k string, year int, x double")
    args = (["k"], "year", "y", ["x"], F.lit(0.0), F.lit(1.0), F.lit(0.0), [F.lit(1.0)])
    with pytest.raises(Exception, match="three observed years"):
        ridge.project(history, ahead, *args).collect()
    longer = history.union(spark.createDataFrame([("s", 2019, 3.0)], history.schema))
    row = ridge.project(longer, ahead, *args).head()
    assert (row.year, row.lag_1, row.rolling_3, row.predicted) == (2022, 2.0, 2.0, 3.0)


def test_projection_refuses_gaps(spark):
    schema = "k string, year int, y double"
    args = (["k"], "year", "y", ["x"], F.lit(0.0), F.lit(1.0), F.lit(0.0), [F.lit(1.0)])
    whole = spark.createDataFrame([("s", y, 1.0) for y in (2018, 2019, 2020, 2021)], schema)
    ahead = spark.createDataFrame([("s", y, 1.0) for y in (2022, 2024)], "k string, year int, x double")
    for history, years in ((whole, ahead), (whole.where("year <> 2020"), ahead.where("year = 2022"))):
        with pytest.raises(Exception, match="three observed years"):
            ridge.project(history, years, *args).collect()
    assert ridge.project(whole, ahead.where("year = 2022"), *args).count() == 1


def test_momentum_counts_years_not_rows(spark):
    rows = [("s", y, float(y - 2000)) for y in (2001, 2002, 2003, 2005, 2006)]
    w = Window.partitionBy("k").orderBy("year")
    got = spark.createDataFrame(rows, "k string, year int, y double").select("year", ridge.baseline_momentum("y", w)["baseline"].alias("b"))
    assert {r.year: r.b for r in got.collect()} == {2001: None, 2002: None, 2003: None, 2005: None, 2006: None}
    near = spark.createDataFrame(rows[:3] + [("s", 2004, 9.0)], "k string, year int, y double")
    assert {r.year: r.b for r in near.select("year", ridge.baseline_momentum("y", w)["baseline"].alias("b")).collect()}[2004] == 3.0


def test_residual_models_cut_after_the_baseline(spark):
    rows = [(y, float(k), 10.0, -4.0 + k) for y in (2000, 2001, 2002) for k in range(6)]
    df = spark.createDataFrame(rows, "year int, x double, base double, r double")
    grid = ridge.alpha_scores(df, ["x"], "r", "year", [2001, 2002], [1e-9], baseline="base").head()
    assert grid.mean_rmse < 1e-6 and grid.selected
    model = ridge.fit(df, ["x"], "r", 1e-9)
    assert abs(df.where("x = 0").select(model.predict(F.col("base")).alias("p")).head().p - 6.0) < 1e-6


def test_names_fold_marks_of_any_form(spark):
    names = ["Be\u030cla", "Việt-Nam (x)", "ŠTORE", "Ά\u0301lfa"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.fold_name(F.col("n")).alias("f")).collect()
    assert [r.f for r in got] == ["BELA", "VIET NAM X", "STORE", "ΑLFA"]


def test_nan_becomes_null_at_ingest(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0)], "k string, v double")
    row = tables.nan_as_null(df).agg(F.avg("v").alias("m"), F.count("v").alias("n")).head()
    assert (row.m, row.n) == (2.0, 1)


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="code, name"):
        tables.require_columns(spark.range(1), ["code", "id", "name"])


def test_csv_with_byte_order_mark(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_bytes("﻿code,name\n 1 , Šent \n,x\n".encode())
    schema = T.StructType().add("code", T.StringType()).add("name", T.StringType())
    rows = tables.read_csv(spark, str(tmp_path / "a.csv"), schema, ["code"]).collect()
    assert [(r.code, r.name) for r in rows] == [("1", "Šent")]


def test_key_difference_and_diff(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    b = spark.createDataFrame([(2, 7), (3, 8)], "k int, v int")
    found = {(r.k, r.difference) for r in joins.key_difference(a, b, ["k"]).collect()}
    assert found == {(1, "missing"), (3, "unexpected")}
    diff = {(r.k, r.mismatch, r.column_name, r.rebuilt_value, r.stored_value) for r in quality.table_diff(a, b, ["k"], ["v"]).collect()}
    assert diff == {(1, "missing", "", None, None), (3, "unexpected", "", None, None), (2, "value", "v", "6", "7")}
