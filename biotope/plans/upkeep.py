"""Panels with lags, trailing and forward windows kept up to date from changed site-weeks alone.

A row of such a panel depends on its site's rows up to ``back`` before it and ``ahead`` after it. A changed, new or
deleted week therefore touches the rows from ``ahead`` before it to ``back`` after it, and these need the rows as far
again around them. Only the needed inputs are read, only the touched rows are built, and only the
partitions that hold them are written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotope.operators import windows
from biotope.session import materialize


def touched_weeks(inputs: DataFrame, changed: DataFrame, site: str, week: str, back: int, ahead: int) -> DataFrame:
    """(site, week, touched) of the inputs that the touched rows need; ``touched`` marks those to be built again.

    Weeks are counted as rows of the site, in arrays as long as its calendar, and for the changed sites only. ``changed``
    may name weeks that are no longer there: their neighbours move.
    """
    news = changed.groupBy(site).agg(F.collect_set(week).alias("__news"))
    calendars = inputs.join(news.select(site), site, "left_semi").groupBy(site).agg(F.array_sort(F.collect_list(week)).alias("__weeks"))

    def around(before: int, after: int) -> Column:
        def rows(c: Column) -> Column:
            place = F.size(F.filter("__weeks", lambda w: w < c))
            return F.sequence(F.greatest(F.lit(0), place - before), F.least(F.size("__weeks") - 1, place + after))

        whole = F.filter("__news", lambda c: F.size(F.filter("__weeks", lambda w: w < c)) - before <= F.size("__weeks") - 1)
        return F.array_distinct(F.flatten(F.transform(whole, rows)))

    placed = calendars.join(news, site)
    needed = placed.select(site, "__weeks", around(ahead, back).alias("__touched"), F.explode(around(ahead + back, back + ahead)).alias("__k"))
    return needed.select(site, F.get("__weeks", F.col("__k")).alias(week), F.array_contains("__touched", F.col("__k")).alias("touched"))


def refresh(
    inputs: DataFrame,
    path: str,
    changed: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    partition: Callable[[str], Column],
    site: str = "site",
    week: str = "week_start",
    back: int = 8,
    ahead: int = 4,
) -> tuple[int, int]:
    """Bring the panel below ``path`` up to date; (input rows read for it, rows built).

    ``inputs`` holds all site-weeks as they are now, ``changed`` the (site, week) whose inputs are other than when the
    panel was written. ``partition`` gives the value of the panel's partition column ``part`` from the week. The result
    is that of building everything anew; a repeated call writes the same again.
    """
    spark = inputs.sparkSession
    news = materialize(changed.select(site, week).distinct(), "changed")
    around = materialize(touched_weeks(inputs, news, site, week, back, ahead), "touched")
    needed = inputs.join(around.select(site, week), [site, week], "left_semi").select(*inputs.columns)
    keys = around.where("touched").select(site, week)
    built = build(needed).join(keys, [site, week], "left_semi").withColumn("part", partition(week))
    gone = keys.union(news)
    parts = gone.select(partition(week).alias("part")).distinct()
    old = spark.read.parquet(path)
    kept = old.join(parts, "part", "left_semi").join(gone, [site, week], "left_anti").select(*old.columns)
    merged = materialize(kept.unionByName(built.select(*old.columns)), "merged")
    # a partition of which no row is left is written empty by its removal
    empty = [r[0] for r in parts.join(merged.select("part").distinct(), "part", "left_anti").collect()]
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for value in empty:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={value}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return around.count(), keys.count()


def write_panel(inputs: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], partition: Callable[[str], Column], week: str = "week_start") -> None:
    """The whole panel, partitioned as ``refresh`` expects it."""
    build(inputs).withColumn("part", partition(week)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def case_panel(site: str = "site", week: str = "week_start", values: Sequence[str] = ("cases_a", "cases_b")) -> Callable[[DataFrame], DataFrame]:
    """Builder of lags, trailing sums of four and eight weeks, and the sum of the four weeks ahead."""
    def build(rows: DataFrame) -> DataFrame:
        w = windows.over_panel(site, week)
        extra = {}
        for c in values:
            extra |= windows.lags(c, [1, 2], w)
            extra |= {f"{c}_prev_4": windows.prev_full(c, 4, w), f"{c}_prev_8": windows.prev_full(c, 8, w), f"{c}_next_4": windows.next_full(c, 4, w)}
        return windows.with_columns(rows.select(site, week, *values), extra)

    return build
