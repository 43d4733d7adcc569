"""Panels brought up to date from changed weeks equal those built anew."""

import datetime as dt
import random

from pyspark.sql import functions as F

from biotope.plans import upkeep
from biotope.session import shared_folder

SCHEMA = "site string, week_start date, cases_a long, cases_b long"


def test_random_changes_equal_a_rebuild(spark):
    """Edited, new and deleted weeks, gaps, whole sites and years that come and go; the rows read follow the change."""
    draw = random.Random(11)
    first = dt.date(2020, 1, 6)
    now = {(f"s{s}", first + dt.timedelta(days=7 * k)): (draw.randint(0, 9), draw.choice([None, 3, 5])) for s in range(12) for k in range(160) if draw.random() > 0.05}
    build, year = upkeep.case_panel(), lambda c: F.year(c)
    path = shared_folder(spark, "test_panel")
    frame = lambda: spark.createDataFrame([(*k, *v) for k, v in now.items()], SCHEMA)
    upkeep.write_panel(frame(), path, build, year)
    for step in range(3):
        keys = draw.sample(sorted(now), 6)
        changed = set(keys)
        for k in keys[:3]:
            now[k] = (draw.randint(10, 20), draw.randint(10, 20))
        for k in keys[3:]:
            del now[k]
        added = (f"s{step}", first - dt.timedelta(days=7 * (step + 1)))
        now[added] = (1, 1)
        changed.add(added)
        if step == 1:
            now[("new", first)] = (2, 2)
            gone = [k for k in now if k[0] == "s11"]
            changed |= {("new", first), *gone}
            for k in gone:
                del now[k]
        news = spark.createDataFrame(sorted(changed), "site string, week_start date")
        read, built = upkeep.refresh(frame(), path, news, build, year)
        spark.catalog.refreshByPath(path)
        found = spark.read.parquet(path).drop("part")
        want = build(frame()).select(*found.columns)
        assert found.exceptAll(want).count() == 0 and found.count() == want.count() == len(now)
        assert built <= len(changed) * 13 and read <= len(changed) * 25 and (step == 1 or read < len(now) / 8)


def test_nothing_changed_reads_nothing(spark):
    rows = spark.createDataFrame([("a", dt.date(2020, 1, 6), 1, 1)], SCHEMA)
    path, year = shared_folder(spark, "test_panel"), lambda c: F.year(c)
    upkeep.write_panel(rows, path, upkeep.case_panel(), year)
    assert upkeep.refresh(rows, path, rows.select("site", "week_start").limit(0), upkeep.case_panel(), year) == (0, 0)
    assert spark.read.parquet(path).count() == 1
