"""Sums of expanding folds from sums by year."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotope.operators.splits import expanding_folds
from biotope.plans import ridge


@pytest.mark.parametrize("weight", [None, "w"])
def test_equal_to_sums_over_copied_rows(spark, weight):
    """Far-off means and uneven years do not cancel; a fold without earlier rows is left out."""
    draw = random.Random(6)
    rows = [(y, 1e6 + y * 50 + draw.gauss(0, 1), draw.random(), draw.gauss(5, 2), draw.random() + 0.1) for y in range(1990, 1999) for _ in range(draw.randint(1, 40))]
    df = spark.createDataFrame(rows, "year int, a double, b double, y double, w double")
    folds = [1990, 1993, 1994, 1998]
    copied = expanding_folds(df, "year", folds).where("fold_role = 'train'")
    want = {r.fold_year: r for r in ridge.gram_sums(copied, ["a", "b"], "y", weight, ["fold_year"]).collect()}
    found = {r.fold_year: r for r in ridge.fold_sums(df, ["a", "b"], "y", "year", folds, weight).collect()}
    assert sorted(found) == sorted(want) == [1993, 1994, 1998]
    for fold, r in found.items():
        assert r.rows == want[fold].rows and r.weight_sum == pytest.approx(want[fold].weight_sum)
        assert np.allclose(r.means, want[fold].means, rtol=1e-12)
        assert np.allclose(r.products, want[fold].products, rtol=1e-7, atol=1e-5)


def test_rows_are_summed_by_year_not_by_fold(spark):
    """The rows meet one aggregate by year; folds come from the written sums."""
    df = spark.range(100).select((F.col("id") % 5 + 1990).cast("int").alias("year"), F.rand(1).alias("a"), F.rand(2).alias("y"))
    plan = ridge.fold_sums(df, ["a"], "y", "year", [1992, 1994])._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "Generate" in plan
