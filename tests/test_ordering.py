"""Distributed order statistics against brute force, with a value holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest

from biotope.operators import metrics, ordering


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    score = np.where(rng.random(n) < 0.34, 0.5, np.round(rng.random(n), 2))
    return pd.DataFrame(
        {
            "id": rng.permutation(n),
            "g": np.where(rng.random(n) < 0.8, "hot", "cold"),
            "y": (rng.random(n) < 0.3).astype(int),
            "p": score,
            "x": np.round(rng.normal(size=n), 3),
        }
    )


@pytest.fixture(scope="module")
def rows(spark, frame):
    return spark.createDataFrame(frame)


def test_average_rank(rows, frame):
    got = ordering.average_rank(rows, "p", ["g"]).toPandas().set_index("id").avg_rank
    want = frame.groupby("g").p.rank(method="average")
    assert np.allclose(got.sort_index(), want.set_axis(frame.id).sort_index())


def test_positions_and_running_sums(rows, frame):
    got = metrics.precision_terms(rows, "y", "p", "id", ["g"]).toPandas().set_index("id").sort_index()
    ordered = frame.sort_values(["p", "id"], ascending=[False, True]).copy()
    ordered["position"] = ordered.groupby("g").cumcount() + 1
    ordered["found"] = ordered.groupby("g").y.cumsum()
    ordered = ordered.set_index("id").sort_index()
    assert (got.position == ordered.position).all()
    assert (got.positives_so_far == ordered.found).all()


def test_auc_equals_pairwise_definition(rows, frame):
    got = {r.g: r.roc_auc for r in metrics.roc_auc(rows, "y", "p", ["g"]).collect()}
    for g, part in frame.groupby("g"):
        pos, neg = part.p[part.y == 1].values, part.p[part.y == 0].values
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert got[g] == pytest.approx(wins / (len(pos) * len(neg)))


@pytest.mark.parametrize("column", ["p", "x"])
def test_quantiles(rows, frame, column):
    wanted = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.97, 1.0]
    got = {(r.g, r.probability): r.quantile for r in ordering.quantiles(rows.select("g", column), column, wanted, ["g"]).collect()}
    for g, part in frame.groupby("g"):
        for q in wanted:
            assert got[(g, q)] == pytest.approx(np.quantile(part[column], q))


def test_quantile_bins_follow_qcut(rows, frame):
    got = ordering.quantile_bins(rows.select("id", "p"), "p", 12, lowest_joins_first=True).toPandas()
    want = pd.qcut(frame.p, 12, duplicates="drop").cat.codes
    merged = got.set_index("id")["bin"].reindex(frame.id).values
    pairs = set(zip(merged, want))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_spearman(rows, frame):
    got = metrics.spearman(rows.select("p", "x"), "p", "x").head().spearman
    assert got == pytest.approx(frame.p.rank().corr(frame.x.rank()))


def test_pr_curve(rows, frame):
    got = metrics.pr_curve(rows.select("y", "p"), "y", "p").toPandas().set_index("threshold")
    for cut in (0.1, 0.5, 0.93):
        called = frame[frame.p >= cut]
        assert got.precision[cut] == pytest.approx(called.y.mean())
        assert got.recall[cut] == pytest.approx(called.y.sum() / frame.y.sum())


def test_top_fraction(rows, frame):
    got = metrics.top_fraction(rows, "y", "p", "id", ["g"], 0.05).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        top = part.sort_values(["p", "id"], ascending=[False, True]).head(max(1, int(len(part) * 0.05)))
        assert got.top_precision[g] == pytest.approx(top.y.mean())
        assert got.top_lift[g] == pytest.approx(top.y.mean() / part.y.mean())


def test_no_rows_give_no_rows(spark):
    empty = spark.createDataFrame([], "id int, y int, p double")
    assert ordering.average_rank(empty, "p").count() == 0
    assert metrics.pr_curve(empty, "y", "p").count() == 0


def test_infinite_values_rank_first_and_last(spark):
    values = [float("-inf"), 1.0, 2.0, 2.0, float("inf"), None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = {r.id: r.avg_rank for r in ordering.average_rank(df, "v").collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.5, 3: 3.5, 4: 5.0, 5: None}


def test_neighbours_of_distinct_values(spark):
    values = [0.5 * k for k in range(400)] * 2
    got = ordering.neighbours(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").collect()
    assert sorted((r.v, r.before, r.after) for r in got if r.before is not None and r.after is not None) == [(0.5 * k, 0.5 * (k - 1), 0.5 * (k + 1)) for k in range(1, 399)]
    assert len(got) == 400
