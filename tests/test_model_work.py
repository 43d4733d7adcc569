"""Boosted families: the whole work of the model queries, and the learner against a plain version of its algorithm."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotope.operators.ordering import earlier_mean, target_history
from biotope.plans import boosting, trees
from biotope.plans.boosting import Fit, Learner, fit_family, in_blocks, read_trees, validation_scores
from biotope.session import materialize
from biotope.workload import bindings, modelling

FOLDER = "/root/testdata/sf0.001"


def test_specs_are_whole():
    for spec in (modelling.SPEC, modelling.REGRESSION):
        assert (spec.iterations, spec.patience, spec.depth) == (250, 40, 6)
        assert (spec.learner.rounds, spec.learner.patience, spec.learner.depth) == (250, 40, 6)


def test_stop_waits_for_patience():
    assert boosting.stop_round([5.0, 4.0, 4.5, 4.2, 3.0, 9.0], 3) == (5, False)
    assert boosting.stop_round([5.0, 4.0, 4.5, 4.2, 4.1, 3.0], 3) == (2, True)


def plain_boost(x, y, w, cuts, learner):
    """Scores of all rows after each round, of a learner that looks at every cut of every feature in every node.

    ``x`` holds None for missing; rows of weight 0 are scored only.
    """
    rows = range(len(y))
    mean = sum(w[k] * y[k] for k in rows) / sum(w)
    base = math.log(mean / (1 - mean)) if learner.binary else mean
    score = [base] * len(y)
    rounds = []

    def leaf(some, g, h):
        return -sum(g[k] for k in some) / (sum(h[k] for k in some) + learner.l2) * learner.rate

    def gain(some, g, h):
        return sum(g[k] for k in some) ** 2 / (sum(h[k] for k in some) + learner.l2)

    for _ in range(learner.rounds):
        p = [1 / (1 + math.exp(-s)) for s in score] if learner.binary else score
        g = [(p[k] - y[k]) * w[k] for k in rows]
        h = [p[k] * (1 - p[k]) * w[k] if learner.binary else w[k] for k in rows]

        def grow(every, level):
            some = [k for k in every if w[k] > 0]
            best = None
            if level < learner.depth:
                for missing_left in (False, True):
                    for f in range(len(cuts)):
                        for cut in [*cuts[f], math.inf]:
                            left = [k for k in every if (missing_left if x[k][f] is None else x[k][f] <= cut)]
                            inside = set(left)
                            a, b = [k for k in left if w[k] > 0], [k for k in some if k not in inside]
                            if a and b:
                                won = gain(a, g, h) + gain(b, g, h) - gain(some, g, h)
                                if won > 1e-9 and (best is None or won > best[0] + 1e-12):
                                    best = won, left
            if best is None:
                value = leaf(some, g, h)
                for k in every:
                    score[k] += value
                return
            inside = set(best[1])
            grow(best[1], level + 1)
            grow([k for k in every if k not in inside], level + 1)

        grow(list(rows), 0)
        rounds.append(list(score))
    return rounds


def small_panel(spark, n=160):
    draw = random.Random(8)
    rows = []
    for k in range(n):
        x = [draw.random() * 10 if draw.random() > 0.2 else None, float(draw.randint(0, 6)), draw.random()]
        y = (3.0 if x[0] is None else x[0]) + x[1] * x[2] + draw.gauss(0, 0.5)
        rows.append((k, 2000 + k % 4, *x, y if draw.random() > 0.05 else None, float(y > 7)))
    return materialize(spark.createDataFrame(rows, "row long, year int, a double, b double, c double, y double, z double")), rows


@pytest.mark.parametrize("binary", [False, True])
def test_family_equals_the_plain_version(spark, monkeypatch, binary):
    """All ways give the plain version's scores: one block, and levels over many blocks; folds train on earlier years only."""
    df, rows = small_panel(spark)
    learner = Learner(binary=binary, depth=3, rounds=6, patience=3)
    target = "z" if binary else "y"
    fits = [Fit("all/2002", 0, (0, 1, 2), 2002, 2002), Fit("all/2003", 0, (0, 1, 2), 2003, 2003), Fit("two/2003", 0, (2, 0), 2003, 2003), Fit("none", 0, (0,), 2000, 2000)]
    found = []
    for size in (1 << 16, 37):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", size)
        panel = in_blocks(df, ["a", "b", "c"], [target], "year", F.col("year") < 2002)
        assert (panel.count > 1) == (size == 37)
        models = fit_family(panel, fits, learner, "year")
        scores = {(r.fit, r.row): r.score for r in validation_scores(panel, models, fits, learner).collect()}
        found.append(({r.fit: (r.train_rows, r.validation_rows, r.iterations, r.value) for r in models.collect()}, scores))
    # the same trees to the last bit, however the rows are dealt (the mean target is an ordinary sum)
    assert {k: v[:3] for k, v in found[0][0].items()} == {k: v[:3] for k, v in found[1][0].items()}
    assert found[0][1] == pytest.approx(found[1][1], rel=1e-12)
    assert found[0][0]["none"][2] is None
    for fit in fits[:3]:
        known = [r for r in rows if r[5 if not binary else 6] is not None and r[1] <= fit.valid]
        x = [[r[2 + f] for f in fit.features] for r in known]
        y = [r[6 if binary else 5] for r in known]
        w = [1.0 if r[1] < fit.train_before else 0.0 for r in known]
        rounds = plain_boost(x, y, w, [panel.cuts[f].tolist() for f in fit.features], learner)
        held = [k for k, r in enumerate(known) if r[1] == fit.valid]
        if binary:
            errors = [sum(math.log1p(math.exp(s[k])) - y[k] * s[k] for k in held) for s in rounds]
        else:
            errors = [sum((s[k] - y[k]) ** 2 for k in held) for s in rounds]
        best, _ = boosting.stop_round(errors, learner.patience)
        assert found[0][0][fit.name][:3] == (len(known) - len(held), len(held), best)
        want = [1 / (1 + math.exp(-rounds[best - 1][k])) if binary else rounds[best - 1][k] for k in held]
        assert [found[0][1][fit.name, known[k][0]] for k in held] == pytest.approx(want, rel=1e-4)


def test_missingness_alone_decides(spark):
    """A feature whose values say nothing splits by being there: missing goes to the side that gains, right or left."""
    draw = random.Random(1)
    for sign in (1, -1):
        rows = [(k, 0, draw.random() if k % 2 else None, 0.0 if k % 2 else 5.0 * sign) for k in range(200)]
        df = materialize(spark.createDataFrame(rows, "row long, year int, a double, y double"))
        panel = in_blocks(df, ["a"], ["y"], "year")
        learner = Learner(depth=2, rounds=60)
        fit = Fit("m", 0, (0,), 1)
        model = fit_family(panel, [fit], learner, "year").first()
        scored = {r.row: r.score for r in boosting.row_scores(df, ["a"], panel.cuts, fit, model, learner).collect()}
        assert all(abs(scored[k] - y) < 0.1 for k, _, _, y in rows)
        first = read_trees(model, 2)[0]
        assert first.feature[0] == 0


def test_model_takes_weights_categories_and_odd_columns(spark):
    """An all-null feature, a constant one, unseen categories and rows without a target."""
    draw = random.Random(2)
    rows = [(k, f"c{k % 3}" if k % 7 else None, None, 1.0, float(k % 3 == 0), draw.random(), "train" if k < 150 else "validation" if k < 200 else "test") for k in range(260)]
    df = materialize(spark.createDataFrame([*rows, (300, "new", None, 1.0, None, 0.5, "test")], "t long, kind string, empty double, one double, y double, x double, split string"))
    spec = trees.TreeSpec(target="y", numeric=("empty", "one", "x"), categorical=("kind",), time="t", balanced=True, iterations=30, patience=5, depth=3)
    model = trees.train(df, spec)
    scored = trees.score(model, df, spec).collect()
    assert len(scored) == 261 and all(0 < r.score < 1 for r in scored)
    known = [r for r in scored if r.split == "test" and r.y is not None and r.kind]
    assert min(r.score for r in known if r.y == 1) > max(r.score for r in known if r.y == 0)
    ranked = trees.importances(spark, model, spec).collect()
    assert ranked[0].feature == "kind" and sum(r.importance for r in ranked) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        trees.train(df, replace(spec, time=None))
    with pytest.raises(ValueError):
        trees.train(df.where("split = 'test'"), spec)


def test_target_statistics_see_no_later_target(spark):
    """Rows of equal time and later ones leave a row's statistic as it is; NULL before any target."""
    draw = random.Random(3)
    rows = [(k, draw.randint(0, 30), draw.choice(["a", "a", "a", "b", None]), draw.choice([None, 1.0, 2.0, 7.0])) for k in range(300)]

    def statistics(some):
        df = spark.createDataFrame(some, "id long, t int, kind string, y double")
        return {r.id: r.s for r in earlier_mean(df, target_history(df, "kind", "y", "t"), "kind", "t", "s").collect()}

    found = statistics(rows)
    for k, t, kind, _ in rows:
        every = [r[3] for r in rows if r[1] < t and r[3] is not None]
        own = [r[3] for r in rows if r[1] < t and r[3] is not None and r[2] == kind and kind is not None]
        want = (sum(own) + 10 * sum(every) / len(every)) / (len(own) + 10) if every else None
        assert found[k] == (pytest.approx(want) if want is not None else None)
    changed = statistics([(k, t, kind, y if t < 15 else 1000.0) for k, t, kind, y in rows])
    assert all(changed[k] == found[k] for k, t, _, _ in rows if t <= 15)
    assert any(changed[k] != found[k] for k, t, _, _ in rows if t > 16)


def test_ablation_is_one_family(spark, monkeypatch):
    """All targets, variants and folds in one family over one panel, whose rows are not copied into folds."""
    seen = {}

    def watched(panel, fits, learner, period, weight=None):
        short = replace(learner, rounds=2)
        seen.update(fits=fits, learner=learner, rows=panel.blocks.agg(F.sum("rows")).first()[0], panel=panel.rows.count())
        return fit_family(panel, fits, short, period, weight)

    monkeypatch.setattr(trees, "fit_family", watched)
    rows = bindings()["grouped_ablation"].run(spark, FOLDER).collect()
    fits = seen["fits"]
    assert len({f.name for f in fits}) == 3 * 15 * 4 and (seen["learner"].rounds, seen["learner"].depth) == (250, 6)
    assert seen["rows"] == seen["panel"]
    assert all(f.valid == f.train_before for f in fits)
    assert len(rows) == 3 * 14 * 4
    for r in rows:
        assert r.rmse > 0 and r.mae > 0 and -1 <= r.spearman <= 1 and 0 <= r.group_validation_coverage_pct <= 100


def test_frozen_count_follows_the_folds(spark, monkeypatch):
    monkeypatch.setattr(trees, "best_iterations", lambda panel, spec, year, folds: [28 + fold % 2 for fold in folds] if spec.iterations == 250 else None)
    rows = bindings()["frozen_holdout"].run(spark, FOLDER)
    assert {r.iterations for r in rows.select("iterations").distinct().collect()} == {28}
    assert rows.where(F.col("score").isNull()).isEmpty()


def test_scores_and_figures_agree(spark):
    """Confusion figures of the train and test rows from the predictions of the same model, by hand."""
    panel = modelling.training_panel(modelling.Tables(spark, FOLDER))
    model = trees.train(panel, modelling.SPEC)
    predicted = trees.holdout_predictions(model, panel, modelling.SPEC).collect()
    figures = {r.split: r for r in bindings()["gbt_train_score"].run(spark, FOLDER).collect()}
    for split in ("validation", "test"):
        own = [r for r in predicted if r.split == split]
        hits = sum(r.target == r.predicted_label for r in own)
        assert figures[split].rows == len(own) and figures[split].accuracy == pytest.approx(hits / len(own))
        positives, negatives = [r.score for r in own if r.target], [r.score for r in own if not r.target]
        wins = sum((p > n) + (p == n) / 2 for p in positives for n in negatives)
        assert figures[split].roc_auc == pytest.approx(wins / len(positives) / len(negatives))
    assert np.isfinite([r.score for r in predicted]).all()


def subsets_value(tree, own, row, known, node=0):
    """Expected value of the tree where only the features in ``known`` are given, by cover."""
    if node >= len(tree.feature) or tree.feature[node] < 0:
        return tree.value[node]
    feature, left, right = tree.feature[node], 2 * node + 1, 2 * node + 2
    if feature in known:
        value = own[feature, row]
        goes_left = tree.missing_left[node] if value == boosting.MISSING else value <= tree.bin[node]
        return subsets_value(tree, own, row, known, left if goes_left else right)
    parts = [tree.cover[c] / tree.cover[node] * subsets_value(tree, own, row, known, c) for c in (left, right)]
    return sum(parts)


def test_attributions_are_shapley_values(spark):
    """Against all feature subsets on small trees; attributions and base value add up to the raw score on every row."""
    df, _ = small_panel(spark)
    panel = in_blocks(df, ["a", "b", "c"], ["y"], "year")
    learner = Learner(depth=4, rounds=8)
    fit = Fit("f", 0, (0, 1, 2), 2003)
    model = fit_family(panel, [fit], learner, "year").first()
    block = boosting.read_block(panel.blocks.first().asDict())
    own = block["bins"]
    for tree in read_trees(model, 4)[:3]:
        found = boosting.path_attributions(boosting.leaf_paths(tree), own)
        for row in range(0, own.shape[1], 11):
            for j in range(3):
                want = 0.0
                others = [f for f in range(3) if f != j]
                for mask in range(4):
                    known = {f for k, f in enumerate(others) if mask >> k & 1}
                    weight = math.factorial(len(known)) * math.factorial(2 - len(known)) / 6
                    want += weight * (subsets_value(tree, own, row, known | {j}) - subsets_value(tree, own, row, known))
                assert found[j, row] == pytest.approx(want, abs=1e-9)
    explained = boosting.row_attributions(df, ["a", "b", "c"], panel.cuts, fit, model, learner)
    both = boosting.row_scores(explained, ["a", "b", "c"], panel.cuts, fit, model, learner).collect()
    assert all(sum(r.attributions) + r.base_value == pytest.approx(r.score) for r in both)


def test_attribution_queries_add_up(spark):
    rows = bindings()["feature_attributions"].run(spark, FOLDER).collect()
    for r in rows:
        raw = r.base_value + sum(v for k, v in r.asDict().items() if k.startswith("effect_"))
        assert 1 / (1 + math.exp(-raw)) == pytest.approx(r.score)
