"""Boosted-tree training, scoring, importance, ablation and frozen holdout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from biotope.functions.rules import REPORT_FAMILY_RULES, first_rule
from biotope.functions.text import fill_category
from biotope.operators.metrics import THRESHOLD, regression_metrics, spearman
from biotope.operators.ordering import earlier_mean, target_history
from biotope.plans.boosting import Fit, Learner, facts_of, fit_family, gains, in_blocks, row_attributions, row_scores, validation_scores
from biotope.session import materialize

SMALLEST_ITERATIONS = 25
#: Split roles as periods of a fit.
ROLES = {"train": 0, "validation": 1, "test": 2}


@dataclass(frozen=True)
class TreeSpec:
    """Contract of one model."""

    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    #: Orders the rows where there are categories, which take part by the mean target of their earlier rows.
    time: str | None = None
    binary: bool = True
    balanced: bool = False
    weight: str | None = None
    iterations: int = 250
    #: Rounds without a smaller validation error after which a fit stops.
    patience: int = 40
    depth: int = 6
    learning_rate: float = 0.1
    ids: tuple[str, ...] = field(default=())

    @property
    def learner(self) -> Learner:
        return Learner(self.binary, self.depth, self.learning_rate, rounds=self.iterations, patience=self.patience)

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.numeric, *[f"{c}__earlier" for c in self.categorical])


@dataclass(frozen=True)
class Model:
    """One fit, with what its features are made from."""

    spec: TreeSpec
    fit: Fit
    row: Row
    cuts: list
    histories: dict[str, DataFrame]

    @property
    def iterations(self) -> int:
        return self.row["iterations"]


def weighted(rows: DataFrame, spec: TreeSpec) -> DataFrame:
    """Rows with their weight in the fit."""
    w = F.col(spec.weight).cast("double") if spec.weight else F.lit(1.0)
    if not (spec.binary and spec.balanced):
        return rows.withColumn("row_weight", w)
    # classes weighted inversely to their share of the training rows
    train = rows.where("split = 'train'") if "split" in rows.columns else rows
    shares = train.where(F.col(spec.target).isNotNull()).groupBy(spec.target).agg(F.count(F.lit(1)).alias("class_n"))
    total = train.agg(F.count(spec.target)).scalar()
    classes = shares.select(spec.target, (total / (2.0 * F.col("class_n"))).alias("class_weight"))
    return rows.join(classes, spec.target, "left").withColumn("row_weight", w * F.coalesce("class_weight", F.lit(1.0)))


def with_features(df: DataFrame, spec: TreeSpec, histories: Mapping[str, DataFrame]) -> DataFrame:
    """Rows with the mean target of each category's earlier training rows."""
    for c in spec.categorical:
        named = df.withColumn("__category", fill_category(F.col(c).cast("string")))
        df = earlier_mean(named, histories[c], "__category", spec.time, f"{c}__earlier").drop("__category")
    return df


def train(df: DataFrame, spec: TreeSpec) -> Model:
    """Fit on the train rows, stopping early on the validation rows where there are any.

    ``df`` is read several times; hand in a materialized table. Rows without a target are left out.
    """
    if spec.categorical and not spec.time:
        raise ValueError("categories need a time column, as a row may only see targets of earlier rows")
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = F.try_element_at(roles, F.col("split")) if "split" in df.columns else F.lit(0)
    learning = df.where(F.col(spec.target).isNotNull() & (role == 0))
    histories = {
        c: materialize(target_history(learning.withColumn("__category", fill_category(F.col(c).cast("string"))), "__category", spec.target, spec.time), "history")
        for c in spec.categorical
    }
    rows = weighted(with_features(df, spec, histories), spec).where(F.col(spec.target).isNotNull())
    rows = materialize(rows.select(*spec.features, spec.target, "row_weight", role.alias("role"), F.monotonically_increasing_id().alias("row")), "fit_rows")
    panel = in_blocks(rows, spec.features, [spec.target], "role", F.col("role") == 0, "row_weight")
    fit = Fit("model", 0, tuple(range(len(spec.features))), train_before=1, valid=1)
    if not facts_of(panel, [fit], "role", "row_weight", spec.binary)["model"].held:
        fit = replace(fit, valid=None)
    model = fit_family(panel, [fit], spec.learner, "role", "row_weight").first()
    if model["iterations"] is None:
        raise ValueError("no rows to train on")
    return Model(spec, fit, model, panel.cuts, histories)


def score(model: Model, df: DataFrame, spec: TreeSpec) -> DataFrame:
    ready = with_features(df, spec, model.histories)
    return row_scores(ready, spec.features, model.cuts, model.fit, model.row, spec.learner).select(*df.columns, "score")


def attributions(model: Model, df: DataFrame, spec: TreeSpec) -> DataFrame:
    """Rows with a column ``effect_<feature>`` for what each feature adds to the raw score, and ``base_value``."""
    ready = with_features(df, spec, model.histories)
    found = row_attributions(ready, spec.features, model.cuts, model.fit, model.row, spec.learner)
    names = [spec.features[f].removesuffix("__earlier") for f in model.fit.features]
    return found.select(*df.columns, *[F.get("attributions", F.lit(k)).alias(f"effect_{name}") for k, name in enumerate(names)], "base_value")


def holdout_predictions(model: Model, df: DataFrame, spec: TreeSpec) -> DataFrame:
    """Validation and test rows with ids, target, score and label at the threshold."""
    rows = score(model, df.where("split in ('validation', 'test')"), spec)
    return rows.select(
        *spec.ids,
        "split",
        F.col(spec.target).alias("target"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted_label"),
    )


def importances(spark: SparkSession, model: Model, spec: TreeSpec) -> DataFrame:
    """Ranked share of each feature in the gain of all splits, with its family."""
    weights = gains(model.row, [f.removesuffix("__earlier") for f in spec.features], model.fit, spec.depth)
    ranked = sorted(weights.items(), key=lambda item: (-item[1], item[0]))
    table = spark.createDataFrame(
        [(i + 1, name, value) for i, (name, value) in enumerate(ranked)],
        "position int, feature string, importance double",
    )
    return table.withColumn("family", first_rule(F.col("feature"), REPORT_FAMILY_RULES, "other"))


def ablation_variants(core: Mapping[str, Sequence[str]], local: Mapping[str, Sequence[str]], control: Sequence[str] = ()) -> list[dict]:
    """Reference with all core groups, plus each local group, minus each core group; all have the control columns."""
    def columns(groups: Mapping[str, Sequence[str]], leave_out: str | None = None) -> list[str]:
        return [*control, *[c for name, members in groups.items() if name != leave_out for c in members]]

    every = [c for members in core.values() for c in members]
    variants = [{"variant": "reference", "comparison": "reference", "group": None, "columns": columns(core), "covers": every}]
    for name, members in local.items():
        variants.append(
            {"variant": f"add_{name}", "comparison": "add", "group": name, "columns": [*columns(core), *members], "covers": members}
        )
    for name, members in core.items():
        variants.append(
            {"variant": f"remove_{name}", "comparison": "remove", "group": name, "columns": columns(core, name), "covers": members}
        )
    return variants


def fold_coverage(panel: DataFrame, targets: Sequence[str], year: str, folds: Sequence[int], groups: Sequence[Sequence[str]]) -> DataFrame:
    """(target, fold_year, covered): per fold year the percentage of rows with the target that have any column of each group."""
    any_of = lambda group: F.greatest(F.lit(0), *[F.col(c).isNotNull().cast("int") for c in group]) if group else F.lit(0)
    share = lambda t, g: F.round(F.coalesce(F.avg(F.when(F.col(t).isNotNull(), any_of(g) * 100.0)), F.lit(0.0)), 4)
    rows = panel.where(F.col(year).isin(list(folds))).groupBy(F.col(year).cast("int").alias("fold_year"))
    wide = rows.agg(*[F.array(*[share(t, g) for g in groups]).alias(t) for t in targets])
    return wide.unpivot(["fold_year"], list(targets), "target", "covered")


def grouped_ablation(
    panel: DataFrame,
    targets: Sequence[str],
    core: Mapping[str, Sequence[str]],
    local: Mapping[str, Sequence[str]],
    year: str,
    folds: Sequence[int],
    spec: TreeSpec,
    control: Sequence[str] = (),
) -> DataFrame:
    """Rows, best iteration, RMSE, MAE, Spearman and coverage of every variant, target and fold.

    All fits grow as one family over one written panel. A fold without train or validation rows has NULL figures.
    """
    variants = ablation_variants(core, local, control)
    columns = list(dict.fromkeys(c for v in variants for c in v["columns"]))
    rows = materialize(panel.select(*columns, *targets, year, F.monotonically_increasing_id().alias("row")), "ablation_rows")
    blocks = in_blocks(rows, columns, targets, year, F.col(year) < min(folds))
    fits, named = [], []
    for k, v in enumerate(variants):
        for t, target in enumerate(targets):
            for fold in folds:
                fits.append(Fit(f"{v['variant']}/{target}/{fold}", t, tuple(columns.index(c) for c in v["columns"]), fold, fold))
                named.append((fits[-1].name, target, v["variant"], v["comparison"], v["group"], fold, len(v["columns"]), k))
    models = fit_family(blocks, fits, spec.learner, year)
    scores = validation_scores(blocks, models, fits, spec.learner)
    table = panel.sparkSession.createDataFrame(
        named, "fit string, target string, variant string, comparison string, group_name string, fold_year int, feature_count int, place int"
    )
    figures = regression_metrics(scores, "truth", "score", ["fit"]).select("fit", "rmse", "mae")
    ranks = spearman(scores, "truth", "score", ["fit"]).select("fit", "spearman")
    coverage = fold_coverage(panel, targets, year, folds, [v["covers"] for v in variants])
    counts = models.select("fit", "train_rows", "validation_rows", F.col("iterations").alias("best_iteration"))
    joined = table.join(counts, "fit").join(figures, "fit", "left").join(ranks, "fit", "left").join(coverage, ["target", "fold_year"], "left")
    return joined.select(
        "target", "variant", "comparison", "group_name", "fold_year", "feature_count", "train_rows", "validation_rows", "best_iteration", "rmse", "mae",
        "spearman", F.coalesce(F.get("covered", F.col("place")), F.lit(0.0)).alias("group_validation_coverage_pct"),
    )


def best_iterations(panel: DataFrame, spec: TreeSpec, year: str, folds: Sequence[int]) -> list[int]:
    """Rounds of the fits that stop on each fold year, as one family; folds without rows give none."""
    rows = materialize(panel.select(*spec.numeric, spec.target, year, F.monotonically_increasing_id().alias("row")), "fold_rows")
    blocks = in_blocks(rows, spec.numeric, [spec.target], year, F.col(year) < min(folds))
    fits = [Fit(f"fold/{fold}", 0, tuple(range(len(spec.numeric))), fold, fold) for fold in folds]
    found = {r[0]: r[1] for r in fit_family(blocks, fits, spec.learner, year).select("fit", "iterations").collect()}  # a row for each fold
    return [found[f.name] for f in fits if found[f.name]]


def frozen_iterations(best_iterations: Sequence[int]) -> int:
    """Half-even rounded mean best iteration, at least 25."""
    mean = round(sum(best_iterations) / len(best_iterations)) if best_iterations else 0
    return max(SMALLEST_ITERATIONS, mean)


def frozen_holdout(
    panel: DataFrame, spec: TreeSpec, year: str, holdout_year: int, best_iterations: Sequence[int]
) -> DataFrame:
    """Train once before the holdout year with the frozen iteration count, score the holdout once."""
    frozen = replace(spec, iterations=frozen_iterations(best_iterations))
    model = train(panel.where(F.col(year) < holdout_year).drop("split"), frozen)
    return score(model, panel.where(F.col(year) == holdout_year).drop("split"), frozen).withColumn(
        "iterations", F.lit(frozen.iterations)
    )
