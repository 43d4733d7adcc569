"""Histogram gradient boosting for a whole family of fits over one panel.

A family shares rows, features and cut points; its fits differ in target, feature subset and in the periods they train
and stop on. The panel is written once as blocks of at most ``BLOCK_ROWS`` rows: bins of all features (one byte each),
targets, periods and weights. A fold is a comparison with the period, no row is copied into it.

Trees of all fits grow level by level. A level is one job: every block sums the gradients of its rows by (fit, node,
feature, bin), the sums of a fit meet in one task, which picks the split of each node, and the splits come back as a
small table. After the last level one job moves the scores on. A panel that is one block needs no meeting: there each
task takes some fits through all rounds on its own. Both ways run the same functions on the same integers: gradients are
rounded to multiples of a power of two, so sums do not depend on how the rows are dealt.

A split sends missing values to the side that gains more; a feature whose values say nothing can so still split by its
missingness. A fit keeps the trees up to the least validation error.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from math import factorial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from biotope.session import materialize, ship_package

BLOCK_ROWS = 1 << 16
#: Cut points of a feature at most; the last value of a byte stands for missing.
MOST_CUTS, MISSING = 253, 255
#: Gradients are multiples of 2**-20 of the largest target, so that 2**32 rows add up without rounding.
STEPS = 20


@dataclass(frozen=True)
class Learner:
    """How every fit of a family learns."""

    binary: bool = False
    depth: int = 6
    rate: float = 0.1
    l2: float = 3.0
    rounds: int = 250
    #: Rounds without a smaller validation error after which a fit stops.
    patience: int = 40


@dataclass(frozen=True)
class Fit:
    """Rows before ``train_before`` train; those of period ``valid``, if given, decide when to stop."""

    name: str
    target: int
    features: tuple[int, ...]
    train_before: int
    valid: int | None = None


class Facts(NamedTuple):
    """Counts and scales of a fit's rows."""

    train: int
    held: int
    base: float
    top: float
    weight: float

    def units(self) -> tuple[float, float]:
        """Steps in which gradients and their curvatures are counted."""
        unit = lambda x: 2.0 ** (np.ceil(np.log2(max(x, 1e-300))) - STEPS)
        return unit((self.top + abs(self.base)) * self.weight), unit(self.weight)


class Layout:
    """Places of a fit's (feature, bin) cells in one row; each feature's missing cell comes after its bins."""

    def __init__(self, cuts: Sequence[np.ndarray], features: Sequence[int]):
        self.features = np.array(features, np.int64)
        self.sizes = np.array([len(cuts[f]) + 1 for f in features], np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes + 1)[:-1])
        self.total = int((self.sizes + 1).sum())
        self.owner = np.repeat(np.arange(len(features)), self.sizes + 1)
        self.missing = self.starts + self.sizes

    def cells(self, bins: np.ndarray) -> np.ndarray:
        """Cells of the rows of a feature-by-row table of bins."""
        own = bins[self.features].astype(np.int64)
        return np.where(own == MISSING, self.missing[:, None], own + self.starts[:, None])


class Tree:
    """Nodes in heap order: position of the split feature in the fit (-1 for a leaf), last bin on the left, side of missing.

    ``cover`` is the curvature of the training rows that reach a node, their weight where the loss is the squared error.
    """

    def __init__(self, depth: int):
        inner, every = (1 << depth) - 1, (1 << (depth + 1)) - 1
        self.feature = np.full(inner, -1, np.int16)
        self.bin = np.zeros(inner, np.int16)
        self.missing_left = np.zeros(inner, bool)
        self.gain = np.zeros(inner)
        self.value = np.zeros(every)
        self.cover = np.zeros(every)
        self.depth = depth

    def leaves(self, own: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Node that each row reaches after so many levels; ``own`` holds the bins of the fit's features by row."""
        rows = np.arange(own.shape[1])
        node = np.zeros(own.shape[1], np.int64)
        for _ in range(self.depth if levels is None else levels):
            inside = node < len(self.feature)
            at = np.where(inside, node, 0)
            split = inside & (self.feature[at] >= 0)
            value = own[self.feature[at], rows]
            left = np.where(value == MISSING, self.missing_left[at], value <= self.bin[at])
            node = np.where(split, 2 * node + 2 - left, node)
        return node

    def take(self, level: int, found: np.ndarray, learner: Learner, units: tuple[float, float]) -> bool:
        """Enter the splits of a level, rows of ``choose``; true where a node was split."""
        first = (1 << level) - 1
        value = lambda g, h: -g * units[0] / (h * units[1] + learner.l2) * learner.rate
        for k, (feature, bin_, left, gain, gl, hl, gr, hr) in enumerate(found.tolist()):
            node = first + k
            if level == 0:
                self.value[0], self.cover[0] = value(gl + gr, hl + hr), (hl + hr) * units[1]
            if feature >= 0:
                self.feature[node], self.bin[node], self.missing_left[node], self.gain[node] = feature, bin_, left, gain
                self.value[2 * node + 1], self.value[2 * node + 2] = value(gl, hl), value(gr, hr)
                self.cover[2 * node + 1], self.cover[2 * node + 2] = hl * units[1], hr * units[1]
        return bool((found[:, 0] >= 0).any())


def choose(sums: np.ndarray, layout: Layout, learner: Learner, units: tuple[float, float]) -> np.ndarray:
    """Best split of each node from its sums (2, nodes, cells): feature, bin, missing left, gain, sums left and right.

    Feature -1 where no split gains. Of equal gains missing to the right wins, then the first feature and bin.
    """
    nodes = sums.shape[1]
    first = layout.starts[layout.owner]
    running = np.cumsum(sums, axis=2)
    before = np.where(first > 0, running[:, :, np.maximum(first - 1, 0)], 0)
    left = running - before
    lost = sums[:, :, layout.missing]
    left[:, :, layout.missing] -= lost  # the missing cell itself stands for "all values left"
    left = np.stack([left, left + lost[:, :, layout.owner]])
    whole = sums[:, :, layout.starts[0] : layout.starts[0] + layout.sizes[0] + 1].sum(axis=2)[:, :, None]
    right = whole - left
    score = lambda s: (s[0] * units[0]) ** 2 / (s[1] * units[1] + learner.l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.stack([score(left[k]) + score(right[k]) - score(whole) for k in (0, 1)], axis=1)
    gain = np.where((left[:, 1] > 0).swapaxes(0, 1) & (right[:, 1] > 0).swapaxes(0, 1), gain, -np.inf)
    flat = gain.reshape(nodes, -1)
    best = flat.argmax(axis=1)
    side, cell = np.divmod(best, layout.total)
    at = np.arange(nodes)
    most = flat[at, best]
    good = most > 1e-12 * (1 + score(whole)[:, 0])  # no more than rounding gains nothing
    feature = layout.owner[cell]
    columns = [np.where(good, feature, -1), cell - layout.starts[feature], side, np.where(good, most, 0)]
    columns += [left[side, 0, at, cell], left[side, 1, at, cell], right[side, 0, at, cell], right[side, 1, at, cell]]
    return np.stack(columns, axis=1).astype(np.float64)


class Part:
    """The rows of one block as one fit sees them."""

    def __init__(self, block: dict, fit: Fit, facts: Facts, layout: Layout, learner: Learner, scores: np.ndarray | None = None):
        target, period = block["targets"][fit.target], block["periods"]
        known = ~np.isnan(target)
        held = np.zeros(len(period), bool) if fit.valid is None else period == fit.valid
        self.rows = known & ((period < fit.train_before) | held)
        self.trains = period[self.rows] < fit.train_before
        self.own = block["bins"][layout.features][:, self.rows]
        self.cells = layout.cells(block["bins"])[:, self.rows][:, self.trains]
        self.truth, self.weight = target[self.rows], block["weights"][self.rows]
        self.score = np.full(len(self.truth), facts.base) if scores is None else scores
        self.layout, self.learner, self.units, self.top = layout, learner, facts.units(), max(facts.top, 1e-300)

    def gradients(self) -> np.ndarray:
        """Whole numbers of steps, first and second order, of the training rows."""
        score, truth, weight = self.score[self.trains], self.truth[self.trains], self.weight[self.trains]
        if self.learner.binary:
            p = 1 / (1 + np.exp(-score))
            both = (p - truth) * weight, p * (1 - p) * weight
        else:
            both = (score - truth) * weight, weight
        return np.stack([np.rint(x / u) for x, u in zip(both, self.units, strict=True)])

    def sums(self, tree: Tree, level: int, gradients: np.ndarray) -> np.ndarray:
        """Gradients of the training rows by node of the level and cell."""
        nodes, total = 1 << level, self.layout.total
        node = tree.leaves(self.own[:, self.trains], level) - (nodes - 1)
        here = node >= 0
        place = (node[here] * total + self.cells[:, here]).ravel()
        repeat = len(self.cells)
        return np.stack([np.bincount(place, np.tile(g[here], repeat), nodes * total).reshape(nodes, total) for g in gradients])

    def advance(self, tree: Tree) -> float:
        """Add the tree to the scores; the loss of the rows that do not train, as a whole number of steps."""
        self.score = self.score + tree.value[tree.leaves(self.own)]
        held = ~self.trains
        score, truth, weight = self.score[held], self.truth[held], self.weight[held]
        if self.learner.binary:
            loss = np.logaddexp(0, score) - truth * score
        else:
            loss = ((score - truth) / self.top) ** 2
        return float(np.rint(loss * weight * 2.0**STEPS).sum())


def stop_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """(rounds up to the least error, whether ``patience`` further rounds without a smaller one have followed)."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        if k - best >= patience:
            return best + 1, True
    return best + 1, False


@dataclass
class Progress:
    """Trees of a fit so far, and the errors after each."""

    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def done(self, learner: Learner, held: int) -> bool:
        return len(self.trees) >= learner.rounds or bool(held and self.errors and stop_round(self.errors, learner.patience)[1])

    def kept(self, learner: Learner, held: int) -> list[Tree]:
        return self.trees[: stop_round(self.errors, learner.patience)[0]] if held and self.errors else self.trees


ARRAYS = {"feature": "<i2", "bin": "<i2", "missing_left": "?", "gain": "<f8", "value": "<f8", "cover": "<f8"}
MODEL = "fit string, train_rows long, validation_rows long, iterations int, base double, " + ", ".join(f"{a} binary" for a in ARRAYS)


def _model_row(fit: Fit, facts: Facts, trees: list[Tree]) -> tuple:
    packed = [np.concatenate([getattr(t, a) for t in trees]).astype(k).tobytes() if trees else b"" for a, k in ARRAYS.items()]
    return fit.name, facts.train, facts.held, len(trees), facts.base, *packed


def read_trees(row, depth: int) -> list[Tree]:
    """Trees of a row of the table of models."""
    arrays = {a: np.frombuffer(row[a], k).reshape(row["iterations"], -1) if row["iterations"] else () for a, k in ARRAYS.items()}
    out = []
    for k in range(row["iterations"]):
        tree = Tree(depth)
        for a in ARRAYS:
            setattr(tree, a, arrays[a][k])
        out.append(tree)
    return out


def binned(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Number of cut points below each value; ``MISSING`` for NaN."""
    return np.where(np.isnan(values), MISSING, np.searchsorted(cuts, values, "left")).astype(np.uint8)


def feature_cuts(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """At most ``MOST_CUTS`` values of each feature at even ranks; the largest cuts nothing off."""
    if not features:
        return []
    ranks = [(k + 1) / (MOST_CUTS + 1) for k in range(MOST_CUTS)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), ranks, 10_000).alias(f"c{k}") for k, c in enumerate(features)], *[F.max(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate(features)]).first()
    return [np.array(sorted({v for v in found[f"c{k}"] or [] if v < found[f"m{k}"]})) for k in range(len(features))]


@dataclass(frozen=True)
class Panel:
    """A panel in blocks, and the names and cut points that its bytes stand for."""

    blocks: DataFrame
    count: int
    features: tuple[str, ...]
    targets: tuple[str, ...]
    cuts: list[np.ndarray]
    rows: DataFrame


BLOCK = "block long, rows int, bins binary, targets binary, periods binary, weights binary, row binary"


def _packed(cuts: list[np.ndarray], targets: int, most: int):
    def run(batches):
        held, waiting, number = 0, [], 0

        def block():
            whole = pa.Table.from_batches(waiting)
            double = lambda c: whole.column(c).to_numpy().astype(np.float64)
            bins = np.stack([binned(double(f"f{k}"), c) for k, c in enumerate(cuts)]) if cuts else np.zeros((0, whole.num_rows), np.uint8)
            y = np.stack([double(f"t{k}") for k in range(targets)])
            parts = [bins, y, whole.column("period").to_numpy().astype("<i8"), double("weight"), whole.column("row").to_numpy().astype("<i8")]
            columns = [pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()), pa.array([whole.num_rows], pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([p.tobytes()], pa.binary()) for p in parts]], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - held)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                held += part.num_rows
                if held == most:
                    yield block()
                    held, waiting, number = 0, [], number + 1
        if held:
            yield block()

    return run


def in_blocks(rows: DataFrame, features: Sequence[str], targets: Sequence[str], period: str, cut_rows: Column | None = None, weight: str | None = None) -> Panel:
    """The panel as blocks; ``rows`` must be a written table with a column ``row`` that tells its rows apart.

    Cut points come from the rows of ``cut_rows``, which every fit should train on, so that no later row shapes them.
    """
    ship_package(rows.sparkSession)
    cuts = feature_cuts(rows.where(cut_rows) if cut_rows is not None else rows, features)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    plain = rows.select(
        *[number(c).alias(f"f{k}") for k, c in enumerate(features)], *[number(c).alias(f"t{k}") for k, c in enumerate(targets)],
        F.col(period).cast("long").alias("period"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), "row",
    )
    parts = max(1, -(-rows.count() // BLOCK_ROWS))
    blocks = materialize(plain.where("period is not null").repartition(parts, "row").mapInArrow(_packed(cuts, len(targets), BLOCK_ROWS), BLOCK), "blocks")
    return Panel(blocks, blocks.count(), tuple(features), tuple(targets), cuts, rows)


def read_block(row: dict) -> dict:
    n = row["rows"]
    table = lambda name, kind: np.frombuffer(row[name], kind).reshape(-1, n)
    return {"bins": table("bins", np.uint8), "targets": table("targets", "<f8"), "periods": table("periods", "<i8")[0], "weights": table("weights", "<f8")[0], "row": table("row", "<i8")[0]}


def facts_of(panel: Panel, fits: Sequence[Fit], period: str, weight: str | None, binary: bool) -> dict[str, Facts]:
    """Counts and scales of every fit's rows, in one aggregate over the distinct row sets."""
    sets = sorted({(f.target, f.train_before, f.valid if f.valid is not None else -1, f.valid is None) for f in fits})
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    at, figures = F.col(period).cast("long"), []
    for k, (target, before, valid, never) in enumerate(sets):
        y = F.col(panel.targets[target]).cast("double")
        y = F.when(~F.isnan(y), y)
        trains, held = y.isNotNull() & (at < before), y.isNotNull() & ((at == valid) if not never else F.lit(False)) & (at >= before)
        figures += [
            F.count_if(trains).alias(f"n{k}"), F.count_if(held).alias(f"h{k}"), (F.sum(F.when(trains, w * y)) / F.sum(F.when(trains, w))).alias(f"b{k}"),
            F.max(F.when(trains | held, F.abs(y))).alias(f"t{k}"), F.max(F.when(trains | held, w)).alias(f"w{k}"),
        ]
    row = panel.rows.agg(*figures).first()
    found = {}
    for k, key in enumerate(sets):
        base = row[f"b{k}"] or 0.0
        if binary:
            p = min(max(base, 1e-6), 1 - 1e-6)
            base = float(np.log(p / (1 - p)))
        found[key] = Facts(row[f"n{k}"], row[f"h{k}"], base, 1.0 if binary else (row[f"t{k}"] or 0.0), row[f"w{k}"] or 1.0)
    return {f.name: found[f.target, f.train_before, f.valid if f.valid is not None else -1, f.valid is None] for f in fits}


def _fit_alone(part: Part, facts: Facts, learner: Learner) -> list[Tree]:
    """All rounds of one fit whose rows are one block."""
    progress = Progress()
    while not progress.done(learner, facts.held):
        tree, gradients = Tree(learner.depth), part.gradients()
        for level in range(learner.depth):
            if not tree.take(level, choose(part.sums(tree, level, gradients), part.layout, learner, part.units), learner, part.units):
                break
        progress.errors.append(part.advance(tree))
        progress.trees.append(tree)
    return progress.kept(learner, facts.held)


def _alone(fits: dict[str, Fit], facts: dict[str, Facts], cuts, learner: Learner):
    """Models of the fits that a task is dealt, from the one block."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                fit = fits[row["fit"]]
                part = Part(read_block(row), fit, facts[fit.name], Layout(cuts, fit.features), learner)
                rows.append(_model_row(fit, facts[fit.name], _fit_alone(part, facts[fit.name], learner)))
            yield _rows_batch(rows)

    return run


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), *[pa.binary()] * len(ARRAYS)]
    names = [c.split()[0] for c in MODEL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _scores_of(row: dict, names: Sequence[str]) -> dict[str, np.ndarray] | None:
    """Scores of the fits in a block, one after another as long as each one's rows are."""
    if row.get("scores") is None:
        return None
    values, ends = np.frombuffer(row["scores"], "<f8"), np.cumsum(row["sizes"])
    return dict(zip(names, np.split(values, ends[:-1]), strict=True))


def _level_sums(fits: Sequence[Fit], going: set, facts, cuts, learner: Learner, trees: dict[str, Tree], level: int):
    """Per block and fit that still grows, the sums of the level."""
    names = [f.name for f in fits]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, scores = read_block(row), _scores_of(row, names)
                for fit in fits:
                    if fit.name in going:
                        part = Part(block, fit, facts[fit.name], Layout(cuts, fit.features), learner, scores and scores[fit.name])
                        sums = part.sums(trees[fit.name], level, part.gradients())
                        yield pa.RecordBatch.from_arrays([pa.array([fit.name]), pa.array([sums.tobytes()], pa.binary())], ["fit", "sums"])

    return run


def _level_splits(fits: dict[str, Fit], facts, cuts, learner: Learner, level: int):
    """Splits of one fit's nodes from the sums of all blocks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fit = fits[key[0].as_py()]
        layout = Layout(cuts, fit.features)
        total = np.zeros((2, 1 << level, layout.total))
        for sums in table.column("sums").to_pylist():
            total += np.frombuffer(sums).reshape(total.shape)
        found = choose(total, layout, learner, facts[fit.name].units())
        return pa.table({"fit": [fit.name], "splits": pa.array([found.tobytes()], pa.binary())})

    return run


def _advanced(fits: Sequence[Fit], going: set, facts, cuts, learner: Learner, trees: dict[str, Tree]):
    """Blocks with the scores after the round, and each fit's loss in the block."""
    names = [f.name for f in fits]
    plain = [c.split()[0] for c in BLOCK.split(", ")]

    def run(batches):
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                block, scores = read_block(row), _scores_of(row, names)
                after, losses = [], []
                for fit in fits:
                    part = Part(block, fit, facts[fit.name], Layout(cuts, fit.features), learner, scores and scores[fit.name])
                    losses.append(part.advance(trees[fit.name]) if fit.name in going else 0.0)
                    after.append(part.score)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(k, 1) for c in plain], pa.array([np.concatenate(after).astype("<f8").tobytes()], pa.binary()),
                        pa.array([[len(a) for a in after]], pa.list_(pa.int32())), pa.array([losses], pa.list_(pa.float64())),
                    ],
                    [*plain, "scores", "sizes", "losses"],
                )

    return run


def _by_levels(panel: Panel, fits: Sequence[Fit], facts, learner: Learner) -> DataFrame:
    """Models of a panel of many blocks, one job a level."""
    by_name, progress, blocks = {f.name: f for f in fits}, {f.name: Progress() for f in fits}, panel.blocks
    while going := {f.name for f in fits if not progress[f.name].done(learner, facts[f.name].held)}:
        trees = {name: Tree(learner.depth) for name in going}
        growing = set(going)
        for level in range(learner.depth):
            if not growing:
                break
            sums = blocks.mapInArrow(_level_sums(fits, growing, facts, panel.cuts, learner, trees, level), "fit string, sums binary")
            splits = sums.groupBy("fit").applyInArrow(_level_splits(by_name, facts, panel.cuts, learner, level), "fit string, splits binary")
            for name, raw in splits.collect():  # a row for each fit
                if not trees[name].take(level, np.frombuffer(raw).reshape(-1, 8), learner, facts[name].units()):
                    growing.discard(name)
        blocks = materialize(blocks.mapInArrow(_advanced(fits, going, facts, panel.cuts, learner, trees), f"{BLOCK}, scores binary, sizes array<int>, losses array<double>"), "scores")
        lost = blocks.select(F.posexplode("losses").alias("fit", "loss")).groupBy("fit").agg(F.sum("loss")).collect()  # a row for each fit
        for k, loss in lost:
            if fits[k].name in going:
                progress[fits[k].name].trees.append(trees[fits[k].name])
                progress[fits[k].name].errors.append(loss)
    rows = [_model_row(f, facts[f.name], progress[f.name].kept(learner, facts[f.name].held)) for f in fits]
    return panel.blocks.sparkSession.createDataFrame(rows, MODEL)


@contextmanager
def _a_block_at_a_time(spark):
    """A batch holds one row of the table of blocks, which is some megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fit_family(panel: Panel, fits: Sequence[Fit], learner: Learner, period: str, weight: str | None = None) -> DataFrame:
    """One row for each fit: train and validation rows, iterations, base score and the trees as arrays.

    A fit without training rows, or without rows of the period it should stop on, has no trees and NULL iterations.
    """
    spark = panel.blocks.sparkSession
    facts = facts_of(panel, fits, period, weight, learner.binary)
    able = [f for f in fits if facts[f.name].train and (f.valid is None or facts[f.name].held) and f.features]
    rest = [(f.name, facts[f.name].train, facts[f.name].held, None, None, *[None] * len(ARRAYS)) for f in fits if f not in able]
    with _a_block_at_a_time(spark):
        if panel.count <= 1:
            dealt = panel.blocks.withColumn("fit", F.explode(F.array(*[F.lit(f.name) for f in able]).cast("array<string>")))
            parts = max(1, min(len(able), 4 * spark.sparkContext.defaultParallelism))
            models = dealt.repartition(parts, "fit").mapInArrow(_alone({f.name: f for f in able}, facts, panel.cuts, learner), MODEL)
        else:
            models = _by_levels(panel, able, facts, learner)
        return materialize(models.union(spark.createDataFrame(rest, MODEL)) if rest else models, "models")


def _family_scores(fits: dict[str, Fit], depth: int, binary: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fit, block = fits[row["fit"]], read_block(row)
                rows = (block["periods"] == fit.valid) & ~np.isnan(block["targets"][fit.target])
                own = block["bins"][np.array(fit.features, np.int64)][:, rows]
                score = sum((t.value[t.leaves(own)] for t in read_trees(row, depth)), np.full(own.shape[1], row["base"]))
                score = 1 / (1 + np.exp(-score)) if binary else score
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fit.name] * len(score), pa.string()), pa.array(block["row"][rows]), pa.array(block["targets"][fit.target][rows]), pa.array(score)],
                    ["fit", "row", "truth", "score"],
                )

    return run


def validation_scores(panel: Panel, models: DataFrame, fits: Sequence[Fit], learner: Learner) -> DataFrame:
    """(fit, row, truth, score) of the rows that each fit stopped on."""
    names = F.array(*[F.lit(f.name) for f in fits])
    dealt = panel.blocks.withColumn("fit", F.explode(names)).join(models.where("iterations is not null"), "fit")
    scored = dealt.mapInArrow(_family_scores({f.name: f for f in fits}, learner.depth, learner.binary), "fit string, row long, truth double, score double")
    with _a_block_at_a_time(models.sparkSession):
        return materialize(scored, "validation_scores")


def row_scores(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], fit: Fit, model, learner: Learner) -> DataFrame:
    """``df`` with the score of one model; ``features`` are the panel's, of which the fit names its own."""
    ship_package(df.sparkSession)
    trees, base = read_trees(model, learner.depth), model["base"]
    own_cuts = [cuts[f] for f in fit.features]
    columns = [f"__feature_{k}" for k in range(len(fit.features))]
    kinds = [c for c in df.schema]

    def run(batches):
        for batch in batches:
            values = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]
            own = np.stack([binned(v, c) for v, c in zip(values, own_cuts, strict=True)])
            score = sum((t.value[t.leaves(own)] for t in trees), np.full(batch.num_rows, base))
            score = 1 / (1 + np.exp(-score)) if learner.binary else score
            yield pa.RecordBatch.from_arrays([*[batch.column(c.name) for c in kinds], pa.array(score)], [*[c.name for c in kinds], "score"])

    numbers = [F.coalesce(F.col(features[f]).cast("double"), F.lit(float("nan"))).alias(c) for f, c in zip(fit.features, columns, strict=True)]
    return df.select("*", *numbers).mapInArrow(run, StructType([*kinds, StructField("score", DoubleType())]))


def gains(model, features: Sequence[str], fit: Fit, depth: int) -> dict[str, float]:
    """Share of each feature in the gain of all splits."""
    total = {features[f]: 0.0 for f in fit.features}
    for tree in read_trees(model, depth):
        for f, g in zip(tree.feature.tolist(), tree.gain.tolist(), strict=True):
            if f >= 0:
                total[features[fit.features[f]]] += g
    whole = sum(total.values())
    return {name: g / whole if whole else 0.0 for name, g in total.items()}


class Path(NamedTuple):
    """A leaf as the conditions on the way to it, gathered by feature, and what it adds to each feature.

    ``steps`` holds (place of the feature on the path, feature, last bin on the left, missing left, goes left) of each
    split. Row ``p`` of ``shares`` is for rows that meet the conditions of the features whose bits are set in ``p``.
    """

    features: list[int]
    steps: list[tuple[int, int, int, bool, bool]]
    shares: np.ndarray
    expected: float


def leaf_paths(tree: Tree) -> list[Path]:
    """Paths of all leaves, with the Shapley value of each feature where an absent feature's splits are taken by cover.

    A leaf is reached in the share of its cover where a feature is absent, and surely or not at all where it is
    present. The sum over feature sets of each size comes from the product of (absent + present * t) over the other
    features of the path, of which there are no more than the tree is deep.
    """
    out = []

    def walk(node: int, steps: list):
        if node < len(tree.feature) and tree.feature[node] >= 0:
            for child, left in ((2 * node + 1, True), (2 * node + 2, False)):
                share = tree.cover[child] / tree.cover[node]
                walk(child, [*steps, (int(tree.feature[node]), int(tree.bin[node]), bool(tree.missing_left[node]), left, share)])
            return
        features = list(dict.fromkeys(s[0] for s in steps))
        m = len(features)
        absent = np.ones(m)
        for feature, *_, share in steps:
            absent[features.index(feature)] *= share
        present = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
        weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
        shares = np.zeros((1 << m, m))
        for j in range(m):
            sizes = np.ones((1 << m, 1))  # coefficients by number of present features
            for i in range(m):
                if i != j:
                    sizes = np.pad(sizes * absent[i], ((0, 0), (0, 1))) + np.pad(sizes * present[:, [i]], ((0, 0), (1, 0)))
            shares[:, j] = tree.value[node] * (present[:, j] - absent[j]) * (sizes @ weights)
        out.append(Path(features, [(features.index(f), f, b, ml, left) for f, b, ml, left, _ in steps], shares, float(tree.value[node] * absent.prod())))

    walk(0, [])
    return out


def path_attributions(paths: Sequence[Path], own: np.ndarray) -> np.ndarray:
    """Features by rows: what each feature adds to each row's score along all paths."""
    out = np.zeros(own.shape)
    for path in paths:
        met = np.ones((len(path.features), own.shape[1]), bool)
        for place, feature, bin_, missing_left, left in path.steps:
            goes_left = np.where(own[feature] == MISSING, missing_left, own[feature] <= bin_)
            met[place] &= goes_left == left
        pattern = (met << np.arange(len(path.features))[:, None]).sum(axis=0) if path.features else np.zeros(own.shape[1], np.int64)
        for j, feature in enumerate(path.features):
            out[feature] += path.shares[pattern, j]
    return out


def row_attributions(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], fit: Fit, model, learner: Learner) -> DataFrame:
    """``df`` with ``attributions``, what each feature of the fit adds to the row's raw score, and ``base_value``.

    Their sum is the raw score (log odds of a binary fit). Additive and exact, with the trees' covers as background.
    """
    ship_package(df.sparkSession)
    paths = [p for t in read_trees(model, learner.depth) for p in leaf_paths(t)]
    base = model["base"] + sum(p.expected for p in paths)
    sent = df.sparkSession.sparkContext.broadcast(paths)
    own_cuts = [cuts[f] for f in fit.features]
    columns = [f"__feature_{k}" for k in range(len(fit.features))]
    kinds = list(df.schema)

    def run(batches):
        for batch in batches:
            own = np.stack([binned(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64), cut) for c, cut in zip(columns, own_cuts, strict=True)])
            values = path_attributions(sent.value, own).T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(columns)).astype(np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c.name) for c in kinds], lists, pa.array(np.full(batch.num_rows, base))], [*[c.name for c in kinds], "attributions", "base_value"])

    numbers = [F.coalesce(F.col(features[f]).cast("double"), F.lit(float("nan"))).alias(c) for f, c in zip(fit.features, columns, strict=True)]
    return df.select("*", *numbers).mapInArrow(run, StructType([*kinds, StructField("attributions", ArrayType(DoubleType())), StructField("base_value", DoubleType())]))
