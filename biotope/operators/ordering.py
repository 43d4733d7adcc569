"""Distributed order statistics: running totals, ranks and exact quantiles.

A window over a whole table, or over a group that may hold a third of it, would
put that group into one task. Here the order column is cut into value buckets
first. Equal values share a bucket, so sums inside a bucket plus the totals of
the buckets before it are exact whatever the cuts are; the cuts only decide how
even the tasks are. Rows are pre-aggregated to one cell per distinct value, which
also absorbs heavily tied values.

The cuts are sampled in a job of their own, as a range sort would do. The rows are
therefore written once to the shared folder, narrowed to what is needed, unless the
caller says they are ``staged`` already. Group columns must not be NULL.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biotope.session import materialize

MIN_BUCKETS = 16


def bucket_count(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BUCKETS, 2 * partitions)


def value_cuts(df: DataFrame, *columns: str) -> dict[str, list[float]]:
    """Approximate quantile cuts per column, fewer than ``bucket_count`` finite numbers each."""
    n = bucket_count(df)
    probabilities = [i / n for i in range(1, n)]
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    found = doubles.approxQuantile(list(columns), probabilities, 1.0 / (2 * n))
    return {c: sorted({x for x in cuts if math.isfinite(x)}) for c, cuts in zip(columns, found)}


def with_bucket(df: DataFrame, column: str, cuts: Sequence[float], name: str) -> DataFrame:
    """Add the position of ``column`` among the cuts (JVM-side binary search)."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    probe = f"{name}_probe"
    bucketizer = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol=probe, outputCol=name, handleInvalid="keep"
    )
    placed = bucketizer.transform(df.withColumn(probe, F.col(column).cast("double")))
    return placed.withColumn(name, F.col(name).cast("int")).drop(probe)


def _before(window) -> object:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _directed(column: str, descending: bool) -> Column:
    return F.col(column).desc() if descending else F.col(column).asc()


def _prefix(
    cells: DataFrame, groups: list[str], bucket: str, order: list[Column], sums: list[str], descending: bool
) -> DataFrame:
    """Add ``<sum>_before``: the sum over all cells of the group ordered strictly before."""
    inner = _before(Window.partitionBy(*groups, bucket).orderBy(*order))
    local = cells.select(
        "*", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"{s}_local") for s in sums]
    )
    # one row per group and bucket, at most ``bucket_count`` + 1 per group
    outer = _before(Window.partitionBy(*groups).orderBy(_directed(bucket, descending)))
    totals = cells.groupBy(*groups, bucket).agg(*[F.sum(s).alias(s) for s in sums])
    offsets = totals.select(
        *groups, bucket, *[F.coalesce(F.sum(s).over(outer), F.lit(0)).alias(f"{s}_offset") for s in sums]
    )
    joined = local.join(offsets, [*groups, bucket])
    return joined.select(
        *cells.columns, *[(F.col(f"{s}_local") + F.col(f"{s}_offset")).alias(f"{s}_before") for s in sums]
    )


def value_prefix(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    descending: bool = False,
    staged: bool = False,
) -> DataFrame:
    """One row per group and distinct value with ``n``, the sums, and the totals before it.

    NULL values are left out, as in the ranking of the metrics.
    """
    groups = list(groups)
    sums = dict(sums or {})
    rows = df.where(F.col(value).isNotNull()).select(*groups, value, *[c.alias(s) for s, c in sums.items()])
    rows = rows if staged else materialize(rows, "values")
    cuts = value_cuts(rows, value)[value]
    cells = rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums])
    cells = with_bucket(cells, value, cuts, "value_bucket")
    prefix = _prefix(
        cells, groups, "value_bucket", [_directed(value, descending)], ["n", *sums], descending
    )
    return prefix.drop("value_bucket")


def neighbours(df: DataFrame, value: str) -> DataFrame:
    """Each distinct value with the next smaller and next larger one (``before``, ``after``).

    Neighbours are found inside value buckets; at a bucket's ends they come from the buckets' extents.
    """
    values = materialize(df.where(F.col(value).isNotNull()).select(value).distinct(), "axis")
    placed = with_bucket(values, value, value_cuts(values, value)[value], "value_bucket")
    inside = Window.partitionBy("value_bucket").orderBy(value)
    # one row per bucket
    across = Window.orderBy("value_bucket")
    ends = placed.groupBy("value_bucket").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    ends = ends.select("value_bucket", F.lag("high").over(across).alias("left"), F.lead("low").over(across).alias("right"))
    near = placed.withColumn("before", F.lag(value).over(inside)).withColumn("after", F.lead(value).over(inside))
    return near.join(ends, "value_bucket").select(
        value, F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after")
    )


def average_rank(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "avg_rank") -> DataFrame:
    """Rank from 1, ties sharing the mean of their positions."""
    rows = materialize(df, "ranked")
    cells = value_prefix(rows, value, groups, staged=True)
    ranks = cells.select(*groups, value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(name))
    return rows.join(ranks, [*groups, value], "left")


def ordered_totals(
    df: DataFrame,
    score: str,
    tie: str,
    groups: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    rank_name: str = "position",
    staged: bool = False,
) -> DataFrame:
    """Row position by score descending, then ``tie`` ascending, with inclusive running sums.

    A value tied over many rows is split by buckets of the (numeric) tie column,
    so that no task holds more than one bucket of it.
    """
    groups = list(groups)
    sums = dict(sums or {})
    rows = df.where(F.col(score).isNotNull()).select(
        "*", *[c.alias(f"{s}_term") for s, c in sums.items()]
    )
    rows = rows if staged else materialize(rows, "ordered")
    cuts = value_cuts(rows, score, tie)
    rows = with_bucket(rows, tie, cuts[tie], "tie_bucket")
    keys = [*groups, score, "tie_bucket"]
    cells = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cell_n"), *[F.sum(f"{s}_term").alias(f"cell_{s}") for s in sums]
    )
    cells = with_bucket(cells, score, cuts[score], "score_bucket")
    cells = _prefix(
        cells,
        groups,
        "score_bucket",
        [F.col(score).desc(), F.col("tie_bucket").asc()],
        ["cell_n", *[f"cell_{s}" for s in sums]],
        descending=True,
    ).select(*keys, "cell_n_before", *[f"cell_{s}_before" for s in sums])
    within = Window.partitionBy(*keys).orderBy(F.col(tie).asc())
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        "*",
        F.row_number().over(within).alias("local_n"),
        *[F.sum(f"{s}_term").over(running).alias(f"local_{s}") for s in sums],
    )
    joined = local.join(cells, keys)
    return joined.select(
        *df.columns,
        (F.col("cell_n_before") + F.col("local_n")).alias(rank_name),
        *[(F.col(f"cell_{s}_before") + F.col(f"local_{s}")).alias(s) for s in sums],
    )


def quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], groups: Sequence[str] = (), staged: bool = False
) -> DataFrame:
    """Exact quantiles, linear on (n - 1) * p: one row per group and probability.

    Groups may be as large as the table: the two neighbouring order statistics are
    picked from the running counts instead of collecting the group's values.
    """
    groups = list(groups)
    values = df.select(*groups, F.col(value).alias("order_value"))
    cells = value_prefix(values, "order_value", groups, staged=staged).select(*groups, "order_value", "n", "n_before")
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    places = cells.groupBy(*groups).agg(F.sum("n").alias("group_n")).select(
        *groups,
        F.transform(
            wanted, lambda p: F.struct(p.alias("probability"), ((F.col("group_n") - 1) * p).alias("place"))
        ).alias("places"),
    )
    # one short row per group meets the cells
    if groups:
        located = cells.join(places, groups)
    else:
        located = cells.withColumn("places", places.scalar())

    def covers(index: Column) -> Column:
        return (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))

    near = F.filter("places", lambda q: covers(F.floor(q["place"])) | covers(F.ceil(q["place"])))
    hits = located.select(*groups, "order_value", "n", "n_before", F.inline(near))
    found = hits.groupBy(*groups, "probability", "place").agg(
        F.max(F.when(covers(F.floor("place")), F.col("order_value"))).alias("lower_value"),
        F.max(F.when(covers(F.ceil("place")), F.col("order_value"))).alias("upper_value"),
    )
    part = F.col("place") - F.floor("place")
    return found.select(
        *groups,
        "probability",
        (F.col("lower_value") + (F.col("upper_value") - F.col("lower_value")) * part).alias("quantile"),
    )


def quantile_columns(
    df: DataFrame, value: str, named: Mapping[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """As ``quantiles`` with one column per named probability."""
    found = quantiles(df, value, list(named.values()), groups)
    return found.groupBy(*groups).agg(
        *[F.max(F.when(F.col("probability") == float(p), F.col("quantile"))).alias(name) for name, p in named.items()]
    )


def quantile_bins(
    df: DataFrame,
    value: str,
    bins: int,
    groups: Sequence[str] = (),
    name: str = "bin",
    lowest_joins_first: bool = False,
    staged: bool = False,
) -> DataFrame:
    """Number of distinct inner quantile edges strictly below the value, from 0.

    Bins are closed on the right. With ``lowest_joins_first`` an edge equal to the
    minimum is dropped, so that the minimum shares the first bin instead of forming
    one. The edges (``bins`` + 1 per group at most) are the only thing joined back.
    """
    groups = list(groups)
    probabilities = [i / bins for i in range(0 if lowest_joins_first else 1, bins)]
    rows = df if staged else materialize(df, "binned")
    edges = quantiles(rows, value, probabilities, groups, staged=True)
    nested = edges.groupBy(*groups).agg(F.sort_array(F.collect_set("quantile")).alias("edges"))
    kept = rows.where(F.col(value).isNotNull())
    placed = kept.join(nested, groups) if groups else kept.withColumn("edges", nested.scalar())
    below = F.size(F.filter("edges", lambda e: e < F.col(value)))
    if lowest_joins_first:
        below = F.greatest(below - 1, F.lit(0))
    return placed.withColumn(name, below).drop("edges")


def percentile_scores(
    reference: DataFrame, queries: DataFrame, value: str, groups: Sequence[str] = (), name: str = "score"
) -> DataFrame:
    """Half-even rounded share (0-100) of reference values not above each query value."""
    groups = list(groups)
    rows = materialize(queries, "queries")
    both = reference.select(*groups, value, F.lit(1).alias("counted")).unionByName(
        rows.select(*groups, value, F.lit(0).alias("counted"))
    )
    cells = value_prefix(both, value, groups, {"held": F.col("counted")})
    sizes = cells.groupBy(*groups).agg(F.sum("held").alias("reference_n"))
    held = cells.withColumn("at_or_below", F.col("held_before") + F.col("held"))
    if groups:
        held = held.join(sizes, groups)
    else:
        held = held.withColumn("reference_n", sizes.scalar())
    scored = held.select(
        *groups,
        value,
        F.bround(100.0 * F.col("at_or_below") / F.col("reference_n"), 0).cast("int").alias(name),
    )
    return rows.join(scored, [*groups, value], "left")


def target_history(rows: DataFrame, category: str, target: str, time: str) -> DataFrame:
    """(category, history): per category the running number and sum of targets up to each time it has, in time order.

    Rows meet by (category, time) in a partial aggregate, so a category with most rows is no task of its own; a
    history is as long as the calendar. The row of category NULL runs over all rows; rows without a time or target are left out.
    """
    known = rows.where(F.col(time).isNotNull() & F.col(target).isNotNull())
    cells = known.groupBy(category, time).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("double")).alias("total"))
    both = cells.where(F.col(category).isNotNull()).unionByName(cells.groupBy(time).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn(category, F.lit(None).cast(cells.schema[category].dataType)))
    w = Window.partitionBy(category).orderBy(time)
    running = both.select(category, F.struct(F.col(time).alias("at"), F.sum("n").over(w).alias("n"), F.sum("total").over(w).alias("total")).alias("step"))
    return running.groupBy(category).agg(F.array_sort(F.collect_list("step")).alias("history"))


def earlier_mean(rows: DataFrame, history: DataFrame, category: str, time: str, name: str, prior_rows: float = 10.0) -> DataFrame:
    """Mean target of the category's rows at earlier times, drawn towards that of all earlier rows as by ``prior_rows`` rows.

    A row never sees its own time or a later one. NULL where no row is earlier or the time is unknown.
    """
    everyone = history.where(F.col(category).isNull()).select(F.first("history")).scalar()
    own = history.where(F.col(category).isNotNull()).select(F.col(category).alias("__key"), F.col("history").alias("__own"))
    found = rows.join(own, rows[category] == own["__key"], "left").withColumn("__all", everyone)
    before = lambda c: F.try_element_at(F.filter(c, lambda s: s["at"] < F.col(time)), F.lit(-1))
    last = found.withColumn("__own", before("__own")).withColumn("__all", before("__all"))
    prior = F.col("__all.total") / F.col("__all.n")
    mean = (F.coalesce("__own.total", F.lit(0.0)) + prior_rows * prior) / (F.coalesce("__own.n", F.lit(0)) + prior_rows)
    return last.withColumn(name, mean).drop("__key", "__own", "__all")
