"""Joins of panels with static, yearly, coarse and overlay tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotope.functions.rules import any_present
from biotope.operators.windows import forward_fill, over_panel


def overlay_join(cells: DataFrame, overlay: DataFrame, key: str = "grid_key") -> DataFrame:
    """Every cell row with every site the cell overlaps."""
    return cells.join(overlay, key)


def static_join(panel: DataFrame, static: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left many-to-one join; uniqueness and completeness are separate checks (``quality``)."""
    return panel.join(static, on, "left")


def asof_year(
    panel: DataFrame, annual: DataFrame, site: str, year: str, values: Sequence[str], source_year: str
) -> DataFrame:
    """Newest annual row with source year not after the panel year.

    The years of a site (as many as the calendar has, one row each after the first
    aggregate) travel as one sorted array, so the panel keeps its rows and no year
    pairs are formed. Repeated years are for ``duplicate_keys`` to report.
    """
    yearly = annual.groupBy(site, year).agg(F.max(F.struct(*values)).alias("values"))
    history = yearly.groupBy(site).agg(
        F.sort_array(F.collect_list(F.struct(F.col(year).alias("source_year"), "values.*"))).alias("annual_rows")
    )
    joined = panel.join(history, site, "left")
    eligible = F.filter("annual_rows", lambda a: a["source_year"] <= F.col(year))
    newest = F.try_element_at(eligible, F.lit(-1))
    return (
        joined.withColumn("newest", newest)
        .select(
            *panel.columns,
            F.col("newest.source_year").alias(source_year),
            *[F.col(f"newest.{v}").alias(v) for v in values],
        )
    )


def yearly_fill(
    panel: DataFrame, annual: DataFrame, site: str, year: str, value: str, source_year: str
) -> DataFrame:
    """Annual value of the panel's own years, carried forward over years without one."""
    keys = panel.select(site, year).distinct()
    known = keys.join(annual.select(site, year, value), [site, year], "left").withColumn(
        "known_year", F.when(F.col(value).isNotNull(), F.col(year))
    )
    w = over_panel(site, year)
    filled = known.select(
        site, year, forward_fill(value, w).alias(value), forward_fill("known_year", w).alias(source_year)
    )
    return panel.join(filled, [site, year], "left")


def zero_filled(panel: DataFrame, counts: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    joined = panel.join(counts, on, "left")
    return joined.select(
        *panel.columns, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in columns]
    )


def coarse_to_weeks(weeks: DataFrame, coarse: DataFrame, site: str, period: str, midpoint: Column) -> DataFrame:
    """Attach monthly or yearly values to the weeks whose midpoint falls in the period."""
    return weeks.withColumn(period, midpoint).join(coarse, [site, period], "inner")


def enrich(panel: DataFrame, sources: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left-join named sources; per source a presence flag, and the number of sources present."""
    flags = []
    for name, (table, on) in sources.items():
        features = [c for c in table.columns if c not in on]
        panel = panel.join(table, list(on), "left").withColumn(
            f"has_{name}", any_present([F.col(c) for c in features]).cast("int")
        )
        flags.append(F.col(f"has_{name}"))
    return panel.withColumn("sources_present_count", sum(flags[1:], flags[0]))


def key_difference(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, found in one aggregate over both sides."""
    sides = expected.select(*keys, F.lit(1).alias("wanted"), F.lit(0).alias("seen")).unionByName(
        present.select(*keys, F.lit(0).alias("wanted"), F.lit(1).alias("seen"))
    )
    flags = sides.groupBy(*keys).agg(F.max("wanted").alias("wanted"), F.max("seen").alias("seen"))
    return flags.where("wanted <> seen").select(
        *keys, F.when(F.col("seen") == 0, "missing").otherwise("unexpected").alias("difference")
    )


def reference_effect(
    results: DataFrame, on: Sequence[str], variant: str, reference: str, metric: str, kind: str
) -> DataFrame:
    """Effect of each variant against the reference variant of the same keys.

    For ``add`` comparisons an improvement is reference minus variant, for
    ``remove`` comparisons variant minus reference; the percentage is NULL when
    the reference is 0.
    """
    base = results.where(F.col(variant) == reference).select(
        *on, F.col(metric).alias(f"reference_{metric}")
    )
    joined = results.where(F.col(variant) != reference).join(base, list(on), "left")
    gain = F.col(f"reference_{metric}") - F.col(metric)
    effect = F.when(F.col(kind) == "add", gain).otherwise(-gain)
    share = F.when(F.col(f"reference_{metric}") != 0, effect / F.col(f"reference_{metric}") * 100.0)
    return joined.withColumn("effect", effect).withColumn("effect_pct", share)


def climatology_anomaly(panel: DataFrame, climatology: DataFrame, month: str, columns: Sequence[str]) -> DataFrame:
    """Value minus the mean of its calendar month; the climatology has 12 rows."""
    norms = climatology.select(month, *[F.col(c).alias(f"{c}_norm") for c in columns])
    joined = panel.join(norms, month)
    return joined.select(
        *panel.columns, *[(F.col(c) - F.col(f"{c}_norm")).alias(f"{c}_anomaly") for c in columns]
    )


def anchored_rows(
    monthly: DataFrame, keys: Sequence[str], values: Sequence[str], last_issue_month: int = 4
) -> DataFrame:
    """Target months 2-10 with their latest issue month and last year's anchors.

    Anchors: December and the October-December mean of the year before, and the
    same month of the year before; rows lacking any of them are left out.
    """
    keys = list(keys)
    targets = monthly.where(F.col("month").between(2, 10)).withColumn(
        "issue_month", F.least(F.col("month") - 1, F.lit(last_issue_month))
    ).withColumn("lead_month", F.col("month") - F.col("issue_month"))
    before = (F.col("year") + 1).alias("year")
    december = monthly.where("month = 12").select(
        *keys, before, *[F.col(v).alias(f"{v}_anchor_prev") for v in values]
    )
    quarter = (
        monthly.where("month between 10 and 12")
        .groupBy(*keys, "year")
        .agg(F.count(F.lit(1)).alias("months"), *[F.avg(v).alias(f"{v}_anchor_q4_mean") for v in values])
        .where("months = 3")
        .select(*keys, before, *[f"{v}_anchor_q4_mean" for v in values])
    )
    same = monthly.select(
        *keys, before, "month", *[F.col(v).alias(f"{v}_same_month_last_year") for v in values]
    )
    return (
        targets.join(december, [*keys, "year"])
        .join(quarter, [*keys, "year"])
        .join(same, [*keys, "year", "month"])
    )


def constant_anchors(
    future: DataFrame, monthly: DataFrame, keys: Sequence[str], values: Sequence[str], last_year: int | Column
) -> DataFrame:
    """Anchors of the last observed year attached to every future row.

    Without keys there is one series, and its anchors are one struct.
    """
    keys = list(keys)
    last = monthly.where(F.col("year") == last_year)
    annual = last.where("month between 10 and 12").groupBy(*keys).agg(
        *[F.max(F.when(F.col("month") == 12, F.col(v))).alias(f"{v}_anchor_prev") for v in values],
        *[F.avg(v).alias(f"{v}_anchor_q4_mean") for v in values],
    )
    same = last.select(*keys, "month", *[F.col(v).alias(f"{v}_same_month_last_year") for v in values])
    if keys:
        return future.join(annual, keys).join(same, [*keys, "month"])
    attached = future.withColumn("_anchors", annual.select(F.struct("*")).scalar())
    return attached.select(*future.columns, *[F.col("_anchors")[c].alias(c) for c in annual.columns]).join(same, "month")


def prediction_truth(
    predictions: DataFrame, observed: DataFrame, on: Sequence[str], prediction: str, baseline: str, truth: str
) -> DataFrame:
    joined = predictions.join(observed, list(on), "left")
    return joined.withColumn("residual", F.col(truth) - F.col(prediction)).withColumn(
        "baseline_residual", F.col(truth) - F.col(baseline)
    )


def corridor(medium: DataFrame, high: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Band between two trajectories."""
    pair = medium.select(*on, F.col(value).alias("medium_value")).join(
        high.select(*on, F.col(value).alias("high_value")), list(on)
    )
    return pair.withColumn("band_low", F.least("medium_value", "high_value")).withColumn(
        "band_high", F.greatest("medium_value", "high_value")
    )


def resolve_names(df: DataFrame, folded: str, aliases: DataFrame, reference: DataFrame) -> DataFrame:
    """Folded name -> alias if there is one -> (code, name); unmatched rows keep NULLs.

    ``aliases``: alias, canonical (both folded); ``reference``: folded_name, code, name.
    """
    renamed = df.join(aliases, df[folded] == aliases["alias"], "left").withColumn(
        "resolved_name", F.coalesce("canonical", folded)
    )
    return renamed.join(reference, F.col("resolved_name") == reference["folded_name"], "left").drop(
        "alias", "canonical", "folded_name", "resolved_name"
    )


def feature_rows(
    dynamic: DataFrame, static: DataFrame, on: str, features: Sequence[str], categorical: Sequence[str] = ()
) -> DataFrame:
    """Model inputs: the dynamic column where present, else the static one of that name.

    Missing numbers stay NULL for the imputer; categories become text with the
    missing marker. Sites lacking either side are left out.
    """
    from biotope.functions.text import fill_category

    ids = [c for c in dynamic.columns if c not in features]
    side = static.select(on, *[F.col(c).alias(f"static_{c}") for c in static.columns if c in features])
    joined = dynamic.join(side, on)

    def pick(name: str) -> Column:
        found = [F.col(c) for c in (name, f"static_{name}") if c in joined.columns]
        value = F.coalesce(*found)
        return fill_category(value.cast("string")) if name in categorical else value.cast("double")

    return joined.select(*ids, *[pick(f).alias(f) for f in features])


def target_join(base: DataFrame, targets: DataFrame, on: Sequence[str], target: str) -> DataFrame:
    """Left one-to-one join of the targets; rows without one are flagged, not dropped."""
    return base.join(targets, list(on), "left").withColumn("target_missing", F.col(target).isNull())


def inner_targets(base: DataFrame, targets: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a target, and the rows dropped for lack of one."""
    return base.join(targets, list(on), "inner"), base.join(targets, list(on), "left_anti")


def outer_merge(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of per-variable frames on their shared keys."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.join(frame, list(on), "full_outer")
    return merged


def template_values(
    template: DataFrame, values: DataFrame, on: Sequence[str], flag: str, name: str = "ready"
) -> DataFrame:
    """Extracted values on the template rows; readiness is false where nothing was extracted."""
    joined = template.join(values, list(on), "left")
    return joined.withColumn(name, F.coalesce(flag, F.lit(False))).drop(flag)


def current_and_previous(
    weeks: DataFrame, static: DataFrame, site: str, period: str, columns: Sequence[str]
) -> DataFrame:
    """Weeks with the calendar week before and the static columns; sites lacking either are left out."""
    before = weeks.select(
        site, F.date_add(period, 7).alias(period), *[F.col(c).alias(f"previous_{c}") for c in columns]
    )
    return weeks.join(before, [site, period]).join(static, site)


def boundaries_with_values(outlines: DataFrame, values: DataFrame, site: str, level: Column) -> DataFrame:
    """Outlines of the sites that have a value, with its level."""
    return outlines.join(values, site).withColumn("level", level)
