"""Rates, weights, labels and ordered rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Experiment -> scenario family.
SCENARIO_FAMILIES = {
    "historical": "historical",
    "rcp_4_5": "medium_emissions",
    "ssp2_4_5": "medium_emissions",
    "rcp_8_5": "high_emissions",
    "ssp5_8_5": "high_emissions",
}

# Notes of a forecast row by what could be extracted for it.
NOTE_FULL = (
    "Numeric forecast extraction succeeded for the operational monthly-stats weather block. "
    "The deeper soil temperature and soil-water layers are not provided by this CDS monthly dataset."
)
NOTE_TEMPERATURE_ONLY = (
    "Numeric extraction is available for temperature-only backtest support rows. "
    "The other forecast families are not present for these historical rows in the current archive."
)
NOTE_NOT_READY = "No numeric forecast extraction was available for this row."


def per_100k(cases: Column, population: Column) -> Column:
    return F.when(population > 0, cases / population * 100000.0)


def weight(value: Column, transform: str = "identity") -> Column:
    """Transformed weight; NULL marks one that is not positive and finite."""
    if transform == "log1p":
        w = F.when(value >= 0, F.log1p(value))
    elif transform == "expm1":
        w = F.expm1(value)
    elif transform == "identity":
        w = value.cast("double")
    else:
        raise ValueError(f"unknown weight transform: {transform}")
    return F.when((w > 0) & (w < float("inf")), w)


def level(value: Column, low: Column, medium: Column) -> Column:
    return F.when(value < low, "Low").when(value < medium, "Medium").otherwise("High")


def trend_label(delta: Column) -> Column:
    """Signed change in points against the week before."""
    # The label texts.
    return (
        F.when(delta > 0, F.format_string("+%d točk glede na prejšnji teden", delta))
        .when(delta < 0, F.format_string("%d točk glede na prejšnji teden", delta))
        .otherwise("brez spremembe glede na prejšnji teden")
    )


# Coverage cuts (percent), helpful-fold cut (percent) and label names.
def coverage_evidence(coverage: Column, group_class: Column) -> Column:
    return (
        F.when((group_class == "core") & (coverage >= 95.0), "national_coverage")
        .when(coverage < 10.0, "exploratory_low_coverage")
        .when(coverage < 25.0, "partial_local_coverage")
        .when(coverage < 95.0, "moderate_subnational_coverage")
        .otherwise("broad_coverage")
    )


def development_signal(effect: Column, helpful: Column, group_class: Column, evidence: Column) -> Column:
    core = group_class == "core"
    stable = (effect > 0) & (helpful >= 75.0)
    return (
        F.when(core & stable, "stable_core_signal")
        .when(core & (effect > 0), "mixed_core_signal")
        .when(core, "not_stably_useful")
        .when(stable & (evidence == "exploratory_low_coverage"), "exploratory_positive_local_signal")
        .when(stable, "promising_local_signal")
        .when(effect > 0, "weak_or_mixed_local_signal")
        .otherwise("no_stable_added_value")
    )


def holdout_confirmation(development: Column, holdout: Column) -> Column:
    dev, hold = F.coalesce(development > 0, F.lit(False)), F.coalesce(holdout > 0, F.lit(False))
    return (
        F.when(dev & hold, "confirmed_on_holdout")
        .when(dev, "did_not_confirm_on_holdout")
        .when(hold, "holdout_positive_but_not_dev_stable")
        .otherwise("consistently_not_helpful")
    )


def starts(*prefixes: str):
    return lambda key: reduce(or_, [key.startswith(p) for p in prefixes])


def holds(*tokens: str):
    return lambda key: reduce(or_, [key.contains(t) for t in tokens])


def equals(*names: str):
    return lambda key: key.isin(*names)


def first_rule(key: Column, rules: Sequence[tuple], default: Column | str) -> Column:
    """Value of the first rule that matches ``key``; rules are (test, value) pairs."""
    chain = None
    for test, value in rules:
        chain = F.when(test(key), value) if chain is None else chain.when(test(key), value)
    return chain.otherwise(default)


# Feature-name tokens of the report's families, first match wins.
REPORT_FAMILY_RULES = (
    (starts("lyme_cases_", "kme_cases_"), "history"),
    (starts("week_of_year", "iso_week", "month"), "seasonality"),
    (holds("temperature", "precip", "soil_moisture", "humidity", "radiation", "wind"), "climate"),
    (holds("elevation", "slope", "aspect", "relief"), "terrain"),
    (holds("cover_pct", "clc"), "land_cover"),
    (holds("population", "obcina", "municipality"), "demography"),
)

# Column-name rules of the panel registry, first match wins.
# (test, source group, family, action, priority)
REGISTRY_RULES = (
    (equals("obcina_sifra"), "panel_index", "location_key", "group_only", "high"),
    (equals("obcina_naziv"), "panel_index", "location_label", "group_only", "low"),
    (equals("week_start", "week_end"), "panel_index", "time_index", "index_only", "low"),
    (
        equals("year", "month", "iso_year", "iso_week", "week_of_year_sin", "week_of_year_cos"),
        "pipeline", "raw_calendar_control", "replace_with_hidden_time_control", "medium",
    ),
    (
        equals("lyme_cases", "kme_cases", "tick_borne_cases_total"),
        "nijz", "current_epidemiology", "target_source_only", "high",
    ),
    (
        equals(
            "observation_days_count", "grid_cell_count", "municipality_area_m2",
            "covered_area_pct", "overlay_method", "population_total_source_year",
            "population_density_source_year", "dominant_clc_label",
            "arso_source_month_key", "obrod_source_calendar_year",
        ),
        "pipeline", "processing_metadata", "exclude_metadata", "low",
    ),
    (
        equals("has_clc_static", "has_arso_local", "has_gozdis_local", "has_obrod_local", "local_sources_present_count"),
        "pipeline", "coverage_flag", "exclude_coverage_flag", "medium",
    ),
    (
        starts("tick_activity_", "growing_degree_", "tick_favorable_"),
        "copernicus", "retired_tick_activity_proxy", "exclude_retired_tick_activity_proxy", "low",
    ),
    (equals("arso_air_temperature_mean_c"), "arso", "local_temperature", "include_local_optional", "low"),
    (equals("arso_relative_humidity_mean_pct"), "arso", "local_humidity", "include_local_optional", "low"),
    (equals("arso_precipitation_sum_mm"), "arso", "local_precipitation", "include_local_optional", "low"),
    (starts("arso_"), "arso", "local_weather", "include_local_optional", "low"),
    (
        equals("gozdis_air_temperature_mean_c", "gozdis_air_temperature_min_c", "gozdis_air_temperature_max_c"),
        "gozdis", "local_temperature", "include_local_optional", "low",
    ),
    (
        equals("gozdis_relative_humidity_mean_pct", "gozdis_relative_humidity_min_pct", "gozdis_relative_humidity_max_pct"),
        "gozdis", "local_humidity", "include_local_optional", "low",
    ),
    (equals("gozdis_precipitation_sum_mm"), "gozdis", "local_precipitation", "include_local_optional", "low"),
    (starts("gozdis_"), "gozdis", "local_weather", "include_local_optional", "low"),
    (starts("obrod_species_"), "obrod", "local_forestry_species_detail", "exclude_sparse_detail", "medium"),
    (starts("obrod_"), "obrod", "local_forestry_summary", "include_local_optional", "low"),
    (starts("elevation_"), "copernicus", "topography", "include_core_predictor", "low"),
    (
        equals("population_total", "population_density_per_km2"),
        "copernicus", "population", "include_core_predictor", "low",
    ),
    (equals("dominant_clc_code"), "copernicus", "land_cover", "include_core_predictor", "medium"),
    (
        equals(
            "dominant_clc_cover_pct", "urban_cover_pct", "agricultural_cover_pct",
            "grassland_pasture_cover_pct", "forest_cover_pct", "broad_leaved_forest_cover_pct",
            "coniferous_forest_cover_pct", "mixed_forest_cover_pct", "shrub_transitional_cover_pct",
            "open_bare_cover_pct", "wetland_cover_pct", "water_cover_pct",
        ),
        "copernicus", "land_cover", "include_core_predictor", "low",
    ),
    (starts("air_temperature_"), "copernicus", "weather_temperature", "include_core_predictor", "low"),
    (
        starts("relative_humidity_", "humidity_hours_", "humid_days_"),
        "copernicus", "weather_humidity", "include_core_predictor", "low",
    ),
    (
        starts("precipitation_", "rainy_days_", "wet_hours_"),
        "copernicus", "weather_precipitation", "include_core_predictor", "low",
    ),
    (starts("soil_temperature_", "soil_water_"), "copernicus", "weather_soil", "include_core_predictor", "low"),
)
REGISTRY_DEFAULT = ("unclassified", "review_needed", "review", "high")


# What forecasting does with a family where it differs from the interpretable action.
FORECASTING_ACTIONS = {
    "location_key": "optional_predictive_only",
    "coverage_flag": "review_missingness_proxy",
    "local_forestry_species_detail": "review_sparse_detail",
}
# The graph group of a family; local weather is grouped by its source, other families stay out.
GRAPH_GROUPS = {
    "local_weather": "local_weather_unclassified",
    "local_forestry_summary": "obrod_summary",
    "topography": "topography",
    "population": "population",
    "land_cover": "land_cover",
    "weather_temperature": "copernicus_temperature",
    "weather_humidity": "copernicus_humidity",
    "weather_precipitation": "copernicus_precipitation",
    "weather_soil": "copernicus_soil",
    "review_needed": "review_needed",
}
LOCAL_GRAPH_FACTORS = {
    "local_temperature": "temperature", "local_humidity": "humidity", "local_precipitation": "precipitation",
}
# How the weeks of a family come about; local weather differs by source.
TIME_ALIGNMENTS = {
    "location_key": "weekly_panel_index",
    "location_label": "weekly_panel_index",
    "time_index": "weekly_panel_index",
    "raw_calendar_control": "derived_from_week_index",
    "current_epidemiology": "weekly_direct",
    "processing_metadata": "mixed_support_metadata",
    "coverage_flag": "source_availability_marker",
    "retired_tick_activity_proxy": "weekly_direct_or_precomputed_history",
    "local_forestry_species_detail": "yearly_to_weekly",
    "local_forestry_summary": "yearly_to_weekly",
    "topography": "static_repeated_to_week",
    "population": "yearly_repeated_to_week",
    "land_cover": "static_repeated_to_week",
    "weather_temperature": "weekly_direct_or_precomputed_history",
    "weather_humidity": "weekly_direct_or_precomputed_history",
    "weather_precipitation": "weekly_direct_or_precomputed_history",
    "weather_soil": "weekly_direct_or_precomputed_history",
    "review_needed": "review_needed",
}
SOURCE_ALIGNMENTS = {"arso": "monthly_to_weekly", "gozdis": "weekly_local_direct"}


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def registry_flags(key: Column, rules=REGISTRY_RULES, default=REGISTRY_DEFAULT) -> dict[str, Column]:
    """Source, family, time alignment, both actions, graph group and review priority of a column name."""
    names = ("source_group", "feature_family", "feature_action", "review_priority")
    flags = {
        name: first_rule(key, [(rule[0], F.lit(rule[i + 1])) for rule in rules], F.lit(default[i]))
        for i, name in enumerate(names)
    }
    source, family = flags["source_group"], flags["feature_family"]
    local = F.concat_ws("_", source, looked_up(family, LOCAL_GRAPH_FACTORS))
    return {
        **flags,
        "forecasting_action": F.coalesce(looked_up(family, FORECASTING_ACTIONS), flags["feature_action"]),
        "graph_group": F.when(family.isin(*LOCAL_GRAPH_FACTORS), local).otherwise(
            F.coalesce(looked_up(family, GRAPH_GROUPS), F.lit("not_in_graph"))
        ),
        "time_alignment": F.coalesce(looked_up(source, SOURCE_ALIGNMENTS), looked_up(family, TIME_ALIGNMENTS)),
    }


def scenario_family(experiment: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SCENARIO_FAMILIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, experiment), experiment)


def indicator(condition: Column) -> Column:
    return condition.cast("double")


def present(columns: Iterable[Column]) -> Column:
    """1 when any of the columns has a value."""
    return reduce(or_, [c.isNotNull() for c in columns]).cast("int")


def any_present(columns: Iterable[Column]) -> Column:
    return reduce(or_, [c.isNotNull() for c in columns])


def all_present(columns: Iterable[Column]) -> Column:
    return reduce(and_, [c.isNotNull() for c in columns])


def extraction_note(core_ready: Column, temperature_ready: Column) -> Column:
    return (
        F.when(F.coalesce(core_ready, F.lit(False)), NOTE_FULL)
        .when(F.coalesce(temperature_ready, F.lit(False)), NOTE_TEMPERATURE_ONLY)
        .otherwise(NOTE_NOT_READY)
    )


def nonnegative(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))
