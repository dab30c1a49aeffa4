"""Cleaning of both inputs, on raw rows or on collapsed cells alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from uptakelens.functions import labels
from uptakelens.functions.sql import aliased
from uptakelens.settings import DEFAULT, Settings
from uptakelens.sources.areas import Areas


def replaced(rows: DataFrame, replacements: dict[str, str]) -> DataFrame:
    """Rows with the given columns set, in one projection."""
    kept = [column for column in rows.columns if column not in replacements]
    return rows.selectExpr(*kept, *aliased(replacements))


def event_label(raw: str, settings: Settings = DEFAULT) -> str:
    """Label of an event's group text, as SQL."""
    return labels.event_label(
        raw, settings.prefix_pattern, settings.group_renames, settings.capitals
    )


def with_event_labels(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Replace the event log's group text by its label and broad group."""
    label = {"label": event_label("group_raw", settings)}
    broad = labels.event_broad_group("label", settings.event_broad_groups)
    labelled = replaced(events, label).drop("group_raw")
    return labelled.selectExpr("*", f"{broad} AS broad_group")


def with_register_labels(register: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Replace the register's group text by its label and broad group."""
    label = {"label": labels.register_label("group_national", settings.group_renames)}
    broad = labels.register_broad_group("label", settings.register_broad_groups)
    labelled = replaced(register, label).drop("group_national")
    return labelled.selectExpr("*", f"{broad} AS broad_group")


def with_repaired_bands(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return replaced(rows, {"age_band": labels.repaired_band("age_band", settings.band_repairs)})


def in_areas(rows: DataFrame, areas: Areas, attributes: Sequence[str] = ()) -> DataFrame:
    """Rows of the target areas with the wanted attributes of their area, in one join. Most rows
    of other areas are screened out before they are shuffled for it."""
    located = areas.sized(areas.located.select("area", *attributes))
    return areas.screened(rows).join(located, "area")


def with_attributes(rows: DataFrame, areas: Areas, attributes: Sequence[str]) -> DataFrame:
    """Rows with the wanted attributes of their area, NULL for an area without any."""
    if not attributes:
        return rows
    return rows.join(areas.sized(areas.lookup.select("area", *attributes)), "area", "left")


def clean_events(events: DataFrame, areas: Areas, settings: Settings = DEFAULT) -> DataFrame:
    """Row-level cleaned event log, with area attributes other than the locality."""
    attributes = [c for c in areas.attributes if c != "locality"]
    rows = with_repaired_bands(in_areas(events, areas, attributes), settings)
    return with_event_labels(rows, settings)


def clean_register(
    register: DataFrame, areas: Areas, settings: Settings = DEFAULT
) -> DataFrame:
    """Row-level cleaned register, with all area attributes."""
    rows = with_repaired_bands(in_areas(register, areas, areas.attributes), settings)
    return with_register_labels(rows, settings)
