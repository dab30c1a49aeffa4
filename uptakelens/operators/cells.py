"""Collapsing the two fact tables, the only inputs that grow, into small cells.

Everything after this module works on cells, whose number is bounded by the product of
the category counts. Partial aggregation runs before every shuffle, so one category (or
one area) holding a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.functions import labels
from uptakelens.functions.sql import aliased
from uptakelens.operators.clean import event_label, in_areas
from uptakelens.settings import DEFAULT, Settings
from uptakelens.sources.areas import Areas

REGISTER_MEASURES = ("population", "unknown_rows")


def _rows(rows: DataFrame, columns: Sequence[str], derived: dict[str, str]) -> DataFrame:
    """The columns, those in `derived` computed and the others taken as they are."""
    return rows.selectExpr(*aliased({c: derived.get(c, c) for c in columns}))


def event_rows(
    events: DataFrame, columns: Sequence[str], settings: Settings = DEFAULT
) -> DataFrame:
    """Columns of the event log, bands repaired, and `events`, 1 per row if it has none."""
    derived = {"age_band": labels.repaired_band("age_band", settings.band_repairs)}
    if "events" not in events.columns:
        derived["events"] = "1L"
    return _rows(events, [*columns, "events"], derived)


def register_rows(
    register: DataFrame, columns: Sequence[str], settings: Settings = DEFAULT
) -> DataFrame:
    """Columns of the register, labelled and repaired, and two measures that add up.

    `population` takes a missing observation as 0 and `unknown_rows` counts those, so a
    sum that must be NULL when any part is missing can be formed at every later level.
    """
    derived = {
        "age_band": labels.repaired_band("age_band", settings.band_repairs),
        "label": labels.register_label("group_national", settings.group_renames),
        "population": "CAST(coalesce(observations, 0) AS BIGINT)",
        "unknown_rows": "CAST(observations IS NULL AS BIGINT)",
    }
    return _rows(register, [*columns, *REGISTER_MEASURES], derived)


def summed(rows: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.expr(f"sum({m}) AS {m}") for m in measures])


def _own_columns(areas: Areas, by: Sequence[str]) -> list[str]:
    """The columns of `by` that the facts have themselves, and the area."""
    return [*dict.fromkeys([*(c for c in by if c not in areas.attributes), "area"])]


def _tagged(
    rows: DataFrame, areas: Areas, by: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Rows of the target areas with the columns `by`, area attributes included.

    With a small lookup the join is a broadcast and no row moves. With a large one the
    rows are screened and summed per area first, so that no raw row is shuffled by its area, and
    most of other areas not even in part of a sum.
    """
    attributes = [c for c in by if c in areas.attributes]
    if areas.broadcastable:
        return in_areas(rows, areas, attributes).select(*by, *measures)
    sums = summed(areas.screened(rows), _own_columns(areas, by), measures)
    return sums.join(areas.located.select("area", *attributes), "area").select(*by, *measures)


def event_cells(
    events: DataFrame, areas: Areas, by: Sequence[str], settings: Settings = DEFAULT
) -> DataFrame:
    """Number of events per combination of `by` in the target areas.

    `by` names raw columns (`group_raw`, not `label`): text is cleaned per cell, not per
    row. See `labelled`.
    """
    rows = event_rows(events, _own_columns(areas, by), settings)
    return summed(_tagged(rows, areas, by, ["events"]), by, ["events"])


def labelled(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Event cells with the label in place of the raw group text."""
    kept = [c for c in cells.columns if c != "group_raw"]
    return cells.selectExpr(*kept, f"{event_label('group_raw', settings)} AS label")


def register_cells(
    register: DataFrame, areas: Areas, by: Sequence[str], settings: Settings = DEFAULT
) -> DataFrame:
    """Register rows of the target areas with the columns `by`, ready to be summed."""
    rows = register_rows(register, _own_columns(areas, by), settings)
    return _tagged(rows, areas, by, REGISTER_MEASURES)


def row_count(rows: DataFrame, column: str) -> str:
    """How many rows a row stands for: the column, if there is one, else 1."""
    return column if column in rows.columns else "1L"


def _summary(
    rows: DataFrame, areas: Areas, by: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """One row per combination of `by` in the target areas, and one, with no area and nothing
    else known, for all rows of other areas."""
    if not areas.broadcastable:
        rows = areas.screened(rows, "left")
        masked = (f"IF(may_be_target, {c}, NULL) AS {c}" for c in by)
        rows = summed(rows.selectExpr(*masked, *measures), by, measures)
    flags = areas.sized(areas.located.select("area", F.lit(True).alias("is_target")))
    masked = (f"IF(is_target, {c}, NULL) AS {c}" for c in by)
    return summed(rows.join(flags, "area", "left").selectExpr(*masked, *measures), by, measures)


def event_summary(
    events: DataFrame, areas: Areas, by: Sequence[str], settings: Settings = DEFAULT
) -> DataFrame:
    """The event log with one row per combination of `by`, which has the area."""
    return _summary(event_rows(events, by, settings), areas, by, ["events"])


def register_summary(register: DataFrame, areas: Areas) -> DataFrame:
    """The register with one row per combination of its own columns.

    Rows with a missing observation stay apart from the others, so that sums which a
    missing one makes NULL come out the same from the summary. `rows` counts them.
    """
    by = ["area", "group_national", "age_band", "sex", "unknown"]
    derived = {"unknown": "observations IS NULL", "rows": row_count(register, "rows")}
    rows = _rows(register, [*by, "observations", "rows"], derived)
    return _summary(rows, areas, by, ["observations", "rows"]).drop("unknown")


def population_by(
    register: DataFrame,
    areas: Areas,
    by: Sequence[str],
    strict_nulls: bool = False,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Sum of observations; NULL when one is missing in strict mode, else over the rest."""
    sums = summed(register_cells(register, areas, by, settings), by, REGISTER_MEASURES)
    population = "IF(unknown_rows = 0, population, NULL)" if strict_nulls else "population"
    return sums.selectExpr(*by, f"{population} AS population")


def add_age_group(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    group = labels.age_group("age_band", settings.age_groups, settings.remaining_age_group)
    return rows.selectExpr("*", f"{group} AS age_group")
