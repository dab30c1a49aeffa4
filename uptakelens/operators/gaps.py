"""Estimated numbers not reached: population minus events, never below zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.functions import counts, labels
from uptakelens.functions.sql import literal
from uptakelens.operators.align import align
from uptakelens.operators.cells import labelled, summed
from uptakelens.operators.rate_tables import with_place
from uptakelens.operators.vocabulary import in_vocabulary
from uptakelens.settings import DEFAULT, Settings

GAP_DIMS = ("age_group", "sex", "label", "imd_quintile")

# The four roll-ups reported, by name.
GAP_LEVELS = {
    "sex_label": ("sex", "label", "age_group"),
    "sex_imd": ("sex", "imd_quintile", "age_group"),
    "sex_label_imd": ("sex", "label", "imd_quintile", "age_group"),
    "label_imd": ("label", "imd_quintile", "age_group"),
}


def gap_cells(aligned: DataFrame, dims: Sequence[str] = GAP_DIMS) -> DataFrame:
    """Events, population and gap of cells aligned on dims.

    The gap is clamped at this grain; every coarser figure is a sum of clamped gaps.
    """
    gap = counts.clamped("population - events", null_as_zero=True)
    return aligned.selectExpr(*dims, "population", "events", f"{gap} AS gap")


def gap_levels(
    cells: DataFrame,
    vocabulary: DataFrame,
    levels: dict[str, Sequence[str]] = GAP_LEVELS,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Gaps summed at every level in one pass, the level's name in the column `level`.

    Labels outside the vocabulary merge into NULL first. A column that a level does not
    have is NULL too; `level` tells the two apart. `ord` and `age_group_ord` are the places
    of label and age group in the display order.
    """
    dims = list(dict.fromkeys(c for columns in levels.values() for c in columns))
    category = {"imd_quintile": "CAST(imd_quintile AS STRING) AS imd_quintile"}
    rows = in_vocabulary(cells, vocabulary).selectExpr(*(category.get(c, c) for c in dims), "ord", "gap")
    sums = rows.groupingSets([list(level) for level in levels.values()], *dims).agg(
        F.expr("grouping_id() AS absent"),
        F.expr("IF(grouping(label) = 0, max(ord), NULL) AS ord"),
        F.expr("sum(gap) AS gap"),
    )
    # grouping_id has one bit per column, the first column's highest, set where it is absent.
    absent = {
        name: sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in level)
        for name, level in levels.items()
    }
    whens = " ".join(f"WHEN {bits} THEN {literal(name)}" for name, bits in absent.items())
    named = sums.selectExpr(f"CASE absent {whens} END AS level", *dims, "ord", "gap")
    return with_place(named, order=settings.age_group_order)


def area_gap(
    register: DataFrame,
    events: DataFrame,
    strict_nulls: bool = False,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Gap and population per area and label over the bands that are not excluded.

    `register` and `events` are cells by area, group and band. A missing band is kept and
    meets a missing band; events of a cell the register lacks are lost. In strict mode a
    missing observation makes its area's gap and total NULL.
    """
    aligned = align(
        register,
        labelled(events, settings),
        ["area", "label", "age_band"],
        in_register=f"{labels.not_in('age_band', settings.excluded_bands)} "
        f"AND label <> {literal(settings.not_known)}",
        in_events=f"label <> {literal(settings.not_stated)}",
        how="left",
        settings=settings,
    )
    sums = summed(aligned, ["area", "label"], ["population", "unknown_rows", "events"])
    total = "IF(unknown_rows = 0, population, NULL)" if strict_nulls else "population"
    gap = counts.clamped(f"({total} - events)", null_as_zero=False)
    return sums.selectExpr("area", "label", f"{gap} AS gap", f"{total} AS total")
