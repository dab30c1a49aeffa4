"""Cross-tabulated matrices: deprivation in rows, groups in columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens import reference_values as fixed
from uptakelens.functions import counts, text
from uptakelens.functions.sql import aliased, listed, literal, name
from uptakelens.operators.rate_tables import with_rates
from uptakelens.settings import DEFAULT, Settings


def rate_matrix(rate_rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Population, events and percent by quintile, one column per broad group.

    One row per age group, sex and quintile, so one pass makes every matrix. The percent
    is formed on the long table; a group missing from a row is NULL there. The columns are
    the settings' groups and, behind them, any further group of their register mapping but the
    one that stands for an unstated label.
    """
    groups = matrix_groups(settings)
    rows = rate_rows.filter(f"broad_group IS NOT NULL AND sex IN ({listed(settings.sexes)})")
    measures = [F.expr(f"first({m}) AS {m}") for m in ("population", "events", "percent")]
    wide = (
        rows.groupBy("age_group", "sex", "imd_quintile")
        .pivot("broad_group", groups)
        .agg(*measures)
    )
    file_name = text.file_name(fixed.RATE_MATRIX_NAME, "age_group", "sex")
    return wide.selectExpr("*", f"{file_name} AS file_name")


def matrix_groups(settings: Settings = DEFAULT) -> list[str]:
    """Columns of the rate matrix."""
    unstated = {
        group
        for group, members in settings.register_broad_groups.items()
        if settings.not_stated in members
    }
    further = [g for g in settings.register_broad_groups if g not in unstated]
    return [*dict.fromkeys([*settings.matrix_broad_groups, *further])]


def gap_matrix(
    level_rows: DataFrame, by_sex: bool = True, settings: Settings = DEFAULT
) -> DataFrame:
    """Gap by quintile, one column per label in the given order, 0 where there is none.

    `level_rows` are one level of the gap table. Rows without a label take no part. Unless
    the settings say otherwise, a matrix (of an age group, and a sex if `by_sex`) that lacks
    one of the labels in all its rows is an error.
    """
    order = list(settings.matrix_labels)
    rows = level_rows.filter("label IS NOT NULL")
    keys, who, each = ["age_group", "imd_quintile"], literal(fixed.BOTH_SEXES), ["age_group"]
    if by_sex:
        rows = rows.filter(f"sex IN ({listed(settings.sexes)})")
        keys, who, each = ["age_group", "sex", "imd_quintile"], "sex", ["age_group", "sex"]
    wide = rows.groupBy(*keys).pivot("label", order).agg(F.expr("sum(gap)"))
    if settings.require_matrix_labels:
        wide = complete_matrices(wide, each, order)
    filled = {label: f"CAST(coalesce({name(label)}, 0) AS BIGINT)" for label in order}
    file_name = text.file_name(fixed.GAP_MATRIX_NAME, "age_group", who)
    return wide.selectExpr(*keys, *aliased(filled), f"{file_name} AS file_name")


def complete_matrices(wide: DataFrame, each: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows, or an error when they are read if a matrix has a label in none of its rows."""
    over = f"PARTITION BY {', '.join(each)}"  # a matrix has a row per quintile
    checks = {}
    for label in order:
        said = literal(f"no rows for the label {label} in the matrix of ")
        error = f"raise_error(concat({said}, concat_ws(', ', {', '.join(each)})))"
        column = name(label)
        checks[label] = f"IF(max({column}) OVER ({over}) IS NULL, CAST({error} AS BIGINT), {column})"
    kept = [name(c) for c in wide.columns if c not in checks]
    return wide.selectExpr(*kept, *aliased(checks))


def suppressed_matrix(matrix: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The matrix as displayed, small numbers hidden."""
    below, shown_as = settings.small_number, settings.small_number_text
    shown = {
        c: counts.suppressed_text(name(c), below, shown_as)
        if c in settings.matrix_labels
        else name(c)
        for c in matrix.columns
    }
    return matrix.selectExpr(*aliased(shown))


def gap_margins(
    level_rows: DataFrame, by_sex: bool = True, settings: Settings = DEFAULT
) -> DataFrame:
    """Cells, row totals, column totals and grand total of each gap matrix, over the labels that
    are its columns. `margin` names the kind of row."""
    keys = ["age_group", "sex"] if by_sex else ["age_group"]
    rows = level_rows.filter(f"label IN ({listed(settings.matrix_labels)})")
    if by_sex:
        rows = rows.filter(f"sex IN ({listed(settings.sexes)})")
    return _margins(rows, keys, "imd_quintile", "label", ["gap"])


def _margins(
    rows: DataFrame, keys: Sequence[str], row: str, column: str, measures: Sequence[str]
) -> DataFrame:
    """Sums by cell, row, column and altogether for every combination of keys."""
    sets = [[*keys, row, column], [*keys, row], [*keys, column], [*keys]]
    sums = rows.groupingSets(sets, *keys, row, column).agg(
        F.expr(
            f"CASE WHEN grouping({row}) + grouping({column}) = 0 THEN 'cell' "
            f"WHEN grouping({row}) = 0 THEN 'row' "
            f"WHEN grouping({column}) = 0 THEN 'column' ELSE 'all' END AS margin"
        ),
        *(F.expr(f"sum({m}) AS {m}") for m in measures),
    )
    return sums.select("margin", *keys, row, column, *measures)


def matrix_margins(rate_rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Cells, row totals, column totals and grand total of each rate matrix, with limits.

    Every total is a ratio of sums. `margin` names the kind of row.
    """
    rows = rate_rows.filter("broad_group IS NOT NULL")
    keys, measures = ["age_group", "sex"], ["events", "population"]
    sums = _margins(rows, keys, "imd_quintile", "broad_group", measures)
    return with_rates(sums, **settings.rate_options)
