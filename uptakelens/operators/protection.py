"""Tables that show their totals and still keep small numbers hidden.

Hiding a small cell is no use if its row's total and the row's other cells are shown. Here every
hidden entry gets company: the corners of a box. A box is spanned by the entry and one other
place in each dimension, totals being places too; its corners can all change together without any
total changing that is outside it. If the corners that would have to fall are at least `leeway`,
the hidden entry may as well be that much larger, and nobody who sees the rest can tell. All
corners of one box protect each other, so the boxes of all small entries together leave nothing
open, whatever else is hidden, and no second round is needed.

Of the boxes that will do, the one that hides the least is taken (small entries, hidden anyway,
count as nothing; on equal sums the first place by name). There always is one: where all other
places are totals, every corner rises.

Small and other hidden entries carry one mark: told apart, each would give a bound away.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens import reference_values as fixed
from uptakelens.functions import text
from uptakelens.functions.sql import aliased, listed, literal, name
from uptakelens.settings import DEFAULT, Settings

#: Coordinate of a total; that of a value is the value behind a sign.
TOTAL = ""
SIGN = "="

#: Values of a dimension that every table has, whether found in it or not.
Known = Mapping[str, Sequence[str]]


def coordinate(column: str) -> str:
    """Place of a value along its dimension; a missing value is a place of its own."""
    return f"coalesce(concat('{SIGN}', CAST({name(column)} AS STRING)), 'NULL')"


def _subsets(dims: Sequence[str]) -> list[list[str]]:
    return [list(c) for n in range(len(dims), -1, -1) for c in combinations(dims, n)]


def _all_of(rows: DataFrame, lists: dict[str, str]) -> DataFrame:
    """A row for every choice of one element of each array; arrays go, elements come."""
    for column, values in lists.items():
        rows = rows.selectExpr("*", f"explode({values}) AS {name(column)}")
    return rows


def places(
    rows: DataFrame, keys: Sequence[str], dims: Sequence[str], known: Known = MappingProxyType({})
) -> DataFrame:
    """The places along each dimension that a table (a combination of keys) has, found or known,
    as arrays `<dim>_places`. They are as many as the vocabularies have entries."""
    sets = {}
    for d in dims:
        given = ", ".join(literal(SIGN + value) for value in known.get(d, ()))
        found = f"collect_set({coordinate(d)})"
        sets[f"{d}_places"] = f"array_union({found}, array({given}))" if given else found
    return rows.groupBy(*keys).agg(*(F.expr(e).alias(c) for c, e in sets.items()))


def with_totals(
    rows: DataFrame,
    keys: Sequence[str],
    dims: Sequence[str],
    measure: str,
    known: Known = MappingProxyType({}),
) -> DataFrame:
    """Every combination of a table's places with its `value`, absent ones as 0, and totals over
    each choice of dimensions. Dimensions become coordinates."""
    grid = _all_of(places(rows, keys, dims, known), {d: f"{d}_places" for d in dims})
    columns = [name(c) for c in (*keys, *dims)]
    own = {d: coordinate(d) for d in dims}
    given = rows.selectExpr(*(name(k) for k in keys), *aliased(own), f"{name(measure)} AS value")
    cells = grid.selectExpr(*columns, "0L AS value").union(given)
    sums = cells.groupingSets([[*keys, *s] for s in _subsets(dims)], *keys, *dims).agg(
        F.expr("sum(value) AS value"),
        *(F.expr(f"IF(grouping({name(d)}) = 1, '{TOTAL}', {name(d)}) AS at_{i}") for i, d in enumerate(dims)),
    )
    return sums.selectExpr(*(name(k) for k in keys), *(f"at_{i} AS {name(d)}" for i, d in enumerate(dims)), "value")


def _corners(dims: Sequence[str]) -> list[str]:
    """For a row with a place and another one (`other_<dim>`) per dimension: all corners but the
    place itself, as columns `corner_<dim>` and `rises`."""
    bit = [f"shiftright(mask, {i}) & 1" for i in range(len(dims))]
    at = {f"corner_{d}": f"IF({bit[i]} = 1, other_{d}, {name(d)})" for i, d in enumerate(dims)}
    totals = [f"CAST({x} = '{TOTAL}' AS INT)" for d in dims for x in (name(d), at[f"corner_{d}"])]
    return [*aliased(at), f"({' + '.join(totals)} + bit_count(mask)) % 2 = 0 AS rises"]


def _masks(dims: Sequence[str]) -> str:
    return f"explode(sequence(1, {2 ** len(dims) - 1})) AS mask"


def hidden(
    entries: DataFrame, keys: Sequence[str], dims: Sequence[str], below: int, leeway: int
) -> DataFrame:
    """Keys and coordinates of the entries to hide, each once."""
    place = [name(c) for c in (*keys, *dims)]
    other = [f"other_{d}" for d in dims]
    small = entries.filter(f"value < {int(below)}").selectExpr(*place)
    lists = entries.groupBy(*keys).agg(*(F.array_sort(F.collect_set(d)).alias(f"{d}_all") for d in dims))
    others = {f"other_{d}": f"filter({d}_all, x -> x <> {name(d)})" for d in dims}
    boxes = _all_of(small.join(lists, list(keys)), others).selectExpr(*place, *other)
    corners = boxes.selectExpr(*place, *other, _masks(dims))
    corners = corners.selectExpr(*place, *other, *_corners(dims))
    met = entries.withColumnsRenamed({d: f"corner_{d}" for d in dims})
    found = corners.join(met, [*keys, *(f"corner_{d}" for d in dims)])
    boxes = found.groupBy(*keys, *dims, *other).agg(
        F.expr(f"sum(IF(value < {int(below)}, 0L, value)) AS hides"),
        F.expr(f"bool_and(rises OR value >= {int(leeway)}) AS holds"),
    )
    best = boxes.filter("holds").groupBy(*keys, *dims).agg(
        F.expr(f"min(struct(hides, {', '.join(other)})) AS box")
    )
    chosen = best.selectExpr(*place, *(f"box.{c} AS {c}" for c in other), _masks(dims))
    company = chosen.selectExpr(*(name(k) for k in keys), *_corners(dims)).drop("rises")
    return small.union(company).distinct()


def protected(
    rows: DataFrame,
    keys: Sequence[str],
    dims: Sequence[str],
    measure: str,
    settings: Settings = DEFAULT,
    leeway: int | None = None,
    known: Known = MappingProxyType({}),
) -> DataFrame:
    """Keys, dims as coordinates, `value` and `is_hidden` for every entry, totals included.

    `leeway` is by how much a hidden entry may be larger for all that is shown; by default the
    threshold of small numbers, so that none is known to be small.
    """
    below = settings.small_number
    entries = with_totals(rows, keys, dims, measure, known)
    gone = hidden(entries, keys, dims, below, below if leeway is None else leeway)
    marked = gone.selectExpr(*(name(c) for c in (*keys, *dims)), "true AS gone")
    return entries.join(marked, [*keys, *dims], "left").selectExpr(
        *(name(c) for c in (*keys, *dims)), "value", "gone IS NOT NULL AS is_hidden"
    )


def said(column: str, total: str) -> str:
    """The value of a coordinate, or the word for the total."""
    return (
        f"CASE {name(column)} WHEN '{TOTAL}' THEN {literal(total)} WHEN 'NULL' THEN NULL"
        f" ELSE substring({name(column)}, 2) END"
    )


def protected_gaps(level_rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Gaps by age group, sex, quintile and label with all their totals, small numbers protected:
    `gap` is NULL where `is_hidden`.

    `level_rows` are the gaps by sex, label and quintile. Both sexes together are a total like
    any other, so that no matrix gives away what another hides. Totals go by the settings' word
    for everybody, and by `both` among the sexes.
    """
    order, everyone = list(settings.matrix_labels), settings.everyone
    if everyone in order or fixed.BOTH_SEXES in settings.sexes:
        raise ValueError("a label or a sex has the name of the total")
    rows = level_rows.filter(f"label IN ({listed(order)}) AND sex IN ({listed(settings.sexes)})")
    known = {"sex": settings.sexes}
    if not settings.require_matrix_labels:
        known["label"] = order
    dims = {"sex": fixed.BOTH_SEXES, "imd_quintile": everyone, "label": everyone}
    entries = protected(rows, ["age_group"], list(dims), "gap", settings, known=known)
    spoken = aliased({d: said(d, total) for d, total in dims.items()})
    return entries.selectExpr("age_group", *spoken, "IF(is_hidden, NULL, value) AS gap", "is_hidden")


def protected_gap_matrix(level_rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """`protected_gaps` as matrices of each sex and of both: one row per age group, sex and
    quintile, one column per label in the given order, and one for the total. Unless the settings
    say otherwise, an age group that lacks one of the labels is an error."""
    order, everyone = list(settings.matrix_labels), settings.everyone
    keys = ["age_group", "sex", "imd_quintile"]
    shown = f"IF(is_hidden, {literal(settings.hidden_text)}, CAST(gap AS STRING)) AS shown"
    long = protected_gaps(level_rows, settings).selectExpr(*keys, "label", shown)
    wide = long.groupBy(*keys).pivot("label", [*order, everyone]).agg(F.expr("first(shown)"))
    missing = (f"raise_error(concat({literal(f'no rows for the label {c} in ')}, age_group))" for c in order)
    columns = {c: f"coalesce({name(c)}, CAST({e} AS STRING))" for c, e in zip(order, missing, strict=True)}
    file_name = text.file_name(fixed.GAP_MATRIX_NAME, "age_group", "sex")
    return wide.selectExpr(*keys, *aliased(columns), name(everyone), f"{file_name} AS file_name")
