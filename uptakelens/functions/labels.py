"""Cleaning and grouping of category text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from uptakelens import reference_values as fixed
from uptakelens.functions.sql import listed, literal


def recode(value: str, renames: Mapping[str, str]) -> str:
    """Replace the listed values; every other value, and NULL, stays as it is."""
    whens = " ".join(f"WHEN {literal(old)} THEN {literal(new)}" for old, new in renames.items())
    return f"CASE {value} {whens} ELSE {value} END"


def grouped(value: str, groups: Mapping[str, Iterable[str]], other: str | None = None) -> str:
    """Name of the group that lists the value; `other` (default NULL) if none does."""
    whens = " ".join(
        f"WHEN {value} IN ({listed(members)}) THEN {literal(group)}"
        for group, members in groups.items()
    )
    return f"CASE {whens} ELSE {literal(other)} END"


def repaired_band(band: str, repairs: Mapping[str, str] = fixed.BAND_REPAIRS) -> str:
    """Undo what a spreadsheet did to an age band."""
    return recode(band, repairs)


def event_label(
    raw: str,
    prefix: str = fixed.PREFIX_PATTERN,
    renames: Mapping[str, str] = fixed.GROUP_RENAMES,
    capitals: Mapping[str, str] = fixed.CAPITALS,
) -> str:
    """Label of an event's group text: prefix removed, renamed, then capitalised."""
    label = recode(f"regexp_replace({raw}, {literal(prefix)}, '')", renames)
    for lower, upper in capitals.items():
        label = f"replace({label}, {literal(lower)}, {literal(upper)})"
    return label


def register_label(raw: str, renames: Mapping[str, str] = fixed.GROUP_RENAMES) -> str:
    """Label of a register row's group text, which carries no prefix."""
    return recode(raw, renames)


def event_broad_group(
    label: str, groups: Mapping[str, Iterable[str]] = fixed.EVENT_BROAD_GROUPS
) -> str:
    return grouped(label, groups)


def register_broad_group(
    label: str, groups: Mapping[str, Iterable[str]] = fixed.REGISTER_BROAD_GROUPS
) -> str:
    return grouped(label, groups)


def age_group(
    band: str,
    groups: Mapping[str, Iterable[str]] = fixed.AGE_GROUPS,
    remaining: str = fixed.REMAINING_AGE_GROUP,
) -> str:
    """Age group of a band; an unlisted band, also NULL, is in the remaining group."""
    return grouped(band, groups, other=remaining)


def position(value: str, order: Iterable[str]) -> str:
    """1-based place of the value in a fixed order, NULL when it is not listed."""
    return f"CAST(NULLIF(array_position(array({listed(order)}), {value}), 0) AS INT)"


def not_in(value: str, excluded: Iterable[str]) -> str:
    """True for every value outside the list, and for NULL, which SQL would drop."""
    return f"({value} IS NULL OR {value} NOT IN ({listed(excluded)}))"
