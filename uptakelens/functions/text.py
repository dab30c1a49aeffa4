"""Display text."""

from __future__ import annotations

from collections.abc import Mapping

from uptakelens import reference_values as fixed
from uptakelens.functions.sql import literal


def number_text(value: str) -> str:
    """A number without a trailing .0, and NA for a missing one."""
    pattern = literal(r"\.0$")
    return f"coalesce(regexp_replace(CAST({value} AS STRING), {pattern}, ''), 'NA')"


def thousands(value: str) -> str:
    """A count with thousands separators."""
    return f"format_number({value}, 0)"


def median_text(medians: Mapping[str, str]) -> str:
    """The medians (expressions by sex), each after the sex's initial, or after its name where
    initials don't tell the sexes apart."""
    initials = {sex: sex[:1] for sex in medians}
    told = initials if len(set(initials.values())) == len(medians) else {sex: sex for sex in medians}
    parts = (f"concat({literal(told[sex] + ':')}, {number_text(m)})" for sex, m in medians.items())
    return f"concat_ws(' | ', {', '.join(parts)})"


def part_of_text(part: str, whole: str) -> str:
    return f"concat_ws(' ', {number_text(part)}, 'of', {number_text(whole)})"


def slug(value: str) -> str:
    """File-name form of a label."""
    return f"replace({value}, ' ', '-')"


def file_name(pattern: str, *values: str) -> str:
    return f"format_string({literal(pattern)}, {', '.join(values)})"


def caption(
    label: str,
    is_everyone: str,
    ages: str = fixed.CAPTION_AGES,
    period: str = fixed.CAPTION_PERIOD,
    of_group: str = fixed.GROUP_CAPTION,
    of_everyone: str = fixed.EVERYONE_CAPTION,
) -> str:
    """Title of one label's area layer, or of the one for everybody. The sentences name the
    places of label, ages and period in braces."""
    pieces = of_group.format(label="\0", ages=ages, period=period).split("\0")
    filled = f", {label}, ".join(literal(piece) for piece in pieces)
    everyone = of_everyone.format(ages=ages, period=period)
    return f"CASE WHEN {is_everyone} THEN {literal(everyone)} ELSE concat({filled}) END"
