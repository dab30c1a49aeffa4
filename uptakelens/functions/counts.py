"""Gaps, disclosure control and sums that respect missing values."""

from __future__ import annotations

from uptakelens import reference_values as fixed
from uptakelens.functions.sql import literal


def clamped(value: str, null_as_zero: bool) -> str:
    """Never below zero. NULL becomes 0 or stays NULL, as asked."""
    if null_as_zero:
        return f"greatest({value}, 0L)"  # greatest() skips NULL
    return f"CASE WHEN {value} < 0 THEN 0L ELSE {value} END"


def suppressed(value: str, below: int = fixed.SMALL_NUMBER) -> str:
    """Values under the threshold become 0; NULL stays NULL."""
    return f"CASE WHEN {value} < {below} THEN 0L ELSE {value} END"


def suppressed_text(
    value: str, below: int = fixed.SMALL_NUMBER, text: str = fixed.SMALL_NUMBER_TEXT
) -> str:
    """Display text of a count, with small ones hidden."""
    return f"CASE WHEN {value} < {below} THEN {literal(text)} ELSE CAST({value} AS STRING) END"


def complete_sum(value: str, over: str = "") -> str:
    """Sum that is NULL as soon as one value is; `over` makes it a window's."""
    whole = f" OVER ({over})" if over else ""
    return (
        f"CASE WHEN count({value}){whole} = count(1){whole} THEN sum({value}){whole} END"
    )
