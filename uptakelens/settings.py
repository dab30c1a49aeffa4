"""What a study may choose: mappings, vocabularies, thresholds and wording, with today's defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from uptakelens import reference_values as fixed


@dataclass(frozen=True)
class Settings:
    """One object for a whole study; every default reproduces the published analysis."""

    # Cleaning
    band_repairs: Mapping[str, str] = field(default_factory=lambda: fixed.BAND_REPAIRS)
    prefix_pattern: str = fixed.PREFIX_PATTERN
    group_renames: Mapping[str, str] = field(default_factory=lambda: fixed.GROUP_RENAMES)
    capitals: Mapping[str, str] = field(default_factory=lambda: fixed.CAPITALS)
    # Groups
    event_broad_groups: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: fixed.EVENT_BROAD_GROUPS
    )
    register_broad_groups: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: fixed.REGISTER_BROAD_GROUPS
    )
    age_groups: Mapping[str, Sequence[str]] = field(default_factory=lambda: fixed.AGE_GROUPS)
    remaining_age_group: str = fixed.REMAINING_AGE_GROUP
    age_group_order: Sequence[str] = tuple(fixed.AGE_GROUP_ORDER)
    # Who counts
    unknown_band: str = fixed.UNKNOWN_BAND
    not_stated: str = fixed.NOT_STATED
    not_known: str = fixed.NOT_KNOWN
    sexes: Sequence[str] = tuple(fixed.SEXES)
    excluded_bands: Sequence[str] = tuple(fixed.BANDS_FROM_65)
    #: Labels of the reports in their order; None takes those found among the events.
    labels: Sequence[str] | None = None
    # Statistics and disclosure control
    level: float = fixed.UPPER_LEVEL
    lower_term: str = "n_plus_1"
    #: Method of the limits: "byar", or "exact" for those of the Poisson distribution.
    limits: str = "byar"
    #: How shares are rounded, see `functions.rates.rounded`.
    rounding: str = "nearest_even"
    small_number: int = fixed.SMALL_NUMBER
    small_number_text: str = fixed.SMALL_NUMBER_TEXT
    #: Mark of every hidden entry where totals are shown, small or not.
    hidden_text: str = "*"
    # Matrices
    matrix_broad_groups: Sequence[str] = tuple(fixed.MATRIX_BROAD_GROUPS)
    matrix_labels: Sequence[str] = tuple(fixed.MATRIX_LABELS)
    #: A matrix that lacks one of its labels is an error.
    require_matrix_labels: bool = True
    # Wording
    everyone: str = fixed.EVERYONE
    ages_text: str = fixed.CAPTION_AGES
    period_text: str = fixed.CAPTION_PERIOD
    #: Sentences with {label}, {ages} and {period}; that for everybody has no label.
    group_caption: str = fixed.GROUP_CAPTION
    everyone_caption: str = fixed.EVERYONE_CAPTION

    @property
    def rate_options(self) -> dict[str, float | str]:
        """What `rate_tables.with_rates` takes."""
        return {"level": self.level, "lower_term": self.lower_term, "limits": self.limits}


DEFAULT = Settings()
