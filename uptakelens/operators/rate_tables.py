"""Rates with confidence limits, and the benchmark they are compared with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from uptakelens import reference_values as fixed
from uptakelens.functions import labels, rates
from uptakelens.functions.sql import aliased, literal
from uptakelens.operators.cells import summed


def with_rates(
    counts: DataFrame,
    level: float = fixed.UPPER_LEVEL,
    lower_term: str = "n_plus_1",
    limits: str = "byar",
) -> DataFrame:
    """Add proportion, percent, z and limits to `events` and `population`: Byar's, or the exact
    ones of the Poisson distribution."""
    if limits not in rates.LIMITS:
        raise ValueError(f"limits must be one of {rates.LIMITS}, not {limits!r}")
    sides = ("events", "population")
    if limits == "exact":
        lower, upper = rates.exact_lower(*sides, level), rates.exact_upper(*sides, level)
    else:
        lower, upper = rates.byar_lower(*sides, level, lower_term), rates.byar_upper(*sides, level)
    ratios = {
        "proportion": rates.proportion(*sides),
        "percent": rates.percent(*sides),
        "z": literal(rates.normal_quantile(level)),
        "lower": lower,
        "upper": upper,
    }
    return counts.selectExpr("*", *aliased(ratios))


def rate_table(aligned: DataFrame, dims: Sequence[str], **options) -> DataFrame:
    """Rates per combination of dims; sums first, ratios of the sums after."""
    return with_rates(summed(aligned, dims, ["events", "population"]), **options)


def benchmark(rate_rows: DataFrame, by: str = "age_group", **options) -> DataFrame:
    """The average to compare with: rates of the summed counts, not mean rates."""
    return rate_table(rate_rows, [by], **options)


def with_place(
    rows: DataFrame, by: str = "age_group", order: Sequence[str] = tuple(fixed.AGE_GROUP_ORDER)
) -> DataFrame:
    """Rows with the place of their age group in the display order."""
    return rows.selectExpr("*", f"{labels.position(by, order)} AS {by}_ord")


def with_benchmark(
    rate_rows: DataFrame,
    average: DataFrame,
    by: str = "age_group",
    order: Sequence[str] = tuple(fixed.AGE_GROUP_ORDER),
) -> DataFrame:
    """Rates next to the benchmark of their age group, with the age group's place."""
    average = average.selectExpr(by, "percent AS benchmark_percent")
    return with_place(rate_rows.join(average, by, "left"), by, order)
