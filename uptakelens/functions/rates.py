"""Proportions, confidence limits and rounding."""

from __future__ import annotations

from statistics import NormalDist

from uptakelens import reference_values as fixed
from uptakelens.functions.sql import literal


def normal_quantile(level: float = fixed.UPPER_LEVEL) -> float:
    """Standard normal quantile, a constant of the query."""
    return NormalDist().inv_cdf(level)


def proportion(events: str, population: str) -> str:
    """events / population, NULL when there is no population."""
    return f"try_divide({events}, {population})"


def percent(events: str, population: str) -> str:
    return f"100 * {proportion(events, population)}"


ROUNDINGS = ("nearest_even", "half_up")


def rounded(value: str, digits: int, rounding: str = "nearest_even") -> str:
    """The value rounded to so many decimals.

    `nearest_even`, as the published analysis rounds: of the two decimals around the value, the
    one that is nearer to it as a double, of equally near ones the even one. `half_up` takes the
    value as it is written, and ties away from zero.
    """
    if rounding not in ROUNDINGS:
        raise ValueError(f"rounding must be one of {ROUNDINGS}, not {rounding!r}")
    if rounding == "half_up":
        return f"round({value}, {digits})"
    power = literal(float(10**digits))
    size = f"abs(CAST({value} AS DOUBLE))"
    below, above = (f"({side}({power} * {size}) / {power})" for side in ("floor", "ceil"))
    down, up = f"({size} - {below})", f"({above} - {size})"
    even = f"floor({power} * {size}) % 2 = 0"
    near = f"sign({value}) * IF({down} < {up} OR ({down} = {up} AND {even}), {below}, {above})"
    # a greater double has no such decimals
    return f"IF({size} < {literal(1e15)} / {power}, {near}, CAST({value} AS DOUBLE))"


def _byar(count: str, sign: str, root_of: str, population: str, level: float) -> str:
    third = literal(normal_quantile(level) / 3)
    cube_root = (
        f"1 - try_divide(1D, 9 * {count}) {sign} {third} * sqrt(try_divide(1D, {root_of}))"
    )
    return f"try_divide(100 * {count} * pow({cube_root}, 3), {population})"


def byar_lower(
    events: str,
    population: str,
    level: float = fixed.UPPER_LEVEL,
    lower_term: str = "n_plus_1",
) -> str:
    """Lower limit in percent; NULL for no events or no population.

    `lower_term="n_plus_1"` takes sqrt(1 / (events + 1)), as the published analysis
    does; `"n"` takes the textbook sqrt(1 / events).
    """
    if lower_term not in ("n_plus_1", "n"):
        raise ValueError(f"lower_term must be 'n_plus_1' or 'n', not {lower_term!r}")
    root_of = f"({events} + 1)" if lower_term == "n_plus_1" else events
    return _byar(events, "-", root_of, population, level)


def byar_upper(events: str, population: str, level: float = fixed.UPPER_LEVEL) -> str:
    """Upper limit in percent; NULL for no population."""
    above = f"({events} + 1)"
    return _byar(above, "+", above, population, level)


LIMITS = ("byar", "exact")
#: Below so many events the exact limits are solved for, from there on taken from a series whose
#: first neglected term is less than a billionth of an event.
SERIES_FROM = 500
STEPS = 12


def _gamma_series(shape: str, z: float) -> str:
    """Quantile of the gamma distribution with a large shape, at the normal quantile z
    (Cornish-Fisher expansion in powers of the root of the shape)."""
    root = f"sqrt(CAST({shape} AS DOUBLE))"
    terms = [
        f"{root}",
        literal(z),
        f"{literal((z**2 - 1) / 3)} / {root}",
        f"{literal((z**3 - 7 * z) / 36)} / pow({root}, 2)",
        f"{literal(-(3 * z**4 + 7 * z**2 - 16) / 810)} / pow({root}, 3)",
        f"{literal((9 * z**5 + 256 * z**3 - 433 * z) / 38880)} / pow({root}, 4)",
        f"{literal((12 * z**6 - 243 * z**4 - 923 * z**2 + 1472) / 204120)} / pow({root}, 5)",
        f"{literal(-(3753 * z**7 + 4353 * z**5 - 289517 * z**3 - 289717 * z) / 146966400)} / pow({root}, 6)",
    ]
    return f"({root} * ({' + '.join(terms)}))"


def _gamma_solved(shape: str, z: float, above: float) -> str:
    """The point that the gamma distribution with a whole shape exceeds with probability `above`:
    Newton's method on the sum of Poisson probabilities, from the cube approximation."""
    cube = f"1 - 1D / (9 * {shape}) + {literal(z / 3)} * sqrt(1D / {shape})"
    start = f"greatest({shape} * pow({cube}, 3), 0.001D)"
    probability = "IF(k = 0, exp(-x), p.last * x / k)"
    sums = (
        f"aggregate(sequence(0L, {shape} - 1), named_struct('last', 0D, 'all', 0D),"
        f" (p, k) -> named_struct('last', {probability}, 'all', p.all + {probability}),"
        f" p -> greatest(x + (p.all - {literal(above)}) / p.last, x / 10))"
    )
    return f"aggregate(sequence(1, {STEPS}), CAST({start} AS DOUBLE), (x, i) -> {sums})"


def _gamma_quantile(shape: str, level: float) -> str:
    z = normal_quantile(level)
    whole = f"CAST({shape} AS BIGINT)"
    solved = _gamma_solved(f"least({whole}, {SERIES_FROM}L)", z, 1 - level)
    return f"IF({whole} < {SERIES_FROM}, {solved}, {_gamma_series(whole, z)})"


def exact_lower(events: str, population: str, level: float = fixed.UPPER_LEVEL) -> str:
    """Lower limit in percent by inverting the Poisson distribution: 0 for no events; NULL for no
    population."""
    quantile = _gamma_quantile(f"greatest({events}, 1)", 1 - level)
    return f"try_divide(100 * CASE WHEN {events} = 0 THEN 0D WHEN {events} > 0 THEN {quantile} END, {population})"


def exact_upper(events: str, population: str, level: float = fixed.UPPER_LEVEL) -> str:
    """Upper limit in percent by inverting the Poisson distribution; NULL for no population."""
    return f"try_divide(100 * {_gamma_quantile(f'({events} + 1)', level)}, {population})"
