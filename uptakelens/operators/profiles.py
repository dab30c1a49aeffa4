"""Who was reached: ages and numbers by label and sex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.functions import text
from uptakelens.functions.sql import aliased, listed, literal, name
from uptakelens.operators.cells import labelled, summed
from uptakelens.operators.vocabulary import numbered
from uptakelens.settings import DEFAULT, Settings


def _by_sex(cells: DataFrame, settings: Settings) -> DataFrame:
    return labelled(cells.filter(f"sex IN ({listed(settings.sexes)})"), settings)


def median_by_sex(
    cells: DataFrame, strict_nulls: bool = True, settings: Settings = DEFAULT
) -> DataFrame:
    """Exact median age per label, one column per sex, the label text and the label's place.

    `cells` are counts by group, sex and age, so a group's state is its distinct ages with
    a count each, however many events it has. In strict mode a missing age makes the
    median NULL. Labels are numbered by all events, also those of other sexes.
    """
    median = "percentile(age, 0.5, events)"
    if strict_nulls:
        median = f"CASE WHEN count(age) = count(1) THEN {median} END"
    sexes = list(settings.sexes)
    wide = labelled(cells, settings).groupBy("label").pivot("sex", sexes)
    wide = wide.agg(F.expr(median).alias("median"), F.expr("sum(events)").alias("events"))
    columns = {sex: f"median_{sex.lower()}" for sex in sexes}
    named = {column: name(f"{sex}_median") for sex, column in columns.items()}
    found = " OR ".join(f"{name(f'{sex}_events')} IS NOT NULL" for sex in sexes)
    rows = numbered(wide, settings).filter(found).selectExpr("label", *aliased(named), "ord")
    told = text.median_text({sex: name(column) for sex, column in columns.items()})
    return rows.selectExpr("label", *map(name, named), f"{told} AS median_text", "ord")


def count_by_sex(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Events by label and sex, with the number as displayed and the label's place, which all
    events decide on, also those of other sexes."""
    sums = numbered(summed(labelled(cells, settings), ["label", "sex"], ["events"]), settings)
    sums = sums.filter(f"sex IN ({listed(settings.sexes)})")
    return sums.selectExpr("label", "sex", "events", f"{text.thousands('events')} AS events_text", "ord")


def age_frequency(cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Events by label, sex and known age: what any density of the ages is drawn from."""
    known_ages = _by_sex(cells.filter("age IS NOT NULL"), settings)
    return summed(known_ages, ["label", "sex", "age"], ["events"])


def age_density(
    cells: DataFrame, points: int = 512, tails: float = 0.0, settings: Settings = DEFAULT
) -> DataFrame:
    """Curves of the ages by label and sex: Gaussian kernel density at equally spaced ages.

    Everything comes from the age frequencies, so a group's state is its distinct ages. The
    bandwidth is 0.9 times the lesser of the standard deviation and the interquartile range over
    1.34, times n to the power -1/5; where that is 0, the deviation, else the age itself, else 1
    takes its place. A curve runs from the least to the greatest age, as drawn in the published
    half violins, or `tails` bandwidths further (from 3 on the area under it is practically 1).
    A group of fewer than two events has no curve. `width` is the density as a share of the
    greatest one among the curves of its sex.
    """
    n, s1, s2 = (f"CAST({x} AS DECIMAL(38, 0))" for x in ("n", "sum_age", "sum_square"))
    sd = f"sqrt(CAST(CAST({n} * {s2} AS DECIMAL(38, 0)) - CAST({s1} * {s1} AS DECIMAL(38, 0)) AS DOUBLE) / n / (n - 1))"
    spread = "least(sd, (quartiles[1] - quartiles[0]) / 1.34D)"
    scale = f"CASE WHEN {spread} > 0 THEN {spread} WHEN sd > 0 THEN sd WHEN least_age <> 0 THEN abs(least_age) ELSE 1 END"
    groups = age_frequency(cells, settings).groupBy("label", "sex").agg(
        F.expr("sum(events) AS n"),
        F.expr("sum(age * events) AS sum_age"),
        F.expr("sum(CAST(age AS BIGINT) * age * events) AS sum_square"),
        F.expr("percentile(age, array(0.25D, 0.75D), events) AS quartiles"),
        F.expr("min(age) AS least_age"),
        F.expr("max(age) AS greatest_age"),
        F.expr("array_sort(collect_list(struct(age, events))) AS ages"),
    )
    groups = groups.filter("n >= 2").selectExpr("*", f"{sd} AS sd")
    groups = groups.selectExpr("*", f"0.9D * {scale} * pow(n, -0.2D) AS bandwidth")
    reach = literal(float(tails))
    ends = [f"least_age - {reach} * bandwidth AS begin", f"greatest_age + {reach} * bandwidth AS end"]
    grid = groups.selectExpr("*", *ends).selectExpr("*", f"explode(sequence(0, {int(points) - 1})) AS point")
    grid = grid.selectExpr("*", f"begin + (end - begin) * point / {int(points) - 1} AS at_age")
    kernel = "x.events * exp(-0.5D * pow((at_age - x.age) / bandwidth, 2))"
    density = f"aggregate(ages, 0D, (total, x) -> total + {kernel}) / (n * bandwidth * sqrt(2 * pi()))"
    curves = grid.selectExpr("label", "sex", "point", "at_age", "bandwidth", f"{density} AS density")
    return curves.selectExpr("*", "density / max(density) OVER (PARTITION BY sex) AS width")
