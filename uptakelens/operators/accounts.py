"""Where the rows go: how many each filter of each pipeline takes in and lets through.

The pipelines differ in their filters, and a rate says nothing about the rows that never reached
it. Everything is counted over cells, in one aggregation per input, and in the report from the
cells that it writes anyway: rows outside the target areas are kept there as one more cell. (A
metric observed beside that write would cost no scan either, but counts a shuffle stage's tasks
twice when a lost executor has them repeated.)
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.functions import labels
from uptakelens.functions.sql import aliased, listed, literal
from uptakelens.operators.align import align
from uptakelens.operators.cells import labelled, summed
from uptakelens.settings import DEFAULT, Settings
from uptakelens.sources.areas import Areas

#: Names of the tests, in the order they are applied, by pipeline and input.
RATES_BY_GROUP = ("area", "age_band", "not_stated", "not_known", "sex")
RATES_BY_IMD = ("area", "age_band", "sex", "imd_quintile")
RATES_BY_GROUP_IMD = ("area", "age_band", "not_stated", "not_known", "sex", "imd_quintile")
AGES = ("area", "sex")
PIPELINES: dict[str, dict[str, Sequence[str]]] = {
    "events": {
        "profiles": AGES,
        "rates_by_group": RATES_BY_GROUP,
        "rates_by_imd": RATES_BY_IMD,
        "rates_by_group_imd": RATES_BY_GROUP_IMD,
        "area_layer": ("area", "not_stated", "on_register"),
    },
    "register": {
        "rates_by_group": RATES_BY_GROUP,
        "rates_by_imd": RATES_BY_IMD,
        "rates_by_group_imd": RATES_BY_GROUP_IMD,
        "area_layer": ("area", "excluded_band", "not_known"),
    },
}
#: Keys that tell which cells of the register an event meets in the area layer.
AREA_CELL = ("area", "label", "age_band")


def tests(settings: Settings = DEFAULT) -> dict[str, str]:
    """What each named test lets through, as SQL over a cell."""
    return {
        "area": "is_target",
        "age_band": f"age_band <> {literal(settings.unknown_band)}",
        "not_stated": f"label <> {literal(settings.not_stated)}",
        "not_known": f"label <> {literal(settings.not_known)}",
        "sex": f"sex IN ({listed(settings.sexes)})",
        "imd_quintile": "imd_quintile IS NOT NULL",
        "excluded_band": labels.not_in("age_band", settings.excluded_bands),
        "on_register": "on_register",
    }


def marked(cells: DataFrame, areas: Areas, by: Sequence[str], measure: str) -> DataFrame:
    """Cells by area and `by` with `is_target` and the quintile; other areas' cells stay."""
    cells = summed(cells.select("area", *by, measure), ["area", *by], [measure])
    flags = areas.located.select("area", "imd_quintile", F.lit(True).alias("is_target"))
    rows = cells.join(areas.sized(flags), "area", "left")
    return rows.selectExpr("area", *by, "imd_quintile", "coalesce(is_target, false) AS is_target", measure)


def with_register(
    events: DataFrame, register: DataFrame, settings: Settings = DEFAULT
) -> DataFrame:
    """The event cells by area, label, band, target and whether the register has such a cell in
    the area layer."""
    test = tests(settings)
    ours, theirs = (
        " AND ".join(test[t] for t in PIPELINES[side]["area_layer"] if t != "on_register")
        for side in ("events", "register")
    )
    # New names: as the first side of a union, columns under their old ones would keep the plan
    # below from being the same as that of the other accounts, whose scan is to serve both.
    keys = {f"cell_{c}": c for c in (*AREA_CELL, "is_target")}
    rows = align(
        register.selectExpr(*aliased(keys), "rows AS population", "0L AS unknown_rows", f"({theirs}) AS passes"),
        events.selectExpr(*aliased(keys), "events", f"({ours}) AS passes"),
        list(keys),
        in_register="passes",
        in_events="passes",
        settings=settings,
    )
    # a cell has a row at least; its sum, unlike the flag, is that of the other accounts' scan
    return rows.selectExpr("population > 0 AS on_register", "events")


def steps(
    cells: DataFrame,
    measure: str,
    source: str,
    pipelines: Mapping[str, Sequence[str]],
    settings: Settings = DEFAULT,
) -> DataFrame:
    """A row for each test of each pipeline with the rows before and after it."""
    test = tests(settings)
    sums, rows = {"n_0": f"sum({measure})"}, []
    for pipeline, names in pipelines.items():
        before = "n_0"
        for step, name in enumerate(names, 1):
            passed = " AND ".join(f"coalesce({test[n]}, false)" for n in names[:step])
            after = f"n_{len(sums)}"
            sums[after] = f"sum(IF({passed}, {measure}, 0L))"
            rows.append(
                f"struct({literal(source)} AS input, {literal(pipeline)} AS pipeline, {step} AS step,"
                f" {literal(name)} AS test, coalesce({before}, 0L) AS rows_in, coalesce({after}, 0L) AS rows_out)"
            )
            before = after
    counted = cells.agg(*(F.expr(e).alias(c) for c, e in sums.items()))
    return counted.selectExpr(f"inline(array({', '.join(rows)}))").selectExpr(
        "*", "rows_in - rows_out AS rows_dropped"
    )


def account(
    events: DataFrame, register: DataFrame, areas: Areas, settings: Settings = DEFAULT
) -> DataFrame:
    """Rows in, out and dropped by input, pipeline and test.

    `events` are cells by area, group, band and sex with their number, `register` cells by area,
    label, band and sex with the number of `rows`; both still have the rows of other areas.
    """
    ours = labelled(marked(events, areas, ["group_raw", "age_band", "sex"], "events"), settings)
    theirs = marked(register, areas, ["label", "age_band", "sex"], "rows")
    told = {p: names for p, names in PIPELINES["events"].items() if "on_register" not in names}
    layer = {p: names for p, names in PIPELINES["events"].items() if p not in told}
    parts = [
        steps(ours, "events", "events", told, settings),
        steps(theirs, "rows", "register", PIPELINES["register"], settings),
    ]
    for pipeline, names in layer.items():
        first = steps(ours, "events", "events", {pipeline: names[:-1]}, settings)
        last = steps(with_register(ours, theirs, settings), "events", "events", {pipeline: names[-1:]}, settings)
        parts += [first, last.selectExpr("input", "pipeline", f"{len(names)} AS step", "test", "rows_in", "rows_out", "rows_dropped")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
