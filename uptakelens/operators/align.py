"""Bringing events and population together on shared keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.functions import labels
from uptakelens.functions.sql import listed, literal
from uptakelens.settings import DEFAULT, Settings


def known(keys: Sequence[str], settings: Settings = DEFAULT) -> str:
    """Cells the rates are about, as far as the keys tell: a known band, one of the two
    sexes, a stated group, an area with a quintile."""
    tests = {
        "age_band": f"age_band <> {literal(settings.unknown_band)}",
        "sex": f"sex IN ({listed(settings.sexes)})",
        "label": f"label NOT IN ({listed([settings.not_stated, settings.not_known])})",
        "imd_quintile": "imd_quintile IS NOT NULL",
    }
    return " AND ".join(tests[key] for key in keys if key in tests)


def align(
    population: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    in_register: str | None = None,
    in_events: str | None = None,
    how: str = "full",
    settings: Settings = DEFAULT,
    broad_group: bool = True,
) -> DataFrame:
    """Population and events per combination of keys, 0 where a side has none.

    The result is that of summing each side per key and outer joining the sums, `full`
    or `left` from the register. Both measures add up, so it is written as one grouped
    sum over the union of the two sides: one shuffle of partial sums, no sort, and NULL
    keys of the two sides meet. `on_register` tells which cells the register has. With a
    label among the keys there is a `broad_group` too, as the register has it: NULL for
    cells found among events only. It depends on the grain of the keys, so a coarser sum that
    has it needs the fine keys first; without it (`broad_group=False`) any grain will do.

    `in_register` and `in_events` say which rows take part. Both tests are applied inside
    the sum: as filters Catalyst would push them, and the text cleaning in them, down to
    the raw rows, and a query that also derives the vocabulary would scan the events twice.
    """
    if how not in ("full", "left"):
        raise ValueError(f"how must be 'full' or 'left', not {how!r}")
    from_register = f"IF({in_register or 'true'}, true, NULL)"
    sides = population.selectExpr(
        *keys,
        "population",
        "unknown_rows",
        "CAST(NULL AS BIGINT) AS events",
        f"{from_register} AS registered",
    ).union(
        events.selectExpr(
            *keys,
            "CAST(NULL AS BIGINT) AS population",
            "CAST(NULL AS BIGINT) AS unknown_rows",
            f"IF({in_events or 'true'}, events, NULL) AS events",
            "CAST(NULL AS BOOLEAN) AS registered",
        )
    )
    cells = sides.groupBy(*keys).agg(
        F.expr("sum(IF(registered, population, NULL)) AS population"),
        F.expr("sum(IF(registered, unknown_rows, NULL)) AS unknown_rows"),
        F.expr("sum(events) AS events"),
        F.expr("max(registered) AS registered"),
    )
    present = "registered IS NOT NULL"
    if how == "full":
        present += " OR events IS NOT NULL"
    filled = [
        *keys,
        *(f"coalesce({c}, 0L) AS {c}" for c in ("population", "unknown_rows", "events")),
        "registered IS NOT NULL AS on_register",
    ]
    if "label" in keys and broad_group:
        broad = labels.register_broad_group("label", settings.register_broad_groups)
        filled.append(f"CASE WHEN registered THEN {broad} END AS broad_group")
    return cells.filter(present).selectExpr(*filled)
