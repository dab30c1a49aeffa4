"""Events kept as cells by period, so that a study over new months reads old events once.

The store has a row per combination of an event's columns and period (a month or a day) with the
number of events, partitioned by period. Cells add up: the events of any window that begins and
ends with a period are sums over its partitions, and no others are read. Areas are not tested, so
a store serves any choice of target areas.

Writing a window replaces the partitions of its periods and of no others. A period without events
is kept as a row of 0 events, which tells it apart from one that was never written; reading a
window that lacks a period is an error.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uptakelens.functions.sql import literal, name
from uptakelens.sources.readers import in_window

#: The event log's columns that a study uses.
COLUMNS = ("area", "group_raw", "age_band", "sex", "age")
PERIOD = "period"
#: How a period is written; the text sorts as time does.
UNITS = {"month": "yyyy-MM", "day": "yyyy-MM-dd"}


def _next(day: dt.date, unit: str) -> dt.date:
    if unit == "day":
        return day + dt.timedelta(days=1)
    return (day.replace(day=1) + dt.timedelta(days=31)).replace(day=1)


def periods_of(start: str, end: str, unit: str = "month") -> list[str]:
    """The periods of start <= date < end, which must begin and end with one."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}, not {unit!r}")
    day, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if unit == "month" and (day.day != 1 or last.day != 1):
        raise ValueError(f"{start} to {end} cuts a month: a store by month can't tell its days apart")
    if day >= last:
        raise ValueError(f"{start} to {end} is empty")
    out = []
    while day < last:
        out.append(day.isoformat()[: len(UNITS[unit])])
        day = _next(day, unit)
    return out


def write_periods(
    events: DataFrame,
    path: str,
    date_column: str,
    start: str,
    end: str,
    unit: str = "month",
    columns: Sequence[str] = COLUMNS,
) -> list[str]:
    """Replace the periods of the window with the events' cells; returns the periods.

    `events` has one row per event, or rows with their number in a column `events`. Only rows of
    the window are read; a hot period is summed in part by every task before it moves.
    """
    wanted = periods_of(start, end, unit)
    kept = [name(c) for c in columns]
    number = "events" if "events" in events.columns else "1L AS events"
    period = f"date_format({name(date_column)}, {literal(UNITS[unit])}) AS {PERIOD}"
    rows = in_window(events, name(date_column), start, end).selectExpr(period, *kept, number)
    cells = rows.groupBy(PERIOD, *columns).agg(F.sum("events").alias("events"))
    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    none = [f"CAST(NULL AS {types[c]}) AS {name(c)}" for c in columns]
    written = ", ".join(literal(p) for p in wanted)
    marks = events.sparkSession.range(1).selectExpr(
        f"explode(array({written})) AS {PERIOD}", *none, "0L AS events"
    )
    (
        cells.union(marks)
        .hint("rebalance", PERIOD)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PERIOD)
        .parquet(path)
    )
    return wanted


def read_periods(
    spark: SparkSession, path: str, start: str, end: str, unit: str = "month"
) -> DataFrame:
    """The events of the window as cells with their number in `events`; only its partitions are
    read."""
    wanted = periods_of(start, end, unit)
    stored = spark.read.schema(_schema(spark, path)).parquet(path)
    window = stored.filter(f"{PERIOD} >= {literal(wanted[0])} AND {PERIOD} <= {literal(wanted[-1])}")
    found = {row[0] for row in window.filter("events = 0").select(PERIOD).distinct().collect()}
    missing = [p for p in wanted if p not in found]
    if missing:
        raise ValueError(f"{path} lacks the periods {missing}")
    return window.filter("events > 0").drop(PERIOD)


def _schema(spark: SparkSession, path: str) -> T.StructType:
    """The stored schema with the period as text, which a partition's name alone would not say."""
    found = spark.read.parquet(path).schema
    fields = [f for f in found.fields if f.name != PERIOD]
    return T.StructType([*fields, T.StructField(PERIOD, T.StringType())])
