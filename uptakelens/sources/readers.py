"""Reading event extracts, registers and lookups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import types as T

from uptakelens import reference_values as fixed
from uptakelens.functions.sql import literal, name
from uptakelens.sources import schemas, writers


@dataclass(frozen=True)
class Quarantine:
    """Where rows that can't be read go, and the share of them above which the read fails."""

    folder: str
    most: float = 0.001


def read_csv_na(
    spark: SparkSession, path: str, schema: T.StructType, quarantine: Quarantine | None = None
) -> DataFrame:
    """Columns of `schema` from CSV with a header, in any order; NA is missing.

    The files of a folder must have one header: it is checked in each of them, and a file
    with other columns, or in another order, fails the read.

    Further columns of the file, such as a row number, are not parsed. A value that does
    not fit its declared type fails the read: silently turning it into NULL would change
    counts. A quoted empty text stays empty, an unquoted one is NULL.

    With a quarantine, such rows, and those with too few or too many values, are set aside as
    they stand in the file, see `set_aside`, and the others are returned.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [field.name for field in schema if field.name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    declared = {field.name: field.dataType for field in schema}
    in_file_order = T.StructType(
        [T.StructField(c, declared.get(c, T.StringType())) for c in header]
    )
    reader = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", "NA")
        .option("emptyValue", "")
    )
    if quarantine is not None:
        return set_aside(spark, reader, path, in_file_order, schema.fieldNames(), quarantine)
    rows = reader.schema(in_file_order).option("mode", "FAILFAST").csv(path)
    return rows.select(*schema.fieldNames())


def set_aside(
    spark: SparkSession,
    reader: DataFrameReader,
    path: str,
    in_file_order: T.StructType,
    columns: Sequence[str],
    quarantine: Quarantine,
) -> DataFrame:
    """The columns of the rows that can be read; the others are in the quarantine's folder, as
    `record` with the `file` they stand in.

    The files are parsed once, into the shared folder, readable and unreadable rows apart; the
    share of the latter is known from that. Above the quarantine's the read fails, with the rows
    in the folder to look at. The folder gathers the rows of all reads.
    """
    names = {f.name.lower() for f in in_file_order}
    record, file, bad = (_unused(n, names) for n in ("record", "file", "is_bad"))
    with_record = T.StructType([*in_file_order, T.StructField(record, T.StringType())])
    parsed = (
        reader.schema(with_record)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", record)
        .option("columnPruning", False)  # else values of columns that aren't needed aren't counted
        .csv(path)
    )
    own = [name(c) for c in columns]
    staged = writers.load_once(
        spark,
        parsed.selectExpr(*own, record, f"_metadata.file_path AS {file}", f"{record} IS NOT NULL AS {bad}"),
        "parsed",
        partition_by=[bad],
    )
    sizes = dict(staged.groupBy(bad).count().collect())
    unread, total = sizes.get(True, 0), sum(sizes.values())
    if unread:
        aside = staged.filter(bad).selectExpr(f"{record} AS record", f"{file} AS file")
        aside.write.mode("append").parquet(quarantine.folder)
    if unread > quarantine.most * total:
        raise ValueError(
            f"{unread} of {total} rows of {path} can't be read, which is more than"
            f" {quarantine.most:%}; they are in {quarantine.folder}"
        )
    return staged.filter(f"NOT {bad}").selectExpr(*own)


def _unused(wanted: str, names: Iterable[str]) -> str:
    while wanted in names:
        wanted += "_"
    return wanted


def read_events(
    spark: SparkSession, path: str, quarantine: Quarantine | None = None
) -> DataFrame:
    rows = read_csv_na(spark, path, schemas.EVENTS, quarantine)
    return rows.withColumnsRenamed(schemas.EVENT_NAMES)


def read_register(
    spark: SparkSession, path: str, quarantine: Quarantine | None = None
) -> DataFrame:
    rows = read_csv_na(spark, path, schemas.REGISTER, quarantine)
    return rows.withColumnsRenamed(schemas.REGISTER_NAMES)


def read_lookup(
    spark: SparkSession, path: str, quarantine: Quarantine | None = None
) -> DataFrame:
    rows = read_csv_na(spark, path, schemas.AREA_LOOKUP, quarantine)
    return rows.withColumnsRenamed(schemas.LOOKUP_NAMES)


def jdbc_options(
    url: str,
    view: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options for a parallel read of a database view, split on a date or number column."""
    return {
        "url": url,
        "dbtable": view,
        "partitionColumn": partition_column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
        "pushDownPredicate": "true",
    }


def read_view(
    spark: SparkSession, properties: Mapping[str, str] | None = None, **options
) -> DataFrame:
    """A database view; `options` are those of `jdbc_options`, `properties` the driver's."""
    reader = spark.read.format("jdbc").options(**jdbc_options(**options))
    return reader.options(**(properties or {})).load()


def extract_events(
    events: DataFrame,
    date_column: str = "vaccination_date",
    start: str = fixed.PERIOD_START,
    end: str = fixed.PERIOD_END,
    columns: Sequence[str] = tuple(schemas.EXTRACT_COLUMNS),
    period_label: str = fixed.PERIOD_LABEL,
) -> DataFrame:
    """Rows with start <= date < end, the listed columns, and the period as a constant."""
    rows = in_window(events, date_column, start, end)
    return rows.selectExpr(*columns, f"{literal(period_label)} AS time_period")


def in_window(events: DataFrame, date_column: str, start: str, end: str) -> DataFrame:
    """Rows with start <= date < end. Comparison with a date turns the literal, not the
    column, into a timestamp, so the filter reaches the scan."""
    low, high = (dt.date.fromisoformat(day).isoformat() for day in (start, end))
    return events.filter(f"{date_column} >= DATE'{low}' AND {date_column} < DATE'{high}'")
