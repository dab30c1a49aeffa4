"""The registered queries: every operator over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from uptakelens.functions.sql import name
from uptakelens.operators import cells, clean
from uptakelens.operators.align import align
from uptakelens.plans.study import (
    AREA_KEYS,
    GROUP_IMD_KEYS,
    GROUP_KEYS,
    IMD_KEYS,
    Study,
    age_groups,
)
from uptakelens.settings import Settings
from uptakelens.sources import periods, readers, reports, sample_views, schemas, writers

Query = Callable[[SparkSession, str], DataFrame]

#: The sample's own period; at small sizes some matrix lacks some label.
SETTINGS = Settings(period_text=sample_views.WINDOW_TEXT, require_matrix_labels=False)
#: Another age grouping, other limits and other groups left out.
OTHER_AGES = {
    "5-19": ["5-9", "5-19", "10-14", "15-19"],
    "20-39": ["20-24", "25-29", "30-34", "35-39"],
}
OTHER_SETTINGS = replace(
    SETTINGS,
    age_groups=OTHER_AGES,
    remaining_age_group="Others",
    age_group_order=("5-19", "20-39", "Others"),
    level=0.95,
    lower_term="n",
)
#: A supplied vocabulary, with a label that does not occur, and other wording and thresholds.
GIVEN_SETTINGS = replace(
    SETTINGS,
    labels=("Indian", "Irish", "Nowhere", "Chinese"),
    everyone="Everybody",
    excluded_bands=("20-24",),
    small_number=20,
    ages_text="other than 20 to 24",
)

#: Sexes in another order, and another sentence.
REORDERED_SETTINGS = replace(
    SETTINGS,
    sexes=("Male", "Female", "Unknown"),
    group_caption="{ages}, {period}: {label} ({label})",
    everyone_caption="{period}: everybody",
)

RATIOS = ("proportion", "percent", "z", "lower", "upper", "at_age", "bandwidth", "density", "width")


@lru_cache(maxsize=16)
def study(spark: SparkSession, folder: str) -> Study:
    """The views of a folder, defined once per session. They are lazy: no data is kept."""
    return Study(
        sample_views.event_tally(spark, folder),
        sample_views.register(spark, folder),
        sample_views.areas(spark, folder),
        SETTINGS,
    )


def rounded(rows: DataFrame) -> DataFrame:
    """Ratios to nine decimals, since two engines differ in the last digit of a double."""
    return rows.selectExpr(
        *(
            f"round({name(c)}, 9) AS {name(c)}"
            if c in RATIOS or c.endswith("_percent")
            else name(c)
            for c in rows.columns
        )
    )


def of_study(build: Callable[[Study], DataFrame], settings: Settings = SETTINGS) -> Query:
    return lambda spark, folder: rounded(build(replace(study(spark, folder), settings=settings)))


def exact_limits(inputs: Study) -> DataFrame:
    """Limits to six decimals: the engines solve for them in different ways."""
    rows = inputs.rates_by_imd(limits="exact")
    return clean.replaced(rows, {c: f"round({c}, 6)" for c in ("lower", "upper")})


def extract_events(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["event_id", "person_id", "area", "group_raw", "sex", "age", "age_band"]
    return readers.extract_events(
        sample_views.event_log(spark, folder),
        "event_date",
        sample_views.WINDOW_START,
        sample_views.WINDOW_END,
        columns,
        sample_views.WINDOW_LABEL,
    )


def clean_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean.clean_events(
        extract_events(spark, folder), sample_views.areas(spark, folder)
    )
    return rows.drop("time_period")


def clean_register(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_register(
        sample_views.register(spark, folder), sample_views.areas(spark, folder)
    )


def aligned(keys: Sequence[str]) -> Query:
    """Aligned cells; NULL broad group marks a cell found among events only."""

    def build(inputs: Study) -> DataFrame:
        return cells.add_age_group(inputs.aligned(keys)).drop("unknown_rows", "on_register")

    return of_study(build)


def aligned_left(inputs: Study) -> DataFrame:
    """The register's cells by area, label and band with their events, NULL bands included."""
    rows = align(
        inputs.register_cells(AREA_KEYS),
        cells.labelled(inputs.event_cells(AREA_KEYS)),
        AREA_KEYS,
        how="left",
    )
    return rows.drop("unknown_rows", "on_register", "broad_group")


def population(strict_nulls: bool) -> Query:
    def build(inputs: Study) -> DataFrame:
        by = ["area", "label", "age_band", "constituency"]
        return cells.population_by(
            inputs.register, inputs.areas, by, strict_nulls, inputs.settings
        )

    return of_study(build)


def rates_from_written_cells(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(study(spark, folder).collapsed(spark).rates_by_group())


def monthly_store(spark: SparkSession, folder: str) -> str:
    """The whole event log by month. One month is written before all of its events are known,
    and then once more: only its partition changes."""
    log = sample_views.event_log(spark, folder)
    path = writers.new_folder(spark, "events-by-month")
    first, month, after, last = sample_views.LOG_START, "1996-12-01", "1997-01-01", sample_views.LOG_END
    early = log.filter(f"event_date < DATE'{month}' OR event_date >= DATE'{after}' OR event_id % 3 = 0")
    periods.write_periods(early, path, "event_date", first, last)
    periods.write_periods(log, path, "event_date", month, after)
    return path


def of_stored_window(build: Callable[[Study], DataFrame], start: str, end: str) -> Query:
    """A study over a window of the stored months; the events themselves aren't read again."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        events = periods.read_periods(spark, monthly_store(spark, folder), start, end)
        return rounded(build(replace(study(spark, folder), events=events)))

    return run


def hand_over(file: str, names: dict[str, str]) -> Query:
    """A hand-over file written as the CSV that other tools read, and read back."""

    def build(spark: SparkSession, folder: str) -> DataFrame:
        table = study(spark, folder).hand_over_files()[file]
        path = writers.new_folder(spark, f"{file}.csv")
        fields = [
            T.StructField(f.name, T.IntegerType() if f.name == "IMD_quintile" else f.dataType)
            for f in table.schema
        ]
        writers.write_results(table, path, "csv")
        original = {new: old for old, new in names.items()}
        rows = readers.read_csv_na(spark, path, T.StructType(fields))
        return rounded(rows.withColumnsRenamed(original))

    return build


def from_csv(
    rows: Callable[[SparkSession, str], DataFrame],
    declared: T.StructType,
    names: dict[str, str],
    read: Callable[[SparkSession, str], DataFrame],
) -> Query:
    """An input written as CSV under its delivered names, and read by the library's reader."""

    def build(spark: SparkSession, folder: str) -> DataFrame:
        delivered = {new: old for old, new in names.items()}
        table = rows(spark, folder).withColumnsRenamed(delivered).select(*declared.names)
        path = writers.new_folder(spark, "input.csv")
        writers.write_results(table, path, "csv")
        return read(spark, path)

    return build


def with_bad_rows(spark: SparkSession, folder: str) -> tuple[str, readers.Quarantine]:
    """The event log as CSV, some of whose ages are no numbers, and where these go."""
    delivered = {new: old for old, new in schemas.EVENT_NAMES.items()}
    age = "IF(event_id % 97 = 0, concat('about ', coalesce(CAST(age AS STRING), 'x')), CAST(age AS STRING)) AS age"
    log = sample_views.event_log(spark, folder)
    log = log.selectExpr("group_raw", age, "age_band", "sex", "area").withColumnsRenamed(delivered)
    path = writers.new_folder(spark, "input.csv")
    writers.write_results(log, path, "csv")
    return path, readers.Quarantine(writers.new_folder(spark, "unreadable"), most=0.02)


def events_past_bad_rows(spark: SparkSession, folder: str) -> DataFrame:
    return readers.read_events(spark, *with_bad_rows(spark, folder))


def unreadable_events(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that were set aside, as they stand in the file."""
    path, quarantine = with_bad_rows(spark, folder)
    readers.read_events(spark, path, quarantine)
    rows = spark.read.parquet(quarantine.folder)
    return rows.selectExpr("record", f"contains(file, '{path.rsplit('/', 1)[-1]}') AS from_the_file")


def of_report(table: str) -> Query:
    """A table of a whole report, written and read back by its pointer and manifest."""

    def build(spark: SparkSession, folder: str) -> DataFrame:
        path = writers.new_folder(spark, "report")
        study(spark, folder).write(spark, path, strict_nulls=False)
        return rounded(reports.read_report(spark, path, table)[table])

    return build


def constituency_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Share tables written one folder per label, and read back with the folder's name."""
    table = study(spark, folder).constituency_share(strict_nulls=False)
    path = writers.new_folder(spark, "sheets")
    with_sheet = T.StructType([*table.schema.fields, T.StructField("sheet", T.StringType())])
    writers.write_sheets(table, path, ["ord", "label"], "parquet")
    return spark.read.schema(with_sheet).parquet(path)


def all_queries() -> dict[str, Query]:
    return {
        "extract_events": extract_events,
        "clean_events": clean_events,
        "clean_register": clean_register,
        "population_by_area": population(strict_nulls=False),
        "population_by_area_strict": population(strict_nulls=True),
        "row_account": of_study(Study.row_account),
        "row_account_from_written_cells": lambda spark, folder: (
            study(spark, folder).collapsed(spark).row_account()
        ),
        "vocabulary_order": of_study(Study.vocabulary),
        "events_count_by_group_sex": of_study(Study.event_counts),
        "median_age_by_group": of_study(Study.median_age),
        "median_age_by_group_lenient": of_study(lambda s: s.median_age(strict_nulls=False)),
        "median_age_of_three_sexes": of_study(
            lambda s: s.median_age(strict_nulls=False), REORDERED_SETTINGS
        ),
        "gap_totals_in_other_words": of_study(
            lambda s: s.gap_totals(strict_nulls=False), REORDERED_SETTINGS
        ),
        "age_frequency": of_study(Study.age_frequency),
        "age_density": of_study(Study.age_density),
        "age_density_with_tails": of_study(lambda s: s.age_density(points=200, tails=3.0)),
        "align_group": aligned(GROUP_KEYS),
        "align_imd": aligned(IMD_KEYS),
        "align_group_imd": aligned(GROUP_IMD_KEYS),
        "align_area_left": of_study(aligned_left),
        "distinct_age_groups": of_study(lambda s: age_groups(s.rates_by_group())),
        "rates_by_group": of_study(Study.rates_by_group),
        "rates_by_group_textbook": of_study(lambda s: s.rates_by_group(lower_term="n")),
        "rates_with_exact_limits": of_study(exact_limits),
        "rates_by_imd": of_study(Study.rates_by_imd),
        "rates_broad_imd": of_study(Study.rates_broad_imd),
        "rates_group_imd": of_study(Study.rates_group_imd),
        "benchmark_age": of_study(Study.benchmark),
        "rates_with_benchmark": of_study(Study.rates_by_group_with_benchmark),
        "imd_rates_with_benchmark": of_study(Study.rates_by_imd_with_benchmark),
        "gap_cells": of_study(Study.gap_cells),
        "gap_levels": of_study(Study.gap_levels),
        "area_gap": of_study(lambda s: s.area_gap(strict_nulls=False)),
        "area_gap_strict": of_study(lambda s: s.area_gap(strict_nulls=True)),
        "area_layer": of_study(lambda s: s.area_layer(strict_nulls=False)),
        "area_layer_strict": of_study(lambda s: s.area_layer(strict_nulls=True)),
        "constituency_share": of_study(lambda s: s.constituency_share(strict_nulls=False)),
        "constituency_share_strict": of_study(lambda s: s.constituency_share(strict_nulls=True)),
        "constituency_share_half_up": of_study(
            lambda s: s.constituency_share(strict_nulls=False), replace(SETTINGS, rounding="half_up")
        ),
        "gap_totals": of_study(lambda s: s.gap_totals(strict_nulls=False)),
        "gap_totals_strict": of_study(lambda s: s.gap_totals(strict_nulls=True)),
        "rate_matrix": of_study(Study.rate_matrix),
        "matrix_margins": of_study(Study.matrix_margins),
        "gap_matrix_by_sex": of_study(Study.gap_matrix),
        "gap_matrix_both": of_study(lambda s: s.gap_matrix(by_sex=False)),
        "gap_matrix_labels": of_study(Study.gap_matrix_text),
        "gap_matrix_labels_by_sex": of_study(lambda s: s.gap_matrix_text(by_sex=True)),
        "gap_margins_by_sex": of_study(Study.gap_margins),
        "gap_margins_both": of_study(lambda s: s.gap_margins(by_sex=False)),
        "gap_matrix_protected": of_study(Study.gap_matrix_protected),
        "gap_margins_protected": of_study(Study.gap_margins_protected),
        "rates_other_settings": of_study(
            Study.rates_by_group_with_benchmark, OTHER_SETTINGS
        ),
        "gap_totals_given_vocabulary": of_study(
            lambda s: s.gap_totals(strict_nulls=False), GIVEN_SETTINGS
        ),
        "area_layer_given_vocabulary": of_study(
            lambda s: s.area_layer(strict_nulls=False), GIVEN_SETTINGS
        ),
        "events_from_csv": from_csv(
            sample_views.event_log, schemas.EVENTS, schemas.EVENT_NAMES, readers.read_events
        ),
        "register_from_csv": from_csv(
            sample_views.register, schemas.REGISTER, schemas.REGISTER_NAMES, readers.read_register
        ),
        "lookup_from_csv": from_csv(
            lambda spark, folder: sample_views.areas(spark, folder).lookup,
            schemas.AREA_LOOKUP,
            schemas.LOOKUP_NAMES,
            readers.read_lookup,
        ),
        "events_past_bad_rows": events_past_bad_rows,
        "unreadable_events": unreadable_events,
        "rates_csv_round_trip": hand_over("rates", schemas.RATE_FILE_NAMES),
        "rates_broad_csv_round_trip": hand_over("rates_broad", schemas.RATE_FILE_NAMES),
        "counts_csv_round_trip": hand_over("unvaccinated_counts", schemas.GAP_FILE_NAMES),
        "counts_both_csv_round_trip": hand_over(
            "unvaccinated_counts_both", schemas.GAP_FILE_NAMES
        ),
        "constituency_sheets": constituency_sheets,
        "area_gap_from_report": of_report("area_gap"),
        "rates_from_written_cells": rates_from_written_cells,
        "rates_from_stored_months": of_stored_window(
            Study.rates_by_group, sample_views.WINDOW_START, sample_views.WINDOW_END
        ),
        "median_age_of_a_stored_quarter": of_stored_window(
            lambda s: s.median_age(strict_nulls=False), "1996-11-01", "1997-02-01"
        ),
    }
