"""A study: events, register and areas, and every table the analysis derives from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uptakelens import reference_values as fixed
from uptakelens.functions import labels, rates
from uptakelens.operators import align as alignment
from uptakelens.operators import (
    accounts,
    area_reports,
    cells,
    clean,
    gaps,
    matrix,
    profiles,
    protection,
    rate_tables,
    vocabulary,
)
from uptakelens.settings import DEFAULT, Settings
from uptakelens.sources import reports, schemas, writers
from uptakelens.sources.areas import Areas

GROUP_KEYS = ("age_band", "label", "sex")
IMD_KEYS = ("age_band", "imd_quintile", "sex")
GROUP_IMD_KEYS = ("age_band", "label", "imd_quintile", "sex")
AREA_KEYS = ("area", "label", "age_band")
PROFILE_KEYS = ("group_raw", "sex", "age")


GROUP_DIMS = ("label", "broad_group", "sex", "age_group")
IMD_DIMS = ("imd_quintile", "sex", "age_group")
BROAD_IMD_DIMS = ("broad_group", "imd_quintile", "sex", "age_group")
GROUP_IMD_DIMS = ("label", "imd_quintile", "sex", "age_group")


@dataclass(frozen=True)
class Study:
    """Inputs under the library's column names (see `sources.schemas`).

    `events` holds one row per event of the period, or fewer rows with their number in a
    column `events`. Every method returns a lazy DataFrame.
    """

    events: DataFrame
    register: DataFrame
    areas: Areas
    settings: Settings = DEFAULT

    # -- cells ---------------------------------------------------------------------

    def event_cells(self, by: Sequence[str]) -> DataFrame:
        """Events per combination; `label` in `by` stands for the raw group text."""
        raw = ["group_raw" if c == "label" else c for c in by]
        return cells.event_cells(self.events, self.areas, raw, self.settings)

    def register_cells(self, by: Sequence[str]) -> DataFrame:
        return cells.register_cells(self.register, self.areas, by, self.settings)

    def collapsed(
        self, spark: SparkSession, name: str = "study", folder: str | None = None
    ) -> Study:
        """The same study on written cells: each input is scanned once for all reports."""
        by = ["area", "group_raw", "age_band", "sex", "age"]
        events = cells.event_summary(self.events, self.areas, by, self.settings)
        register = cells.register_summary(self.register, self.areas)
        return replace(
            self,
            events=writers.load_once(spark, events, f"{name}-events", folder),
            register=writers.load_once(spark, register, f"{name}-register", folder),
        )

    def row_account(self) -> DataFrame:
        """Rows in, out and dropped by every filter of every pipeline. The period is not among
        them: rows outside of it are never read."""
        by = ["group_raw", "age_band", "sex"]
        events = cells.event_rows(self.events, ["area", *by], self.settings)
        columns = ["area", "label", "age_band", "sex", "rows"]
        register = self.register.withColumn("rows", F.expr(cells.row_count(self.register, "rows")))
        register = cells.register_rows(register, columns, self.settings)
        return accounts.account(events, register, self.areas, self.settings)

    # -- profiles ------------------------------------------------------------------

    def vocabulary(self, by: Sequence[str] = ("label",)) -> DataFrame:
        """Ordered labels; `by` as in the cells of the same query lets it share their scan."""
        if self.settings.labels is not None:
            spark = self.events.sparkSession
            return vocabulary.given_vocabulary(spark, self.settings.labels, self.settings)
        found = cells.labelled(self.event_cells(by), self.settings)
        return vocabulary.vocabulary(found, self.settings)

    def _in_order(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """The rows with the place of their label; a label outside the vocabulary has none."""
        places = self.vocabulary(by).selectExpr("label AS known_label", "ord")
        return rows.join(places, F.expr("label <=> known_label"), "left").drop("known_label")

    def median_age(self, strict_nulls: bool = True) -> DataFrame:
        cells = self.event_cells(PROFILE_KEYS)
        return profiles.median_by_sex(cells, strict_nulls, self.settings)

    def event_counts(self) -> DataFrame:
        return profiles.count_by_sex(self.event_cells(["group_raw", "sex"]), self.settings)

    def age_frequency(self) -> DataFrame:
        rows = profiles.age_frequency(self.event_cells(PROFILE_KEYS), self.settings)
        return self._in_order(rows, PROFILE_KEYS)

    def age_density(self, points: int = 512, tails: float = 0.0) -> DataFrame:
        """Curves of the ages by label and sex."""
        rows = profiles.age_density(self.event_cells(PROFILE_KEYS), points, tails, self.settings)
        return self._in_order(rows, PROFILE_KEYS)

    # -- rates ---------------------------------------------------------------------

    def _sides(self, cell_keys: Sequence[str], alone: bool) -> tuple[DataFrame, DataFrame]:
        """Register and event cells with labels and age groups. `alone`: no vocabulary is
        taken from the same cells, so events of other sexes can go before the sum."""
        study = self
        known_sex = alignment.known(["sex"], self.settings)
        if alone:
            study = replace(self, events=self.events.filter(known_sex))
        events = study.event_cells(cell_keys)
        if "label" in cell_keys:
            events = cells.labelled(events, self.settings)
        register = self.register_cells(cell_keys).filter(known_sex)
        return tuple(cells.add_age_group(side, self.settings) for side in (register, events))

    def aligned(
        self, keys: Sequence[str], dims: Sequence[str] | None = None, alone: bool = False
    ) -> DataFrame:
        """Known cells with population and events, 0 where a side has none.

        `keys` say which cells are known and are the grain of the result, unless coarser
        `dims` are given: both measures add up, so one sum serves, as long as no broad group
        is wanted, which belongs to the fine cells.
        """
        register, events = self._sides(keys, alone)
        known = alignment.known(keys, self.settings)
        return alignment.align(
            register,
            events,
            dims or keys,
            in_register=known,
            in_events=known,
            settings=self.settings,
            broad_group=dims is None,
        )

    def rates(
        self, keys: Sequence[str], dims: Sequence[str], alone: bool = True, **options
    ) -> DataFrame:
        """Rates per combination of dims over the cells known by their keys."""
        options = self.settings.rate_options | options
        if "broad_group" in dims:
            rows = cells.add_age_group(self.aligned(keys, alone=alone), self.settings)
            rows = cells.summed(rows, dims, ["events", "population"])
        else:
            rows = self.aligned(keys, dims, alone).select(*dims, "events", "population")
        if "imd_quintile" in dims:
            rows = clean.replaced(rows, {"imd_quintile": "CAST(imd_quintile AS STRING)"})
        return rate_tables.with_rates(rows.select(*dims, "events", "population"), **options)

    def rates_by_group(self, alone: bool = True, **options) -> DataFrame:
        return self.rates(GROUP_KEYS, GROUP_DIMS, alone, **options)

    def rates_by_imd(self, **options) -> DataFrame:
        return self.rates(IMD_KEYS, IMD_DIMS, **options)

    def rates_broad_imd(self, **options) -> DataFrame:
        return self.rates(GROUP_IMD_KEYS, BROAD_IMD_DIMS, **options)

    def rates_group_imd(self, **options) -> DataFrame:
        return self.rates(GROUP_IMD_KEYS, GROUP_IMD_DIMS, **options)

    def benchmark(self) -> DataFrame:
        return self.rates(GROUP_KEYS, ["age_group"])

    def rates_by_group_with_benchmark(self) -> DataFrame:
        """Rates by group, in vocabulary order, next to the average of their age group."""
        rate_rows = self.rates_by_group(alone=False)
        average = rate_tables.benchmark(rate_rows)
        compared = rate_tables.with_benchmark(
            rate_rows, average, order=self.settings.age_group_order
        )
        return vocabulary.in_vocabulary(compared, self.vocabulary(GROUP_KEYS))

    def rates_by_imd_with_benchmark(self) -> DataFrame:
        """Rates by quintile next to the same average, which always is that of the groups.

        One grouped sum makes both: by quintile, sex and age group it adds up the cells whose
        quintile is known, and those whose label is. The latter's totals by age group are the
        average, formed over these few rows.
        """
        settings = self.settings
        register, events = self._sides(GROUP_IMD_KEYS, alone=True)
        rows = register.selectExpr(*GROUP_IMD_KEYS, "age_group", "population", "0L AS events")
        rows = rows.union(
            events.selectExpr(*GROUP_IMD_KEYS, "age_group", "0L AS population", "events")
        )
        in_rate, in_average = (alignment.known(keys, settings) for keys in (IMD_KEYS, GROUP_KEYS))
        sums = rows.groupBy(*IMD_DIMS).agg(
            F.expr(f"sum(IF({in_rate}, events, NULL)) AS events"),
            F.expr(f"sum(IF({in_rate}, population, NULL)) AS population"),
            F.expr(f"sum(IF({in_average}, events, NULL)) AS average_events"),
            F.expr(f"sum(IF({in_average}, population, NULL)) AS average_population"),
        )
        whole = (f"sum(average_{m}) OVER (PARTITION BY age_group)" for m in ("events", "population"))
        average = f"{rates.percent(*whole)} AS benchmark_percent"
        sums = sums.selectExpr(*IMD_DIMS, "events", "population", average)
        sums = clean.replaced(
            sums.filter("events IS NOT NULL"),
            {"imd_quintile": "CAST(imd_quintile AS STRING)"},
        )
        sums = sums.select(*IMD_DIMS, "events", "population", "benchmark_percent")
        rows = rate_tables.with_rates(sums, **settings.rate_options)
        return rate_tables.with_place(rows, order=settings.age_group_order)

    # -- gaps ----------------------------------------------------------------------

    def gap_cells(self, alone: bool = True) -> DataFrame:
        return gaps.gap_cells(self.aligned(GROUP_IMD_KEYS, gaps.GAP_DIMS, alone))

    def gap_levels(self, levels: dict[str, Sequence[str]] = gaps.GAP_LEVELS) -> DataFrame:
        alone = self.settings.labels is not None
        return gaps.gap_levels(
            self.gap_cells(alone), self.vocabulary(GROUP_IMD_KEYS), levels, self.settings
        )

    def gaps_by_area(self, strict_nulls: bool = True) -> DataFrame:
        """Gap and total by area and label: what all reports by area start from."""
        return gaps.area_gap(
            self.register_cells(AREA_KEYS),
            self.event_cells(AREA_KEYS),
            strict_nulls,
            self.settings,
        )

    def area_gap(self, strict_nulls: bool = True, by_area: DataFrame | None = None) -> DataFrame:
        """`by_area`, here and below, may be the written gaps by area."""
        rows = self.gaps_by_area(strict_nulls) if by_area is None else by_area
        return area_reports.with_constituency(rows, self.areas)

    def area_layer(self, strict_nulls: bool = True, by_area: DataFrame | None = None) -> DataFrame:
        rows = self.gaps_by_area(strict_nulls) if by_area is None else by_area
        return area_reports.area_layer(rows, self.vocabulary(AREA_KEYS), self.areas, self.settings)

    def constituency_share(
        self, strict_nulls: bool = True, by_area: DataFrame | None = None
    ) -> DataFrame:
        return area_reports.constituency_share(
            self.area_gap(strict_nulls, by_area), self.vocabulary(AREA_KEYS), self.settings
        )

    def gap_totals(self, strict_nulls: bool = True, by_area: DataFrame | None = None) -> DataFrame:
        rows = self.gaps_by_area(strict_nulls) if by_area is None else by_area
        return area_reports.gap_totals(rows, self.vocabulary(AREA_KEYS), self.settings)

    # -- matrices ------------------------------------------------------------------

    def rate_matrix(self) -> DataFrame:
        return matrix.rate_matrix(self.rates_broad_imd(), self.settings)

    def _matrix_level(self, by_sex: bool, levels: DataFrame | None) -> DataFrame:
        level = "sex_label_imd" if by_sex else "label_imd"
        rows = self.gap_levels({level: gaps.GAP_LEVELS[level]}) if levels is None else levels
        return rows.filter(f"level = '{level}'")

    def gap_matrix(self, by_sex: bool = True, levels: DataFrame | None = None) -> DataFrame:
        """Counts in clear; `levels` may be a written gap table."""
        return matrix.gap_matrix(self._matrix_level(by_sex, levels), by_sex, self.settings)

    def gap_matrix_text(
        self, by_sex: bool = False, levels: DataFrame | None = None
    ) -> DataFrame:
        """The gap matrix as displayed, small numbers hidden."""
        return matrix.suppressed_matrix(self.gap_matrix(by_sex, levels), self.settings)

    def gap_margins(self, by_sex: bool = True, levels: DataFrame | None = None) -> DataFrame:
        return matrix.gap_margins(self._matrix_level(by_sex, levels), by_sex, self.settings)

    def gap_matrix_protected(self, levels: DataFrame | None = None) -> DataFrame:
        """The gap matrices with their totals, as displayed, so that no hidden number follows
        from what is shown."""
        return protection.protected_gap_matrix(self._matrix_level(True, levels), self.settings)

    def gap_margins_protected(self, levels: DataFrame | None = None) -> DataFrame:
        """The same as a long table, hidden numbers NULL."""
        return protection.protected_gaps(self._matrix_level(True, levels), self.settings)

    def matrix_margins(self) -> DataFrame:
        return matrix.matrix_margins(self.rates_broad_imd(), self.settings)

    # -- everything ----------------------------------------------------------------

    def tables(
        self,
        strict_nulls: bool = True,
        levels: DataFrame | None = None,
        unsuppressed: bool = False,
        by_area: DataFrame | None = None,
    ) -> dict[str, DataFrame]:
        """Every table of the analysis, by the name it is written under.

        Gap matrices hide small numbers, and where they show totals, what these would give away;
        `unsuppressed` adds the matrices and their margins in clear.
        """
        tables = {
            "row_account": self.row_account(),
            "vocabulary": self.vocabulary(),
            "median_age": self.median_age(strict_nulls),
            "event_counts": self.event_counts(),
            "age_frequency": self.age_frequency(),
            "age_density": self.age_density(),
            "rates_by_group": self.rates_by_group_with_benchmark(),
            "rates_by_imd": self.rates_by_imd_with_benchmark(),
            "rates_broad_imd": self.rates_broad_imd(),
            "rates_group_imd": self.rates_group_imd(),
            "benchmark": self.benchmark(),
            "gap_levels": self.gap_levels() if levels is None else levels,
            "rate_matrix": self.rate_matrix(),
            "matrix_margins": self.matrix_margins(),
            "gap_matrix_by_sex": self.gap_matrix_text(True, levels),
            "gap_matrix_both": self.gap_matrix_text(False, levels),
            "gap_matrix_protected": self.gap_matrix_protected(levels),
            "gap_margins_protected": self.gap_margins_protected(levels),
            "area_gap": self.area_gap(strict_nulls, by_area),
            "area_layer": self.area_layer(strict_nulls, by_area),
            "constituency_share": self.constituency_share(strict_nulls, by_area),
            "gap_totals": self.gap_totals(strict_nulls, by_area),
        }
        if unsuppressed:
            tables |= {
                "gap_counts_by_sex": self.gap_matrix(True, levels),
                "gap_counts_both": self.gap_matrix(False, levels),
                "gap_margins_by_sex": self.gap_margins(True, levels),
                "gap_margins_both": self.gap_margins(False, levels),
            }
        return tables

    def write(
        self,
        spark: SparkSession,
        folder: str,
        strict_nulls: bool = True,
        unsuppressed: bool = False,
        scratch: str | None = None,
    ) -> dict[str, str]:
        """Write every table as Parquet, the hand-over files as CSV, the shares as sheets.

        Both inputs are scanned once, into cells that all tables start from. The gap levels are
        computed once, as are the gaps by area, which are laid out by area, so that no report by
        area shuffles them again. These live in a folder of their own in `scratch` (default:
        the session's shared folder), which goes when all is written. The report is complete or
        not there at all: see `sources.reports`. Returns the tables' paths by name.
        """
        own = writers.new_folder(spark, "report", scratch)
        try:
            study = self.collapsed(spark, folder=own)
            levels = writers.load_once(spark, study.gap_levels(), "gap_levels", own)
            with writers.laid_out(spark, own, "area") as write:
                by_area = write(study.gaps_by_area(strict_nulls), "gaps_by_area")
                tables = study.tables(strict_nulls, levels, unsuppressed, by_area)
                files = study.hand_over_files(levels)
                as_csv = partial(writers.write_results, file_format="csv")
                by = ["ord", "label"]
                as_sheets = partial(as_csv, partition_by=by)
                jobs = {n: (t, "parquet", writers.write_results) for n, t in tables.items()}
                jobs |= {f"{n}.csv": (t, "csv", as_csv) for n, t in files.items()}
                shares = writers.sheets(tables["constituency_share"], by)
                jobs["constituency_sheets"] = (shares, "csv", as_sheets)
                return reports.write_report(spark, folder, jobs)
        finally:
            writers.remove(spark, own)

    def hand_over_files(self, levels: DataFrame | None = None) -> dict[str, DataFrame]:
        """The tables other tools read, under the column names they expect."""
        levels = (self.gap_levels() if levels is None else levels).drop("ord", "age_group_ord")
        by_sex = levels.filter("level = 'sex_label_imd'")
        both = levels.filter("level = 'label_imd'")
        return {
            "rates_broad": self.rates_broad_imd().withColumnsRenamed(schemas.RATE_FILE_NAMES),
            "rates": self.rates_group_imd().withColumnsRenamed(schemas.RATE_FILE_NAMES),
            "unvaccinated_counts": by_sex.drop("level").withColumnsRenamed(
                schemas.GAP_FILE_NAMES
            ),
            "unvaccinated_counts_both": both.drop("level", "sex").withColumnsRenamed(
                schemas.GAP_FILE_NAMES
            ),
        }


def age_groups(rows: DataFrame) -> DataFrame:
    """Distinct age groups with their place in the display order."""
    found = vocabulary.distinct_values(rows, "age_group")
    place = labels.position("age_group", fixed.AGE_GROUP_ORDER)
    return found.selectExpr("age_group", f"{place} AS age_group_ord")
