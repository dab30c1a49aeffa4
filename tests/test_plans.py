"""What Catalyst makes of the queries."""

from __future__ import annotations

import pytest
import small
from folders import SF_0001

from uptakelens.operators import cells, clean
from uptakelens.plans import sample_queries
from uptakelens.sources import writers
from uptakelens.sources.areas import checked_areas

QUERIES = sample_queries.all_queries()
# These write and read back inside, so their own plan is a plain scan.
ROUND_TRIPS = {
    *(n for n in QUERIES if n.endswith(("_round_trip", "_from_csv"))),
    "constituency_sheets",
    "rates_from_written_cells",
    "rates_from_stored_months",
    "row_account_from_written_cells",
    "area_gap_from_report",
    "events_past_bad_rows",
    "unreadable_events",
    "median_age_of_a_stored_quarter",
}
# Their report groups are one row, set beside every area.
LAYERS = {n for n in QUERIES if n.startswith("area_layer")}


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame) -> str:
    """What was run, subqueries included, without the plans that it began with."""
    frame.collect()
    kept, initial = [], None
    for line in plan(frame).splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if initial is not None and depth < initial:
            initial = None
        if "== Initial Plan ==" in line:
            initial = depth
        if initial is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.mark.parametrize("name", sorted(LAYERS))
def test_a_layer_sets_one_row_of_groups_beside_its_areas(spark, name):
    lines = plan(QUERIES[name](spark, SF_0001)).splitlines()
    loops = [i for i, x in enumerate(lines) if "NestedLoopJoin" in x]
    assert len(loops) == 1 and not any("CartesianProduct" in x for x in lines)
    depth = lines[loops[0]].index("BroadcastNestedLoopJoin")
    side = next(i for i, x in enumerate(lines[loops[0] + 1 :], loops[0] + 1) if x[depth:].startswith("+- "))
    assert "BroadcastExchange" in lines[side]
    assert any("ObjectHashAggregate(keys=[]" in x for x in lines[side + 1 : side + 3])  # one row


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROUND_TRIPS - LAYERS))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF_0001))
    for unwanted in ("Python", "CartesianProduct", "NestedLoopJoin"):
        assert unwanted not in text


def test_window_and_columns_reach_the_scan(spark):
    text = QUERIES["rates_by_group"](spark, SF_0001)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in text
    assert "LessThan(o_orderdate,1" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_window_passes_the_join(spark):
    text = QUERIES["extract_events"](spark, SF_0001)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text


@pytest.mark.parametrize(
    "name",
    [
        "rates_with_benchmark",
        "imd_rates_with_benchmark",
        "gap_levels",
        "gap_matrix_by_sex",
        "constituency_share",
        "gap_totals",
        "area_layer",
        "row_account",
    ],
)
def test_each_input_is_scanned_once(spark, name):
    text = final_plan(QUERIES[name](spark, SF_0001))
    assert text.count("FileScan parquet [o_") == 1
    # once as the register, once as the people of the event log
    assert text.count("FileScan parquet [c_") == 2


@pytest.mark.parametrize("name", ["rates_by_group", "vocabulary_order", "area_gap", "gap_levels"])
def test_text_is_cleaned_per_cell(spark, name):
    """No text cleaning below the aggregation of the raw rows."""
    text = final_plan(QUERIES[name](spark, SF_0001))
    raw = [line for line in text.splitlines() if "Scan parquet" in line or "Filter" in line]
    assert raw and not any("regexp_replace" in line for line in raw)


def test_large_lookup_is_joined_after_the_sum(spark):
    """Beyond the broadcast bound the rows are summed per area before they meet the areas."""
    study = small.study(spark, max_rows=1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = study.event_cells(["age_band", "group_raw", "imd_quintile"])
        lines = plan(cells).splitlines()
        joins = [i for i, line in enumerate(lines) if "SortMergeJoin" in line]
        partial = [i for i, line in enumerate(lines) if "partial_sum(" in line]
        assert len(joins) == 1 and len(partial) == 2
        assert partial[0] < joins[0] < partial[1]
        assert sum(row["events"] for row in cells.collect()) == len(small.EVENTS) - 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_other_areas_are_screened_out_below_the_shuffle(spark):
    """A large list's screen is tested at the scan: rows of other areas aren't summed or moved."""
    lookup = spark.range(1000).selectExpr(
        "CAST(id AS STRING) AS area", "1 AS imd_quintile", "'c' AS constituency", "'l' AS locality"
    )
    areas = checked_areas(lookup.select("area"), lookup, max_rows=1)
    events = spark.range(0, 50_000, 1, 4).selectExpr(
        "CAST(id AS STRING) AS area", "'A: British' AS group_raw", "'20-24' AS age_band"
    )
    assert areas.screened(events).count() < 5_000  # 1000 are of target areas
    assert areas.screened(events.filter("CAST(area AS INT) < 1000")).count() == 1000
    by = ["age_band", "group_raw", "imd_quintile"]
    summed = cells.event_cells(events, areas, by)
    assert summed.collect()[0]["events"] == 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {"partial_sum(": plan(cells.event_cells(events, areas, by))}
        plans["Exchange hashpartitioning(area"] = plan(clean.clean_events(events, areas))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for moved, text in plans.items():
        lines = text.splitlines()
        screens = [i for i, line in enumerate(lines) if "BroadcastHashJoin" in line and "screen_word" in line]
        assert len(screens) == 1
        assert min(i for i, line in enumerate(lines) if moved in line) < screens[0]
    small = checked_areas(lookup.select("area"), lookup)
    assert small.screen is None and cells.event_cells(events, small, by).collect() == summed.collect()


def test_small_lookup_is_broadcast(spark):
    text = plan(small.study(spark).event_cells(["age_band", "group_raw", "imd_quintile"]))
    facts = [line for line in text.splitlines() if "Exchange hashpartitioning(age_band" in line]
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text
    assert len(facts) == 1


def test_a_hot_area_is_split_when_the_lookup_is_large(spark):
    """One join to the written areas, whose hot partition adaptive execution splits."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    lookup = spark.range(2000).selectExpr(
        "CAST(id AS STRING) AS area", "1 AS imd_quintile", "'c' AS constituency", "'l' AS locality"
    )
    areas = checked_areas(lookup.select("area"), lookup, max_rows=1)
    events = spark.range(0, 100_000, 1, 8).selectExpr(
        "CAST(IF(id % 2 = 0, 7, id % 2000) AS STRING) AS area",
        "'A: British' AS group_raw",
        "'20-24' AS age_band",
        "uuid() AS text",
    )
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        cleaned = clean.clean_events(events, areas)
        assert "skew=true" in final_plan(cleaned)
        assert cleaned.count() == 100_000
    finally:
        for key in settings:
            spark.conf.unset(key)


@pytest.mark.parametrize(
    "name, exchanges",
    [("rates_by_imd", 2), ("rates_group_imd", 2), ("benchmark_age", 2), ("gap_cells", 2)],
)
def test_one_sum_aligns_and_rolls_up(spark, name, exchanges):
    """Besides the collapse of the events: one more shuffle, of partial sums."""
    text = plan(QUERIES[name](spark, SF_0001))
    lines = [x.split("ENSURE")[0] for x in text.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("age_" in x for x in lines) == exchanges


def above(text: str, leaf: str) -> list[list[str]]:
    """For each line of a plan with the leaf, the operators that its rows pass."""
    lines = [(len(x) - len(x.lstrip(" :+-")), x.strip(" :+-")) for x in text.splitlines()]
    out = []
    for i, (depth, own) in enumerate(lines):
        if leaf in own:
            path = []
            for d, x in reversed(lines[:i]):
                if d < depth:
                    path.append(x)
                    depth = d
            out.append(path)
    return out


def test_reports_by_area_start_from_gaps_laid_out_by_area(spark, tmp_path):
    """Gaps written in buckets by area aren't shuffled by area again, in any report by area."""
    study = small.study(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with writers.laid_out(spark, str(tmp_path), "area") as write:
            by_area = write(study.gaps_by_area(False), "gaps")
            for name in ("area_gap", "area_layer", "constituency_share", "gap_totals"):
                frame = getattr(study, name)(False, by_area)
                (path,) = above(plan(frame), "FileScan parquet spark_catalog")
                exchanges = [x for x in path if x.startswith("Exchange")]
                # none for the areas; for the others, partial sums of few labels and places
                assert not any("(area" in x for x in exchanges)
                assert not exchanges if name in ("area_gap", "area_layer") else exchanges
                direct = getattr(study, name)(False)
                assert sorted(map(repr, frame.collect())) == sorted(map(repr, direct.collect()))
        assert not spark.catalog.listTables(pattern="gaps_*")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
