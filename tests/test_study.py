"""The whole pipeline on a hand-sized study, against plain Python and known answers."""

from __future__ import annotations

from dataclasses import replace

import pytest
import small

from uptakelens.operators import align, matrix
from uptakelens.operators.vocabulary import require_labels
from uptakelens.plans.study import AREA_KEYS
from uptakelens.sources.areas import checked_areas


@pytest.fixture(scope="module", params=["broadcast", "too large to broadcast"])
def study(spark, request):
    limits = {} if request.param == "broadcast" else {"max_rows": 1}
    built = small.study(spark, **limits)
    assert built.areas.broadcastable == (request.param == "broadcast")
    return built


def rows(frame, *columns):
    return {tuple(row) for row in frame.select(*columns).collect()}


def test_rates_by_group(study):
    found = study.rates_by_group().collect()
    got = {
        (r["label"], r["broad_group"], r["sex"], r["age_group"]): (r["events"], r["population"])
        for r in found
    }
    assert got == small.rates_by_group()
    assert len(found) == len(got)


@pytest.mark.parametrize("strict", [False, True])
def test_area_gap(study, strict):
    found = study.area_gap(strict).collect()
    got = {(r["area"], r["label"]): (r["gap"], r["total"]) for r in found}
    assert got == small.area_gaps(strict)
    north_or_south = {"a1": "North", "a2": "South", "a3": "South", "a4": None}
    assert all(r["constituency"] == north_or_south[r["area"]] for r in found)


def test_no_event_is_lost_or_invented(study):
    aligned = study.aligned(("age_band", "label", "sex"))
    known = [
        e
        for e in small.EVENTS
        if e[0] != "a9"
        and e[1] not in (None, "Z: Not stated")
        and e[2] not in (None, "NA-NA")
        and e[3] in ("Female", "Male")
    ]
    assert aligned.selectExpr("sum(events)").first()[0] == len(known)


def test_null_bands_meet_in_the_left_join(study):
    cells = align.align(
        study.register_cells(AREA_KEYS),
        study.event_cells(AREA_KEYS).withColumnRenamed("group_raw", "label"),
        AREA_KEYS,
        how="left",
    )
    # The raw text differs from the label, so only the NULL label with its band can meet.
    met = cells.filter("events > 0")
    assert rows(met, "area", "label", "age_band", "population", "events") == {
        ("a3", None, "20-24", 2, 1)
    }


def test_vocabulary_order(study):
    found = study.vocabulary().orderBy("ord").collect()
    assert [r["label"] for r in found] == [
        "All",
        "White British",
        "Not stated",
        "African",
        "Indian",
    ]
    assert [r["ord"] for r in found] == [1, 2, 3, 4, 5]


def test_everybody_is_not_the_label_all(study):
    totals = {r["ord"]: r for r in study.gap_totals(strict_nulls=False).collect()}
    assert totals[1]["label"] == "All" and totals[1]["summary"] == "7 of 8"
    everybody = totals[6]
    gaps = small.area_gaps(strict=False).values()
    assert everybody["label"] == "All"
    assert everybody["gap"] == sum(gap for gap, _ in gaps)
    assert everybody["total"] == sum(total for _, total in gaps)
    assert "all ethnicities" in everybody["caption"]
    assert totals[3]["label"] == "Not stated" and totals[3]["summary"] == "0 of 0"


def test_strict_totals(study):
    totals = {r["ord"]: r["summary"] for r in study.gap_totals().collect()}
    assert totals[4] == "NA of NA"  # African: one observation is missing
    assert totals[6] == "NA of NA"  # and so is everybody's
    assert totals[1] == "7 of 8"


def test_constituency_share(study):
    found = study.constituency_share(strict_nulls=False).filter("ord = 6").orderBy("position").collect()
    gaps = small.area_gaps(strict=False)
    by_place = {"North": 0, "South": 0, None: 0}
    for (area, _), (gap, _) in gaps.items():
        by_place[{"a1": "North", "a2": "South", "a3": "South"}.get(area)] += gap
    whole = sum(by_place.values())
    assert {r["constituency"]: r["gap"] for r in found} == by_place
    assert [r["share"] for r in found] == sorted(
        (round(100 * gap / whole, 1) for gap in by_place.values()), reverse=True
    )


def test_area_layer_fills_and_suppresses(study):
    found = study.area_layer(strict_nulls=False).collect()
    assert len(found) == 6 * len(small.TARGETS)
    everybody = {r["area"]: r["value"] for r in found if r["ord"] == 6}
    gaps = small.area_gaps(strict=False)
    for (area,) in small.TARGETS:
        gap = sum(g for (a, _), (g, _) in gaps.items() if a == area)
        assert everybody[area] == (gap if gap >= 5 else 0)
    assert all(r["value"] == 0 or r["value"] >= 5 for r in found)


def test_gap_levels_add_up(study):
    levels = study.gap_levels().groupBy("level").agg({"gap": "sum"}).collect()
    sums = {level: gap for level, gap in levels}
    assert set(sums) == {"sex_label", "sex_imd", "sex_label_imd", "label_imd"}
    assert len(set(sums.values())) == 1
    cells = study.gap_cells()
    assert cells.filter("gap < 0 OR gap < population - events").count() == 0
    # Chinese is on the register only: outside the vocabulary, so its label is NULL.
    merged = study.gap_levels().filter("level = 'label_imd' AND label IS NULL")
    assert rows(merged, "imd_quintile", "age_group", "gap") == {("2", "Less than 65", 6)}


def test_medians(study):
    strict = {r["label"]: r for r in study.median_age().collect()}
    assert strict["Indian"]["median_male"] is None
    assert strict["Indian"]["median_text"] == "F:NA | M:NA"
    lenient = {r["label"]: r for r in study.median_age(strict_nulls=False).collect()}
    assert lenient["Indian"]["median_male"] == 67.0
    assert lenient["African"]["median_female"] == 93.5
    assert lenient["White British"]["median_text"] == "F:22 | M:24"
    order = {r["label"]: r["ord"] for r in study.vocabulary().collect()}
    assert all(r["ord"] == order.get(label) for label, r in lenient.items())


@pytest.mark.parametrize("sexes", [("Male", "Female"), ("Female",), ("Unknown", "Male")])
def test_medians_of_other_sexes(study, sexes):
    other = replace(study, settings=replace(study.settings, sexes=sexes))
    by_label = {r["label"]: r for r in other.median_age(strict_nulls=False).collect()}
    plain = small.medians([e for e in small.EVENTS if e[4] is not None])
    assert other.median_age().columns == ["label", *(f"median_{s.lower()}" for s in sexes), "median_text", "ord"]
    for label, row in by_label.items():
        for sex in set(sexes) & {"Female", "Male"}:
            assert row[f"median_{sex.lower()}"] == plain.get((label, sex))
    counted = other.event_counts().collect()
    assert {r["sex"] for r in counted} == set(sexes)
    order = {r["label"]: r["ord"] for r in study.vocabulary().collect()}
    assert all(r["ord"] == order.get(r["label"]) for r in counted)


def test_benchmark_is_a_ratio_of_sums(study):
    rate_rows = study.rates_by_group().collect()
    for row in study.benchmark().collect():
        same = [r for r in rate_rows if r["age_group"] == row["age_group"]]
        assert row["events"] == sum(r["events"] for r in same)
        assert row["population"] == sum(r["population"] for r in same)
    compared = study.rates_by_group_with_benchmark()
    places = {"Less than 65": 1, "65-79": 2, "80+": 3}
    assert all(r["age_group_ord"] == places[r["age_group"]] for r in compared.collect())


def test_limits_enclose_the_rate(study):
    outside = "population > 0 AND (lower > percent OR upper < percent)"
    assert study.rates_group_imd().filter(outside).count() == 0


def test_written_cells_give_the_same_tables(spark, study):
    written = study.collapsed(spark, "small-study")
    for build in (
        lambda s: s.rates_by_group(),
        lambda s: s.median_age(),
        lambda s: s.area_gap(),
        lambda s: s.vocabulary(),
    ):
        before, after = build(study), build(written)
        assert before.columns == after.columns
        assert set(before.collect()) == set(after.collect())


def test_matrix_needs_all_labels_when_asked(study):
    with pytest.raises(Exception, match="no rows for the label"):
        study.gap_matrix().collect()
    with pytest.raises(Exception, match="no rows for the label .* in the matrix of 65-79, Male"):
        with_settings(study, matrix_labels=("Indian", "White British")).gap_matrix().collect()
    narrow = with_settings(
        study, matrix_labels=("Indian", "White British"), require_matrix_labels=False
    ).gap_matrix()
    assert narrow.columns == [
        "age_group", "sex", "imd_quintile", "Indian", "White British", "file_name",
    ]
    by_row = {(r[0], r[1], r[2]): r for r in narrow.collect()}
    assert by_row["65-79", "Male", "1"]["Indian"] == 8
    assert by_row["65-79", "Male", "1"]["White British"] == 0
    assert by_row["65-79", "Male", "1"]["file_name"] == "Unvaxed-65-79-Male"


def with_settings(study, **changes):
    return replace(study, settings=replace(study.settings, **changes))


def test_shown_matrices_and_their_margins(study):
    narrow = with_settings(
        study, matrix_labels=("Indian", "White British"), require_matrix_labels=False
    )
    for by_sex in (True, False):
        clear = narrow.gap_matrix(by_sex).collect()
        shown = {tuple(r[:2 + by_sex]): r for r in narrow.gap_matrix_text(by_sex).collect()}
        for row in clear:
            for label in ("Indian", "White British"):
                value = row[label]
                assert shown[tuple(row[:2 + by_sex])][label] == ("<5" if value < 5 else str(value))
        sums = narrow.gap_margins(by_sex).groupBy("margin").sum("gap").collect()
        assert len({r[1] for r in sums}) == 1 and len(sums) == 4
        assert sums[0][1] == sum(r["Indian"] + r["White British"] for r in clear)


def test_other_mappings_reach_the_tables(study):
    other = with_settings(
        study,
        register_broad_groups={"One": ["Indian"], "Two": ["White British"]},
        matrix_broad_groups=("One",),
        age_groups={"Young": ["20-24"]},
        remaining_age_group="Old",
        age_group_order=("Young", "Old"),
        sexes=("Female", "Male"),
    )
    rates = other.rates_by_group().collect()
    assert {r["broad_group"] for r in rates} <= {"One", "Two", None}
    assert {r["age_group"] for r in rates} == {"Young", "Old"}
    wide = other.rate_matrix()
    assert "Two_population" in wide.columns  # no group of the mapping is left out
    assert wide.agg({"Two_population": "sum"}).first()[0] > 0


def test_unknown_areas_are_told_from_areas_without_a_gap(study):
    strict = study.area_layer(strict_nulls=True)
    unknown = {(r["label"], r["area"]) for r in strict.filter("NOT is_known").collect()}
    gaps = study.area_gap(strict_nulls=True).filter("gap IS NULL").collect()
    assert {(r["label"], r["area"]) for r in gaps} <= unknown and unknown
    assert study.area_layer(strict_nulls=False).filter("NOT is_known").count() == 0


def test_supplied_vocabulary(study):
    given = with_settings(study, labels=("Indian", "Nowhere"))
    totals = {r["ord"]: r for r in given.gap_totals(strict_nulls=False).collect()}
    assert [totals[i]["label"] for i in (1, 2, 3)] == ["Indian", "Nowhere", "All"]
    assert totals[2]["summary"] == "0 of 0"


def test_margins(study):
    margins = study.matrix_margins()
    whole = margins.filter("margin = 'all'").selectExpr("sum(events)", "sum(population)").first()
    cells = margins.filter("margin = 'cell'").selectExpr("sum(events)", "sum(population)").first()
    assert whole == cells


def test_rate_matrix_leaves_out_missing_groups(study):
    wide = matrix.rate_matrix(study.rates_broad_imd())
    row = wide.filter("sex = 'Male' AND age_group = '65-79'").first()
    assert (row["Asian_population"], row["Asian_events"], row["Asian_percent"]) == (10, 2, 20.0)
    assert row["White_population"] is None and row["White_percent"] is None


def test_repeated_area_is_an_error(spark):
    targets = spark.createDataFrame(small.TARGETS, "area string")
    lookup = spark.createDataFrame([*small.LOOKUP, small.LOOKUP[0]], small.LOOKUP_SCHEMA)
    with pytest.raises(ValueError, match="more than once"):
        checked_areas(targets, lookup)


def test_size_checks(spark):
    targets = spark.createDataFrame(small.TARGETS, "area string")
    lookup = spark.createDataFrame(small.LOOKUP, small.LOOKUP_SCHEMA)
    assert checked_areas(targets, lookup).broadcastable
    assert not checked_areas(targets, lookup, max_rows=4).broadcastable
    assert not checked_areas(targets, lookup, max_bytes=20).broadcastable


def test_require_labels(spark):
    frame = spark.createDataFrame([("a",), ("b",), (None,)], "label string")
    require_labels(frame, "label", ["a", "b"])
    with pytest.raises(ValueError, match="'c'"):
        require_labels(frame, "label", ["a", "c"])


def test_align_rejects_other_joins(study):
    with pytest.raises(ValueError, match="how"):
        align.align(study.register, study.events, ["area"], how="inner")


def test_account_of_rows(study):
    """Every row is dropped by the first filter it fails."""
    found = {(r["input"], r["pipeline"], r["test"]): (r["rows_in"], r["rows_dropped"]) for r in study.row_account().collect()}
    assert found["events", "rates_by_group", "area"] == (len(small.EVENTS), 1)
    kept = [e for e in small.EVENTS if e[0] != "a9"]
    no_band = [e for e in kept if e[2] in (None, "NA-NA")]
    assert found["events", "rates_by_group", "age_band"] == (len(kept), len(no_band))
    assert found["events", "rates_by_group", "not_stated"][1] == 2  # one not stated, one without a group
    assert found["events", "rates_by_group", "sex"][1] == 1
    assert found["events", "rates_by_imd", "imd_quintile"][1] == 2  # a3 has no quintile
    assert found["register", "rates_by_group", "area"] == (len(small.REGISTER), 1)
    assert found["register", "area_layer", "not_known"][1] == 2
    reached = sum(r["events"] for r in study.event_cells(["area"]).collect())
    assert reached == len(kept)


def test_account_of_written_cells(spark, study, tmp_path):
    written = study.collapsed(spark, folder=str(tmp_path))
    assert sorted(written.row_account().collect()) == sorted(study.row_account().collect())
    # rows of other areas are one cell without an area
    assert written.events.filter("area IS NULL").selectExpr("sum(events)").first()[0] == 1
