"""Pinned totals of the views described in FIXTURES.md, at scale factor 0.01."""

from __future__ import annotations

import pytest
from folders import SF_001

from uptakelens.plans.study import Study
from uptakelens.sources import sample_views as views
from uptakelens.sources.areas import checked_areas


@pytest.fixture(scope="module")
def study(spark):
    person = views.person(spark, SF_001)
    lookup = views.areas(spark, SF_001).lookup
    return Study(
        views.event_tally(spark, SF_001),
        person.selectExpr(*views.columns(views.REGISTER)),
        checked_areas(lookup.filter("CAST(area AS INT) < 20"), lookup),
    )


def totals(frame, *expressions):
    return tuple(frame.selectExpr(*expressions).first())


def test_inputs(spark, study):
    assert views.person(spark, SF_001).count() == 1500
    assert views.event_log(spark, SF_001).count() == 15000
    assert totals(study.events, "sum(events)") == (2235,)
    assert totals(study.event_cells(["sex"]), "sum(events)") == (1748,)
    assert totals(study.register, "count(1)") == (1500,)
    assert totals(study.register_cells(["sex"]), "count(1)", "sum(population)") == (1198, 2393)


def test_mangled_bands(spark):
    log = views.event_log(spark, SF_001)
    counts = totals(
        log,
        "count_if(age_band IN ('05-Sep', 'Oct-14'))",
        "count_if(age_band = 'NA-NA')",
        "count_if(age_band IS NULL)",
        "count_if(age >= 105)",
        "count_if(age IS NULL)",
    )
    assert counts == (1250, 352, 158, 1079, 364)


def test_rates(study):
    rates = study.rates_by_group()
    assert totals(rates, "count(1)", "sum(events)", "sum(population)") == (133, 1262, 1739)
    oddities = ("count_if(broad_group IS NULL)", "count_if(population = 0)", "count_if(events = 0)")
    assert totals(rates, *oddities) == (37, 37, 10)
    benchmark = {r["age_group"]: (r["events"], r["population"]) for r in study.benchmark().collect()}
    assert benchmark == {"Less than 65": (822, 1133), "65-79": (162, 220), "80+": (278, 386)}


def test_gap_cells(study):
    found = totals(
        study.gap_cells(),
        "count(1)",
        "sum(events)",
        "sum(population)",
        "sum(gap)",
        "count_if(events > population)",
    )
    assert found == (435, 1195, 1651, 897, 147)


def test_area_gap(study):
    sums = ("count(1)", "count(gap)", "sum(gap)", "sum(total)", "count_if(gap = 0)")
    assert totals(study.area_gap(strict_nulls=False), *sums) == (278, 278, 748, 1327, 75)
    assert totals(study.area_gap(), *sums) == (278, 270, 726, 1285, 72)


def test_everybody_by_constituency(study):
    shares = study.constituency_share(strict_nulls=False).filter("label = 'All'").collect()
    assert {r["constituency"]: (r["gap"], r["total"]) for r in shares} == {
        "AFRICA": (128, 236),
        "AMERICA": (153, 281),
        "ASIA": (170, 289),
        "EUROPE": (166, 284),
        "MIDDLE EAST": (131, 237),
    }
