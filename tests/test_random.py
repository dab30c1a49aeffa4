"""Random studies against plain Python."""

from __future__ import annotations

import pytest
import small


@pytest.fixture(scope="module", params=[1, 2, 3])
def inputs(request):
    return small.random_inputs(request.param)


@pytest.fixture(scope="module")
def study(spark, inputs):
    return small.study(spark, *inputs)


def test_rates(study, inputs):
    found = {
        (r["label"], r["broad_group"], r["sex"], r["age_group"]): (r["events"], r["population"])
        for r in study.rates_by_group().collect()
    }
    assert found == small.rates_by_group(*inputs)


@pytest.mark.parametrize("strict", [False, True])
def test_area_gaps(study, inputs, strict):
    found = {
        (r["area"], r["label"]): (r["gap"], r["total"]) for r in study.area_gap(strict).collect()
    }
    assert found == small.area_gaps(strict, *inputs)


def test_gap_cells_and_levels(study, inputs):
    expected = small.gap_cells(*inputs)
    found = {
        (r["age_group"], r["sex"], r["label"], r["imd_quintile"]): r["gap"]
        for r in study.gap_cells().collect()
    }
    assert found == expected
    known = set(small.vocabulary(inputs[0]))
    by_sex = {}
    for (age_group, sex, label, _), gap in expected.items():
        key = (age_group, sex, label if label in known else None)
        by_sex[key] = by_sex.get(key, 0) + gap
    level = study.gap_levels().filter("level = 'sex_label'").collect()
    assert {(r["age_group"], r["sex"], r["label"]): r["gap"] for r in level} == by_sex


def test_medians(study, inputs):
    found = {}
    for row in study.median_age().collect():
        for sex in ("Female", "Male"):
            found[row["label"], sex] = row[f"median_{sex.lower()}"]
    expected = small.medians(inputs[0])
    assert {key: value for key, value in found.items() if key in expected} == expected
    assert all(found[key] is None for key in found.keys() - expected.keys())


def test_vocabulary(study, inputs):
    found = study.vocabulary().orderBy("ord").collect()
    assert [r["label"] for r in found] == small.vocabulary(inputs[0])


def test_totals_and_layer(study, inputs):
    gaps = small.area_gaps(False, *inputs)
    names = small.vocabulary(inputs[0])
    totals = {r["ord"]: (r["gap"], r["total"]) for r in study.gap_totals(False).collect()}
    for place, label in enumerate(names, 1):
        own = [value for (_, name), value in gaps.items() if name == label]
        assert totals[place] == (sum(g for g, _ in own), sum(t for _, t in own))
    everybody = (sum(g for g, _ in gaps.values()), sum(t for _, t in gaps.values()))
    assert totals[len(names) + 1] == everybody
    layer = {(r["ord"], r["area"]): r["value"] for r in study.area_layer(False).collect()}
    assert len(layer) == (len(names) + 1) * len(small.TARGETS)
    for (place, area), value in layer.items():
        wanted = None if place > len(names) else names[place - 1]
        gap = sum(g for (a, n), (g, _) in gaps.items() if a == area and wanted in (None, n))
        assert value == (gap if gap >= 5 else 0)
