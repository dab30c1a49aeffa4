from __future__ import annotations

import math
from statistics import quantiles, stdev

import pytest

from uptakelens.operators import profiles

SCHEMA = "group_raw string, sex string, age int, events bigint"


def curves(spark, ages: dict[str, list[int]], **options) -> dict[str, list]:
    rows = [(g, "Female", a, 1) for g, own in ages.items() for a in own]
    found = profiles.age_density(spark.createDataFrame(rows, SCHEMA), **options).collect()
    out = {g: sorted((r for r in found if r.label == g), key=lambda r: r.point) for g in ages}
    assert sum(map(len, out.values())) == len(found)
    return out


def area(curve: list) -> float:
    return sum((b.at_age - a.at_age) * (a.density + b.density) / 2 for a, b in zip(curve, curve[1:], strict=False))


AGES = {"many": [18, 20, 20, 25, 31, 40, 41, 41, 60, 99], "two": [30, 50], "middle": [30] * 9 + [80], "same": [40, 40], "zero": [0, 0]}


def test_curves_are_the_kernel_sums(spark):
    for group, curve in curves(spark, AGES, points=65).items():
        ages = AGES[group]
        q = quantiles(ages, n=4, method="inclusive")
        spread = min(stdev(ages), (q[2] - q[0]) / 1.34) or stdev(ages) or abs(ages[0]) or 1
        h = 0.9 * spread * len(ages) ** -0.2
        assert len(curve) == 65 and curve[0].bandwidth == pytest.approx(h)
        assert (curve[0].at_age, curve[-1].at_age) == (min(ages), max(ages))
        for r in curve:
            sums = sum(math.exp(-0.5 * ((r.at_age - a) / h) ** 2) for a in ages)
            assert r.density == pytest.approx(sums / (len(ages) * h * math.sqrt(2 * math.pi)))


def test_area_is_one_with_tails(spark):
    found = curves(spark, AGES, points=400, tails=4.0)
    for curve in found.values():
        assert area(curve) == pytest.approx(1, abs=1e-3)
    assert max(r.width for c in found.values() for r in c) == 1


def test_one_event_has_no_curve(spark):
    assert curves(spark, {"one": [30], "some": [1, 2]}, points=5)["one"] == []


def test_counts_weigh_as_many_rows(spark):
    once = [("a", "Male", 20, 3), ("a", "Male", 70, 10**12)]
    found = profiles.age_density(spark.createDataFrame(once, SCHEMA), points=3).collect()
    h = found[0].bandwidth
    assert h > 0 and found[-1].density == pytest.approx(1 / (h * math.sqrt(2 * math.pi)), rel=1e-6)
