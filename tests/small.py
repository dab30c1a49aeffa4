"""A hand-sized study and the same results by plain Python, row by row."""

from __future__ import annotations

import random
from collections import defaultdict
from statistics import median

from uptakelens import reference_values as fixed
from uptakelens.plans.study import Study
from uptakelens.settings import DEFAULT
from uptakelens.sources.areas import checked_areas

EVENT_SCHEMA = "area string, group_raw string, age_band string, sex string, age int"
REGISTER_SCHEMA = (
    "area string, group_national string, age_band string, sex string, observations long"
)
LOOKUP_SCHEMA = "area string, imd_quintile int, constituency string, locality string"

LOOKUP = [
    ("a1", 1, "North", "x"),
    ("a2", 2, "South", "x"),
    ("a3", None, "South", "y"),
    ("a9", 5, "Elsewhere", "z"),
]
# a4 has no lookup row, a5 neither people nor events.
TARGETS = [("a1",), ("a2",), ("a3",), ("a4",), ("a5",)]

EVENTS = [
    *[("a1", "A: British", "20-24", "Female", 22)] * 30,  # a hot cell, more events than people
    ("a1", "H: Indian", "65-69", "Male", 66),
    ("a1", "H: Indian", "65-69", "Male", 68),
    ("a1", "H: Indian", "05-Sep", "Male", None),
    ("a2", "N: african", "80-84", "Female", 81),
    ("a2", "N: african", "105-109", "Female", 106),
    ("a2", "Z: Not stated", "20-24", "Male", 21),
    ("a2", "P: All", "30-34", "Male", 31),  # a label that reads like the report's "All"
    ("a3", "A: British", "20-24", "Male", 23),
    ("a3", None, "20-24", "Male", 24),
    ("a3", "A: British", None, "Male", 25),
    ("a4", "A: British", "20-24", "Unknown", 26),
    ("a4", "A: British", "NA-NA", "Female", None),
    ("a9", "A: British", "20-24", "Female", 20),
]

REGISTER = [
    ("a1", "British", "20-24", "Female", 12),
    ("a1", "Indian", "65-69", "Male", 10),
    ("a1", "Indian", "05-Sep", "Male", 4),
    ("a1", "Not Known", "20-24", "Male", 7),
    ("a2", "African", "80-84", "Female", None),
    ("a2", "African", "25-29", "Female", None),
    ("a2", "African", "25-29", "Female", 9),
    ("a2", "Chinese", "25-29", "Male", 6),
    ("a2", "All", "30-34", "Male", 8),
    ("a3", "British", "20-24", "Male", 5),
    ("a3", "British", None, "Male", 3),
    ("a3", None, "20-24", "Male", 2),
    ("a4", "British", "20-24", "Male", 20),
    ("a4", "British", "NA-NA", "Female", 2),
    ("a9", "British", "20-24", "Female", 99),
]


def study(spark, events=EVENTS, register=REGISTER, settings=DEFAULT, **limits) -> Study:
    return Study(
        spark.createDataFrame(events, EVENT_SCHEMA),
        spark.createDataFrame(register, REGISTER_SCHEMA),
        checked_areas(
            spark.createDataFrame(TARGETS, "area string"),
            spark.createDataFrame(LOOKUP, LOOKUP_SCHEMA),
            **limits,
        ),
        settings,
    )


def _band(band):
    return fixed.BAND_REPAIRS.get(band, band)


def _label(raw):
    if raw is None:
        return None
    label = raw[3:] if raw[1:3] == ": " else raw
    label = fixed.GROUP_RENAMES.get(label, label)
    for old, new in fixed.CAPITALS.items():
        label = label.replace(old, new)
    return label


def _in_targets(area):
    return (area,) in TARGETS


def quintile(area):
    return {row[0]: row[1] for row in LOOKUP}.get(area)


def _group(label, groups):
    return next((name for name, members in groups.items() if label in members), None)


def _age_group(band):
    return _group(band, fixed.AGE_GROUPS) or fixed.REMAINING_AGE_GROUP


def rates_by_group(event_rows=EVENTS, register_rows=REGISTER) -> dict:
    """(label, broad, sex, age group) -> (events, population)."""
    population, events = defaultdict(int), defaultdict(int)
    for area, group, band, sex, observations in register_rows:
        if _in_targets(area):
            population[_band(band), _label(group), sex] += observations or 0
    for area, group, band, sex, _ in event_rows:
        if _in_targets(area):
            events[_band(band), _label(group), sex] += 1
    sums = defaultdict(lambda: [0, 0])
    for key in population.keys() | events.keys():
        band, label, sex = key
        if band in (None, "NA-NA") or label in (None, "Not stated", "Not Known"):
            continue
        if sex not in fixed.SEXES:
            continue
        broad = _group(label, fixed.REGISTER_BROAD_GROUPS) if key in population else None
        cell = sums[label, broad, sex, _age_group(band)]
        cell[0] += events.get(key, 0)
        cell[1] += population.get(key, 0)
    return {key: tuple(cell) for key, cell in sums.items()}


def area_gaps(strict: bool, event_rows=EVENTS, register_rows=REGISTER) -> dict:
    """(area, label) -> (gap, total), None where a missing observation makes it so."""
    cells, events = {}, defaultdict(int)
    for area, group, band, _, observations in register_rows:
        label, band = _label(group), _band(band)
        if not _in_targets(area) or label in (None, "Not Known") or band in fixed.BANDS_FROM_65:
            continue
        cells.setdefault((area, label, band), []).append(observations)
    for area, group, band, _, _ in event_rows:
        if _label(group) not in (None, "Not stated"):
            events[area, _label(group), _band(band)] += 1
    sums = {}
    for (area, label, band), observed in cells.items():
        known = [value for value in observed if value is not None]
        part = None if strict and len(known) < len(observed) else sum(known)
        total, reached = sums.get((area, label), (0, 0))
        total = None if part is None or total is None else total + part
        sums[area, label] = (total, reached + events.get((area, label, band), 0))
    return {
        key: (None, None) if total is None else (max(total - reached, 0), total)
        for key, (total, reached) in sums.items()
    }


def gap_cells(event_rows, register_rows) -> dict:
    """(age group, sex, label, quintile) -> gap, clamped at that grain."""
    population, events = defaultdict(int), defaultdict(int)
    for area, group, band, sex, observations in register_rows:
        if _in_targets(area):
            population[_band(band), _label(group), sex, quintile(area)] += observations or 0
    for area, group, band, sex, _ in event_rows:
        if _in_targets(area):
            events[_band(band), _label(group), sex, quintile(area)] += 1
    sums = defaultdict(int)
    for key in population.keys() | events.keys():
        band, label, sex, imd = key
        if band in (None, "NA-NA") or label in (None, "Not stated", "Not Known"):
            continue
        if sex in fixed.SEXES and imd is not None:
            sums[_age_group(band), sex, label, imd] += population.get(key, 0) - events.get(key, 0)
    return {key: max(gap, 0) for key, gap in sums.items()}


def medians(event_rows) -> dict:
    """(label, sex) -> median age, None when an age is missing."""
    ages = defaultdict(list)
    for area, group, _, sex, age in event_rows:
        if _in_targets(area) and sex in fixed.SEXES:
            ages[_label(group), sex].append(age)
    return {
        key: None if None in values else float(median(values)) for key, values in ages.items()
    }


def vocabulary(event_rows) -> list:
    """Labels from the last in (broad group, label) order, a missing broad group last."""
    found = {_label(group) for area, group, *_ in event_rows if _in_targets(area)} - {None}
    place = {label: _group(label, fixed.EVENT_BROAD_GROUPS) for label in found}
    ascending = sorted(found, key=lambda label: (place[label] is None, place[label] or "", label))
    return ascending[::-1]


def random_inputs(seed: int) -> tuple[list, list]:
    """Events and register rows with every kind of oddity, a third of them in one cell."""
    draw = random.Random(seed)
    areas = ["a1", "a2", "a3", "a4", "a9", None]
    bands = ["05-Sep", "Oct-14", "10-14", "5-19", "20-24", "65-69", "80-84", "105-109", "NA-NA", None]
    sexes = ["Female", "Male", "Male", "Unknown", None]
    raw = ["A: British", "British", "N: african", "R: Chinese", "Z: Not stated", "Q: Roma", "x", None]
    national = ["British", "African", "Chinese", "Not Known", "Not stated", "x", None]
    events = [
        (
            draw.choice(areas),
            draw.choice(raw),
            draw.choice(bands),
            draw.choice(sexes),
            draw.choice([None, *range(0, 110)]),
        )
        for _ in range(400)
    ]
    events += [("a1", "N: african", "20-24", "Male", 20 + i % 5) for i in range(200)]
    register = [
        (
            draw.choice(areas),
            draw.choice(national),
            draw.choice(bands),
            draw.choice(sexes),
            draw.choice([None, 0, 1, 2, 3, 40]) if draw.random() < 0.5 else draw.randint(0, 9),
        )
        for _ in range(300)
    ]
    return events, register
