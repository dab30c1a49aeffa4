"""Golden rows of the single expressions."""

from __future__ import annotations

import math

import pytest

from uptakelens.functions import counts, labels, rates, text
from uptakelens.functions.sql import listed, literal, name
from uptakelens.operators import rate_tables


def values(spark, expression, rows, schema):
    """The expression over each row, in the rows' order."""
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
    result = frame.selectExpr("i", f"{expression} AS value").orderBy("i").collect()
    return [row["value"] for row in result]


@pytest.mark.parametrize(
    "events, population, percent, lower, upper, textbook",
    [
        (10, 100, 10.0, 4.966145212937602, 18.391458605756476, 4.787449913967563),
        (1, 50, 2.0, 0.15562250056336596, 11.127511164950523, 0.026144265803008663),
        (0, 20, 0.0, None, 18.340059160868755, None),
        (250, 200, 125.0, 110.01181476721838, 141.49425936201362, 109.98344212386164),
        (5000, 20000, 25.0, 24.311862834118692, 25.702745785091754, 24.31179482668713),
        (3, 0, None, None, None, None),
    ],
)
def test_byar(spark, events, population, percent, lower, upper, textbook):
    sides = ("events", "population")
    expected = {
        rates.percent(*sides): percent,
        rates.byar_lower(*sides): lower,
        rates.byar_upper(*sides): upper,
        rates.byar_lower(*sides, lower_term="n"): textbook,
    }
    row = spark.createDataFrame([(events, population)], "events long, population long")
    for found, wanted in zip(row.selectExpr(*expected).first(), expected.values(), strict=True):
        assert found == (None if wanted is None else pytest.approx(wanted, abs=1e-9))


def test_byar_rejects_unknown_term():
    with pytest.raises(ValueError, match="lower_term"):
        rates.byar_lower("n", "p", lower_term="x")


def test_quantile():
    assert rates.normal_quantile() == pytest.approx(1.959963984540054, abs=1e-15)


@pytest.mark.parametrize(
    "raw, label, broad",
    [
        ("A: British", "White British", "White"),
        ("D: White and black caribbean", "White and Black Caribbean", "Mixed"),
        ("N: african", "African", "Black"),
        ("L: Any other asian background", "Any other Asian background", None),
        ("R: Chinese", "Chinese", "Asian"),
        ("Z: Not stated", "Not stated", "Unknown"),
        ("British", "White British", "White"),
        ("A: B: British", "White British", "White"),
        ("É: Arab", "Arab", "Other"),
        ("white british", "white british", None),
        ("", "", None),
        (None, None, None),
    ],
)
def test_event_label(spark, raw, label, broad):
    found = labels.event_label("raw")
    assert values(spark, found, [(raw,)], "raw string") == [label]
    assert values(spark, labels.event_broad_group("raw"), [(label,)], "raw string") == [broad]


@pytest.mark.parametrize(
    "raw, label, broad",
    [
        ("British", "White British", "White"),
        ("Chinese", "Chinese", "Other"),
        ("Any other Asian background", "Any other Asian background", "Asian"),
        ("Not Known", "Not Known", None),
        ("A: British", "A: British", None),
        (None, None, None),
    ],
)
def test_register_label(spark, raw, label, broad):
    assert values(spark, labels.register_label("raw"), [(raw,)], "raw string") == [label]
    assert values(spark, labels.register_broad_group("raw"), [(label,)], "raw string") == [broad]


BOTH = {
    "Pakistani": "Asian", "Indian": "Asian", "Bangladeshi": "Asian", "African": "Black",
    "Caribbean": "Black", "White and Black Caribbean": "Mixed",
    "White and Black African": "Mixed", "White and Asian": "Mixed", "White British": "White",
    "Irish": "White", "Any other ethnic group": "Other", "Not stated": "Unknown",
}
EVENTS_ONLY = {
    "Other Asian": "Asian", "Chinese": "Asian", "Other Black": "Black", "Mixed other": "Mixed",
    "Other White": "White", "Gypsy or Irish Traveller": "White", "Roma": "White", "Arab": "Other",
    "Any other Asian background": None, "Any other Black background": None,
    "Any other mixed background": None, "Any other white background": None, "Not Known": None,
}
REGISTER_ONLY = {
    "Any other Asian background": "Asian", "Any other Black background": "Black",
    "Any other mixed background": "Mixed", "Any other white background": "White",
    "Chinese": "Other", "Other Asian": None, "Other Black": None, "Mixed other": None,
    "Other White": None, "Gypsy or Irish Traveller": None, "Roma": None, "Arab": None,
    "Not Known": None,
}


@pytest.mark.parametrize(
    "broad, own",
    [(labels.event_broad_group, EVENTS_ONLY), (labels.register_broad_group, REGISTER_ONLY)],
)
def test_every_label_of_both_vocabularies(spark, broad, own):
    expected = BOTH | own
    found = values(spark, broad("label"), [(label,) for label in expected], "label string")
    assert dict(zip(expected, found, strict=True)) == expected


def test_bands_and_age_groups(spark):
    bands = [("05-Sep",), ("Oct-14",), ("65-69",), (None,), ("NA-NA",)]
    repaired = values(spark, labels.repaired_band("band"), bands, "band string")
    assert repaired == ["5-19", "10-14", "65-69", None, "NA-NA"]
    groups = {
        "65-69": "65-79",
        "75-79": "65-79",
        "80-84": "80+",
        "100-104": "80+",
        "105-109": "Less than 65",
        "5-19": "Less than 65",
        None: "Less than 65",
    }
    rows = [(band,) for band in groups]
    assert values(spark, labels.age_group("band"), rows, "band string") == list(groups.values())


def test_position(spark):
    rows = [("a",), ("c",), ("x",), (None,)]
    assert values(spark, labels.position("v", ["a", "b", "c"]), rows, "v string") == [1, 3, None, None]


def test_not_in_keeps_null(spark):
    rows = [("a",), ("b",), (None,)]
    assert values(spark, labels.not_in("v", ["a"]), rows, "v string") == [False, True, True]


def test_gap_then_suppression(spark):
    rows = [(7,), (4,), (0,), (-3,), (None,)]
    kept = counts.clamped("v", null_as_zero=False)
    assert values(spark, kept, rows, "v long") == [7, 4, 0, 0, None]
    assert values(spark, counts.clamped("v", null_as_zero=True), rows, "v long") == [7, 4, 0, 0, 0]
    assert values(spark, counts.suppressed(f"({kept})"), rows, "v long") == [7, 0, 0, 0, None]
    shown = values(spark, counts.suppressed_text(f"({kept})"), rows, "v long")
    assert shown == ["7", "<5", "<5", "<5", None]


def test_complete_sum(spark):
    frame = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, v long")
    frame.createOrReplaceTempView("complete_sum_rows")
    found = spark.sql(f"SELECT k, {counts.complete_sum('v')} AS s FROM complete_sum_rows GROUP BY k")
    assert {row["k"]: row["s"] for row in found.collect()} == {"a": None, "b": 5}


def test_texts(spark):
    rows = [(45.0, 47.5), (None, 30.0)]
    both = {"Female": "f", "Male": "m"}
    found = values(spark, text.median_text(both), rows, "f double, m double")
    assert found == ["F:45 | M:47.5", "F:NA | M:30"]
    for sexes, said in (
        ({"Male": "m", "Female": "f"}, "M:47.5 | F:45"),
        ({"Male": "m"}, "M:47.5"),
        ({"Man": "m", "Male": "f"}, "Man:47.5 | Male:45"),
    ):
        assert values(spark, text.median_text(sexes), rows, "f double, m double")[0] == said
    numbers = [(1234567,), (12,)]
    assert values(spark, text.thousands("n"), numbers, "n long") == ["1,234,567", "12"]
    assert values(spark, text.slug("s"), [("White and Asian",)], "s string") == ["White-and-Asian"]
    parts = values(spark, text.part_of_text("a", "b"), [(1, 2), (None, None)], "a long, b long")
    assert parts == ["1 of 2", "NA of NA"]


def test_captions_in_other_words(spark):
    rows = [("Indian", False), ("All", True)]
    words = {"of_group": "{label}: {label}, {period}", "of_everyone": "{ages}"}
    caption = text.caption("label", "everyone", "18+", "May", **words)
    assert values(spark, caption, rows, "label string, everyone boolean") == ["Indian: Indian, May", "18+"]


def test_captions(spark):
    rows = [("Indian", False), ("All", True)]
    found = values(spark, text.caption("label", "everyone"), rows, "label string, everyone boolean")
    ending = (
        "aged less than 65 who didn't receive a Covid-19 vaccine between Oct 2023 and Sept 2024"
    )
    assert found == [
        f"Estimated number of Indian residents {ending}",
        f"Estimated number of residents of all ethnicities {ending}",
    ]


def test_literals(spark):
    tricky = ["it's", "back\\slash", 'quote"', "\\w: "]
    row = spark.range(1).selectExpr(*(literal(value) for value in tricky)).first()
    assert list(row) == tricky
    assert listed(["a", "b"]) == "'a', 'b'"
    assert name("a b") == "`a b`"
    assert spark.range(1).selectExpr(f"1 AS {name('a`b')}").columns == ["a`b"]


@pytest.mark.parametrize(
    "value, nearest, half_up",
    [
        (0.15, 0.1, 0.2), (0.25, 0.2, 0.3), (0.35, 0.3, 0.4), (0.55, 0.6, 0.6), (0.65, 0.7, 0.7),
        (12.25, 12.2, 12.3), (12.75, 12.8, 12.8), (6.25, 6.2, 6.3), (18.75, 18.8, 18.8), (31.25, 31.2, 31.3),
        (-12.25, -12.2, -12.3), (33.333, 33.3, 33.3), (100.0, 100.0, 100.0), (0.0, 0.0, 0.0), (None, None, None),
        (0.05, 0.0, 0.1), (1e300, 1e300, 1e300),
    ],
)
def test_rounding(spark, value, nearest, half_up):
    frame = spark.createDataFrame([(value,)], "v double")
    found = frame.selectExpr(rates.rounded("v", 1), rates.rounded("v", 1, "half_up")).first()
    assert tuple(found) == (nearest, half_up)


def test_unknown_rounding():
    with pytest.raises(ValueError, match="rounding"):
        rates.rounded("v", 1, "down")


def poisson_tail(mean: float, n: int) -> float:
    """Probability of at most n events."""
    return math.fsum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(n + 1))


def solved(n: int, level: float) -> tuple[float, float]:
    """Means under which n events or more, or n or fewer, have the probability 1 - level."""
    out = []
    for least, wanted in ((n - 1, level), (n, 1 - level)):
        low, high = 0.0, 2.0 * n + 50
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if least >= 0 and poisson_tail(middle, least) > wanted else (low, middle)
        out.append(0.0 if least < 0 else low)
    return tuple(out)


#: Exact limits of a count at 95 %, as tables print them.
POISSON = {
    0: (0, 3.69), 1: (0.03, 5.57), 2: (0.24, 7.22), 5: (1.62, 11.67), 10: (4.80, 18.39),
    50: (37.11, 65.92), 100: (81.36, 121.63),
}


@pytest.mark.parametrize("level", [0.975, 0.995])
def test_exact_limits(spark, level):
    counts = [0, 1, 2, 3, 5, 10, 37, 50, 100, 250, 498, 499, 500, 501, 1200, 5000]
    frame = spark.createDataFrame([(n,) for n in counts], "n bigint")
    rows = frame.selectExpr("n", rates.exact_lower("n", "100", level), rates.exact_upper("n", "100", level)).collect()
    for n, lower, upper in rows:
        assert (lower, upper) == pytest.approx(solved(n, level), rel=1e-9, abs=1e-9)
        if level == 0.975 and n in POISSON:
            assert (lower, upper) == pytest.approx(POISSON[n], abs=5.1e-3)


def test_exact_limits_without_people_and_for_many_events(spark):
    frame = spark.createDataFrame([(3, 0), (10**12, 10**13), (None, 5)], "n bigint, people bigint")
    none, many, missing = frame.selectExpr(rates.exact_lower("n", "people"), rates.exact_upper("n", "people")).collect()
    assert tuple(none) == tuple(missing) == (None, None)
    assert 9.99998 < many[0] < 10 < many[1] < 10.00002


def test_unknown_limits(spark):
    with pytest.raises(ValueError, match="limits"):
        rate_tables.with_rates(spark.range(1).selectExpr("1L AS events", "2L AS population"), limits="wald")
