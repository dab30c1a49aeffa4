"""No hidden number may follow from what is shown: checked by looking for other tables."""

from __future__ import annotations

import itertools
import random
from dataclasses import replace

import numpy as np
import pytest

from uptakelens.operators import protection
from uptakelens.settings import DEFAULT

LEEWAY = DEFAULT.small_number


def random_tables(shape: tuple[int, ...], n: int, seed: int) -> dict[int, np.ndarray]:
    draw = random.Random(seed)
    kinds = [[0, 1, 4, 7, 30], [0, 0, 0, 2], [5, 6, 40, 3], [0, 100], [2], [0]]
    values = (draw.choice(kinds) for _ in range(n))
    return {t: np.array([draw.choice(v) for _ in range(np.prod(shape))]).reshape(shape) for t, v in enumerate(values)}


def entries_of(table: np.ndarray) -> dict[tuple[str, ...], np.ndarray]:
    """For each entry, total or not, which cells it is the sum of."""
    out = {}
    for at in itertools.product(*([*range(n), None] for n in table.shape)):
        mask = np.zeros(table.shape, bool)
        mask[tuple(slice(None) if a is None else a for a in at)] = True
        out[tuple("" if a is None else f"={a}" for a in at)] = mask.ravel()
    return out


def check(table: np.ndarray, shown: dict[tuple[str, ...], tuple[int, bool]]) -> None:
    sums = entries_of(table)
    assert set(shown) == set(sums)
    flat = table.ravel()
    for at, (value, hidden) in shown.items():
        assert value == flat[sums[at]].sum()
        assert hidden or value >= DEFAULT.small_number
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=flat.size)), np.int8)
    visible = np.array([sums[at] for at, (_, h) in shown.items() if not h], np.int8).reshape(-1, flat.size)
    steps = steps[(steps @ visible.T == 0).all(axis=1)]
    by_one = steps[(flat + steps >= 0).all(axis=1)]
    by_leeway = steps[(flat + LEEWAY * steps.astype(int) >= 0).all(axis=1)]
    for at, (value, hidden) in shown.items():
        if hidden:
            change = by_one @ sums[at].astype(np.int8)
            assert (change != 0).any(), (at, table)
            if value < DEFAULT.small_number:
                assert (by_leeway @ sums[at].astype(np.int8) > 0).any(), (at, table)


def protected(spark, tables: dict[int, np.ndarray], dims: list[str]):
    rows = [
        (t, *map(str, at), int(v)) for t, table in tables.items() for at, v in np.ndenumerate(table)
        if v or t % 2 or sum(at) == 0 or any(at) and list(at) == [at[0]] * len(at)
    ]
    schema = "t int, " + "".join(f"{d} string, " for d in dims) + "v bigint"
    known = {d: [str(i) for i in range(n)] for d, n in zip(dims, next(iter(tables.values())).shape, strict=True)}
    found = protection.protected(spark.createDataFrame(rows, schema), ["t"], dims, "v", known=known).collect()
    out = {t: {} for t in tables}
    for row in found:
        out[row.t][tuple(row[d] for d in dims)] = (row.value, row.is_hidden)
    return out


@pytest.mark.parametrize("shape", [(3, 3), (2, 2, 2), (1, 4), (1, 1)])
def test_no_hidden_entry_is_determined(spark, shape):
    tables = random_tables(shape, 36, sum(shape))
    dims = ["a", "b", "c"][: len(shape)]
    for t, shown in protected(spark, tables, dims).items():
        check(tables[t], shown)


def test_nothing_small_hides_nothing(spark):
    tables = {0: np.array([[5, 9], [70, 8]])}
    shown = protected(spark, tables, ["a", "b"])[0]
    assert len(shown) == 9 and not any(hidden for _, hidden in shown.values())


def test_the_cheapest_box_is_taken(spark):
    tables = {1: np.array([[1, 20, 30], [6, 90, 7], [50, 60, 70]])}
    shown = protected(spark, tables, ["a", "b"])[1]
    hidden = {at for at, (_, gone) in shown.items() if gone}
    assert hidden == {("=0", "=0"), ("=0", "=2"), ("=1", "=0"), ("=1", "=2")}


def test_matrix(spark):
    labels = ("Irish", "Indian", "Chinese")
    settings = replace(DEFAULT, matrix_labels=labels, require_matrix_labels=False, hidden_text="x")
    rows = [
        ("80+", sex, imd, label, 2 if (sex, imd, label) == ("Male", "1", "Irish") else 10 + int(imd) + i)
        for sex in ("Female", "Male") for imd in ("1", "2") for i, label in enumerate(labels)
    ]
    levels = spark.createDataFrame(
        [*rows, ("80+", "Male", "1", None, 1), ("80+", "Other", "1", "Irish", 1)],
        "age_group string, sex string, imd_quintile string, label string, gap bigint",
    )
    wide = protection.protected_gap_matrix(levels, settings).collect()
    assert [c for c in wide[0].__fields__] == ["age_group", "sex", "imd_quintile", *labels, "All", "file_name"]
    shown = {(r.sex, r.imd_quintile): r for r in wide}
    assert len(shown) == 9
    assert shown["Male", "1"].Irish == "x" and shown["both", "All"].All == str(sum(r[4] for r in rows))
    hidden = sum(r[c] == "x" for r in wide for c in (*labels, "All"))
    assert hidden == 8  # one box
    assert shown["both", "All"].file_name == "Unvaxed-80+-both"
    strict = replace(settings, require_matrix_labels=True, matrix_labels=("Irish", "Roma"))
    with pytest.raises(Exception, match="no rows for the label Roma in 80"):
        protection.protected_gap_matrix(levels, strict).collect()
    with pytest.raises(ValueError, match="name of the total"):
        protection.protected_gaps(levels, replace(settings, everyone="Irish"))
