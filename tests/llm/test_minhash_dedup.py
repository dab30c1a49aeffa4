from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from frames import PLAIN, empty, odd, rows_of, table
from helpers import SF_0001

from uptakelens.llm import minhash_dedup as dedup
from uptakelens.llm.components import roots


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain(rows):
    """doc_id, n_shingles, component_id and kept, every pair compared."""
    sets = [(doc_id, shingle_set(text)) for doc_id, text in rows]
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            shared = len(a & b)
            if a and b and 100 * shared >= 85 * (len(a) + len(b) - shared):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for (doc_id, own), g in zip(sets, group, strict=True):
        ids = [d for (d, _), h in zip(sets, group, strict=True) if h == g and d is not None]
        component = min(ids, default=None) if own else doc_id
        out.append((doc_id, len(own), component, doc_id == component))
    return sorted(out, key=repr)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_0001}/documents.parquet")
    assert rows_of(dedup.report(docs)) == plain(docs.select("doc_id", "text").collect())


def edited(words, draw, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("pairs, block", [(64, 1 << 15), (2, 700), (0, 1 << 15)])
def test_chains_copies_and_near_misses(spark, monkeypatch, pairs, block):
    monkeypatch.setattr(dedup, "PAIRS", pairs)
    monkeypatch.setattr(dedup, "BLOCK", block)
    draw = random.Random(8)
    rows, number = [], 0
    for base in range(4):
        words = [f"w{base}x{draw.randrange(5000)}" for _ in range(200)]
        text = " ".join(words)
        for _ in range(25):  # a chain: each a copy of some earlier one with an edit or two
            rows.append((number, text if draw.random() < 0.8 else text.upper()))
            number += 1
            text = edited(rows[draw.randrange(max(0, len(rows) - 6), len(rows))][1].lower().split(), draw, draw.randint(0, 4))
    draw.shuffle(rows)
    expected = plain(rows)
    assert 8 < sum(r[3] for r in expected) < 90
    assert rows_of(dedup.report(table(spark, "doc_id bigint, text string, node string", *((*r, "x") for r in rows)))) == expected


def test_odd_documents(spark):
    docs = odd(spark, extra=False).select("doc_id", "text")
    found = rows_of(dedup.report(odd(spark)))
    assert found == plain([tuple(r) for r in docs.collect()])
    assert dedup.report(empty(spark)).collect() == []


def test_shingles_equal_plain_sets():
    texts = [PLAIN, None, "", "a", "a b c d", "a b c d e", "A b C d e f a b c d e", "é\xa0x y\tz\x0bq\x0cw\r\nv"]
    value, text = dedup.shingles(pa.array(texts))
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(shingle_set(t)) for t in texts]


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    shared, a, b = (draw.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    value = np.concatenate([shared, a, shared, b])
    signature = dedup.signatures(value, np.repeat([0, 1], 800), 3)
    assert abs((signature[0] == signature[1]).mean() - 0.6) < 0.15
    assert (signature[2] == np.iinfo(np.int32).max).all()


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(3, 3)], [(5, 1), (1, 5), (2, 9), (9, 5), (7, 8)]])
def test_components(spark, links):
    found = dict(map(tuple, roots(table(spark, "a bigint, b bigint", *links)).collect()))
    nodes = {x for link in links for x in link}
    group = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert {x: found.get(x, x) for x in nodes} == group


def test_many_short_texts_are_dealt_into_small_cells(spark, monkeypatch):
    def watched(cells, percent, whole=dedup._alike):
        most = max((sum(map(len, cell)) for cell in cells.to_pylist()), default=0)
        if most > 300:
            raise ValueError(f"{most} classes in a cell")
        return whole(cells, percent)

    monkeypatch.setattr(dedup, "CLASSES", 100, raising=False)
    monkeypatch.setattr(dedup, "_alike", watched)
    ten = "each of these ten words but the last is alike"
    rows = [(i, f"{ten} x{i}") for i in range(500)]
    rows += [(500 + i, f"{ten} y{i // 2} " + " ".join(f"z{j}" for j in range(i // 2 * 90, i // 2 * 90 + 90)) + f" q{i}") for i in range(20)]
    assert rows_of(dedup.report(table(spark, "doc_id bigint, text string", *rows))) == plain(rows)


@pytest.mark.parametrize("strip", [1, 7, 256])
@pytest.mark.parametrize("sides", [1, 2])
def test_strips_of_a_cell_find_the_same_links(monkeypatch, strip, sides):
    monkeypatch.setattr(dedup, "STRIP", strip, raising=False)
    monkeypatch.setattr(dedup, "COLUMNS", 5)
    draw = random.Random(3)
    cells = []
    for _ in range(3):
        classes = [{"node": draw.randrange(10**9), "root": draw.randrange(9), "set": sorted(draw.sample(range(12), draw.randint(9, 12)))} for _ in range(30)]
        cells.append([classes[i::sides] for i in range(sides)])
    kind = pa.list_(pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64()), ("set", pa.list_(pa.int64()))])))
    for cell, found in zip(cells, dedup._alike(pa.array(cells, kind), 85).to_pylist(), strict=True):
        own = {c["node"]: (side, c["root"], set(c["set"])) for side, some in enumerate(cell) for c in some}

        def linked(a, b):
            both = len(a[2] & b[2])
            return 100 * both >= 85 * len(a[2] | b[2]) and (sides == 1 or a[0] != b[0])

        pairs = {(a[1], b[1]) for a in own.values() for b in own.values() if a[1] < b[1] and linked(a, b)}
        assert sorted((own[x["a"]][1], own[x["b"]][1]) for x in found) == sorted(pairs)
        assert all(linked(own[x["a"]], own[x["b"]]) for x in found)


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_that_collide_under_powers(spark, n):
    """Two long words with nothing in common, but with equal sums of powers of any odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    rows = [(1, one), (2, two), (3, f"{one} {two}"), (4, one)]
    found = rows_of(dedup.report(table(spark, "doc_id bigint, text string", *rows)))
    assert found == plain(rows)


def test_rows_without_id_meet_their_own_copies_only(spark):
    """Many alike texts without id: each set is made once for its copies, not once for all rows."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(None, edited(words, draw, 1)) for _ in range(80)] + [(5, edited(words, draw, 1)), (5, "a b c d e f")]
    docs = table(spark, "doc_id bigint, text string", *rows)
    shaped = dedup.shapes(docs)
    nodes = shaped.select("node").distinct()
    assert dedup.full_sets(docs, shaped, nodes).count() == nodes.count()
    assert rows_of(dedup.report(docs)) == plain(rows)


def test_sets_are_made_after_the_join(spark, monkeypatch):
    plans = []
    settled = dedup.settled
    monkeypatch.setattr(
        dedup, "settled", lambda f: plans.append(f._jdf.queryExecution().executedPlan().toString()) or settled(f)
    )
    dedup.report(spark.read.parquet(f"{SF_0001}/documents.parquet")).collect()
    assert all(p.count("ArrowEvalPython") <= 1 for p in plans)
