from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from frames import empty, odd, rows_of, table

from uptakelens.llm import source_divergence as audit

DOCS = "lang string, source string, text string"


def plain(docs: list[tuple], min_docs: int, top: int) -> list[tuple]:
    """The definition, word by word, in Python integers."""
    n, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        n[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in {k[0] for k in n}:
        kept = [t for t, d in seen[lang].items() if d >= min_docs]
        own = {s: Counter({t: c[t] for t in kept}) for (g, s), c in n.items() if g == lang}
        whole = sum(own.values(), Counter())

        def shares(c, kept=kept):
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, i + 1) for i, x in enumerate(found[:most])]
    return sorted(out)


def found(spark, docs, **options):
    frame = table(spark, DOCS, *docs)
    return sorted(map(tuple, audit.report(frame, **options).collect()))


WORDS = [
    "a", "Be", "the", "exactly8", "eightabc", "ninebytes", "sixteenbyteslong", "seventeenbyteslon", "Ünïcödé",
    "日本語", "日本語日本語日本語", "x" * 40, "X" * 41, "x" * 41, "ÿ", "zz", "é", "É", " ", "don't", "😀",
]


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(spark, seed):
    draw = random.Random(seed)
    docs = []
    for _ in range(120):
        text = draw.choice([" ", "1", ".\n"]).join(draw.choice(WORDS) for _ in range(draw.randint(0, 25)))
        source = draw.choice(["hot"] * 3 + ["a", "b", None, "", "only numbers"])
        docs.append((draw.choice(["en", "de", None]), source, "12 34" if source == "only numbers" else text))
    rows = found(spark, docs, min_docs=4, top=6)
    assert rows == plain(docs, 4, 6)
    assert {r[2] for r in rows} == {"pair", "term"}


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"w{i}x" * (1 + i % 9) for i in range(60)]
    docs = [("en", f"s{i % 7}", " ".join(draw.choices(words, k=40))) for i in range(80)]
    docs.append(("en", "long", " ".join(draw.choices(words, k=3000))))
    rows = found(spark, docs, min_docs=3, top=9)
    assert rows == plain(docs, 3, 9)
    monkeypatch.setattr(audit, "CELLS", 16)
    assert found(spark, docs, min_docs=3, top=9) == rows


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(["short", "sixteenbyteslong", "y" * 50, "z" * 500] * 40).encode()
    monkeypatch.setattr(audit, "PIECE", 300)
    assert len(list(audit._pieces(np.frombuffer(text, np.uint8), 300))) == 40
    ((terms, _, n, docs),) = audit._long_text(np.frombuffer(text, np.uint8))
    assert dict(zip(terms.to_pylist(), n.tolist(), strict=True)) == Counter(text.decode().split())
    assert set(docs.tolist()) == {1}


def test_radix_order_is_stable():
    draw = np.random.default_rng(2)
    high, low = (draw.integers(0, 3, 500).astype(np.uint64) << np.uint64(s) for s in (61, 17))
    order = audit.radix_order([high, low])
    assert order.tolist() == sorted(range(500), key=lambda i: (high[i], low[i], i))


def test_no_kept_term_gives_zero_distances(spark):
    docs = [("en", "a", "one two"), ("en", "b", "two"), ("en", "c", None), ("fr", "a", "un")]
    rows = found(spark, docs)
    assert rows == plain(docs, 30, 50)
    assert len(rows) == 6 and all(r[2] == "pair" and r[4] == 0 for r in rows)


def test_odd_documents(spark):
    docs = [tuple(r) for r in odd(spark).select("lang", "source", "text").collect()]
    rows = rows_of(audit.report(odd(spark), min_docs=2))
    assert sorted(map(repr, rows)) == sorted(map(repr, plain(docs, 2, 50)))
    assert audit.report(empty(spark)).collect() == []
