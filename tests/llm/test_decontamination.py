from __future__ import annotations

import random
import re

from frames import CLASHES, empty, odd, rows_of, table
from pyspark.sql import functions as F

from uptakelens.llm import decontamination as search


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def shingles(text):
    """An item's runs of five words, or its words as one run."""
    words = words_of(text)
    return runs(words, min(5, len(words))) if words else set()


def plain(docs, items):
    own = {}
    for doc_id, text in docs:
        if doc_id is not None:
            found = own.setdefault(doc_id, set())
            for k in range(1, 6):
                found |= runs(words_of(text), k)
    out = []
    for item_id, text in items:
        key = shingles(text)
        for doc_id, found in own.items() if item_id is not None and key else ():
            n = len(key & found)
            if n * 100 >= 80 * len(key):
                out.append((doc_id, item_id, len(key), n, n / len(key)))
    return sorted(out, key=repr)


def test_planted_items_of_all_sizes(spark):
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 6, 7, 9, 14, 14, 30, 60, 200])]
    items += [(50, items[7][1].upper() + "!"), (51, None), (52, ""), (None, "no id but some words here"), (53, "?!")]
    docs = []
    for i in range(120):
        words = [word() for _ in range(draw.choice([0, 3, 50, 2000]))]
        item = draw.choice(items)[1] or ""
        part = item.split()
        for _ in range(draw.randint(0, 3)):
            if part and draw.random() < 0.5:
                part[draw.randrange(len(part))] = "changed"
        docs.append((i, ", ".join(words[:25]) + "\n" + " ".join(part) + " — " + " ".join(words[25:])))
    docs += [(130 + i, text) for i, (_, text) in enumerate(items)]
    expected = plain(docs, items)
    found = search.leaks(
        table(spark, "doc_id bigint, text string", *docs).withColumns({c: F.lit(1) for c in CLASHES}),
        table(spark, "item_id bigint, text string", *items).withColumns({c: F.lit(1) for c in CLASHES}),
    )
    assert rows_of(found) == expected
    assert len({r[1] for r in expected}) > 8


def test_odd_documents(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog"), (2, "one two"), (3, "x" * 150_000)]
    docs = odd(spark)
    table_ = table(spark, "item_id bigint, text string", *items)
    found = rows_of(search.leaks(docs, table_))
    assert found == plain([(r[0], r[1]) for r in odd(spark, extra=False).collect()], items)
    kept = search.clean(docs, table_)
    assert kept.columns == docs.columns
    alone = {i: plain([(1, r[1])], items) for i, r in enumerate(odd(spark, extra=False).collect())}
    assert kept.count() == sum(not leaked for leaked in alone.values())


def test_short_items_inside_long_documents(spark):
    items = [(1, "Alpha, beta gamma delta!"), (2, "zeta eta"), (3, "eta ZETA"), (4, "solo"), (5, "alpha beta gamma delta")]
    docs = [
        (1, "some words alpha beta gamma delta and more of them"), (2, "alpha beta gamma, no delta here"),
        (3, "x zeta eta y"), (4, "a solo part"), (5, "zeta"), (None, "a solo part"), (6, None),
    ]
    args = table(spark, "doc_id bigint, text string", *docs), table(spark, "item_id bigint, text string", *items)
    found = rows_of(search.leaks(*args))
    assert found == plain(docs, items)
    assert {(r[0], r[1]) for r in found} == {(1, 1), (1, 5), (3, 2), (4, 4)}
    kept = {(r.doc_id, r.text) for r in search.clean(*args).collect()}
    assert kept == {docs[1], docs[4], docs[6]}  # the row without id is dropped too


def test_rows_of_one_id_are_judged_by_themselves(spark):
    items = table(spark, "item_id bigint, text string", (1, "a b c d e f g"))
    docs = [(7, "a b c d e f g"), (7, "something else entirely here now"), (7, "something else entirely here now")]
    kept = search.clean(table(spark, "doc_id bigint, text string", *docs), items).collect()
    assert sorted(map(tuple, kept)) == docs[1:]


def test_empty_tables(spark):
    items = table(spark, "item_id bigint, text string", (1, "a b c d e"))
    assert search.leaks(empty(spark), items).collect() == []
    assert search.leaks(odd(spark), items.filter("false")).collect() == []
