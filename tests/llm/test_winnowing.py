from __future__ import annotations

import hashlib
import random
import re

from frames import empty, odd, rows_of, table
from helpers import SF_0001

from uptakelens.llm import winnowing


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def places(printed):
    return [(int(p), h) for p, _, h in (x.partition(":") for x in printed.split())]


def edits(rows):
    """Edited text of each row, in the order of the contract; ids must differ."""
    chain = sorted(rows, key=lambda r: -r[0])
    for i, (doc_id, text) in enumerate(chain):
        after = chain[(i + 1) % len(chain)][1] or ""
        text = text or ""
        half = len(text) // 2
        yield doc_id, text, text[: len(text) - half] + after[:half], after


def check(rows, found):
    found = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    by_text = {}
    for doc_id, text, edited, after in edits(rows):
        row = found[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(text, set()).add(row.fingerprint)
        sets = [{h for _, h in places(p)} for p in (row.fingerprint, row.edited_fingerprint)]
        like = len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0
        assert abs(row.near_edited - like) < 1e-12
        assert bool(row.fingerprint) == bool(words(text))
    for fingerprints in by_text.values():
        assert len(fingerprints) == 1
    for doc_id, _, _, after in edits(rows):
        a = {h for _, h in places(found[doc_id].fingerprint)}
        (next_print,) = by_text[after]
        b = {h for _, h in places(next_print)}
        like = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(found[doc_id].near_next - like) < 1e-12


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_0001}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, winnowing.report(docs).collect())


def test_ids_far_apart_and_small_blocks(spark):
    draw = random.Random(2)
    ids = [draw.randrange(-(2**40), 2**40) for _ in range(150)] + list(range(150))
    rows = [(i, " ".join(f"w{draw.randrange(40)}" for _ in range(draw.randrange(60)))) for i in set(ids)]
    docs = table(spark, "doc_id bigint, text string", *rows)
    found = winnowing.report(docs, block=7)
    check(rows, found.collect())
    assert rows_of(found) == rows_of(winnowing.report(docs, block=100_000))


def test_selection_is_the_rightmost_minimum_of_each_window(spark):
    draw = random.Random(9)
    k, window = 2, 4
    texts = [" ".join(draw.choice("ab") for _ in range(n)) for n in (1, 2, 3, 5, 6, 40, 300)]
    frame = table(spark, "id int, text string", *enumerate(texts))
    got = winnowing.with_fingerprint(frame, "text", "picks", k, window)
    got = got.selectExpr("id", f"{winnowing.printed('picks')} AS f").collect()
    grams = {tuple(w[i : i + k]) for w in (t.split() for t in texts) for i in range(max(1, len(w) - k + 1))}
    names = table(spark, "a string, b string", *((*g, None)[:2] for g in grams))
    mask = f"{~winnowing._PLACES}L"
    order = {tuple(x for x in r[:2] if x): r[2] for r in names.selectExpr("a", "b", f"xxhash64(a, b) & {mask}").collect()}
    for row in got:
        own = texts[row.id].split()
        hashes = [order[tuple(own[i : i + k])] for i in range(max(1, len(own) - k + 1))]
        expected = []
        for j in range(max(1, len(hashes) - window + 1)):
            part = hashes[j : j + window]
            at = j + max(i for i, h in enumerate(part) if h == min(part))
            if at not in expected:
                expected.append(at)
        assert [p for p, _ in places(row.f)] == expected


def test_shared_runs_share_a_hash(spark):
    draw = random.Random(3)
    run = [f"s{i}" for i in range(winnowing.GRAM + winnowing.WINDOW - 1)]
    rows = []
    for i in range(40):
        a, b = ([f"{i}{c}{draw.random()}" for _ in range(draw.randrange(50))] for c in "ab")
        rows.append((i, " ".join(a + run + b)))
    found = winnowing.report(table(spark, "doc_id bigint, text string", *rows)).collect()
    sets = [{h for _, h in places(r.fingerprint)} for r in found]
    assert all(a & b for a in sets for b in sets)


def test_odd_documents(spark):
    docs = odd(spark)
    rows = rows_of(winnowing.report(docs, block=3))
    assert len(rows) == 16 and rows == rows_of(winnowing.report(odd(spark, extra=False)))
    unique = docs.filter("doc_id NOT IN (11, 12)").select("doc_id", "text", "score")
    check([tuple(r)[:2] for r in unique.collect()], winnowing.report(unique).collect())
    assert winnowing.report(empty(spark)).collect() == []
    one = table(spark, "doc_id bigint, text string", (5, "only one document here, abc"))
    check([(5, "only one document here, abc")], winnowing.report(one).collect())
