from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from frames import PLAIN, empty, odd, rows_of, table
from helpers import SF_001

from uptakelens.llm import personal_data as pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits: str) -> bool:
    double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in double) % 10 == 0


def base(text: str | None) -> list[tuple[int, int, int]]:
    """The contract's patterns, word for word."""
    tests = [
        lambda s: True,
        lambda s: all(int(x) <= 255 for x in s.split(".")),
        lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d),
        lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15,
    ]
    return [
        (k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if tests[k](m[0])
    ]


def printed(spans) -> str:
    return ",".join(f"{pii.KINDS[k]}:{b}:{e}" for k, b, e in spans)


def check(rows, texts):
    for row in rows:
        expected = base(texts[row.doc_id])
        counts = [row.n_email, row.n_ip, row.n_card, row.n_phone]
        assert counts == [sum(s[0] == k for s in expected) for k in range(4)]
        assert row.base_sha256 == hashlib.sha256(printed(expected).encode()).hexdigest()
        assert not expected or set(printed(expected).split(",")) <= set(row.spans.split(","))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_001}/documents.parquet")
    rows = pii.report(docs).collect()
    assert len(rows) == docs.count()
    check(rows, dict(docs.select("doc_id", "text").collect()))
    assert all(sum(r[f"n_{k}"] for r in rows) for k in pii.KINDS[: pii.BASE])


PIECES = [
    "a@b.c", "x.y@", "@", ".", "_", "%+-", "a", "é", "@b", ".c", " ", "-", "1", "255", "256", "0007", "1.2.3.4", "1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "(", ")", "12345678901234567890", "\n", "00",
]


def test_base_spans_of_random_texts():
    draw = random.Random(7)
    for _ in range(4000):
        text = "".join(draw.choices(PIECES, k=draw.randint(1, 14)))
        assert sorted(pii.base_spans(text)) == sorted(base(text)), text


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "a@", "+1 ", "@", "a.", "((", "Dr. A", "x at y "])
def test_very_long_texts_take_linear_time(unit):
    text = unit * (400_000 // len(unit))
    begun = time.time()
    pii.nodes(text, pii.base_spans(text))
    assert time.time() - begun < 20


@pytest.fixture(scope="module")
def weights(spark):
    return pii.train(spark.read.parquet(f"{SF_001}/documents.parquet"))


def added(text: str, weights) -> list[tuple[str, str]]:
    return [(pii.KINDS[k], text[b:e]) for k, b, e, new in pii.found_in([text], weights)[0] if new]


def test_held_out_mentions(spark, weights):
    """Mentions set into other texts than those of the fit are found, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id BETWEEN 5000 AND 5600")
    texts = [r.text[:1500] for r in docs.select("text").collect() if r.text]
    made = pii.labelled(texts, seed=99)
    right = wrong = missed = 0
    for (text, spans), found in zip(made, pii.found_in([t for t, _ in made], weights), strict=True):
        nodes = pii.nodes(text, pii.base_spans(text))
        for x, true in zip(nodes, pii.truth(nodes, spans), strict=True):
            if x.fixed >= 0:
                continue
            got = next((k + 1 for k, b, e, new in found if new and b <= x.begin and e >= x.end), 0)
            right += got == true > 0
            wrong += got not in (0, true)
            missed += got != true and true > 0
    assert right > 1000
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_labels_agree_over_distance(weights):
    far = " lorem ipsum dolor sit amet" * 400
    text = f"phone: +49 (030) 555-7713 here{far} and (030) 555-7713 again{far} 030 555 7713 there."
    assert added(text, weights) == [("phone", "(030) 555-7713"), ("phone", "030 555 7713")]
    text = f"we met Dr. Zoravi yesterday{far} then saw Zoravi in town{far} with Zoravi again"
    assert added(text, weights) == [("person", "Zoravi")] * 3
    text = f"write to kaluso.17@ranu.org now{far} or to kaluso.17 at ranu dot org later"
    assert added(text, weights) == [("email", "kaluso.17 at ranu dot org")]


def test_clean_texts_stay_clean(weights):
    for text in (PLAIN, "Order 10293847 of 2024-03-12, 1,234,567 pieces, see page 12.", "At home. Then in Lyon, dot by dot.", ""):
        assert added(text, weights) == []


def test_masked(spark, weights):
    docs = table(spark, "doc_id bigint, text string", (1, "to a.b@c.org, 10.0.0.1."), (2, None), (3, PLAIN))
    assert rows_of(pii.masked(docs, weights)) == [(1, "to [EMAIL], [IP]."), (2, None), (3, PLAIN)]


def test_odd_documents(spark):
    rows = pii.report(odd(spark)).collect()
    assert len(rows) == 16 and rows_of(pii.report(odd(spark, extra=False))) == sorted(map(tuple, rows), key=repr)
    assert all(r.spans == "" for r in rows)
    assert pii.report(empty(spark)).collect() == []
