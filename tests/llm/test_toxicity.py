from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from frames import LONG, empty, odd, rows_of, table
from helpers import SF_001, SF_01
from pyspark.sql import functions as F

from uptakelens.llm import toxicity


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{SF_001}/documents.parquet")
    return docs, spark.read.parquet(f"{SF_001}/labels.parquet")


def test_held_out_scores(spark):
    docs = spark.read.parquet(f"{SF_01}/documents.parquet")
    labels = spark.read.parquet(f"{SF_01}/labels.parquet")
    rows = toxicity.report(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    bad, good = ([r.score for r in held if r.toxic == x] for x in (1, 0))
    better = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert better > 0.97
    assert sum(s >= 0.3 for s in bad) > 0.8 * len(bad)
    assert sum(s >= 0.3 for s in good) < 0.02 * len(good)
    # calibrated: among held-out rows of like scores, so many are toxic as the scores say
    held.sort(key=lambda r: r.score)
    for part in np.array_split(np.array([(r.score, r.toxic) for r in held]), 5):
        assert abs(part[:, 0].mean() - part[:, 1].mean()) < 0.05


def test_labels_of_the_held_out_part_do_not_count(spark, given):
    docs, labels = given
    fold = toxicity.training_fold()
    other = labels.withColumn("toxic", F.expr(f"if({fold}, toxic, 1 - toxic)"))
    assert rows_of(toxicity.report(docs, labels)) == rows_of(toxicity.report(docs, other))


LEXICON = toxicity.lexicon_of(["idiot", "scum"], [1.0, 0.5])


def feature(text):
    return dict(zip(toxicity.FEATURES, toxicity.features(pa.array([text], pa.string()), LEXICON)[0], strict=True))


def test_features():
    f = feature("You IDIOT! you scum, 1d10t and id1ot$. What??? sooo")
    assert f["lexicon_hits"] == 2 and f["strongest"] == 1.0 and f["person_near"] == 2
    assert f["disguised_hits"] == 1 and f["capital_word_rate"] > 0 and f["repeat_rate"] > 0
    assert f["question_rate"] == 3 / 51 and f["exclamation_rate"] == 1 / 51
    far = feature("you " + "word " * 20 + "idiot")
    assert far["lexicon_hits"] == 1 and far["person_near"] == 0
    assert not any(feature("").values()) and not any(feature(None).values())


def plain(text, lexicon):
    """The features by their definitions, byte by byte and word by word."""
    raw = (text or "").encode()
    low = bytes(b | 32 if 65 <= b <= 90 else b for b in raw)
    size = max(len(raw), 1)
    letters = [97 <= b <= 122 or b >= 128 for b in low]
    runs, begin = [], None
    for i, x in enumerate([*letters, False]):
        if x and begin is None:
            begin = i
        if not x and begin is not None:
            runs.append((begin, i))
            begin = None
    words = [low[b:e].decode("utf-8", "replace") for b, e in runs]
    weights = [lexicon.get(w, 0) for w in words]
    persons = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = sum(w > 0 and any(abs(i - p) <= toxicity.REACH for p in persons) for i, w in enumerate(weights))
    shouted = sum(e - b > 1 and all(65 <= c <= 90 for c in raw[b:e]) for b, e in runs)
    tokens = [t for t in re.split(rb"[ \x09-\x0d]+", raw) if t]
    odd_signs = b"#$%&*@^~_|<>+=" + b"0123456789" + b"!"
    mixed = [
        t for t in tokens
        if any(c in odd_signs for c in t) and any(97 <= (c | 32) <= 122 and c < 128 or c >= 128 for c in t)
    ]
    undo = {ord(a): ord(b) for a, b in toxicity.DISGUISES.items()}
    undone = [bytes(undo.get(c | 32 if 65 <= c <= 90 else c, c | 32 if 65 <= c <= 90 else c) for c in t) for t in mixed]
    repeats = sum(
        letters[i] and low[i] == low[i - 1] == low[i - 2] for i in range(2, len(low))
    )

    def rate(signs):
        return sum(c in signs for c in raw) / size

    n = max(len(words), 1)
    hits = sum(w > 0 for w in weights)
    return [
        hits / n, hits, max(weights, default=0), sum(weights) / n,
        sum(lexicon.get(t.decode("utf-8", "replace"), 0) > 0 for t in undone), near, len(persons) / n,
        sum(65 <= c <= 90 for c in raw) / size, shouted / n, rate(b".,;:!?'\"()-"), rate(b"!"), rate(b"?"),
        rate(b"#$%&*@^~_|<>+="), rate(b"0123456789"), repeats / size, len(mixed) / max(len(tokens), 1), len(words),
    ]


def test_features_by_brute_force():
    draw = random.Random(4)
    parts = [
        "you", "You", "idiot", "IDIOT", "scum", "1d10t", "id!ot", "$cum", "SCUM!!", "plain", "words", "sooo", "du", "vous",
        "é", "Über", "日本", "42", "a1", "#tag", "...", "?!", "\n", "\t", "x", "OK", "UN",
    ]
    texts = ["", None, " ", "idiot"]
    texts += ["".join(draw.choice(parts) + draw.choice(["", " ", " ", ", "]) for _ in range(draw.randint(1, 40))) for _ in range(300)]
    found = toxicity.features(pa.array(texts, pa.string()), LEXICON)
    for text, row in zip(texts, found, strict=True):
        expected = plain(text, {"idiot": 1.0, "scum": 0.5})
        assert row.tolist() == pytest.approx(expected), (text, dict(zip(toxicity.FEATURES, zip(row, expected), strict=True)))


def test_texts_of_a_batch_do_not_touch():
    texts = ["end you", "idiot begins", "", None, LONG, "IDIOT", "é" * 1000, "a" * 100_000]
    alone = np.concatenate([toxicity.features(pa.array([t], pa.string()), LEXICON) for t in texts])
    assert np.array_equal(toxicity.features(pa.array(texts), LEXICON), alone)


def test_odd_documents(spark, given):
    model = toxicity.train(*given)
    rows = rows_of(toxicity.scores(odd(spark), model))
    assert len(rows) == 16 and rows == rows_of(toxicity.scores(odd(spark, extra=False), model))
    assert len({r[1] for r in rows if r[0] in (3, 4)}) == 1
    assert toxicity.scores(empty(spark), model).collect() == []


def test_without_both_classes(spark):
    labels = table(spark, "doc_id bigint, toxic int, quality int", (1, 1, 0), (2, 1, 0), (7, None, 1), (None, 0, 0))
    assert {r.score for r in toxicity.report(odd(spark), labels.filter("false")).collect()} == {0.0}
    only = toxicity.train(odd(spark), labels)
    assert only.trees is None and only.constant == 1.0
