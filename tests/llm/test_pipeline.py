"""The pipeline's stages against plain versions of them, each on its own input."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
from frames import odd, table
from helpers import SF_0001
from test_decontamination import plain as plain_leaks
from test_line_dedup import plain as plain_lines
from test_minhash_dedup import shingle_set

import corpus_pipeline as pipeline
from uptakelens.llm import language_id, line_dedup, pieces, sentencepiece_codec

STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF_0001}/documents.parquet")


def texts(frame):
    return sorted(map(tuple, frame.select("doc_id", "text").collect()), key=repr)


def run(spark, name, docs):
    out = STAGES[name](spark, docs, SF_0001)
    assert out.columns == docs.columns
    return out


def groups_of(rows):
    """The rows in groups of near copies, every pair compared; rows without words by themselves."""
    sets = [shingle_set(text) for _, text in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= 85 * (len(a) + len(sets[j]) - shared):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [[r for r, g in zip(rows, group, strict=True) if g == k] for k in set(group)]


def check_stages(spark, docs):
    rows = texts(docs)
    kept = run(spark, "language_id", docs)
    model = language_id.train(docs, language_id.training_fold())
    n_phrases, size = language_id.phrases(model, pa.array([r[1] for r in rows], pa.string()))
    known = [s < 40 or min(p) < 0.9 * s for p, s in zip(n_phrases.tolist(), size.tolist(), strict=True)]
    lettered = [bool(re.search(r"[^\W\d_]", r[1] or "")) for r in rows]
    assert texts(kept) == [r for r, a, b in zip(rows, lettered, known, strict=True) if a and b]

    rows = [tuple(r) for r in kept.select("doc_id", "text", "source").collect()]
    expected = [
        (doc_id, text)
        for doc_id, text, _, removed in plain_lines(rows, line_dedup.MIN_SITES)
        if not removed or text.strip()
    ]
    kept = run(spark, "line_dedup", kept).cache()
    assert texts(kept) == sorted(expected, key=repr)
    assert all(r.n_chars == len(r.text) for r in kept.collect())

    rows = texts(kept)
    kept = run(spark, "near_dedup", kept).cache()
    found = texts(kept)
    groups = groups_of(rows)
    assert len(found) == sum(1 if shingle_set(g[0][1]) else len(g) for g in groups)
    for group in groups:
        stay = [r for r in found if r in group]
        least = min(group, key=lambda r: (r[0] is None, r[0] or 0))
        if shingle_set(group[0][1]):
            assert len(stay) == 1 and stay[0][0] == least[0]
        else:
            assert sorted(stay, key=repr) == sorted(group, key=repr)

    items = [tuple(r) for r in spark.read.parquet(f"{SF_0001}/benchmark.parquet").collect()]
    kept = run(spark, "decontamination", kept)
    assert texts(kept) == [r for r in found if not plain_leaks([(1, r[1])], items)]

    words = pieces.Vocabulary(sentencepiece_codec.read_model())
    out = STAGES["encoding"](spark, kept, SF_0001)
    decoded = sorted(((r.doc_id, words.decode(list(r.ids))) for r in out.collect()), key=repr)
    assert decoded == texts(kept)
    return out


def test_stages_on_given_documents(spark, given):
    out = check_stages(spark, given)
    whole = pipeline.run(spark, SF_0001)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, out.collect()))


def test_stages_on_odd_documents(spark):
    check_stages(spark, odd(spark))


def test_stages_on_no_documents(spark, given):
    docs = given.filter("false")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF_0001)
        assert out.count() == 0
        docs = out if name != "encoding" else docs


def test_a_foreign_language_goes_and_short_texts_stay(spark, given):
    texts_ = {
        100_001: "Привет мир это довольно длинный текст на русском языке для проверки",
        100_002: "これは日本語で書かれたかなり長い文章です。" * 5,
        100_003: "hi the",
    }
    more = table(spark, "doc_id bigint, text string", *texts_.items())
    docs = given.unionByName(more, allowMissingColumns=True)
    kept = {r.doc_id for r in run(spark, "language_id", docs).select("doc_id").collect()}
    assert 100_003 in kept and not {100_001, 100_002} & kept
    assert kept >= {r.doc_id for r in given.filter(r"text rlike '[a-z]{3}'").collect()}


def test_a_copy_takes_no_other_text_of_its_id_along(spark):
    copy = "the same words again and again in both of these"
    rows = [(1, copy), (2, copy), (2, "a clean text that has nothing to do with the others"), (None, copy), (3, copy), (1, copy)]
    docs = table(spark, "doc_id bigint, text string", *rows)
    assert texts(STAGES["near_dedup"](spark, docs, SF_0001)) == [rows[0], rows[2]]
