from __future__ import annotations

import random

import pyarrow as pa
from frames import empty, odd, rows_of
from helpers import SF_001
from pyspark.sql import functions as F

from uptakelens.llm import language_id, ragged


def greedy(text: bytes, sample: bytes) -> int:
    """Phrases of a text cut at every STRETCH symbols, by plain search."""
    count = 0
    for k in range(0, len(text), language_id.STRETCH):
        part, i = text[k : k + language_id.STRETCH], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i = max(i + 1, j - 1)
            count += 1
    return count


def test_phrases_equal_plain_search():
    draw = random.Random(4)
    samples = tuple(bytes(draw.choice(b"abc ") for _ in range(300)) for _ in range(3))
    model = language_id.LanguageModel(("x", "y", "z"), samples)
    texts = ["".join(draw.choice("abcd e") for _ in range(n)) for n in (1, 7, 100, 511, 512, 513, 2000)]
    total, size = language_id.phrases(model, pa.array(texts))
    for text, found, n in zip(texts, total, size, strict=True):
        data, at = language_id.symbols(*ragged.utf8(pa.array([text])))
        assert n == len(data)
        assert found.tolist() == [greedy(data.tobytes(), s) for s in samples]


def test_symbols_join_gaps_within_texts_only():
    data, at = language_id.symbols(*ragged.utf8(pa.array(["A, b", "", " .C", None])))
    assert [data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] == [b"a b", b"", b" c", b""]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_001}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(rows) == docs.count() and len(held) > 200
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_label_and_id_of_a_text_do_not_count(spark):
    docs = spark.read.parquet(f"{SF_001}/documents.parquet").limit(300)
    model = language_id.train(docs, language_id.training_fold())
    plain = rows_of(language_id.with_language(docs, model).select("text", "lang_pred", "score"))
    other = docs.withColumns({"lang": F.lit("de"), "doc_id": F.col("doc_id") + 7})
    assert rows_of(language_id.with_language(other, model).select("text", "lang_pred", "score")) == plain


def test_odd_documents(spark):
    rows = rows_of(language_id.identify(odd(spark)))
    assert rows == rows_of(language_id.identify(odd(spark, extra=False)))
    assert len(rows) == 16
    by_id = {r[0]: r for r in rows}
    for i in (3, 4, 5, 6):
        assert by_id[i][2:] == ("und", 0.0)
    assert by_id[10][2] != "und" and by_id[8][2] != "und"
    assert language_id.identify(empty(spark)).collect() == []


def test_nothing_learned(spark):
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(docs).collect()} == {"und"}
