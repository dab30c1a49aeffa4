from __future__ import annotations

import hashlib
import random
import re

import pytest
import zstandard
from frames import empty, odd, rows_of, table
from helpers import SF_001

from uptakelens.llm import fill_in_middle as fim


def draws(doc_id: int | None) -> list[int]:
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]


def plain(doc_id: int | None, text: str | None) -> tuple:
    """n, form, prefix, middle, suffix and output by the definition."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, (h1, h2, h3, h4) = len(units), draws(doc_id)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def expected(doc_id, text):
    n, form, p, m, output = plain(doc_id, text)
    return (doc_id, n, form, p, m, sha(output), sha(text))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_001}/documents.parquet")
    texts = docs.select("doc_id", "text").collect()
    rows = rows_of(fim.report(docs))
    assert rows == sorted((expected(*r) for r in texts), key=repr)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_outputs_are_compressed_streams_of_the_text(spark):
    texts = {i: f"{'word ' * (i * 3000)}end {i}" for i in range(12)}
    rows = fim.transformed(table(spark, "doc_id bigint, text string", *texts.items())).collect()
    for row in rows:
        reader = zstandard.ZstdDecompressor().stream_reader(row.output, read_across_frames=True)
        assert reader.read().decode() == plain(row.doc_id, texts[row.doc_id])[4]


def test_odd_documents(spark):
    rows = odd(spark).select("doc_id", "text").collect()
    assert rows_of(fim.report(odd(spark))) == sorted((expected(*r) for r in rows), key=repr)
    assert fim.report(empty(spark)).collect() == []


PIECES = ["a", "Word", "longerword" * 3, " ", "\n", "é", "日本", "😀", "<", ">", "<P", "S>", "1", "M"]


@pytest.mark.parametrize("most", [4, 7, 64])
def test_small_frames(most):
    draw = random.Random(most)
    opened = 0
    for _ in range(150):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(1, 30)))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        store = fim.stored(text, most)
        kept = store["frames"]
        assert store["n"] == len(units) and sum(f["chars"] for f in kept) == len(text)
        assert b"".join(fim._unpack(f["data"]) for f in kept) == text.encode()
        low, high = sorted(draw.randint(0, len(units)) for _ in range(2))
        if store["marked"]:
            continue
        p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        for form, whole in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}"), ("plain", text)):
            output, *chars = fim.rearranged(kept, form, low, high)
            assert b"".join(map(fim._unpack, output)).decode() == whole
            assert chars == ([None, None] if form == "plain" else [len(p), len(m)])
            assert b"".join(fim.rebuilt(output, form)).decode() == text
            opened += 1
    assert opened > 200


def test_choosing_the_parts_opens_only_the_cut_frames(monkeypatch):
    kept = fim.stored("ab cd " * 5000, 1000)["frames"]
    opened, unpack = [], fim._unpack
    monkeypatch.setattr(fim, "_unpack", lambda data: opened.append(data) or unpack(data))
    fim.rearranged(kept, "psm", 7001, 13003)
    assert len(kept) > 25 and len(set(opened)) <= 4
