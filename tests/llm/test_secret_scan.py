from __future__ import annotations

import hashlib
import random
import re

from frames import empty, odd, rows_of, table
from helpers import SF_001

from uptakelens.llm import secret_scan as scan

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text: str | None) -> list[tuple[int, str, int]]:
    """The contract's patterns, word for word."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(b, scan.KINDS[k], e) for b, k, e in sorted(found)]


def weak(text: str) -> set[tuple[str, int, int]]:
    """Weak parts with what they need, every pair compared."""
    parts = [(p["kind"], p["begin"], p["end"]) for p in scan.parts(text)]

    def near(part, kinds):
        return any(
            k in kinds and b <= part[2] + scan.SCOPE and e >= part[1] - scan.SCOPE for k, b, e in parts
        )

    out = set()
    for p in parts:
        if p[0] == 3 and near(p, {0, 2, 5}):
            out.add(("user", *p[1:]))
        if p[0] == 4 and near(p, {1, 3}) and near(p, {0, 2}):
            out.add(("endpoint", *p[1:]))
        if p[0] == 5 and near(p, {1, 3}):
            out.add(("blob", *p[1:]))
    return out


def printed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for b, k, e in spans)


def check(rows, texts):
    for row in rows:
        text = texts[row.doc_id]
        expected = base(text)
        assert row.n_assign == sum(k == "assign" for _, k, _ in expected)
        assert row.n_access == sum(k == "access" for _, k, _ in expected)
        assert row.n_hex == sum(k == "hex" for _, k, _ in expected)
        assert row.base_sha256 == hashlib.sha256(printed(expected).encode()).hexdigest()
        all_spans = expected + [(b, k, e) for k, b, e in weak(text or "")]
        all_spans.sort(key=lambda s: (s[0], scan.KINDS.index(s[1]), s[2]))
        assert row.spans == printed(all_spans)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_001}/documents.parquet")
    rows = scan.report(docs).collect()
    assert len(rows) == docs.count() and any(r.n_assign for r in rows)
    check(rows, dict(docs.select("doc_id", "text").collect()))


WORDS = [
    "password = hunter2secret", "Passwd:abc", "TOKEN='a.b-c_d/e+f='", 'api_key: "0123456789abcdef01234567"',
    "AKIA" + "Q7" * 8, "AKIASHORT", "deadbeef" * 3, "ABCDEF0123456789" * 2, "user=alice", "login: bob@x.org",
    "https://db.example.org:5432/x", "host = db1.internal.example", "Zm9vYmFyQmF6MTIzNDU2Nzg5MHF3ZXJ0eXVpb3A",
    "plain", "é日本", "ſecret = longenough", "toKen = kelvinvalue1", "secret secret = secret=abc",
]


def test_random_texts_with_linked_parts(spark):
    draw = random.Random(11)
    texts = {}
    for i in range(150):
        gap = [" ", "\n", " " * 150, " x" * 60, "." * 199]
        texts[i] = "".join(draw.choice(WORDS) + draw.choice(gap) for _ in range(draw.randint(0, 14)))
    rows = scan.report(table(spark, "doc_id bigint, text string", *texts.items())).collect()
    check(rows, texts)
    assert any("user" in r.spans for r in rows) and any("endpoint" in r.spans for r in rows)
    assert any("blob" in r.spans for r in rows)


def test_odd_documents(spark):
    rows = rows_of(scan.report(odd(spark)))
    assert len(rows) == 16 and rows == rows_of(scan.report(odd(spark, extra=False)))
    assert scan.report(empty(spark)).collect() == []


def test_weak_parts_of_any_length_and_prefix():
    user, host, blob = "DB_USER=" + "u" * 90, "DB_HOST=db.example.org:5432", "aB3/" * 500
    text = f"AKIA{'Q7' * 8} {user} {host} {blob}"
    found = {(scan.KINDS[p["kind"]], text[p["begin"] : p["end"]]) for p in scan.parts(text)}
    assert {("user", user[3:]), ("endpoint", host[3:]), ("blob", blob)} <= found
