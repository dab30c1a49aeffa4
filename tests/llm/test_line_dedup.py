from __future__ import annotations

from collections import defaultdict

import pytest
from frames import empty, odd, rows_of, table

from uptakelens.llm import line_dedup

SCHEMA = "doc_id bigint, text string, source string, line string, gone string"


def plain(rows, min_sites, min_chars=line_dedup.MIN_CHARS):
    """The operator's rule, line by line."""
    sites, first = defaultdict(set), {}
    for doc_id, text, source in rows:
        for place, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip(" ")
            if len(line) >= min_chars:
                sites[line] |= {source} - {None}
                where = (doc_id is not None, doc_id or 0, place)
                first[line] = min(first.get(line, where), where)
    out = []
    for doc_id, text, _ in rows:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [
            x for place, x in enumerate(lines)
            if len(x.strip(" ")) < min_chars
            or len(sites[x.strip(" ")]) < min_sites
            or first[x.strip(" ")] == (doc_id is not None, doc_id or 0, place)
        ]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def site_rows():
    rows = []
    for i in range(120):
        lines = [f"own line of document {i}", "seen on all of the sites", "  seen on all of the sites "]
        lines += [f"spread over {k} sites, about" for k in range(1, 16) if i % 30 < k]
        rows.append((i, "\n".join(lines + ["short", ""]), f"site{i % 30}"))
    return rows + [(200, "seen on all of the sites", None), (None, "seen on all of the sites", "site1"), (201, "seen on all of the sites", "site2")]


@pytest.mark.parametrize("near", [0.0, 0.25, 10.0])
def test_estimated_and_exact_counts_agree_with_plain(spark, monkeypatch, near):
    monkeypatch.setattr(line_dedup, "NEAR", near)
    rows = site_rows()
    docs = table(spark, SCHEMA, *((*r, "x", "y") for r in rows))
    found = line_dedup.without_boilerplate(docs, 8).select("doc_id", "text", "n_lines", "n_removed")
    assert rows_of(found) == plain(rows, 8)


def test_columns_stay(spark):
    docs = table(spark, SCHEMA, *((*r, "x", "y") for r in site_rows()))
    found = line_dedup.without_boilerplate(docs, 8)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {(r.line, r.gone) for r in found.collect()} == {("x", "y")}


def test_odd_documents(spark):
    rows = [(r[0], r[1], r[3]) for r in odd(spark, extra=False).collect()]
    found = line_dedup.without_boilerplate(odd(spark), 2).select("doc_id", "text", "n_lines", "n_removed")
    assert rows_of(found) == plain(rows, 2)
    assert line_dedup.report(empty(spark)).collect() == []


def test_few_lines_are_settled_in_few_files(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files = {k: spark.conf.get(k) for k in held}, []

    def counted(frame):
        out = settled(frame)
        files.append(out.rdd.getNumPartitions())
        return out

    settled = line_dedup.settled
    monkeypatch.setattr(line_dedup, "settled", counted)
    rows = site_rows()
    docs = table(spark, SCHEMA, *((*r, "x", "y") for r in rows)).coalesce(2)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = line_dedup.without_boilerplate(docs, 8).select("doc_id", "text", "n_lines", "n_removed")
        assert rows_of(found) == plain(rows, 8)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) == 3
    assert max(files) <= 1 + 96 // line_dedup.FILES
