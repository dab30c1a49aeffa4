"""Source divergence audit: how far the sources of a language differ in their words.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. Each task counts them by
length-bucketed packing: terms of up to 8 bytes become one uint64, of up to 16 bytes two, both
big-endian, so that numbers sort as bytes do; stable radix passes over 16-bit digits bring equal
terms together and leave their groups and documents in order, and the runs are counted. Longer
terms are sorted as bytes in a bucket for each length. Spark adds the tasks' counts up, keeps the
terms that at least MIN_DOCS documents of a language hold, and compares shares scaled to whole
numbers, so all sums are exact. Two sources are compared over blocks of terms: each block is a
small matrix of sources by terms, whose partial distances Spark adds up.

The result has a row for every ordered pair of sources of a language, and for each source the
TOP terms that it has most in excess of its language. The pairs are as many as the question has;
a block holds at most CELLS numbers (or one term).

A null text, lang or source is ''. A group without any kept term takes part with equal shares;
with no kept term in its language all its pairs have value 0. Repeated rows are documents of
their own; doc_id is not read. Ties rank by the item's UTF-8 bytes. An empty table gives an empty
result, further columns are ignored. A text of any length is counted in pieces of PIECE bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uptakelens.llm.ragged import lowered, released, slices, utf8, words
from uptakelens.llm.tables import settled, small_side

MIN_DOCS = 30
TOP = 50
#: Added to every count; parts in which shares are expressed.
PRIOR = 5
PARTS = 1_000_000_000
#: Bytes of text that are counted at a time.
PIECE = 4 << 20
#: Terms of a block, and numbers in its matrix.
BLOCK_TERMS = 4096
CELLS = 1 << 22

COUNTED = "lang string, source string, term string, n bigint, n_docs bigint"
GAP = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def radix_order(digits_of: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by uint64 columns, the first of them leading."""
    order = np.arange(len(digits_of[0]))
    for word in reversed(digits_of):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first `size` (up to 8) bytes from `begin` as big-endian numbers, zeros behind."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    wide = np.ndarray(len(data), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    blank = (8 * (8 - size)).astype(np.uint64)
    value = wide[np.minimum(begin, len(data) - 1)].astype(np.uint64)
    return np.where(size > 0, value >> blank << blank, np.uint64(0))


def runs(changes: np.ndarray) -> np.ndarray:
    """Where runs begin, given for each row but the first whether it differs from the last."""
    return np.flatnonzero(np.concatenate([np.ones(1, bool), changes]))


def _counted(columns: list[np.ndarray], group: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple:
    """First rows, occurrences and documents of every (term, group); rows are in the order of
    term, group and document."""
    if not len(group):
        return (np.zeros(0, np.int64),) * 3
    new_term = np.zeros(len(group) - 1, bool)
    for c in columns:
        new_term |= c[1:] != c[:-1]
    of_doc = runs(new_term | (doc[1:] != doc[:-1]))
    of_group = runs(new_term | (group[1:] != group[:-1]))
    docs_before = np.searchsorted(of_doc, np.append(of_group, len(group)))
    return of_group, np.add.reduceat(n, of_group), np.diff(docs_before)


def buckets(
    data: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray, doc: np.ndarray, n: np.ndarray
) -> Iterator[tuple[np.ndarray, ...]]:
    """Begin, end, group, occurrences and documents of every distinct term and group, for each
    bucket of lengths. Spans come in the order of group and document."""
    size = end - begin
    for least, most in ((1, 8), (9, 16)):
        at = np.flatnonzero((size >= least) & (size <= most))
        b, s = begin[at], size[at]
        columns = [packed(data, b + k, np.clip(s - k, 0, 8)) for k in range(0, most, 8)]
        order = radix_order(columns)
        at = at[order]
        columns = [c[order] for c in columns]
        first, count, docs = _counted(columns, group[at], doc[at], n[at])
        at = at[first]
        yield begin[at], end[at], group[at], count, docs
    for length in np.unique(size[size > 16]):
        at = np.flatnonzero(size == length)
        rows = np.lib.stride_tricks.sliding_window_view(data, length)[begin[at]]
        terms = np.ascontiguousarray(rows).view(f"S{length}").ravel()
        order = np.argsort(terms, kind="stable")
        at, terms = at[order], terms[order]
        first, count, docs = _counted([terms], group[at], doc[at], n[at])
        at = at[first]
        yield begin[at], end[at], group[at], count, docs


def gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Spans of bytes as an Arrow column of texts."""
    size = end - begin
    ends = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, size)
    offsets, values = ends.astype(np.int32), np.ascontiguousarray(data[place])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(values))


def _pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in runs of about `most` bytes, cut at gaps; a longer term stays whole."""
    gaps = np.flatnonzero(GAP[data])
    begin = 0
    while begin < len(data):
        k = np.searchsorted(gaps, begin + most)
        end = int(gaps[k]) + 1 if k < len(gaps) else len(data)
        yield data[begin:end]
        begin = end


def _spans_counted(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> list[tuple[pa.Array, ...]]:
    begin, end = words(data, at, GAP[data])
    doc = np.searchsorted(at, begin, "right") - 1
    ones = np.ones(len(begin), np.int64)
    return [
        (gathered(data, b, e), g, count, docs)
        for b, e, g, count, docs in buckets(data, begin, end, group[doc], doc, ones)
    ]


def _long_text(data: np.ndarray) -> list[tuple[pa.Array, ...]]:
    """Counts of one long text, piece by piece: the pieces' distinct terms are counted again,
    with their numbers, and each term has one document."""
    found = pa.array([], pa.string())
    n = np.zeros(0, np.int64)
    for piece in _pieces(data, PIECE):
        parts = _spans_counted(piece, np.array([0, len(piece)]), np.zeros(1, np.int64))
        found = pa.concat_arrays([found, *(p[0] for p in parts)])
        n = np.concatenate([n, *(p[2] for p in parts)])
        terms, at = utf8(found)
        same = np.zeros(len(n), np.int64)
        merged = list(buckets(terms, at[:-1], at[1:], same, same, n))
        found = pa.concat_arrays([gathered(terms, b, e) for b, e, *_ in merged])
        n = np.concatenate([m[3] for m in merged])
    return [(found, np.zeros(len(n), np.int64), n, np.ones(len(n), np.int64))]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with their numbers for each group of a batch, and a row without term per group."""
    names = COUNTED.replace(",", "").split()[::2]
    for batch in batches:
        lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary)
        group += source.indices.to_numpy()
        order = np.argsort(group, kind="stable")
        text, group = batch.column(2).take(pa.array(order)), group[order]
        found = [(pa.nulls(len(x := np.unique(group)), pa.string()), x, x * 0, x * 0)]
        done = 0
        for part in slices(text, PIECE):
            data, at = utf8(part)
            data = lowered(data)
            own = group[done : done + len(part)]
            if len(part) == 1 and len(data) > 2 * PIECE:
                found += [(t, g + own[0], n, docs) for t, g, n, docs in _long_text(data)]
            else:
                found += _spans_counted(data, at, own)
            done += len(part)
        for terms, of, n, docs in found:
            columns = [
                lang.dictionary.take(pa.array(of // len(source.dictionary))),
                source.dictionary.take(pa.array(of % len(source.dictionary))),
                terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if i < 3 else c for i, c in enumerate(columns)], names)
        released()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n (occurrences there) and lang_n of the terms that a language keeps,
    and a row with term NULL for every group; settled."""
    rows = docs.selectExpr(*(f"coalesce({c}, '') AS {c}" for c in ("lang", "source", "text")))
    counts = rows.mapInArrow(_count_batches, COUNTED)
    sums = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    term = Window.partitionBy("lang", "term")
    both = sums.withColumns({f"lang_{c}": F.sum(c).over(term) for c in ("n", "n_docs")})
    kept = both.filter(f"term IS NULL OR lang_n_docs >= {int(min_docs)}")
    return settled(kept.select("lang", "source", "term", "n", "lang_n"))


def share(count: str, total: str, terms: str) -> str:
    """SQL: the smoothed share of a count in PARTS, rounded down, and 1; exact for any count."""
    above = f"CAST({count} + {PRIOR} AS DECIMAL(20, 0)) * CAST({PARTS} AS DECIMAL(10, 0))"
    return f"1 + ({above} div CAST({total} + {PRIOR} * {terms} AS DECIMAL(20, 0)))"


def groups(kept: DataFrame) -> DataFrame:
    """lang, source, total (its occurrences of kept terms), lang_total, n_terms; settled."""
    terms = kept.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.max("lang_n").alias("n"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("n_terms"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    both = own.join(small_side(settled(langs)), "lang", "left")
    return settled(both.na.fill(0, ["lang_total", "n_terms"]))


def term_excess(kept: DataFrame, group: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the terms a source has most in excess."""
    rows = kept.filter("n > 0 AND term IS NOT NULL").join(small_side(group), ["lang", "source"])
    value = f"{share('n', 'total', 'n_terms')} - ({share('lang_n', 'lang_total', 'n_terms')})"
    over = rows.selectExpr("lang", "source", "term AS item", f"{value} AS value").filter("value > 0")
    return ranked(over).filter(F.col("rank") <= int(top))


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _block_distances(counts: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of the differences of each two sources over one block's terms, the lesser first."""
    names = sources.column("of_source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names = [names[i] for i in order]
    place = {s: i for i, s in enumerate(names)}
    none = sources.column("at_zero").to_numpy()[order]
    term = counts.column("term").combine_chunks().dictionary_encode()
    shares = np.repeat(none, len(term.dictionary)).reshape(len(names), -1)
    row = np.array([place[s] for s in counts.column("source").to_pylist()], np.int64)
    shares[row, term.indices.to_numpy()] = counts.column("p").to_numpy()
    out = [np.abs(shares[i + 1 :] - shares[i]).sum(axis=1) for i in range(len(names))]
    first = np.repeat(np.arange(len(names)), [len(x) for x in out])
    second = np.concatenate([np.arange(i + 1, len(names)) for i in range(len(names))])
    source = pa.array(names, pa.string())
    return pa.table({
        "lang": pa.array([sources.column("of_lang")[0].as_py()] * len(first), pa.string()),
        "source": source.take(pa.array(first)),
        "item": source.take(pa.array(second)),
        "value": pa.array(np.concatenate(out).astype(np.int64)),
    })


def pair_distances(kept: DataFrame, group: DataFrame) -> DataFrame:
    """lang, source, item (another source), value, rank for all ordered pairs of a language."""
    sources = group.groupBy("lang").agg(F.count("*").alias("n_sources"))
    terms = f"greatest(1, least({BLOCK_TERMS}, {CELLS} div n_sources))"
    blocks = group.join(small_side(settled(sources)), "lang").selectExpr(
        "lang", "source", "total", "n_terms", f"greatest(1, ceil(n_terms / {terms})) AS n_blocks"
    )
    p, at_zero = share("n", "total", "n_terms"), share("0L", "total", "greatest(n_terms, 1)")
    counts = kept.filter("n > 0 AND term IS NOT NULL").join(small_side(settled(blocks)), ["lang", "source"])
    counts = counts.selectExpr("lang", "pmod(xxhash64(term), n_blocks) AS block", "source", "term", f"{p} AS p")
    each = blocks.selectExpr(
        "lang AS of_lang", "explode(sequence(0L, n_blocks - 1)) AS of_block", "source AS of_source", f"{at_zero} AS at_zero"
    )
    parts = counts.groupBy("lang", "block").cogroup(each.groupBy("of_lang", "of_block")).applyInArrow(
        _block_distances, "lang string, source string, item string, value bigint"
    )
    half = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = "inline(array(struct(source, item), struct(item AS source, source AS item)))"
    return ranked(half.selectExpr("lang", other, "value"))


def report(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank."""
    kept = kept_terms(docs, min_docs)
    group = groups(kept)
    parts = {"pair": pair_distances(kept, group), "term": term_excess(kept, group, top)}
    pair, term = (
        rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        for part, rows in parts.items()
    )
    return pair.unionAll(term)


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), terms AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM terms GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCS}
), langs AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), own AS (
  SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM terms t JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT d.lang, d.source, coalesce(max(l.total), 0) AS lang_total, coalesce(max(l.v), 0) AS v,
    coalesce((SELECT sum(o.n) FROM own o WHERE o.lang = d.lang AND o.source = d.source), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN langs l ON l.lang = d.lang GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
    1 + {PARTS} * (coalesce(o.n, 0) + {PRIOR}) // (g.total + {PRIOR} * g.v) AS p,
    1 + {PARTS} * (k.n + {PRIOR}) // (g.lang_total + {PRIOR} * g.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows
)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= {TOP}
"""
