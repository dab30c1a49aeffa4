"""Fill-in-middle transformation over texts kept as seekable compressed frames.

A text is stored as independent zstandard frames of at most FRAME bytes, cut at code points, each
with its number of units (runs of A-Z and a-z, or one other code point; a unit belongs to the
frame it begins in) and of code points. Their running sums find the frame that a cut lies in, so
choosing the parts opens only the two cut frames. The output is a sequence of frames too: whole
frames are moved as they are, the cut ones are written anew, and the marks are frames of their
own; one after another they are a valid zstandard stream of the output text. Digests, and the
text rebuilt from the output, are read from such frames in order, one at a time, so that memory
doesn't grow with the text beyond its compressed form.

Where to cut, and which form, comes from the digest of `1:` and the doc_id (of `1:` alone for a
missing doc_id): the prefix ends after the smaller of two numbers of units, the middle after the
larger. A text that is empty or holds one of the marks stays plain; else `plain_percent` in
100 stay plain and `spm_percent` of the others put the suffix first.

A null text is empty. Rows that share a doc_id each get their own result, with the same draws; an
empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.llm.ragged import released
from uptakelens.llm.tables import settled

#: Fixed by the contract.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_PERCENT = 10
SPM_PERCENT = 20
#: Bytes of text in a frame, and how hard it is compressed.
FRAME = 1 << 16
LEVEL = 1
#: Bytes of texts that an output batch stems from.
BATCH = 8 << 20

STORED = "array<struct<data:binary,units:bigint,chars:bigint>>"
_STORED = pa.list_(pa.struct([("data", pa.binary()), ("units", pa.int64()), ("chars", pa.int64())]))
_STORE = pa.struct([("frames", _STORED), ("n", pa.int64()), ("marked", pa.bool_())])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=False).compress
_unpack = zstandard.ZstdDecompressor().decompress


def unit_starts(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point, and whether a unit, begins at each byte; `inside` tells whether the
    byte before was a letter."""
    letter = _LETTER[data]
    point = (data & 0xC0) != 0x80
    after_letter = np.concatenate([[inside], letter[:-1]])
    return point, point & ~(letter & after_letter)


def frames(text: bytes, most: int = FRAME) -> list[dict]:
    """The text's frames, each with its numbers of units and code points."""
    out, begin, inside = [], 0, False
    while begin < len(text):
        end = min(begin + most, len(text))
        while end < len(text) and end > begin + 1 and text[end] & 0xC0 == 0x80:
            end -= 1
        part = text[begin:end]
        point, unit = unit_starts(np.frombuffer(part, np.uint8), inside)
        out.append({"data": _pack(part), "units": int(np.count_nonzero(unit)), "chars": int(np.count_nonzero(point))})
        inside = bool(_LETTER[part[-1]])
        begin = end
    return out


def stored(text: str | bytes | None, most: int = FRAME) -> dict:
    """The frames of a text, its units, and whether it holds a mark."""
    data = text.encode() if isinstance(text, str) else text or b""
    found = frames(data, most)
    marked = any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE))
    return {"frames": found, "n": sum(f["units"] for f in found), "marked": marked}


def located(kept: list[dict], units: int) -> tuple[int, int, int]:
    """Frame, byte in it, and code points before, of the place after so many units of the text.
    Only the frame that holds the place is opened (and the one before it, for its last byte)."""
    ends = np.cumsum([f["units"] for f in kept])
    at = int(np.searchsorted(ends, units, "right"))
    points = sum(f["chars"] for f in kept[:at])
    if at == len(kept):
        return at, 0, points
    inside = at > 0 and bool(_LETTER[_unpack(kept[at - 1]["data"])[-1]])
    point, unit = unit_starts(np.frombuffer(_unpack(kept[at]["data"]), np.uint8), inside)
    byte = int(np.flatnonzero(unit)[units - (int(ends[at - 1]) if at else 0)])
    return at, byte, points + int(np.count_nonzero(point[:byte]))


def part(kept: list[dict], begin: tuple[int, int, int], end: tuple[int, int, int]) -> list[bytes]:
    """Frames of the text between two places: whole ones as they are, cut ones written anew."""
    out = []
    for i in range(begin[0], min(end[0] + 1, len(kept))):
        low = begin[1] if i == begin[0] else 0
        high = end[1] if i == end[0] else None
        if low == 0 and high is None:
            out.append(kept[i]["data"])
        elif high is None or high > low:
            out.append(_pack(_unpack(kept[i]["data"])[low:high]))
    return out


def rearranged(kept: list[dict], form: str, low: int, high: int) -> tuple[list[bytes], int | None, int | None]:
    """Frames of the output, and code points of prefix and middle (None if plain)."""
    if form == "plain":
        return [f["data"] for f in kept], None, None
    start, first, second = (0, 0, 0), located(kept, low), located(kept, high)
    end = (len(kept), 0, 0)
    prefix, middle, suffix = part(kept, start, first), part(kept, first, second), part(kept, second, end)
    p, s, m = ([_pack(mark)] for mark in (PREFIX, SUFFIX, MIDDLE))
    out = p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle
    return out, first[2], second[2] - first[2]


def rebuilt(output: list[bytes], form: str) -> Iterator[bytes]:
    """The text again, in pieces, from the frames of an output and its form.

    The marks are looked for in the running text, where each occurs once: texts that hold one
    are plain. Frames are opened in order, and those with the middle's neighbour once more."""
    if form == "plain":
        yield from map(_unpack, output)
        return
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    places, tail, before, sizes = {}, b"", 0, []
    for frame in output:
        data = _unpack(frame)
        seen = tail + data
        for mark in marks:
            k = seen.find(mark)
            if k >= 0 and mark not in places:
                places[mark] = before - len(tail) + k
        tail = seen[-2:]
        before += len(data)
        sizes.append(len(data))
    at = [places[mark] for mark in marks] + [before]
    spans = {mark: (at[i] + len(mark), at[i + 1]) for i, mark in enumerate(marks)}
    ends = np.cumsum(sizes)
    for mark in (PREFIX, MIDDLE, SUFFIX):
        low, high = spans[mark]
        i = int(np.searchsorted(ends, low, "right"))
        while i < len(output) and ends[i] - sizes[i] < high:
            data, offset = _unpack(output[i]), int(ends[i]) - sizes[i]
            yield data[max(low - offset, 0) : high - offset]
            i += 1


def digest(pieces: Iterator[bytes]) -> str:
    """SHA-256 of pieces read one after another."""
    out = hashlib.sha256()
    for piece in pieces:
        out.update(piece)
    return out.hexdigest()


# -- over a table ------------------------------------------------------------------


def _batches(sizes: np.ndarray, most: int = BATCH) -> Iterator[slice]:
    """Runs of rows of about `most` bytes."""
    total, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        yield slice(begin, end)
        begin = end


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, frames, n and marked of every row."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for run in _batches(sizes):
            texts_of = texts.slice(run.start, run.stop - run.start)
            made = pa.array((stored(t.as_py()) for t in texts_of), _STORE)
            columns = [ids.slice(run.start, len(texts_of)), *(made.field(i) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "frames", "n", "marked"])
        released()


def seekable(docs: DataFrame) -> DataFrame:
    """The store, settled: doc_id, frames, n (units), marked."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return settled(rows.mapInArrow(_store_batches, f"doc_id {id_type}, frames {STORED}, n bigint, marked boolean"))


def drawn(store: DataFrame, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """The store with form, low and high (units before the middle's begin and end)."""
    key = "sha2(CAST(concat('1:', coalesce(CAST(doc_id AS STRING), '')) AS BINARY), 256)"
    rows = store.withColumn("key", F.expr(key))
    h = [f"CAST(conv(substring(key, {1 + 8 * k}, 8), 16, 10) AS BIGINT)" for k in range(4)]
    rows = rows.withColumns({"first": F.expr(f"{h[0]} % (n + 1)"), "second": F.expr(f"{h[1]} % (n + 1)")})
    form = (
        f"CASE WHEN n = 0 OR marked OR {h[2]} % 100 >= {100 - plain_percent} THEN 'plain'"
        f" WHEN {h[3]} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END"
    )
    return rows.selectExpr(
        "doc_id", "frames", "n", f"{form} AS form", "least(first, second) AS low", "greatest(first, second) AS high"
    )


def _rearranged_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    columns = [batch.column(i) for i in range(4)]
    for i in range(batch.num_rows):
        kept, form, low, high = (c[i].as_py() for c in columns)
        yield form, *rearranged(kept, form, low, high)


def _output_column(kept: pa.Array, form: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    rows = _rearranged_rows(pa.RecordBatch.from_arrays([kept, form, low, high], list("abcd")))
    return pa.array((b"".join(output) for _, output, _, _ in rows), pa.binary())


def transformed(docs: DataFrame, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form and output: a zstandard stream of the transformed text."""
    write = F.arrow_udf(_output_column, "binary")
    rows = drawn(seekable(docs), plain_percent, spm_percent)
    return rows.select("doc_id", "n", "form", write("frames", "form", "low", "high").alias("output"))


_DIGESTS = pa.struct([
    ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
])


def _digest_column(kept: pa.Array, form: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    rows = _rearranged_rows(pa.RecordBatch.from_arrays([kept, form, low, high], list("abcd")))
    names = _DIGESTS.names
    return pa.array(
        (
            dict(zip(names, (p, m, digest(map(_unpack, output)), digest(rebuilt(output, f))), strict=True))
            for f, output, p, m in rows
        ),
        _DIGESTS,
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256."""
    read = F.arrow_udf(
        _digest_column,
        "struct<prefix_chars:bigint,middle_chars:bigint,output_sha256:string,restored_sha256:string>",
    )
    rows = drawn(seekable(docs))
    found = rows.select("doc_id", "n", "form", read("frames", "form", "low", "high").alias("found"))
    return found.select("doc_id", "n", "form", "found.*")


SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || key[1:8])::BIGINT AS h1, ('0x' || key[9:16])::BIGINT AS h2,
    ('0x' || key[17:24])::BIGINT AS h3, ('0x' || key[25:32])::BIGINT AS h4
  FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix,
    coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
    coalesce(array_to_string(units[high + 1:], ''), '') AS suffix
  FROM formed
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
