"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text over a vocabulary's pieces and scores (see `pieces`) is a shortest path,
and a path through a stretch of text depends on the rest only by where its pieces cross the stretch's
ends: at one of as many places as the longest piece has characters. Giant documents are therefore
split into chunks, whatever lies at their ends, and dealt out over the cluster:

1. every chunk yields a transfer matrix, the best score from each entry to each exit;
2. the matrices are multiplied in the max-plus sense, which is associative: by blocks of chunks first,
   then along the blocks, then along the chunks of a block, which gives the score of every entry;
3. every chunk is traced back on its own from each of its exits, which gives the ids and the entry that
   belong to the exit; where all paths share a border, as in any text with words, that is one entry;
4. the exits that follow from each other, from the end of the document, pick the ids.

The result is that of a single pass, equal scores included, and doesn't depend on the chunks' size. Other
documents are one chunk and need no scan; they are segmented in place by the batch.

A null text is empty and has no ids. Decoding an encoding gives the text back, whatever its characters.
Repeated rows each get a result, an empty table gives an empty one. Only doc_id and text are read. The
vocabulary's path is a parameter; it is read on the driver and sent with the functions (0.5 MB).
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.llm import ragged
from uptakelens.llm.pieces import MARK, Vocabulary, marked, max_plus, normal, vocabulary
from uptakelens.llm.tables import settled

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of more characters are giant, and cut into chunks of so many.
GIANT = 1 << 16
CHUNK = 1 << 15
#: Chunks whose matrices are multiplied in one task.
BLOCK = 64
#: Bytes segmented, or ids decoded, at a time.
BATCH = 1 << 18


def read_model(path: str = MODEL) -> bytes:
    """A SentencePiece model file."""
    return Path(path).read_bytes()


def _batches(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about BATCH characters."""
    begin = total = 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text) > BATCH:
            yield texts[begin:i]
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield texts[begin:]


def encode_column(model: bytes, column: pa.Array) -> pa.Array:
    """Ids of every text, null being empty."""
    words = vocabulary(model)
    parts = []
    for some in ragged.slices(column, BATCH):
        ids, at, _ = words.encode_all([normal(x or "") for x in some.to_pylist()])
        parts.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
    ragged.released()
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def decode_column(model: bytes, column: pa.Array) -> pa.Array:
    """Text of every list of ids, null being empty."""
    words = vocabulary(model)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    parts, begin = [], 0
    while begin < len(column):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + BATCH, "right")))
        ids = column.slice(begin, end - begin).flatten().to_numpy()
        parts.append(words.decode_all(ids, np.concatenate([[0], total[begin:end] - done])))
        begin = end
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def encoded_in_place(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text and ids, each document at once."""

    def encode(column: pa.Array) -> pa.Array:
        return encode_column(model, column)

    return docs.select("doc_id", "text", F.arrow_udf(encode, "array<int>")("text").alias("ids"))


def chunks(docs: DataFrame, longest: int, size: int = CHUNK) -> DataFrame:
    """Settled: document (a name for the row), doc_id, chunk, chunks, and the text of the chunk, with
    the character in front of it and those behind it that its pieces can reach.

    The names are settled before the chunks are dealt out by them, so that a chunk that has to be cut
    again after the loss of an executor goes by the same name."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, document, text in zip(*batch.columns, strict=True):
                raw = text.as_py()
                n = -(-(len(raw) + 1) // size)
                for i in range(n):
                    part = raw[max(0, i * size - 2) : (i + 1) * size + longest - 2]
                    rows = [[doc_id.as_py()], [document.as_py()], [i], [n], [part]]
                    columns = [pa.array(x, f.type) for x, f in zip(rows, _CHUNKS, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_CHUNKS)

    name = F.monotonically_increasing_id().alias("document")
    named = settled(docs.select(F.col("doc_id").cast("bigint"), name, "text"))
    rows = named.mapInArrow(cut, "doc_id bigint, document bigint, chunk int, chunks int, text string")
    return settled(rows.repartition("document", "chunk"))


_CHUNKS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("document", pa.int64()),
        ("chunk", pa.int32()),
        ("chunks", pa.int32()),
        ("text", pa.string()),
    ]
)


def _seen(
    words: Vocabulary, rows: Iterator[tuple[str, int, int]], size: int
) -> Iterator[tuple[str, int, tuple[int, int] | None, np.ndarray, float]]:
    """Of every chunk (text, chunk, chunks): the text as the lattice sees it, its own length, its first
    and last border, and ids and score of what lies between them."""
    seen = []
    for text, chunk, chunks in rows:
        s = marked(text)
        before, s = ("", MARK + s) if chunk == 0 else (s[0], s[1:])
        own = len(s) if chunk == chunks - 1 else size
        seen.append((s, own, words.borders(s, before, own)))
    begin = 0
    for some in _batches([s[slice(*cut)] if cut else "" for s, _, cut in seen]):
        ids, at, scores = words.encode_all(some)
        for i, one in enumerate(seen[begin : begin + len(some)]):
            yield *one, ids[at[i] : at[i + 1]], float(scores[i])
        begin += len(some)


def transfers(cut: DataFrame, model: bytes, size: int = CHUNK) -> DataFrame:
    """document, chunk and its transfer matrix (64-bit floats, row by row)."""

    def transfer(text: pa.Array, chunk: pa.Array, chunks: pa.Array) -> pa.Array:
        words = vocabulary(model)
        rows = zip(text.to_pylist(), chunk.to_pylist(), chunks.to_pylist(), strict=True)
        seen = _seen(words, rows, size)
        found = [words.transfer(s, own, cut, score).tobytes() for s, own, cut, _, score in seen]
        return pa.array(found, pa.binary())

    udf = F.arrow_udf(transfer, "binary")
    return cut.select("document", "chunk", udf("text", "chunk", "chunks").alias("matrix"))


def _matrix(raw: bytes) -> np.ndarray:
    values = np.frombuffer(raw)
    return values.reshape(int(len(values) ** 0.5), -1)


def _product(column: pa.Array) -> pa.Array:
    """One matrix for each block, given as its chunks' matrices in order."""
    out = []
    for rows in column.to_pylist():
        whole = _matrix(rows[0]["matrix"])
        for row in rows[1:]:
            whole = max_plus(whole, _matrix(row["matrix"]))
        out.append(whole.tobytes())
    return pa.array(out, pa.binary())


_ENTRIES = "array<struct<number:int,entry:binary>>"
_ENTRY = pa.list_(pa.struct([("number", pa.int32()), ("entry", pa.binary())]))


def _entries(column: pa.Array, entry: pa.Array | None = None) -> pa.Array:
    """Scores of the entries of each matrix of a row, given those of the first (or the document's
    beginning)."""
    out = []
    firsts = [None] * len(column) if entry is None else entry.to_pylist()
    for rows, first in zip(column.to_pylist(), firsts, strict=True):
        if first is None:
            scores = np.full(_matrix(rows[0]["matrix"]).shape[0], -np.inf)
            scores[0] = 0.0
        else:
            scores = np.frombuffer(first)
        own = []
        for row in rows:
            own.append({"number": row["number"], "entry": scores.tobytes()})
            scores = (scores[:, None] + _matrix(row["matrix"])).max(0)
        out.append(own)
    return pa.array(out, _ENTRY)


def _gathered(number: str, value: str) -> str:
    """SQL: a group's values in the order of their numbers, each with its number."""
    return f"sort_array(collect_list(struct(int({number}) AS number, {value})))"


def entry_scores(matrices: DataFrame, block: int = BLOCK) -> DataFrame:
    """document, chunk and the scores of its entries: the parallel scan. What is gathered is a
    block's matrices, and a document's products, of which each is a few kilobytes."""
    product = F.arrow_udf(_product, "binary")

    def from_start(rows: pa.Array) -> pa.Array:
        return _entries(rows)

    def from_entry(rows: pa.Array, entry: pa.Array) -> pa.Array:
        return _entries(rows, entry)

    blocks = matrices.withColumn("block", F.expr(f"int(chunk div {block})")).groupBy("document", "block")
    blocks = blocks.agg(F.expr(_gathered("chunk", "matrix")).alias("rows"))
    products = blocks.select("document", "block", product("rows").alias("matrix"))
    whole = products.groupBy("document").agg(F.expr(_gathered("block", "matrix")).alias("rows"))
    first = F.explode(F.arrow_udf(from_start, _ENTRIES)("rows")).alias("x")
    by_block = whole.select("document", first).selectExpr("document", "x.number AS block", "x.entry")
    each = F.explode(F.arrow_udf(from_entry, _ENTRIES)("rows", "entry")).alias("x")
    rows = blocks.join(by_block, ["document", "block"]).select("document", each)
    return rows.selectExpr("document", "x.number AS chunk", "x.entry")


def tracebacks(cut: DataFrame, entries: DataFrame, model: bytes, size: int = CHUNK) -> DataFrame:
    """doc_id, document, chunk, chunks, ids that all paths share (common), and for each exit the ids behind them
    (ends) and the entry it goes back to (came)."""

    def trace(text: pa.Array, chunk: pa.Array, chunks: pa.Array, entry: pa.Array) -> pa.Array:
        words = vocabulary(model)
        rows = zip(text.to_pylist(), chunk.to_pylist(), chunks.to_pylist(), strict=True)
        out = []
        for (s, own, cut, ids, _), raw in zip(_seen(words, rows, size), entry.to_pylist(), strict=True):
            found = words.backtraced(s, own, cut, ids.tolist(), np.frombuffer(raw).tolist())
            out.append(dict(zip(["common", "ends", "came"], found, strict=True)))
        ids = pa.list_(pa.int32())
        return pa.array(out, pa.struct([("common", ids), ("ends", pa.list_(ids)), ("came", ids)]))

    udf = F.arrow_udf(trace, "struct<common:array<int>,ends:array<array<int>>,came:array<int>>")
    rows = cut.join(entries, ["document", "chunk"])
    own = ["doc_id", "document", "chunk", "chunks"]
    traced = rows.select(*own, udf("text", "chunk", "chunks", "entry").alias("t"))
    return settled(traced.select(*own, "t.*"))


def _exits(column: pa.Array) -> pa.Array:
    """The exit that the best path takes from each chunk of a document, from its end."""
    out = []
    for rows in column.to_pylist():
        exits, at = [], 0
        for row in reversed(rows):
            exits.append({"chunk": row["number"], "way": at})
            at = row["came"][at]
        out.append(exits)
    return pa.array(out, pa.list_(pa.struct([("chunk", pa.int32()), ("way", pa.int32())])))


def encoded_by_scan(docs: DataFrame, model: bytes, size: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id and ids of documents that aren't empty, by chunks. A document that lacks a chunk, or has
    one twice, is an error."""
    longest = vocabulary(model).longest
    if size < longest:
        raise ValueError(f"a chunk needs {longest} characters at least")
    cut = chunks(docs, longest, size)
    entries = entry_scores(settled(transfers(cut, model, size)), block)
    traced = tracebacks(cut, entries, model, size)
    # A chunk's row here is its number and one small array.
    came = traced.groupBy("document").agg(F.expr(_gathered("chunk", "came")).alias("rows"))
    way = F.explode(F.arrow_udf(_exits, "array<struct<chunk:int,way:int>>")("rows")).alias("x")
    exits = came.select("document", way).select("document", "x.*")
    ids = traced.join(exits, ["document", "chunk"])
    ids = ids.select("document", "doc_id", "chunk", "chunks", F.expr("concat(common, ends[way])").alias("ids"))
    whole = ids.groupBy("document").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("chunks").alias("chunks"),
        F.expr("sort_array(collect_list(struct(chunk, ids)))").alias("parts"),
    )
    complete = "transform(parts, x -> x.chunk) = sequence(0, chunks - 1)"
    said = "'document', string(doc_id), 'has other chunks than its', string(chunks)"
    error = f"raise_error(concat_ws(' ', {said}))"
    joined = "flatten(transform(parts, x -> x.ids))"
    return whole.select("doc_id", F.expr(f"if({complete}, {joined}, {error})").alias("ids"))


def encode(docs: DataFrame, model: bytes, giant: int = GIANT, size: int = CHUNK) -> DataFrame:
    """doc_id and ids of every document."""
    is_giant = F.expr(f"coalesce(length(text) > {giant}, false)")
    small = encoded_in_place(docs.filter(~is_giant), model).select("doc_id", "ids")
    large = docs.filter(is_giant).select("doc_id", "text")
    return small.unionByName(encoded_by_scan(large, model, size))


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """The rows (ids, ...) with a column decoded, the text."""

    def of(column: pa.Array) -> pa.Array:
        return decode_column(model, column)

    return rows.withColumn("decoded", F.arrow_udf(of, "string")("ids"))


def report(docs: DataFrame, model: bytes | None = None, giant: int = GIANT, size: int = CHUNK) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids with blanks between) and decoded_sha256 (of the text that
    they decode to, UTF-8) of every document."""
    model = model or read_model()
    rows = decode(encode(docs.select("doc_id", "text"), model, giant, size), model)
    return rows.selectExpr(
        "doc_id",
        "bigint(size(ids)) AS n_ids",
        "sha2(cast(array_join(ids, ' ') AS binary), 256) AS ids_sha256",
        "sha2(cast(decoded AS binary), 256) AS decoded_sha256",
    )
