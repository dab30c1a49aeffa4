"""Document fingerprints by winnowing, and their likeness to edited texts and to next documents.

A text's words are its runs of letters and digits in lower case. Every run of GRAM words is hashed,
and of every WINDOW hashes in a row the least is chosen, on ties the rightmost; the fingerprint is
what was chosen, each with its place. Texts that share GRAM + WINDOW - 1 words in a row share a
chosen hash, and nothing shorter than GRAM words can match. A text of fewer words is one gram, one of
fewer grams one window; a text without words has an empty fingerprint. All of it is array
expressions over the words of one row.

A chosen entry is one number: 40 bits of hash above 24 bits that fall with the place, so that the
least number is the least hash with the rightmost place. Beyond 2**24 words places start anew.

The next document follows in descending order of doc_id (then of a hash of the text, missing ids at
the end), and the first follows the last. Documents are dealt into blocks of neighbouring ids, each
with one more row: the document that follows its last. So one shuffle by block brings every document
and its next together, and a window inside each block finds it; no task holds more than a few blocks.

A null text is empty. Two empty fingerprints are alike (1), an empty and another are not (0).
Repeated rows follow each other and each get a result. An empty table gives an empty result. Only
doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uptakelens.llm.tables import settled

GRAM = 5
WINDOW = 16
#: Documents in a block, about. There are at most MOST_BLOCKS, so that a row for each of them can
#: be broadcast; larger tables have larger blocks.
BLOCK = 2000
MOST_BLOCKS = 200_000
#: Quantiles of doc_id between which blocks are equally wide.
QUANTILES = 256
_PLACES = (1 << 24) - 1
_EMPTY = "cast(array() AS array<bigint>)"


def words(text: str) -> str:
    """SQL: the words of a text column (as a split that may have empty ends)."""
    return rf"split(lower({text}), '[^\\p{{L}}\\p{{N}}]+')"


def without_empty_ends(w: str) -> str:
    """SQL: the array without an empty first or last element."""
    first, last = f"int({w}[0] = '')", f"int(size({w}) > 1 AND {w}[size({w}) - 1] = '')"
    return f"slice({w}, 1 + {first}, size({w}) - {first} - {last})"


def grams(w: str, k: int = GRAM) -> str:
    """SQL: hash and place of every run of k words."""
    run = ", ".join(f"get({w}, i + {j})" for j in range(k))
    entry = f"(xxhash64({run}) & {~_PLACES}L) | ({_PLACES}L - (i & {_PLACES}))"
    return f"if(size({w}) = 0, {_EMPTY}, transform(sequence(0, greatest(size({w}) - {k}, 0)), i -> {entry}))"


def chosen(v: str, window: int = WINDOW) -> str:
    """SQL: the least entry of every window, each once."""
    least = f"transform(sequence(1, greatest(size({v}) - {window}, 0) + 1), j -> array_min(slice({v}, j, {window})))"
    return f"if(size({v}) = 0, {_EMPTY}, array_distinct({least}))"


def hash_set(picks: str) -> str:
    """SQL: the distinct hashes of a fingerprint."""
    return f"array_distinct(transform({picks}, x -> shiftrightunsigned(x, 24)))"


def printed(picks: str) -> str:
    """SQL: a fingerprint as text, place:hash with blanks between."""
    one = f"concat({_PLACES}L - (x & {_PLACES}L), ':', lower(hex(shiftrightunsigned(x, 24))))"
    return f"array_join(transform({picks}, x -> {one}), ' ')"


def likeness(a: str, b: str) -> str:
    """SQL: shared over all distinct hashes of two sets; 1 if both are empty."""
    both = f"size(array_intersect({a}, {b}))"
    return f"if(size({a}) + size({b}) = 0, 1D, {both} / double(size({a}) + size({b}) - {both}))"


def with_fingerprint(
    frame: DataFrame, text: str, out: str, k: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """The frame with a column `out` of chosen entries. The steps are columns of their own, each
    used more than once by the next, so that none is evaluated within another's loop."""
    frame = frame.withColumn("_w", F.expr(words(text)))
    frame = frame.withColumn("_w", F.expr(without_empty_ends("_w")))
    frame = frame.withColumn("_v", F.expr(grams("_w", k)))
    return frame.withColumn(out, F.expr(chosen("_v", window))).drop("_w", "_v")


def blocks(docs: DataFrame, block: int = BLOCK) -> tuple[str, DataFrame]:
    """SQL for a document's block, rising with its id, and a settled table of each block's first
    document in the order (doc_id, key) and the block that this document ends (above)."""
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    n, bounds = docs.select(F.count("doc_id"), F.percentile_approx("doc_id", shares, 10_000)).first()
    bounds = sorted(set(bounds or [0]))
    fine = -(-n // (max(block, -(-n // MOST_BLOCKS)) * max(1, len(bounds) - 1)))
    listed = "array(" + ", ".join(f"{x}L" for x in bounds) + ")"
    width = [max(1, -(-(b - a) // max(fine, 1))) for a, b in zip(bounds, bounds[1:], strict=False)]
    widths = "array(" + ", ".join(f"{x}L" for x in [*width, 1]) + ")"
    at = f"greatest(0, size(filter({listed}, b -> b <= doc_id)) - 1)"
    inside = f"least({max(fine, 1) - 1}L, (doc_id - {listed}[{at}]) div {widths}[{at}])"
    number = f"coalesce({at} * {max(fine, 1)}L + greatest(0L, {inside}), -1L)"
    first = "max(struct(doc_id, ~key AS down))"
    heads = docs.selectExpr("doc_id", "xxhash64(text) AS key", f"{number} AS block").groupBy("block")
    heads = heads.agg(F.expr(first).alias("first")).selectExpr("block", "first.doc_id", "~first.down AS key")
    every = Window.orderBy("block")  # at most MOST_BLOCKS rows
    above = F.lead("block").over(every)
    lowest = F.first("block").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return number, settled(heads.withColumn("above", F.coalesce(above, lowest)))


def dealt(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, text and key by block; `extra` marks the additional row that ends a block."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number, heads = blocks(docs, block)
    heads = heads.selectExpr("doc_id AS h_id", "key AS h_key", "above")
    rows = docs.withColumn("key", F.expr("xxhash64(text)")).withColumn("block", F.expr(number))
    is_head = F.col("key").eqNullSafe(F.col("h_key")) & F.col("doc_id").eqNullSafe(F.col("h_id"))
    rows = rows.join(F.broadcast(heads), is_head, "left")
    own, ends = "struct(block, false AS extra)", "struct(above AS block, true AS extra)"
    places = f"inline(if(above IS NULL, array({own}), array({own}, {ends})))"
    return rows.selectExpr("doc_id", "text", "key", places).repartition("block")


def report(docs: DataFrame, k: int = GRAM, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    order = Window.partitionBy("block").orderBy("extra", F.desc_nulls_last("doc_id"), "key")
    rows = with_fingerprint(dealt(docs, block), "text", "picks", k, window)
    rows = rows.withColumn("hashes", F.expr(hash_set("picks")))
    rows = rows.withColumns(
        {"next_text": F.lead("text").over(order), "next_hashes": F.lead("hashes").over(order)}
    ).filter("NOT extra")
    rows = rows.withColumn("n_chars", F.expr("bigint(length(text))"))
    half = "int(n_chars div 2)"
    edited = f"concat(left(text, int(n_chars) - {half}), left(next_text, {half}))"
    rows = rows.withColumn("edited", F.expr(edited))
    rows = with_fingerprint(rows, "edited", "edited_picks", k, window)
    rows = rows.withColumn("edited_hashes", F.expr(hash_set("edited_picks")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.expr("sha2(cast(edited AS binary), 256)").alias("edited_sha256"),
        F.expr(printed("picks")).alias("fingerprint"),
        F.expr(printed("edited_picks")).alias("edited_fingerprint"),
        F.expr(likeness("hashes", "edited_hashes")).alias("near_edited"),
        F.expr(likeness("hashes", "next_hashes")).alias("near_next"),
    )
