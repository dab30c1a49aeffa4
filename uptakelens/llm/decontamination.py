"""Benchmark decontamination: test items found inside long documents by MinHash containment.

A text's words are its runs of letters and digits in lower case, an item's shingles the distinct
runs of SHINGLE words, or its words as one run if they are fewer. A document leaks an item if it
holds at least the share SIMILARITY of the item's shingles, however long the document is; it is
read in runs of SHINGLE words, and of as few words as short items have.

Items are partitioned by size: an item of n shingles may lack floor((1 - SIMILARITY) * n) of them, and
its sketch holds one more than that, those with the least hashes (the bottom of a MinHash order).
A document that leaks the item therefore holds a shingle of the sketch, so that the search loses
nothing, and long and short items each get the smallest sketch for which this is so. The search reads
every shingle of every document against the sketches; the document's own size only rules out items
of more shingles than it has words. Candidates are then verified exactly, by the words of all shingles
of the item and the document. Items with the same shingles are searched for as one and reported
under each of their ids.

The sketches are broadcast up to a checked size and joined by a shuffle beyond; only matches leave
the scan. Null texts, and texts without words, leak nothing and are leaked by none. In the result, as
pairs are told by their ids, rows that share a doc_id are one document and rows without one are left
out; `clean` tells rows by id and text, so that each is kept or dropped for what it holds itself.
Empty tables give an empty result; columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.llm.tables import settled, small_side, unused
from uptakelens.llm.winnowing import without_empty_ends, words

SHINGLE = 5
#: Share of an item's shingles, in percent.
SIMILARITY = 80


def with_words(frame: DataFrame) -> DataFrame:
    """The frame with an array w of its words in place of text."""
    frame = frame.withColumn("w", F.expr(words("text"))).withColumn("w", F.expr(without_empty_ends("w")))
    return frame.drop("text")


def shingle(k: int = SHINGLE) -> str:
    """SQL: the k words from place i on, as arguments."""
    return ", ".join(f"get(w, i + {j})" for j in range(k))


def shingles(frame: DataFrame, columns: list[str], value: str, k: int = SHINGLE) -> DataFrame:
    """One row for each run of k words (all words, if they are fewer): the columns, and `value` of
    its words. A test of the number of words would have Catalyst split every text once more."""
    places = f"explode(sequence(0, greatest(size(w) - {k}, 0))) AS i"
    return frame.selectExpr(*columns, "w", places).selectExpr(*columns, value)


def item_sets(items: DataFrame, k: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """Settled: set_id (the least item_id of those with the same shingles), item_ids, words of a
    shingle (s) and their number (size), its hash (h), the item's size n, the least number a leak
    needs, and whether the shingle is in the sketch."""
    known = with_words(items.select("item_id", "text").filter("item_id IS NOT NULL"))
    text = f"concat_ws(' ', {shingle(k)}) AS s"
    rows = shingles(known.filter("size(w) > 0"), ["item_id"], text, k).distinct()
    sets = rows.groupBy("item_id").agg(F.sort_array(F.collect_list("s")).alias("set"))
    sets = sets.groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    sets = sets.withColumns({"n": F.expr("size(set)"), "set_id": F.expr("item_ids[0]")})
    sets = sets.withColumn("need", F.expr(f"(n * {percent} + 99) div 100"))
    hashed = "transform(set, s -> struct(xxhash64(split(s, ' ')) AS h, s))"
    sets = sets.withColumn("set", F.expr(f"sort_array({hashed})"))
    rows = sets.selectExpr("set_id", "item_ids", "n", "need", "posexplode(set) AS (rank, x)")
    rows = rows.selectExpr("set_id", "item_ids", "n", "need", "x.h", "x.s", "rank <= n - need AS sketch")
    return settled(rows.withColumn("size", F.expr("size(split(s, ' '))")))


def runs(found: DataFrame, columns: list[str], value: str, sizes: list[int]) -> DataFrame:
    """The documents' runs of each of the sizes; `{run}` in value stands for a run's words."""
    out = None
    for k in sizes:
        rows = shingles(found, columns, value.format(run=shingle(k)), k)
        out = rows if out is None else out.unionAll(rows)
    return out


def sizes_of(sets: DataFrame, k: int = SHINGLE) -> list[int]:
    """The numbers of words that shingles of items have: k, and less for short items."""
    return sorted({k, *(r.size for r in sets.select("size").distinct().collect())})


def candidates(docs: DataFrame, sets: DataFrame, sizes: list[int], key: list[str]) -> DataFrame:
    """Pairs (key, set_id) that share a shingle of the item's sketch."""
    # A text without words makes one run of none, which no item has. Were m nullable, Catalyst would test it for null at the scan and split every text several
    # times more.
    found = with_words(docs.select(*key, "text"))
    rows = runs(found, [*key, "coalesce(size(w), 0) AS m"], "xxhash64(array({run})) AS h", sizes)
    sketches = sets.filter("sketch").select("set_id", "need", F.col("h").alias("sketch_h"))
    near = rows.join(small_side(sketches), F.expr("h = sketch_h AND m >= need"))
    return near.select(*key, "set_id").distinct()


def leaked_sets(docs: DataFrame, sets: DataFrame, key: list[str], k: int = SHINGLE) -> DataFrame:
    """key, set_id, n, need and the number of shingles found, of every leak."""
    sizes = sizes_of(sets, k)
    pairs = settled(candidates(docs, sets, sizes, key))
    ids = small_side(settled(pairs.select(*key).distinct()))
    named = with_words(docs.select(*key, "text").join(ids, key, "left_semi"))
    own = runs(named, key, "concat_ws(' ', {run}) AS s", sizes)
    full = small_side(sets.select("set_id", "n", "need", "s"))
    met = own.join(full, "s").select(*key, "set_id", "n", "need", "s")
    met = met.join(small_side(pairs), [*key, "set_id"], "left_semi").distinct()
    return met.groupBy(*key, "set_id", "n", "need").count().filter("count >= need")


def leaks(
    docs: DataFrame, items: DataFrame, k: int = SHINGLE, percent: int = SIMILARITY
) -> DataFrame:
    """doc_id, item_id, n_item, n_found and containment of every leak."""
    sets = item_sets(items, k, percent)
    known = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    counts = leaked_sets(known, sets, ["doc_id"], k)
    names = sets.select("set_id", "item_ids").distinct()
    return counts.join(small_side(settled(names)), "set_id").selectExpr(
        "doc_id",
        "explode(item_ids) AS item_id",
        "bigint(n) AS n_item",
        "count AS n_found",
        "count / double(n) AS containment",
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns. Rows are told by their text, so
    that those without id, or of one id, are each judged by what they hold."""
    rows = docs.select(F.xxhash64("text").alias("text_hash"), "text").filter("text IS NOT NULL")
    found = settled(leaked_sets(rows, item_sets(items), ["text_hash"]).select("text_hash").distinct())
    name = unused("text_hash", docs.columns)
    found = small_side(found.withColumnRenamed("text_hash", name))
    marked = docs.withColumn(name, F.xxhash64("text"))
    return marked.join(found, name, "left_anti").select(docs.columns)


SQL = rf"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') IF x <> ''] AS w
  FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') IF x <> '']
  FROM benchmark WHERE item_id IS NOT NULL
), sizes AS (
  SELECT DISTINCT least(len(w), {SHINGLE}) AS k FROM w WHERE side = 'i' AND len(w) > 0
), places AS (
  SELECT side, id, w, least(len(w), {SHINGLE}) AS k, unnest(range(0, len(w) - least(len(w), {SHINGLE}) + 1)) AS i
  FROM w WHERE side = 'i' AND len(w) > 0
  UNION ALL
  SELECT side, id, w, k, unnest(range(0, len(w) - k + 1)) FROM w, sizes WHERE side = 'd' AND len(w) >= k
), shingles AS (
  SELECT DISTINCT side, id, array_to_string(w[i + 1 : i + k], ' ') AS s FROM places
), items AS (
  SELECT id, count(*) AS n FROM shingles WHERE side = 'i' GROUP BY id
), found AS (
  SELECT d.id AS doc_id, i.id AS item_id, t.n, count(*) AS c
  FROM items t JOIN shingles i ON i.side = 'i' AND i.id = t.id
  JOIN shingles d ON d.side = 'd' AND d.s = i.s GROUP BY ALL
)
SELECT doc_id, item_id, n AS n_item, c AS n_found, c / CAST(n AS DOUBLE) AS containment
FROM found WHERE c * 100 >= n * {SIMILARITY}
"""
