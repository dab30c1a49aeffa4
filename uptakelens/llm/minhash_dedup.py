"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A text's words are separated by blanks and the characters 9 to 13, with A-Z in lower case; its set
are the distinct hashes (64 bits) of all runs of SHINGLE words, or of all words if they are fewer.

Signatures need two permutations only: the first deals a shingle to a place of a circle of 2**UNIVERSE
places, coordinate k of the signature is the least value that the second permutation, shifted by k,
gives to the places of the set. What a shingle adds to all coordinates is thus a run of the second
permutation, and a signature the column-wise minimum of such runs. BANDS bands of ROWS coordinates make
buckets; two sets alike by 0.85 meet in none of them with a probability of 8 in 10 million.

Equal sets are one class, so copies cost nothing further. A class goes by 64 bits of its set; among
10 billion different sets, fewer than three pairs are expected to share them. In every bucket the classes are compared
with its least one, and what is linked becomes one component; then, where a bucket still holds several
components, the classes outside its largest one are compared with all classes of other components.
So every pair of a bucket that could still join two components is verified on the full sets, but for
those that their sizes or their distances from the bucket's first class rule out, while a group of
many copies that do belong together costs a comparison for each copy, not for each pair. Large
buckets whose classes don't belong together are compared in blocks: there, too, every pair is
verified, but none is a row, and blocks meet in as many tasks as there are pairs of blocks.
Components are found by alternating stars. Sets are only made for documents that share a bucket.

A null text, or one without words, is linked with nothing. Repeated rows are copies; rows that share
a doc_id but not a text are told apart by their sets. A component's id is its smallest doc_id,
missing ids left aside (null if it has none). Empty tables give an empty result; only doc_id and
text are read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uptakelens.llm import ragged
from uptakelens.llm.components import roots
from uptakelens.llm.tables import settled, small_side, unused

SHINGLE = 5
#: Least similarity of linked documents, in percent.
SIMILARITY = 85
BANDS, ROWS = 24, 5
UNIVERSE = 22
#: Bytes of text worked on at a time, and shingles whose runs are gathered at a time.
SLICE = 1 << 18
GATHER = 1 << 13
#: Classes of a bucket whose pairs may be rows of a table; in larger buckets they are compared in
#: blocks of so many shingles and so many classes, so many columns of a matrix at a time; their
#: similarities are worked out so many rows at a time.
PAIRS = 64
BLOCK = 1 << 15
CLASSES = 1000
COLUMNS = 1 << 12
STRIP = 256
_STEP = 0xD6E8FEB86659FD93


def _runs() -> np.ndarray:
    return ragged.held("runs", _made_runs)


def _made_runs() -> np.ndarray:
    """Row p: the values of the second permutation from place p on, around the circle."""
    values = np.random.default_rng(5).permutation(np.arange(1 << UNIVERSE, dtype=np.int32))
    around = np.concatenate([values, values[: BANDS * ROWS]])
    return np.lib.stride_tricks.sliding_window_view(around, BANDS * ROWS)


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, by text and hash, and the texts' numbers."""
    data, at = ragged.utf8(column)
    data = ragged.lowered(data)
    begin, end = ragged.words(data, at, (data == 32) | ((data >= 9) & (data <= 13)))
    word = ragged.span_hashes(data, begin, end)
    text = np.searchsorted(at, begin, "right") - 1
    count = np.bincount(text, minlength=len(at) - 1)
    power = ragged.powers(_STEP, k)
    values, texts = [], []
    if len(word) >= k:
        full = np.flatnonzero(text[k - 1 :] == text[: len(text) - k + 1])
        values.append(sum(word[full + j] * power[j] for j in range(k)))
        texts.append(text[full])
    first = np.cumsum(count) - count
    for few in range(1, k):
        own = np.flatnonzero(count == few)
        values.append(sum((word[first[own] + j] * power[j] for j in range(few)), np.zeros(len(own), np.uint64)))
        texts.append(own)
    value = ragged.mixed(np.concatenate(values))
    text = np.concatenate(texts)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], text[new]


def signatures(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Circulant MinHash of n sets; an empty set has the largest value everywhere."""
    runs = _runs()
    mask = (1 << UNIVERSE) - 1
    place = ((value & np.uint64(mask)).astype(np.int64) * 0x2545F491 + 0x1B873593) & mask
    place ^= place >> (UNIVERSE // 2)
    out = np.full((n, BANDS * ROWS), np.iinfo(np.int32).max, np.int32)
    for i in range(0, len(value), GATHER):
        own = text[i : i + GATHER]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        least = np.minimum.reduceat(runs[place[i : i + GATHER]], starts, axis=0)
        out[own[starts]] = np.minimum(out[own[starts]], least)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """The bucket of every band."""
    by_band = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    total = (by_band * ragged.powers(_STEP, ROWS)).sum(2, dtype=np.uint64)
    return ragged.mixed(total + ragged.mixed(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def set_names(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """64 bits that tell sets apart: two sums of stirred hashes, stirred."""
    sums = np.zeros((2, n), np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else []
    if len(starts):
        sums[0, text[starts]] = np.add.reduceat(ragged.mixed(value + np.uint64(1)), starts)
        sums[1, text[starts]] = np.add.reduceat(ragged.mixed(~value), starts)
    return ragged.mixed(sums[0] + ragged.mixed(sums[1])).view(np.int64)


def _shapes(column: pa.Array) -> pa.Array:
    parts = [[], [], []]
    for some in ragged.slices(column, SLICE):
        value, text = shingles(some)
        n = len(some)
        parts[0].append(pa.array(np.bincount(text, minlength=n)))
        parts[1].append(pa.array(set_names(value, text, n)))
        buckets = bands(signatures(value, text, n))
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * BANDS)
        parts[2].append(pa.ListArray.from_arrays(ends, pa.array(buckets.ravel())))
    ragged.released()
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
    whole = [pa.concat_arrays(p) if p else pa.array([], t) for p, t in zip(parts, kinds, strict=True)]
    return pa.StructArray.from_arrays(whole, ["n", "node", "buckets"])


def _sets(column: pa.Array) -> pa.Array:
    names, sets = [], []
    for some in ragged.slices(column, SLICE):
        value, text = shingles(some)
        names.append(pa.array(set_names(value, text, len(some))))
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(some)))])
        sets.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value.view(np.int64))))
    ragged.released()
    if not names:
        names, sets = [pa.array([], pa.int64())], [pa.array([], pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays([pa.concat_arrays(names), pa.concat_arrays(sets)], ["node", "set"])


def shapes(docs: DataFrame) -> DataFrame:
    """Settled: doc_id, text_hash, n (size of the set), node (its name) and buckets of every
    document."""
    shape = F.arrow_udf(_shapes, "struct<n:bigint,node:bigint,buckets:array<bigint>>")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), shape("text").alias("s"))
    return settled(rows.select("doc_id", "text_hash", "s.*"))


def members(shaped: DataFrame) -> DataFrame:
    """Settled: bucket, hub (its least class), node and n of every class in a bucket of several."""
    classes = shaped.filter("n > 0").groupBy("node").agg(
        F.max("n").alias("n"), F.first("buckets").alias("buckets")
    )
    rows = classes.select("node", "n", F.explode("buckets").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c"))
    return settled(rows.join(hubs.filter("c > 1").drop("c"), "bucket"))


def full_sets(docs: DataFrame, shaped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Settled: node and its set, for the given nodes. One document stands for each, by its id and
    text, so that rows without id, or of one id, are met by copies of theirs only. The function
    counts as not deterministic, else Spark would move the test of its result below the join, and
    make the sets of all documents."""
    first = shaped.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    wanted = first.join(nodes, "node").selectExpr("node AS wanted", "first.doc_id AS first", "first.text_hash")
    same = F.expr("doc_id <=> first AND xxhash64(text) = text_hash")
    rows = docs.select("doc_id", "text").join(small_side(settled(wanted)), same)
    made = F.arrow_udf(_sets, "struct<node:bigint,set:array<bigint>>").asNondeterministic()
    rows = rows.select("wanted", made("text").alias("s")).filter("wanted = s.node")
    return settled(rows.select("s.*").dropDuplicates(["node"]))


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Settled: the pairs (a, b), whether their full sets are alike by `percent` (linked), and their
    Jaccard distance."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.withColumn("shared", F.expr("bigint(size(array_intersect(set_a, set_b)))"))
    both = both.withColumn("whole", F.expr("size(set_a) + size(set_b) - shared"))
    linked = f"100 * shared >= {percent} * whole AS linked"
    return settled(both.selectExpr("a", "b", linked, "1 - shared / double(whole) AS distance"))


def still_open(
    near: DataFrame, stars: DataFrame, root: DataFrame, shaped: DataFrame
) -> DataFrame:
    """Settled: of the buckets that hold several components, every class with its component (root),
    the component most of the bucket's classes belong to (main), their number, its distance from
    the bucket's hub where that is known, and its buckets."""
    grouped = near.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = settled(grouped.select("bucket", "hub", "node", "n", "root"))
    largest = grouped.groupBy("bucket", "root").count().groupBy("bucket")
    largest = largest.agg(
        F.max(F.struct("count", "root")).alias("top"),
        F.count(F.lit(1)).alias("c"),
        F.sum("count").alias("members"),
    )
    several = largest.filter("c > 1").select("bucket", F.col("top.root").alias("main"), "members")
    distances = stars.select(F.col("a").alias("hub"), F.col("b").alias("node"), "distance")
    open_ = grouped.join(several, "bucket").join(distances, ["hub", "node"], "left")
    open_ = settled(open_.withColumn("distance", F.expr("if(node = hub, 0D, distance)")))
    nodes = settled(open_.select("node").distinct())
    wide = shaped.join(small_side(nodes), "node", "left_semi").groupBy("node")
    return settled(open_.join(wide.agg(F.first("buckets").alias("buckets")), "node"))


def open_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a bucket and can be alike, of
    the buckets of at most PAIRS classes.

    Each is made once, in the first bucket it shares, from the side that is outside the bucket's
    main component. Sizes must allow the similarity, and so must the distances from the hub: as
    Jaccard distance is a metric, two sets are at least as far apart as these differ."""
    open_ = open_.filter(f"members <= {PAIRS}")
    outside = open_.filter("root <> main").selectExpr(
        "bucket", "node AS a", "n AS n_a", "root AS root_a", "distance AS distance_a", "buckets AS buckets_a"
    )
    able = (
        "root <> root_a AND (root = main OR a < node)"
        f" AND 100 * least(n, n_a) >= {percent} * greatest(n, n_a)"
        f" AND coalesce(abs(distance - distance_a) <= {(100 - percent) / 100 + 1e-9}D, true)"
        " AND bucket = get(array_intersect(buckets_a, buckets), 0)"
    )
    return outside.join(open_.drop("hub"), "bucket").filter(able).selectExpr("a", "node AS b")


def _alike(cells: pa.Array, percent: int) -> pa.Array:
    """Of each cell, one or two lists of classes: pairs that are alike by `percent` and belong to
    different components, one for every two components; of two lists only pairs across them."""
    out = []
    for cell in cells:
        lists = cell.values
        side = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        members = lists.flatten()
        node, root = (members.field(name).to_numpy() for name in ("node", "root"))
        size = pc.list_value_length(members.field("set")).to_numpy()
        _, shingle = np.unique(members.field("set").flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(node)), size)
        shared = np.zeros((len(node), len(node)), np.float32)
        order = np.argsort(shingle, kind="stable")
        shingle, row = shingle[order], row[order]
        for begin in range(0, int(shingle[-1]) + 1, COLUMNS):
            some = slice(*np.searchsorted(shingle, (begin, begin + COLUMNS)))
            has = np.zeros((len(node), COLUMNS), np.float32)
            has[row[some], shingle[some] - begin] = 1
            shared += has @ has.T
        # Pairs of components by one number; of each, the first pair of classes.
        _, number = np.unique(root, return_inverse=True)
        pairs, keys = [], []
        for begin in range(0, len(node), STRIP):
            strip = slice(begin, begin + STRIP)
            whole = size[strip, None] + size[None, :] - shared[strip]
            found = (100 * shared[strip] >= percent * whole) & (number[strip, None] < number[None, :])
            if len(lists) > 1:
                found &= side[strip, None] != side[None, :]
            a, b = np.nonzero(found)
            key, first = np.unique(number[begin + a] * len(node) + number[b], return_index=True)
            keys.append(key)
            pairs.append(np.stack([node[begin + a[first]], node[b[first]]]))
        _, first = np.unique(np.concatenate(keys), return_index=True)
        out.append(np.concatenate(pairs, axis=1)[:, first])
    ends = np.cumsum([0, *(x.shape[1] for x in out)]).astype(np.int32)
    a, b = (pa.array(x) for x in np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([a, b], ["a", "b"]))


def links_in_blocks(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the classes of the buckets of more than PAIRS classes.

    Classes that such buckets hold together, directly or by others, are a family. A family is dealt
    into blocks of about BLOCK shingles and CLASSES classes at most, and every two blocks, and every block by itself, are a cell:
    its sets are compared inside one task, as a product of matrices, and only links leave it. So no
    pair is a row, a large family is spread over as many tasks as it has cells, and each pair is
    compared once, in however many buckets it is."""
    large = open_.filter(f"members > {PAIRS}").select("bucket", "hub", "node", "root", "n")
    family = roots(large.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    family = family.withColumnsRenamed({"a": "node", "b": "family"})
    rows = large.select("node", "root", "n").distinct().join(family, "node", "left")
    rows = rows.withColumn("family", F.coalesce("family", "node"))
    parts = f"int(ceil(greatest(sum(n) / {BLOCK}, count(*) / {CLASSES})))"
    blocks = rows.groupBy("family").agg(F.expr(parts).alias("blocks"))
    rows = rows.join(blocks, "family").withColumn("block", F.expr("pmod(xxhash64(node, 3), blocks)"))
    rows = rows.join(sets, "node").groupBy("family", "blocks", "block")
    rows = rows.agg(F.collect_list(F.struct("node", "root", "set")).alias("members"))
    cells = rows.selectExpr("*", "explode(sequence(0, blocks - 1)) AS other").selectExpr(
        "family", "least(block, other) AS i", "greatest(block, other) AS j", "members"
    )
    cells = cells.groupBy("family", "i", "j").agg(F.collect_list("members").alias("lists"))

    def alike(column: pa.Array) -> pa.Array:
        return _alike(column, percent)

    found = F.arrow_udf(alike, "array<struct<a:bigint,b:bigint>>")("lists")
    return settled(cells.select(F.explode(found).alias("l")).select("l.*"))


def links(docs: DataFrame, shaped: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """Settled: nodes (a) and the root (b) of their component, for all but the roots."""
    near = members(shaped)
    sets = full_sets(docs, shaped, near.select("node").distinct())
    sizes = near.select(F.col("node").alias("hub"), F.col("n").alias("n_hub")).distinct()
    able = f"100 * least(n, n_hub) >= {percent} * greatest(n, n_hub)"
    stars = near.filter("node <> hub").select("hub", "node", "n").distinct().join(sizes, "hub")
    stars = compared(stars.filter(able).selectExpr("hub AS a", "node AS b"), sets, percent)
    linked = stars.filter("linked").select("a", "b")
    root = roots(linked).withColumnsRenamed({"a": "node", "b": "root"})
    open_ = still_open(near, stars, root, shaped)
    more = compared(open_pairs(open_, percent), sets, percent).filter("linked").select("a", "b")
    more = more.unionAll(links_in_blocks(open_, sets, percent))
    return roots(root.selectExpr("node AS a", "root AS b").unionAll(more))


def without_copies(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id
    (rows without one come last), of these the one whose text has the least hash. Rows are told
    by id and text, so that a copy takes no other text of its id along; rows that are alike in
    both are one document, of which any row stays. Documents without words all stay."""
    own = docs.select("doc_id", "text")
    shaped = shapes(own)
    root = links(own, shaped, percent).withColumnsRenamed({"a": "node", "b": "root"})
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").alias("place")
    places = shaped.filter("n > 0").groupBy("node", order).count()
    firsts = places.groupBy("node").agg(F.min("place").alias("place")).join(root, "node", "left")
    firsts = firsts.withColumn("root", F.coalesce("root", "node"))
    best = firsts.groupBy("root").agg(F.min("place").alias("best"))
    by_node = small_side(settled(firsts.join(best, "root").select("node", "best")))
    judged = settled(places.join(by_node, "node").selectExpr("place.*", "place <=> best AS stays", "count"))
    id_, hash_ = (unused(n, docs.columns) for n in ("gone_id", "gone_hash"))
    marked = docs.withColumn(hash_, F.xxhash64("text"))

    def meeting(test: str) -> tuple[DataFrame, Column]:
        found = judged.filter(test).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(f"{hash_}_"))
        return small_side(settled(found)), F.expr(f"doc_id <=> {id_} AND {hash_} = {hash_}_")

    rows = marked.join(*meeting("NOT stays"), "left_anti")
    if judged.filter("stays AND count > 1").isEmpty():
        return rows.select(docs.columns)
    once = rows.join(*meeting("stays AND count > 1"), "left_anti")
    several = rows.join(*meeting("stays AND count > 1"), "left_semi").dropDuplicates(["doc_id", hash_])
    return once.unionAll(several).select(docs.columns)


def report(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select("doc_id", "text")
    shaped = shapes(docs)
    root = links(docs, shaped, percent).withColumnsRenamed({"a": "node", "b": "root"})
    first = shaped.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = first.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = rooted.join(ids, "root").select("node", "component_id")
    empty = F.expr("n = 0")
    rows = shaped.filter("n > 0").join(by_node, "node").select("doc_id", "n", "component_id")
    rows = rows.unionAll(shaped.filter(empty).select("doc_id", "n", F.col("doc_id").alias("component_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)
