"""Line dedup by distinct-site spread: lines that many sites share are boilerplate and go.

A document's lines are compared without blanks at their ends; lines of fewer than MIN_CHARS
characters are left alone. One pass sums up, for each line's hash, a HyperLogLog sketch of the sites
(sources) it occurs on; sketches merge before and after the shuffle, so a line in a third of all
documents is one sketch per task. Lines whose estimate is clearly above MIN_SITES are boilerplate,
clearly below are not; for those in between (NEAR) a second pass counts the distinct sites exactly. Of
every boilerplate line one occurrence stays, that of the smallest doc_id and place, so that no
content is lost; all others are removed.

Only hashes and places are shuffled for the search. Of all lines few are left when the sites are
counted; they are settled in fewer files than a shuffle has partitions (FILES), as on a local file
system every file of a checkpoint starts two processes. To rebuild texts, documents are joined once
with the places of their removed lines. A null text stays null and has no lines; a null site counts as
no site; repeated rows lose the same lines (and keep the same first one); documents that lose all
lines have an empty text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.llm.tables import settled, small_side, unused

MIN_SITES = 10
MIN_CHARS = 10
#: Estimates within this share of MIN_SITES are counted exactly; the sketches' standard error is
#: 1.6 % (2**12 registers), and less for few sites.
NEAR = 0.25
#: One file of a settled table of lines for so many partitions of the shuffle before it.
FILES = 16


def places(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key (hash of the text), source, place and line hash of every line."""
    rows = docs.selectExpr(
        "doc_id", "xxhash64(text) AS key", "source", r"posexplode(split(text, '\n')) AS (place, line)"
    ).withColumn("line", F.trim("line"))
    return rows.filter(F.length("line") >= min_chars).withColumn("line", F.xxhash64("line"))


def gathered(lines: DataFrame) -> DataFrame:
    """Settled: the few lines that a filter has left in each partition of a shuffle."""
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(lines.repartition(1 + partitions // FILES))


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Settled: line, and whether it is surely on `min_sites` sites; lines surely on fewer are left out."""
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("source")).alias("sites")
    sites = lines.filter("source IS NOT NULL").groupBy("line").agg(sketch)
    sites = sites.filter(F.col("sites") >= min_sites * (1 - NEAR))
    return gathered(sites.select("line", (F.col("sites") > min_sites * (1 + NEAR)).alias("sure")))


def removals(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key and the places of the lines to remove."""
    lines = places(docs, min_chars)
    hits = settled(lines.join(small_side(spread(lines, min_sites)), "line"))
    boilerplate = (
        hits.groupBy("line")
        .agg(
            F.max("sure").alias("sure"),
            F.expr("count(DISTINCT if(sure, NULL, source))").alias("sites"),
            F.min(F.struct("doc_id", "place")).alias("first"),
        )
        .filter(F.col("sure") | (F.col("sites") >= min_sites))
        .select("line", "first")
    )
    gone = hits.join(small_side(gathered(boilerplate)), "line")
    gone = gone.filter("NOT (struct(doc_id, place) <=> first)")
    return gone.groupBy("doc_id", "key").agg(F.collect_set("place").alias("gone"))


def without_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS
) -> DataFrame:
    """The documents with the boilerplate lines taken out of text, and n_lines and n_removed
    (columns of these names are replaced)."""
    found = removals(docs, min_sites, min_chars)
    id_, key, gone, lines = (unused(n, docs.columns) for n in ("gone_id", "gone_key", "gone", "lines"))
    found = found.toDF(id_, key, gone)
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key))
    rows = docs.join(found, same, "left").withColumn(lines, F.expr(r"split(text, '\n')"))
    left = f"array_except(sequence(0, size({lines}) - 1), {gone})"
    rebuilt = rf"array_join(transform({left}, i -> {lines}[i]), '\n')"
    text = f"if({gone} IS NULL, text, {rebuilt})"
    counts = {
        "n_lines": f"bigint(coalesce(size({lines}), 0))",
        "n_removed": f"bigint(coalesce(size({gone}), 0))",
    }
    own = [c for c in docs.columns if c not in counts]
    return rows.select(
        *(F.expr(text).alias(c) if c == "text" else F.col(c) for c in own),
        *(F.expr(e).alias(c) for c, e in counts.items()),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines and n_removed of every document."""
    return without_boilerplate(docs.select("doc_id", "text", "source"), MIN_SITES).drop("source")


SQL = f"""
WITH l AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents
), p AS (
  SELECT doc_id, source, i - 1 AS place, trim(lines[i]) AS line
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)
  WHERE length(trim(lines[i])) >= {MIN_CHARS}
), b AS (
  SELECT line, min(row(doc_id, place)) AS first FROM p
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), gone AS (
  SELECT doc_id, list(place) AS gone FROM p JOIN b USING (line)
  WHERE row(doc_id, place) IS DISTINCT FROM first GROUP BY doc_id
)
SELECT doc_id,
  CASE WHEN gone IS NULL THEN array_to_string(lines, chr(10))
    ELSE array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(gone, i - 1)], chr(10))
  END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN gone USING (doc_id)
"""
