"""Documents with everything that can be odd about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN = "The quick brown fox jumps over the lazy dog, and you know it well.\nAnother line of text here."
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(60_000))
ROWS = [
    (1, PLAIN, "en", "a"),
    (2, PLAIN, "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n ", "fr", "c"),
    (6, "1234 5678 !!!", "fr", None),
    (7, LONG, "en", "a"),
    (8, "x" * 150_000, "de", "b"),
    (9, "one two", "de", "b"),
    (10, "É▁日本語 \x00 😀 ñandú\n\n\nfin", "es", "c"),
    (11, PLAIN.upper(), "en", "d"),
    (11, PLAIN.upper(), "en", "d"),
    (12, "first of two rows with an id in common", "en", "e"),
    (12, "second of two rows with an id in common", "en", "e"),
    (None, PLAIN, "en", "f"),
    (None, None, None, None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Names that operators use inside, or give to their results.
CLASHES = (
    "score lang_pred held_out host path rule verdict key line lines place block extra n node bucket "
    "hub root set a b h s w m i need sketch first above ids document chunk text_of kind begin row "
    "gone found parts features raw label toxic prediction probability n_lines n_removed kept component_id"
).split()


def odd(spark: SparkSession, extra: bool = True) -> DataFrame:
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.withColumns({c: F.lit("x") for c in CLASHES}) if extra else docs


def empty(spark: SparkSession) -> DataFrame:
    return odd(spark, extra=False).filter("false")


def table(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def rows_of(frame: DataFrame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=repr)
