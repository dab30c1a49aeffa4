"""The stages that turn raw documents into encoded training text.

Each stage takes what its predecessor kept and returns documents with the same columns; the last
returns the ids of every document's pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uptakelens.llm import (
    decontamination,
    language_id,
    line_dedup,
    minhash_dedup,
    sentencepiece_codec,
)
from uptakelens.llm.tables import shared_folder, table
from uptakelens.sources.writers import remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, by its languages and scores."""
    return language_id.accepted(docs, language_id.train(docs, language_id.training_fold()))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; n_chars follows. Documents of which
    nothing but white space is left by that go."""
    rows = line_dedup.without_boilerplate(docs)
    left = rows.filter(r"n_removed = 0 OR text rlike '\\S'")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.withColumn("n_chars", F.coalesce(n_chars, "n_chars")).select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return minhash_dedup.without_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, and the ids of the text's pieces."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.read_model())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("encoding", encoded),
]

#: Language identification and encoding can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next. A
    stage's folder goes when its successor is written, so that the last one's input stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}_{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                remove(spark, before)
            before = path
    return docs
