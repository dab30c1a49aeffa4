"""Reading the text tables, cutting lineage, and joins whose small side is checked."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few numbers each (some 50 MB as a
#: hash table); beyond, the join shuffles. The result is the same.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share. Where that is
    unset, a temporary folder serves on a local master; a cluster without it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def settled(frame: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that a lost executor costs no
    recomputation and every later use sees the same rows."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def small_side(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A settled frame of narrow rows, with a broadcast hint if it has at most `most` rows."""
    return F.broadcast(frame) if frame.count() <= most else frame


def training_fold() -> str:
    """SQL: the row may be learned from (crc32 of the id as text, mod 4, is not 2).
    A missing id counts as held out."""
    return "coalesce(pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) <> 2, false)"


def unused(name: str, columns: list[str]) -> str:
    """The name, or one like it, that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
