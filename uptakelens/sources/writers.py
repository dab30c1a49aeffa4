"""Writing results, and the shared folder that intermediate tables live in."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from uptakelens.functions.text import slug


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder.

    Only a local session without that setting falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return f"{folder.rstrip('/')}/uptakelens-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"uptakelens-{spark.sparkContext.applicationId}")


def settled(rows: DataFrame) -> DataFrame:
    """The rows written to the session's checkpoint folder and read from there."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def new_folder(spark: SparkSession, name: str, within: str | None = None) -> str:
    """A path in a folder (default: the shared one) that nothing else reads or writes."""
    return f"{(within or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_results(
    results: DataFrame,
    path: str,
    file_format: str = "parquet",
    names: Mapping[str, str] | None = None,
    partition_by: Sequence[str] = (),
) -> str:
    """Write one result table; CSV files carry a header, NA for missing values and a quoted empty
    text for an empty one."""
    if names:
        results = results.withColumnsRenamed(names)
    writer = results.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def sheets(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """The results with a column `sheet`, the file-name form of the last of `by`.

    The rebalance hint gathers a sheet's rows into few files and still splits a sheet
    that is too large for one task.
    """
    return results.selectExpr("*", f"{slug(by[-1])} AS sheet").hint("rebalance", *by)


def write_sheets(
    results: DataFrame, path: str, by: Sequence[str], file_format: str = "csv"
) -> str:
    """One folder per combination of `by`, the last of which names the sheet.

    Labels that differ are in folders of their own even where their file-name forms agree.
    """
    return write_results(sheets(results, by), path, file_format, partition_by=by)


def load_once(
    spark: SparkSession,
    rows: DataFrame,
    name: str,
    folder: str | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Write the rows to a new place in the folder (default: the shared one) and read them back.

    Later queries start from the written table: the inputs are scanned once, and a lost
    executor costs no recomputation.
    """
    path = new_folder(spark, name, folder)
    schema = rows.schema
    write_results(rows, path, partition_by=partition_by)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def laid_out(spark: SparkSession, folder: str, by: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that writes rows into the folder in buckets by a column, and reads them back:
    what sums or joins by that column needs no further shuffle. The tables' names are forgotten
    at the end; the folder is the caller's."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = []

    def write(rows: DataFrame, name: str) -> DataFrame:
        table = f"{name}_{uuid.uuid4().hex}"
        dealt = rows.repartition(buckets, by).write.bucketBy(buckets, by)
        dealt.option("path", f"{folder.rstrip('/')}/{table}").saveAsTable(table)
        names.append(table)
        return spark.table(table)

    try:
        yield write
    finally:
        for table in names:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, wherever it is stored."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
