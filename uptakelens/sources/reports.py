"""Reports that are there whole or not at all.

A report is a folder of tables. Each run writes to a folder of its own below it and lists every
table, with its format, rows and schema, in a manifest; only then a small file, the pointer, is
renamed into place, which names the run. Whoever reads goes by the pointer and so sees the old
report until the new one is complete, and the old one still if a run fails half way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from uptakelens.sources import writers

POINTER = "CURRENT"
MANIFEST = "MANIFEST.json"
RUNS = "runs"
#: Writes submitted at a time.
WRITERS = 4
#: Complete runs that stay, the newest one included: what a reader has open stays readable.
KEPT = 2


@dataclass(frozen=True)
class Entry:
    """A table of a report: its folder in the run, format, number of rows and schema."""

    path: str
    file_format: str
    rows: int
    schema: T.StructType


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is renamed into place, over an older one."""
    target, made = _path(spark, path), _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = _files(spark, path).create(made, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    whole = _files(spark, path).makeQualified(target)
    context = hadoop.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    option[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(_files(spark, path).makeQualified(made), whole, option)


def _read_text(spark: SparkSession, path: str) -> str | None:
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return None
    return "\n".join(row.value for row in spark.read.text(path, wholetext=True).collect())


def write_report(
    spark: SparkSession,
    folder: str,
    jobs: Mapping[str, tuple[DataFrame, str, Callable[[DataFrame, str], str]]],
    kept: int = KEPT,
) -> dict[str, str]:
    """Write every table (frame, format, and a function that writes it to a path) into a new run
    and then make it the current one. Returns the tables' paths by name.

    If a table fails, the run's folder goes and the error is raised; the current report stays.
    """
    run = f"{RUNS}/{uuid.uuid4().hex}"
    own = f"{folder.rstrip('/')}/{run}"

    def written(name: str) -> dict:
        frame, file_format, write = jobs[name]
        path = write(frame, f"{own}/{name}")
        rows = spark.read.format(file_format).options(header=True).load(path).count()
        return {"path": name, "format": file_format, "rows": rows, "schema": frame.schema.jsonValue()}

    try:
        with ThreadPoolExecutor(WRITERS) as pool:
            entries = dict(zip(jobs, pool.map(written, jobs), strict=True))
        _write_text(spark, f"{own}/{MANIFEST}", json.dumps(entries))
    except BaseException:
        writers.remove(spark, own)
        raise
    history = [run, *_history(spark, folder)]
    _write_text(spark, f"{folder.rstrip('/')}/{POINTER}", "\n".join(history[:kept]))
    for old in history[kept:]:
        writers.remove(spark, f"{folder.rstrip('/')}/{old}")
    return {name: f"{own}/{entry['path']}" for name, entry in entries.items()}


def _history(spark: SparkSession, folder: str) -> list[str]:
    """The runs that the pointer names, the current one first."""
    text = _read_text(spark, f"{folder.rstrip('/')}/{POINTER}")
    return text.split("\n") if text else []


def entries(spark: SparkSession, folder: str) -> dict[str, Entry]:
    """What the current report holds, by its manifest."""
    runs = _history(spark, folder)
    if not runs:
        raise FileNotFoundError(f"{folder} has no complete report")
    own = f"{folder.rstrip('/')}/{runs[0]}"
    found = json.loads(_read_text(spark, f"{own}/{MANIFEST}") or "{}")
    return {
        name: Entry(f"{own}/{e['path']}", e["format"], e["rows"], T.StructType.fromJson(e["schema"]))
        for name, e in found.items()
    }


def read_report(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The current report's tables, or the named ones, under the schema they were written with."""
    held = entries(spark, folder)
    missing = [n for n in names if n not in held]
    if missing:
        raise ValueError(f"the report in {folder} lacks {missing}")
    return {n: _table(spark, held[n]) for n in names or held}


def _table(spark: SparkSession, entry: Entry) -> DataFrame:
    reader = spark.read.schema(entry.schema).format(entry.file_format)
    if entry.file_format == "csv":
        reader = reader.option("header", True).option("nullValue", "NA").option("emptyValue", "")
    return reader.load(entry.path)
