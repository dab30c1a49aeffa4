"""Spark settings the library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does three jobs here: it coalesces the small partitions behind the
# first aggregation, it splits hot keys of a sort-merge join, and it turns a planned
# sort-merge join into a broadcast join when a side proves small at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.exchange.reuse": "true",
    "spark.sql.ansi.enabled": "true",  # a sum that overflows is an error
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, app_name: str = "uptakelens", **extra) -> SparkSession:
    """A session with `SETTINGS`; `master` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
