"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from uptakelens.llm import (
    chat_format,
    decontamination,
    fill_in_middle,
    language_id,
    line_dedup,
    minhash_dedup,
    personal_data,
    secret_scan,
    sentencepiece_codec,
    source_divergence,
    toxicity,
    url_filter,
    winnowing,
)
from uptakelens.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    """The operator applied to one whole table."""
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def all_queries() -> dict[str, Query]:
    """One query for each operator."""
    return {
        "op1_language_id": over("documents", language_id.identify),
        "op2_url_filter": over("pages", url_filter.judge),
        "op3_chat_perspectives": over("conversations", chat_format.rotated),
        "op4_line_dedup": over("documents", line_dedup.report),
        "op5_minhash_dedup": over("documents", minhash_dedup.report),
        "op6_decontamination": lambda spark, sf_dir: decontamination.leaks(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
        ),
        "op7_toxicity": lambda spark, sf_dir: toxicity.report(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        ),
        "op8_winnowing": over("documents", winnowing.report),
        "op9_sentencepiece": over("documents", sentencepiece_codec.report),
        "op10_secret_scan": over("documents", secret_scan.report),
        "op11_personal_data": over("documents", personal_data.report),
        "op12_fill_in_middle": over("documents", fill_in_middle.report),
        "op13_source_divergence": over("documents", source_divergence.report),
    }


def all_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express on whole tables."""
    return {
        "op3_chat_perspectives": chat_format.SQL,
        "op4_line_dedup": line_dedup.SQL,
        "op6_decontamination": decontamination.SQL,
        "op12_fill_in_middle": fill_in_middle.SQL,
        "op13_source_divergence": source_divergence.SQL,
    }
