"""The ordered list of labels that the reports run over."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uptakelens import reference_values as fixed
from uptakelens.functions import labels
from uptakelens.functions.sql import listed, literal, name
from uptakelens.settings import DEFAULT, Settings

#: More report groups than this are taken for text that was never cleaned.
MAX_LABELS = 10_000


def given_vocabulary(
    spark: SparkSession, order: Sequence[str], settings: Settings = DEFAULT
) -> DataFrame:
    """The caller's labels in the caller's order."""
    rows = spark.createDataFrame(
        [(label, i) for i, label in enumerate(order, 1)], "label string, ord int"
    )
    broad = labels.event_broad_group("label", settings.event_broad_groups)
    return rows.selectExpr("label", f"{broad} AS broad_group", "ord")


def vocabulary(labelled_cells: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Labels found among the events, numbered from the last in (broad group, label) order.

    A label without a broad group sorts last and so comes first here. The window sees the
    distinct labels only, after aggregation, never the facts. A missing label is left out
    through its sum: a filter on the label itself would be pushed to the raw rows and
    clean the text of each. More than MAX_LABELS labels are an error.
    """
    found = (
        labelled_cells.groupBy("label")
        .agg(F.expr("sum(CASE WHEN label IS NOT NULL THEN events END) AS events"))
        .filter("events > 0")
    )
    broad = labels.event_broad_group("label", settings.event_broad_groups)
    last_first = "broad_group DESC NULLS FIRST, label DESC"
    place = f"row_number() OVER (ORDER BY {last_first})"
    return found.selectExpr("label", f"{broad} AS broad_group").selectExpr(
        "label", "broad_group", f"{bounded(place)} AS ord"
    )


def numbered(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows of every label found among the events with its place `ord` in the vocabulary, which
    a label outside of it doesn't have. Where the vocabulary is not given, it is that of the rows
    themselves, so that it needn't be derived once more; few rows for each label are numbered."""
    if settings.labels is not None:
        places = given_vocabulary(rows.sparkSession, settings.labels, settings)
        places = places.selectExpr("label AS known_label", "ord")
        return rows.join(places, F.expr("label <=> known_label"), "left").drop("known_label")
    broad = labels.event_broad_group("label", settings.event_broad_groups)
    last_first = "label IS NULL, broad_group DESC NULLS FIRST, label DESC"
    place = f"dense_rank() OVER (ORDER BY {last_first})"
    kept = [name(c) for c in rows.columns]
    found = rows.selectExpr(*kept, f"{broad} AS broad_group")
    return found.selectExpr(*kept, f"IF(label IS NULL, NULL, {bounded(place)}) AS ord")


def bounded(place: str) -> str:
    """The place of a label, or an error beyond MAX_LABELS."""
    error = literal(f"more than {MAX_LABELS} labels: has the text been cleaned?")
    return f"IF({place} > {MAX_LABELS}, CAST(raise_error({error}) AS INT), {place})"


def in_vocabulary(rows: DataFrame, labels_in_order: DataFrame) -> DataFrame:
    """Keep labels of the vocabulary and their place; any other label becomes NULL.

    The vocabulary has no NULL, so null-safe equality gives the same rows. Plain equality
    would add a not-null filter on the cleaned text that moves down to the raw rows.
    """
    kept = [column for column in rows.columns if column != "label"]
    known = labels_in_order.selectExpr("ord", "label AS known_label")
    return rows.join(known, F.expr("label <=> known_label"), "left").selectExpr(
        *kept, "ord", "known_label AS label"
    )


def report_groups(labels_in_order: DataFrame, everyone: str = fixed.EVERYONE) -> DataFrame:
    """The vocabulary followed by one more group for everybody."""
    last = labels_in_order.agg(F.expr("CAST(count(1) + 1 AS INT) AS ord"))
    return labels_in_order.selectExpr("label", "ord", "false AS is_everyone").union(
        last.selectExpr(f"{literal(everyone)} AS label", "ord", "true AS is_everyone")
    )


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def require_labels(rows: DataFrame, column: str, expected: Iterable[str]) -> None:
    """Raise when a fixed column list names a label the data does not have."""
    expected = list(expected)
    listed_rows = rows.filter(f"{name(column)} IN ({listed(expected)})")
    # at most len(expected) rows
    present = {row[0] for row in distinct_values(listed_rows, column).collect()}
    missing = [label for label in expected if label not in present]
    if missing:
        raise ValueError(f"no rows for the labels {missing}")
