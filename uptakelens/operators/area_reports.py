"""Reports by area and constituency, per label and for everybody, without a loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.functions import counts, rates, text
from uptakelens.functions.sql import literal
from uptakelens.operators.clean import with_attributes
from uptakelens.operators.vocabulary import report_groups
from uptakelens.settings import DEFAULT, Settings
from uptakelens.sources.areas import Areas


def with_constituency(gaps: DataFrame, areas: Areas) -> DataFrame:
    return with_attributes(gaps, areas, ["constituency"])


def per_label_and_everyone(
    gaps: DataFrame, keys: Sequence[str], settings: Settings = DEFAULT
) -> DataFrame:
    """Gap and total per label and keys, and once more per keys over all labels.

    A NULL below makes the sum NULL. `grouping` marks the rows for everybody: a label can
    itself be NULL, so the label column alone would not do.
    """
    sums = gaps.groupingSets([["label", *keys], list(keys)], "label", *keys).agg(
        F.expr("grouping(label) = 1 AS is_everyone"),
        F.expr(f"{counts.complete_sum('gap')} AS gap"),
        F.expr(f"{counts.complete_sum('total')} AS total"),
    )
    label = f"IF(is_everyone, {literal(settings.everyone)}, label)"
    return sums.selectExpr(f"{label} AS label", *keys, "is_everyone", "gap", "total")


def of_report_groups(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """The report groups with their rows; "All" as a label is not taken for everybody."""
    return groups.join(rows, ["label", "is_everyone"], how)


def constituency_share(
    gaps: DataFrame, vocabulary: DataFrame, settings: Settings = DEFAULT
) -> DataFrame:
    """Gap, total and share of the label's gap by constituency, largest share first.

    Labels outside the vocabulary have no table of their own but count for everybody.
    """
    sums = of_report_groups(
        per_label_and_everyone(gaps, ["constituency"], settings),
        report_groups(vocabulary, settings.everyone),
    )
    whole = "PARTITION BY ord"
    label_gap = counts.complete_sum("gap", over=whole)
    whole_gap = sums.selectExpr("*", f"try_divide(100 * gap, {label_gap}) AS exact")
    shares = whole_gap.selectExpr("*", f"{rates.rounded('exact', 1, settings.rounding)} AS share")
    ranked = f"{whole} ORDER BY share DESC NULLS LAST, constituency ASC NULLS LAST"
    return shares.selectExpr(
        "ord",
        "label",
        "constituency",
        "gap",
        "total",
        "share",
        f"row_number() OVER ({ranked}) AS position",
    )


def gap_totals(
    gaps: DataFrame, vocabulary: DataFrame, settings: Settings = DEFAULT
) -> DataFrame:
    """Total gap and population per label and for everybody, with caption and file name.

    A label of the vocabulary that the register lacks has 0 of 0.
    """
    sums = per_label_and_everyone(gaps, [], settings).selectExpr("*", "true AS found")
    groups = report_groups(vocabulary, settings.everyone)
    sentences = settings.group_caption, settings.everyone_caption
    caption = text.caption(
        "label", "is_everyone", settings.ages_text, settings.period_text, *sentences
    )
    rows = of_report_groups(sums, groups, "left").selectExpr(
        "ord",
        "label",
        "is_everyone",
        "IF(found IS NULL, 0L, gap) AS gap",
        "IF(found IS NULL, 0L, total) AS total",
    )
    return rows.selectExpr(
        "ord",
        "label",
        "gap",
        "total",
        f"{text.part_of_text('gap', 'total')} AS summary",
        f"{caption} AS caption",
        f"{text.slug('label')} AS file_name",
    )


def area_layer(
    gaps: DataFrame, vocabulary: DataFrame, areas: Areas, settings: Settings = DEFAULT
) -> DataFrame:
    """One published value per report group and target area.

    Suppression acts on the group's own value, for everybody on the sum. An area without
    a value gets 0; in strict mode so does an area whose gap is not known, which the column
    `is_known` tells apart.

    An area's values by label are gathered in a map (a vocabulary's worth of entries), which the
    target areas meet by their name. The report groups, one row that holds them all (at most
    MAX_LABELS of them), are set beside each area and unfolded there. So the areas move once at
    most, and gaps that are laid out by area not at all. (As a subquery, that row would have the
    events scanned a second time.)
    """

    def published(gap: str) -> str:
        return f"struct({counts.suppressed(gap, settings.small_number)} AS value, {gap} IS NULL AS unknown)"

    by_label = gaps.groupBy("area", "label").agg(F.expr(f"{counts.complete_sum('gap')} AS gap"))
    per_area = by_label.groupBy("area").agg(
        F.expr(
            f"map_from_entries(collect_list(struct(label, {published('gap')}))"
            " FILTER (WHERE label IS NOT NULL)) AS by_label"
        ),
        F.expr(f"{counts.complete_sum('gap')} AS gap"),
    )
    groups = report_groups(vocabulary, settings.everyone).agg(
        F.expr("array_sort(collect_list(struct(ord, label, is_everyone))) AS groups")
    )
    layer = areas.targets.distinct().join(per_area.withColumn("found", F.lit(True)), "area", "left")
    rows = layer.crossJoin(F.broadcast(groups)).selectExpr(
        "area", "found", "gap", "by_label", "inline(groups)"
    )
    everyone = f"IF(found, {published('gap')}, NULL)"
    rows = rows.selectExpr(
        "ord", "label", "area", f"IF(is_everyone, {everyone}, try_element_at(by_label, label)) AS shown"
    )
    return rows.selectExpr(
        "ord",
        "label",
        "area",
        "coalesce(shown.value, 0L) AS value",
        "NOT coalesce(shown.unknown, false) AS is_known",
    )
