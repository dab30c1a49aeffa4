"""Target areas and their attributes, with the size check behind every broadcast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.functions.sql import name
from uptakelens.sources.writers import settled

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: The screen of a list too large to broadcast: at most so many words of 64 bits, one for about
#: so many areas. Its size doesn't depend on the list's beyond that.
SCREEN_WORDS = 1 << 20
AREAS_PER_WORD = 4


@dataclass(frozen=True)
class Areas:
    """Areas to report on (`targets`) and their attributes (`lookup`), keyed by `area`.

    `located` has every target area once, with its attributes. `broadcastable` is only true
    when both tables were counted and found under the bounds; beyond, `located` was written
    once, so that facts meet it in a single join of their own, which can split a hot area, and
    `screen` tells of most rows of other areas that they need not go there.
    """

    targets: DataFrame
    lookup: DataFrame
    located: DataFrame
    broadcastable: bool
    attributes: tuple[str, ...]
    screen: DataFrame | None = None
    words: int = 0

    def screened(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """The rows without most of those whose area is no target: a Bloom filter in words of
        64 bits, of which the area's hash picks one and four bits of it. `how="left"` keeps
        all rows and adds `may_be_target`. Where the areas can be broadcast, nothing is done."""
        if self.screen is None:
            return rows if how == "inner" else rows.withColumn("may_be_target", F.lit(True))
        bits = screen_bits("area")
        met = F.expr(f"{screen_word('area', self.words)} = screen_word AND ({bits} & screen_bits) = {bits}")
        joined = rows.join(F.broadcast(self.screen), met, how)
        if how == "left":
            joined = joined.withColumn("may_be_target", F.expr("screen_word IS NOT NULL"))
        return joined.drop("screen_word", "screen_bits")

    def sized(self, side: DataFrame) -> DataFrame:
        """The side with a broadcast hint if it was proven small, else as it is."""
        return F.broadcast(side) if self.broadcastable else side


def screen_word(area: str, words: int) -> str:
    """The word of the screen that an area has its bits in."""
    return f"pmod(xxhash64({area}), {words}L)"


def screen_bits(area: str) -> str:
    """An area's bits in its word."""
    stirred = f"xxhash64({area}, 'bits')"
    places = (f"CAST(shiftrightunsigned({stirred}, {6 * i}) & 63 AS INT)" for i in range(4))
    return "(" + " | ".join(f"shiftleft(1L, {p})" for p in places) + ")"


def screen_of(targets: DataFrame, areas: int) -> tuple[DataFrame, int]:
    """The target areas' screen, settled, and its number of words."""
    words = 1
    while words < min(SCREEN_WORDS, areas / AREAS_PER_WORD):
        words *= 2
    rows = targets.filter("area IS NOT NULL").selectExpr(
        f"{screen_word('area', words)} AS screen_word", f"{screen_bits('area')} AS screen_bits"
    )
    return settled(rows.groupBy("screen_word").agg(F.expr("bit_or(screen_bits) AS screen_bits"))), words


def checked_areas(
    targets: DataFrame,
    lookup: DataFrame,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> Areas:
    """Count both tables in one job; raise if an area occurs twice in the lookup.

    A repeated area would multiply the facts joined to it.
    """
    targets = targets.select("area")

    def weighed(side: DataFrame, title: str) -> DataFrame:
        widths = (f"coalesce(octet_length(CAST({name(c)} AS STRING)), 0)" for c in side.columns)
        return side.selectExpr(f"'{title}' AS side", "area", f"{' + '.join(widths)} AS width")

    per_area = (
        weighed(targets, "targets")
        .union(weighed(lookup, "lookup"))
        .groupBy("side", "area")
        .agg(F.expr("count(1) AS copies"), F.expr("sum(width) AS width"))
    )
    per_side = per_area.groupBy("side").agg(
        F.expr("sum(copies) AS rows"),
        F.expr("max(CASE WHEN area IS NOT NULL THEN copies END) AS copies"),
        F.expr("sum(width) AS bytes"),
    )
    sizes = {row["side"]: row for row in per_side.collect()}  # one row per side
    if "lookup" in sizes and (sizes["lookup"]["copies"] or 0) > 1:
        raise ValueError("the area lookup lists an area more than once")
    small = all(
        size["rows"] <= max_rows and size["bytes"] <= max_bytes for size in sizes.values()
    )
    attributes = tuple(c for c in lookup.columns if c != "area")
    located = targets.distinct().join(F.broadcast(lookup) if small else lookup, "area", "left")
    if small:
        return Areas(targets, lookup, located, small, attributes)
    located = settled(located)
    screen, words = screen_of(located, sizes["targets"]["rows"] if "targets" in sizes else 0)
    return Areas(targets, lookup, located, small, attributes, screen, words)
