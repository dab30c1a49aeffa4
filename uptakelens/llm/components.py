"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.llm.tables import settled

#: Links that a task works on, about.
LINKS = 1 << 13


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    around = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return around.unionAll(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.selectExpr("count(*)", "sum(pmod(xxhash64(a, b), 1000000007))").first())


def _round(links: DataFrame, tasks: int, large: bool = True) -> DataFrame:
    """Settled: the links after a large star (if asked for) and a small one. Links are few numbers;
    they are worked on in so many tasks, however many partitions a shuffle has."""
    if large:
        links = _large_star(links)
    return settled(_small_star(links.distinct().coalesce(tasks)).distinct().coalesce(tasks))


def roots(links: DataFrame) -> DataFrame:
    """Settled: every node (a) of links (a, b) that isn't the least of its component, with the least
    (b). Alternates large and small stars, which halve the depth of a component's tree each time;
    a node with very many links is one row of partial minima per task, and its links are dealt by
    both ends or meet the minima in a join that can split them. The number of links doesn't grow
    from round to round."""
    ordered = links.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").filter("a <> b")
    tasks = 1 + _state(ordered)[0] // LINKS
    links = _round(ordered, tasks, large=False)
    before, now = None, _state(links)
    while now != before:
        links = _round(links, tasks)
        before, now = now, _state(links)
    return links
