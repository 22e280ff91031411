"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before it is shuffled) and an equi-join whose hot keys the
adaptive planner can split (minima are written first, as it splits joins of plain shuffles only); no group is
gathered, and nothing but counts reaches the driver. The count of links bounds each table of a round, so small
ones are written as few files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, written


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and its neighbours."""
    both = _both(links)
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least", rows=rows)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("least")), "least", rows=rows)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def _digest(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a long, b long)``: the least node that it reaches.

    Repeated links, both directions of one link and self-links are fine; an empty table gives no rows.
    """
    now = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = _digest(now)
    while known[0]:
        rows = 2 * known[0]  # both ends of each link are the most that any table here has
        now = checkpointed(_small_star(written(_large_star(now, rows), "links", rows=rows), rows), rows)
        if (then := _digest(now)) == known:
            break
        known = then
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return packed(found, 2 * known[0])
