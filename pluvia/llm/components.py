"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a partial minimum per node and a join; neighbours are never gathered in a list, hubs' links are not
brought together, and each round's links are written to the shared folder, so that lost executors don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Nodes that may count as hubs, and the links that one has at least.
HUBS, LEAST_HUB = 100_000, 1000


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_own(rows: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """``rows`` (a, b) with the value m of their a from ``own`` (a, m, n: rows of that a).

    Rows of hubs, that is of more than ``most`` rows, find it in a broadcast table and stay where they are.
    """
    hubs = stored(own.filter(F.col("n") > most).select("a", "m"))
    if hubs.isEmpty():
        return rows.join(own.select("a", "m"), "a")
    hubs = F.broadcast(hubs)  # at most HUBS rows, by the choice of ``most``
    return rows.join(hubs, "a").unionByName(rows.join(hubs.select("a"), "a", "left_anti").join(own.select("a", "m"), "a"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint); root is the smallest node that it reaches.

    Self links and repeated links are harmless; without links there are no rows.
    """
    current = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(current)
    while before[0]:
        most = max(LEAST_HUB, 2 * before[0] // HUBS)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = _with_own(both, least, most).filter("b >= a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_own(large, low, most).select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        after = _signature(current)
        if after == before:
            break
        before = after
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
